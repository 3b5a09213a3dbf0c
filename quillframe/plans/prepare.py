"""Preparation for modelling and the fixed automatic cleaning plan."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.columns import col, dtype, is_numeric, num, numeric_cols, pick_many, resolve, text_cols, time_cols
from quillframe.operators import clean
from quillframe.operators.analysis import report
from quillframe.operators.feature import correlated_later
from quillframe.operators.stats import duplicate_count
from quillframe.operators.transform import train_test_split
from quillframe.plans.facts import column_facts
from quillframe.plans.features import Fitted, fit_encode, fit_fill, fit_outliers, fit_scale

ID_NAME = re.compile(r"(^|_)(id|key|uuid|index)$", re.IGNORECASE)


def infer_dtypes(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Text columns that mostly read as numbers or dates change type; the rate is over all rows."""
    return clean.fix_dtypes(df, threshold)


def unusable_columns(df: DataFrame, protect: str | None = None, threshold: float = 0.5) -> list[str]:
    """Constant columns, unique columns named like an id, and columns with too many nulls."""
    named = [c for c in df.columns if ID_NAME.search(c)]
    f = column_facts(df, distinct=named)
    same = clean.constant_columns(df)
    return [c for c, x in f["columns"].items() if c != protect and (
        c in same or (c in named and x["unique"] == f["rows"]) or x["null_pct"] / 100 > threshold)]


@dataclass
class PrepareConfig:
    missing: str = "auto"
    outliers: str = "iqr"
    outlier_threshold: float = 1.5
    encoding: str = "auto"
    scaling: str = "standard"
    drop_threshold: float = 0.5
    correlation: float = 0.95
    test_size: float = 0.2
    seed: int = 42


@dataclass
class Prepared:
    """``train`` and ``test`` carry the target; ``fitted`` replays the steps; ``report`` lists them."""

    train: DataFrame
    test: DataFrame | None
    target: str | None
    fitted: Fitted
    report: DataFrame
    target_labels: DataFrame | None = None


def choose_encoding(df: DataFrame, method: str, target: str | None) -> dict[str, str]:
    """auto is one-hot up to ten levels, else label."""
    facts = column_facts(df, distinct=text_cols(df))["columns"]
    return {c: ("onehot" if facts[c]["unique"] <= 10 else "label") if method == "auto" else method for c in text_cols(df) if c != target}


def prepare(df: DataFrame, target: str | None = None, mode: str = "full", config: PrepareConfig | None = None) -> Prepared:
    """cleaning: types, unusable columns, nulls, duplicates. clean adds outliers, encoding, scaling and correlated columns.
    full does the same fitted on the training part of a split."""
    if mode not in ("cleaning", "clean", "full"):
        raise ValueError("mode must be cleaning, clean or full")
    k = config or PrepareConfig()
    log: list[tuple[str, str]] = []
    out = infer_dtypes(df)
    log.append(("infer_dtypes", ", ".join(f"{c}: {dtype(out, c)}" for c in df.columns if dtype(df, c) != dtype(out, c))))
    if mode != "cleaning":
        target = resolve(out, target) if target else out.columns[-1]
    bad = unusable_columns(out, target, k.drop_threshold)
    out = out.drop(*bad)
    log.append(("drop_unusable_columns", ", ".join(bad)))
    fitted = Fitted([{"kind": "drop", "columns": bad}])
    if mode == "cleaning":
        step = fit_fill(out, default=k.missing)
        out = Fitted([step]).transform(out).dropDuplicates()
        fitted.steps.append(step)
        log.append(("fill_missing", ", ".join(sorted(step["values"]))))
        return Prepared(out, None, None, fitted, report(df, log, "step string, detail string"))
    out = out.where(col(target).isNotNull()).dropDuplicates().persist()  # every fit below reads it
    labels = None
    if not is_numeric(out, target):
        from quillframe.operators.transform import level_codes
        from quillframe.functions.levels import attach

        labels = level_codes(out, target)
        order = out.columns
        out = attach(out, labels, target).withColumn(target, F.col("_code")).select(*[col(c) for c in order])
    test = None
    if mode == "full":
        classes = column_facts(out.select(col(target)))["columns"][target]["unique"]
        split = train_test_split(out, k.test_size, k.seed, target if classes <= 20 else None)
        out, test = (split.where(F.col("_split") == s).drop("_split") for s in ("train", "test"))

    def add(step, tables=None):
        nonlocal out
        fitted.steps.append(step)
        fitted.tables.update(tables or {})
        out = Fitted([step], fitted.tables).transform(out)

    step = fit_fill(out, default=k.missing, skip=[target])
    add(step)
    log.append(("fill_missing", ", ".join(sorted(step["values"]))))
    if k.outliers != "none":
        method = {"iqr": "iqr_clip", "zscore": "zscore_clip"}[k.outliers]
        add(fit_outliers(out, {c: method for c in numeric_cols(out) if c != target}, k.outlier_threshold))
        log.append(("clip_outliers", k.outliers))
    plan = choose_encoding(out, k.encoding, target)
    add(*fit_encode(out, plan, "none", target))
    log.append(("encode_categoricals", ", ".join(f"{c}: {m}" for c, m in sorted(plan.items()))))
    rest = [c for c in [*time_cols(out), *text_cols(out)] if c != target]
    if rest:
        add({"kind": "drop", "columns": rest})
    add(fit_scale(out, k.scaling, [target]))
    log.append(("scale_features", k.scaling))
    twins = correlated_later(out, [c for c in numeric_cols(out) if c != target], k.correlation)
    add({"kind": "drop", "columns": twins})
    log.append(("drop_correlated", ", ".join(twins)))
    if test is not None:
        test = Fitted(fitted.steps[1:], fitted.tables).transform(test)
    return Prepared(out, test, target, fitted, report(df, log, "step string, detail string"), labels)


def auto_clean(df: DataFrame, threshold: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """Fixed plan: types, white space, constant columns, duplicates, mostly null columns, nulls. Returns (table, log)."""
    log = []

    def note(step, before, after):
        log.append((step, len(before.columns), len(after.columns)))
        return after

    out = note("fix_dtypes", df, clean.fix_dtypes(df))
    out = note("strip_whitespace", out, clean.strip_whitespace(out) if text_cols(out) else out)
    out = note("drop_constant", out, clean.drop_constant(out))
    out = note("remove_duplicates", out, out.dropDuplicates())
    out = note("remove_high_null_cols", out, clean.remove_high_null_cols(out, threshold))
    out = note("fill_nulls", out, clean.fill_nulls(out))
    return out, report(df, log, "step string, columns_before long, columns_after long")
