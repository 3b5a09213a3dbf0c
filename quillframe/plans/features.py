"""Feature pipeline: every step is fitted once, kept as parameters, and replayed on new rows without refitting."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.columns import col, is_numeric, is_time, num, numeric_cols, resolve_all, text_cols
from quillframe.functions.gram import moment_matrix
from quillframe.functions.levels import attach, level_stats
from quillframe.functions.ordered import reliable_checkpoint
from quillframe.functions.profile import fit as fit_row
from quillframe.functions.quantile import fit_quantiles
from quillframe.functions.scale import clip, fit_scaler, moments, quantile_bounds, sigma_bounds
from quillframe.operators.clean import filled_along, mode_values, typed
from quillframe.operators.feature import complete, correlated_later, forest_input, variances
from quillframe.operators.stats import iqr_fences, levels_of, mi_scores
from quillframe.operators.transform import level_codes
from quillframe.plans.facts import column_facts, suggest_encoding, suggest_fill
from quillframe.functions.forest import importances, is_class_target

MAX_DUMMIES = 30


@dataclass
class Fitted:
    """Ordered steps (plain parameters) and per-level tables kept as frames."""

    steps: list[dict] = field(default_factory=list)
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = _APPLY[step["kind"]](df, step, self.tables)
        return df

    def save(self, spark: SparkSession, path: str) -> None:
        """Parameters as JSON text, level tables as parquet, both through Spark."""
        spark.createDataFrame([(json.dumps({"steps": self.steps, "tables": sorted(self.tables)}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/steps")
        for i, name in enumerate(sorted(self.tables)):
            self.tables[name].write.mode("overwrite").parquet(f"{path}/table_{i}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Fitted:
        state = json.loads(spark.read.text(f"{path}/steps", wholetext=True).first()["value"])
        return Fitted(state["steps"], {name: spark.read.parquet(f"{path}/table_{i}") for i, name in enumerate(state["tables"])})


def _drop(df, step, tables):
    return df.drop(*step["columns"])


def _derive(df, step, tables):
    return df.withColumns({name: derived(df, spec) for name, spec in step["columns"].items() if all(c in df.columns for c in spec["columns"])})


def derived(df: DataFrame, spec: Mapping) -> Column:
    """date_part, ratio, interaction or log."""
    kind, c = spec["kind"], spec["columns"]
    if kind == "date_part":
        fns = {"year": F.year, "month": F.month, "day": F.dayofmonth, "weekday": F.weekday, "hour": F.hour, "quarter": F.quarter}
        return fns[spec.get("part", "year")](col(c[0]))
    if kind == "ratio":
        return num(c[0]) / F.when(num(c[1]) != 0, num(c[1]))
    if kind == "interaction":
        return num(c[0]) * num(c[1])
    if kind == "log":
        return F.log1p(F.greatest(num(c[0]), F.lit(0.0)))
    raise ValueError(f"unknown derived feature {kind!r}")


def _fill(df, step, tables):
    if step.get("drop_rows"):
        df = df.na.drop(subset=[c for c in step["drop_rows"] if c in df.columns])
    if step.get("ffill"):
        df = filled_along(df, step["ffill"], step["order_by"])
    new = {c: F.coalesce(col(c), typed(df, c, v)) for c, v in step["values"].items() if c in df.columns}
    return df.withColumns(new) if new else df


def _outlier(df, step, tables):
    for c, (lo, hi) in step["remove"].items():
        df = df.where(num(c).between(lo, hi) | num(c).isNull())
    new = {c: clip(num(c), lo, hi) for c, (lo, hi) in step["clip"].items() if c in df.columns}
    return df.withColumns(new) if new else df


def _encode(df, step, tables):
    for c, spec in step["columns"].items():
        if c not in df.columns:
            continue
        if spec["method"] == "onehot":
            df = df.withColumns({f"{c}_{v}": F.coalesce((col(c).cast("string") == F.lit(v)).cast("int"), F.lit(0)) for v in spec["levels"]}).drop(c)
        else:
            order = df.columns
            df = attach(df, tables[c], c).withColumn(c, F.coalesce(F.col("_e"), F.lit(float(spec["unknown"])))).select(*[col(x) for x in order])
    return df


def _scale(df, step, tables):
    new = {c: (num(c) - F.lit(a)) / F.lit(b or 1.0) for c, (a, b) in step["columns"].items() if c in df.columns}
    return df.withColumns(new) if new else df


def _select(df, step, tables):
    return df.select(*[col(c) for c in step["columns"] if c in df.columns])


def _reduce(df, step, tables):
    z = [(num(c) - F.lit(m)) / F.lit(s or 1.0) for c, m, s in step["inputs"]]
    new = {f"PC{k + 1}": sum((e * F.lit(w) for e, w in zip(z, v)), F.lit(0.0)) for k, v in enumerate(step["loadings"])}
    return df.withColumns(new).drop(*[c for c, _, _ in step["inputs"]])


_APPLY = {"drop": _drop, "derive": _derive, "fill": _fill, "outlier": _outlier, "encode": _encode, "scale": _scale, "select": _select, "reduce": _reduce}


def fit_drop(df: DataFrame, columns: Sequence[str]) -> dict:
    return {"kind": "drop", "columns": resolve_all(df, columns)}


def fit_derive(df: DataFrame, specs: Mapping[str, Mapping]) -> dict:
    return {"kind": "derive", "columns": {k: {**v, "columns": resolve_all(df, v["columns"])} for k, v in specs.items()}}


def fit_fill(df: DataFrame, plan: Mapping[str, str] | None = None, default: str = "auto", constants: Mapping | None = None,
             order_by: Sequence[str] = (), skip: Sequence[str] = ()) -> dict:
    """Strategies: auto, drop, mean, median, mode, ffill, constant, none. Values come from the fitted rows."""
    facts = column_facts(df, distinct=())["columns"]
    how = {}
    for c, x in facts.items():
        s = (plan or {}).get(c, default)
        if c in skip or not x["nulls"] or s == "none":
            continue
        s = suggest_fill(x) if s == "auto" else s
        how[c] = "mode" if s in ("mean", "median") and x["kind"] != "numeric" else s
    values: dict = {}
    means = [c for c, s in how.items() if s == "mean"]
    if means:
        values |= {c: m for c, (m, _) in moments(df, means).items()}
    medians = [c for c, s in how.items() if s == "median"]
    if medians:
        values |= {c: q[0] for c, q in fit_quantiles(df, medians, [0.5]).items()}
    common = [c for c, s in how.items() if s == "mode"]
    if common:
        values |= {c: v if isinstance(v, (int, float)) else str(v) for c, v in mode_values(df, common).items()}
    values |= {c: (constants or {}).get(c, 0) for c, s in how.items() if s == "constant"}
    return {"kind": "fill", "values": values, "drop_rows": [c for c, s in how.items() if s == "drop"],
            "ffill": [c for c, s in how.items() if s == "ffill"], "order_by": list(order_by)}


def fit_outliers(df: DataFrame, plan: Mapping[str, str], factor: float = 1.5) -> dict:
    """iqr_clip, zscore_clip, zscore_remove or winsorize per column."""
    out: dict = {"kind": "outlier", "clip": {}, "remove": {}}
    for method, target, bounds in (("iqr_clip", "clip", lambda c: iqr_fences(df, c, factor)), ("zscore_clip", "clip", lambda c: sigma_bounds(df, c, factor)),
                                   ("zscore_remove", "remove", lambda c: sigma_bounds(df, c, 3.0)), ("winsorize", "clip", lambda c: quantile_bounds(df, c, 0.05, 0.95))):
        cols = [c for c, m in plan.items() if m == method and is_numeric(df, c)]
        if cols:
            out[target] |= {c: list(b) for c, b in bounds(cols).items()}
    return out


def fit_encode(df: DataFrame, plan: Mapping[str, str] | None = None, default: str = "auto", target: str | None = None) -> tuple[dict, dict[str, DataFrame]]:
    """onehot, label, ordinal, frequency, target or auto; unknown levels give -1, 0 or the global mean on replay."""
    facts = column_facts(df, distinct=text_cols(df))["columns"]
    columns, tables = {}, {}
    for c in text_cols(df):
        if c == target:
            continue
        method = (plan or {}).get(c, default)
        method = suggest_encoding(facts[c]) if method == "auto" else method
        if not method or method == "none":
            continue
        if method == "onehot":
            if facts[c]["unique"] <= MAX_DUMMIES:
                columns[c] = {"method": "onehot", "levels": levels_of(df, c, MAX_DUMMIES)}
                continue
            method = "frequency"
        if method == "target" and not (target and is_numeric(df, target)):
            method = "label"
        if method in ("label", "ordinal"):
            tables[c] = level_codes(df, c).select("value", F.col("_code").cast("double").alias("_e"))
            columns[c] = {"method": method, "unknown": -1}
        elif method == "frequency":
            n = fit_row(df, n=F.count(col(c)))["n"]
            tables[c] = reliable_checkpoint(level_stats(df, c, _k=F.count(F.lit(1))).select("value", (F.col("_k") / F.lit(float(max(n, 1)))).alias("_e")))
            columns[c] = {"method": method, "unknown": 0}
        elif method == "target":
            tables[c] = reliable_checkpoint(level_stats(df, c, _e=F.avg(num(target))))
            columns[c] = {"method": method, "unknown": fit_row(df, m=F.avg(num(target)))["m"]}
        else:
            raise ValueError(f"unknown encoding {method!r}")
    return {"kind": "encode", "columns": columns}, tables


def fit_scale(df: DataFrame, method: str = "standard", skip: Sequence[str] = ()) -> dict:
    cols = [c for c in numeric_cols(df) if c not in skip]
    return {"kind": "scale", "columns": {} if method == "none" or not cols else {c: list(v) for c, v in fit_scaler(df, cols, method).items()}}


def rank_features(df: DataFrame, target: str | None, method: str = "variance", trees: int = 50, seed: int = 42) -> list[tuple[str, float]]:
    """(feature, score), best first: variance, correlation, mutual_info (by bins), neighbours (mutual information) or rfe (forest importance)."""
    feats = [c for c in numeric_cols(df) if c != target]
    if method == "variance" or target is None:
        s = {c: v or 0.0 for c, v in variances(df, feats).items()}
    elif method == "correlation":
        from quillframe.operators.analysis import with_target

        s = {x["a"]: abs(x["r"] or 0.0) for x in with_target(df, feats, target).collect()}  # one row per feature
    elif method in ("mutual_info", "neighbours"):
        how, classes = ("bins", False) if method == "mutual_info" else ("neighbours", is_class_target(df, target))
        scores = mi_scores(df, feats, target, method=how, classes=classes).collect()  # one row per feature
        s = {c: 0.0 for c in feats} | {x["feature"]: x["mi"] for x in scores}
    elif method == "rfe":
        _, names, rows, classify = forest_input(df, target)
        s = dict(zip(names, importances(rows, range(len(names)), classify, trees, 5, seed)))
    else:
        raise ValueError(f"unknown ranking {method!r}")
    return sorted(s.items(), key=lambda t: -t[1])


def fit_select(df: DataFrame, target: str | None, method: str = "variance", n: int = 10, **kw) -> dict:
    best = [c for c, _ in rank_features(df, target, method, **kw)[:n]]
    return {"kind": "select", "columns": [c for c in df.columns if c in best or c == target or not is_numeric(df, c)]}


def fit_reduce(df: DataFrame, n: int = 2, skip: Sequence[str] = ()) -> dict:
    cols = [c for c in numeric_cols(df) if c not in skip]
    rows = df.where(complete(cols))
    m = moments(rows, cols, F.stddev_pop)
    gram, count = moment_matrix(rows, [(num(c) - F.lit(m[c][0])) / F.lit(m[c][1] or 1.0) for c in cols], intercept=False)
    values, vectors = np.linalg.eigh(gram / max(count, 1))
    loadings = []
    for k in range(min(n, len(cols))):
        v = vectors[:, -1 - k]
        loadings.append([float(w) for w in v * (1 if v[np.argmax(np.abs(v))] >= 0 else -1)])
    return {"kind": "reduce", "inputs": [[c, float(m[c][0]), float(m[c][1] or 1.0)] for c in cols], "loadings": loadings}


@dataclass
class FeatureConfig:
    target: str | None = None
    drop: Sequence[str] = ()
    derive: Mapping[str, Mapping] = field(default_factory=dict)
    fill: Mapping[str, str] = field(default_factory=dict)
    fill_default: str = "auto"
    constants: Mapping = field(default_factory=dict)
    outliers: Mapping[str, str] = field(default_factory=dict)
    encode: Mapping[str, str] = field(default_factory=dict)
    encode_default: str = "auto"
    scale: str = "none"
    select: str | None = None
    top_n: int = 10
    components: int = 0
    order_by: Sequence[str] = ()


def fit_pipeline(df: DataFrame, config: FeatureConfig) -> Fitted:
    """Fit drop, derive, fill, outliers, encode, scale, select and reduce in this order."""
    out = Fitted()
    keep = [config.target] if config.target else []
    current = df

    def add(step, tables=None):
        nonlocal current
        out.steps.append(step)
        out.tables.update(tables or {})
        current = _APPLY[step["kind"]](current, step, out.tables)

    if config.drop:
        add(fit_drop(current, config.drop))
    if config.derive:
        add(fit_derive(current, config.derive))
    add(fit_fill(current, config.fill, config.fill_default, config.constants, config.order_by, keep))
    if config.outliers:
        add(fit_outliers(current, config.outliers))
    step, tables = fit_encode(current, config.encode, config.encode_default, config.target)
    add(step, tables)
    rest = [c for c in current.columns if c not in keep and (c in text_cols(current) or is_time(current, c))]
    if rest:
        add(fit_drop(current, rest))
    if config.scale != "none":
        add(fit_scale(current, config.scale, keep))
    if config.select:
        add(fit_select(current, config.target, config.select, config.top_n))
    if config.components:
        add(fit_reduce(current, config.components, keep))
    return out


def auto_features(df: DataFrame, target: str, var_limit: float = 0.01, corr_limit: float = 0.95, skew_limit: float = 1.5, top: int = 25) -> Fitted:
    """Drop low variance and correlated columns, log skewed ones, keep the best by mutual information above 30 features."""
    feats = [c for c in numeric_cols(df) if c != target]
    low = [c for c, v in variances(df, feats).items() if v is not None and v < var_limit]
    feats = [c for c in feats if c not in low]
    twin = correlated_later(df, feats, corr_limit)
    feats = [c for c in feats if c not in twin]
    facts = column_facts(df.select(*[col(c) for c in feats]), distinct=())["columns"] if feats else {}
    logs = {f"{c}_log": {"kind": "log", "columns": [c]} for c, x in facts.items() if x["skew"] is not None and abs(x["skew"]) > skew_limit and x["min"] >= 0}
    out = Fitted([{"kind": "drop", "columns": [*low, *twin]}])
    if logs:
        out.steps += [{"kind": "derive", "columns": logs}, {"kind": "drop", "columns": [s["columns"][0] for s in logs.values()]}]
    if len(feats) > 30:
        out.steps.append(fit_select(out.transform(df), target, "mutual_info", top))
    return out
