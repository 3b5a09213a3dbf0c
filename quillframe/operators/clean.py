"""Repair: nulls, duplicates, outliers, types, text hygiene, class balance."""

from __future__ import annotations

import html
import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.columns import (col, is_numeric, is_time, num, numeric_cols, pick, pick_many, resolve, resolve_all,
                                text_cols)
from quillframe.functions.dates import java_pattern, parse
from quillframe.functions.freq import freq_long, modes, value_counts
from quillframe.functions.levels import attach, oversample, undersample
from quillframe.functions.ordered import index_rows, reliable_checkpoint
from quillframe.functions.profile import fit, nulls, skew_g1
from quillframe.functions.quantile import fit_quantiles, quantiles
from quillframe.functions.scale import clip_columns, quantile_bounds, replace_columns, sigma_bounds
from quillframe.functions.space import nearest
from quillframe.functions.tokens import rewritten
from quillframe.operators.stats import iqr_fences, label_column
from quillframe.registry import operator

# Words read as true or false.
TRUE_WORDS = ("yes", "y", "true", "t", "1", "1.0", "si", "on")
FALSE_WORDS = ("no", "n", "false", "f", "0", "0.0", "off")
PLAIN_TRUE = ("true", "yes", "1", "t", "y")
PLAIN_FALSE = ("false", "no", "0", "f", "n")
CURRENCY = "$€£¥₹₩₫฿"
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
URL = r"https?://\S+|www\.\S+"
# Wrongly decoded sequences and their repair, applied in this order.
MOJIBAKE = (
    ("\xc3\xa2\xe2\x82\xac\xe2\x84\xa2", "'"), ("\xc3\xa2\xe2\x82\xac\xcb\x9c", "'"),
    ("\xc3\xa2\xe2\x82\xac\xc5\x93", '"'), ("\xc3\xa2\xe2\x82\xac\xc2\x9d", '"'),
    ("\xc3\xa2\xe2\x82\xac\xe2\x80\x9c", "—"), ("\xc3\xa2\xe2\x82\xac\xe2\x80\x9d", "–"),
    ("\xc3\xa2\xe2\x82\xac\xc2\xa6", "…"), ("\xc3\x83\xc2\xa9", "é"), ("\xc3\x83\xc2\xa8", "è"),
    ("\xc3\x83\xc2\xbc", "ü"), ("\xc3\x83\xc2\xb6", "ö"), ("\xc3\x83\xc2\xa4", "ä"),
    ("\xc3\x83\xc2\xb1", "ñ"), ("\xc2\xc2", ""), ("\x00", ""),
)
ID_NAMES = ("id", "index", "idx", "key", "row", "num", "number", "seq", "serial")


def null_shares(df: DataFrame) -> dict[str, float]:
    s = fit(df, n=F.count(F.lit(1)), **{f"c{i}": nulls(col(c)) for i, c in enumerate(df.columns)})
    return {c: s[f"c{i}"] / s["n"] if s["n"] else 0.0 for i, c in enumerate(df.columns)}


def mode_values(df: DataFrame, cols: Sequence[str]) -> dict:
    """Most frequent value of each column, smallest on a tie; one row per column comes to the driver."""
    rows = modes(freq_long(df, cols)).collect()
    return {x["column"]: x["mode_num"] if x["mode_num"] is not None else x["mode"] for x in rows}


def typed(df: DataFrame, name: str, value) -> Column:
    return F.lit(value).cast(df.schema[name].dataType)


def fill_values(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(col(c), typed(df, c, v)) for c, v in values.items()}) if values else df


@operator("clean.drop_nulls")
def drop_nulls(df: DataFrame, column: str | None = None, threshold: float = 0.5) -> DataFrame:
    if column is not None:
        return df.where(col(resolve(df, column)).isNotNull())
    bad = [c for c, s in null_shares(df).items() if s > threshold]
    return df.drop(*bad).na.drop()


@operator("clean.fill_nulls")
def fill_nulls(df: DataFrame, column: str | None = None, strategy: str = "auto") -> DataFrame:
    return fill_values(df, fit_fill(df, pick_many(df, column, "any"), strategy))


def fit_fill(df: DataFrame, cols: Sequence[str], strategy: str = "auto") -> dict:
    """Fill value per column that has nulls."""
    shares = null_shares(df.select(*[col(c) for c in cols]))
    cols = [c for c in cols if shares[c] > 0]
    nums = [c for c in cols if is_numeric(df, c)]
    how = dict.fromkeys(nums, strategy)
    if strategy == "auto" and nums:
        s = fit(df, **{f"s{i}": skew_g1(num(c)) for i, c in enumerate(nums)})
        how = {c: "median" if s[f"s{i}"] is not None and abs(s[f"s{i}"]) > 1 else "mean" for i, c in enumerate(nums)}
    out: dict = {}
    means = [c for c in nums if how[c] == "mean"]
    if means:
        s = fit(df, **{f"m{i}": F.avg(num(c)) for i, c in enumerate(means)})
        out |= {c: s[f"m{i}"] for i, c in enumerate(means) if s[f"m{i}"] is not None}
    out |= {c: 0 for c in nums if how[c] == "zero"}
    medians = [c for c in nums if how[c] not in ("mean", "zero")]
    if medians:
        out |= {c: q[0] for c, q in fit_quantiles(df, medians, [0.5]).items()}
    others = [c for c in cols if c not in nums]
    if others:
        m = mode_values(df, others)
        out |= {c: m.get(c, "Unknown" if c in text_cols(df) else None) for c in others}
    return out


@operator("clean.fill_with_value")
def fill_with_value(df: DataFrame, column: str | None = None, value=0) -> DataFrame:
    cols = pick_many(df, column, "any")
    fits = [c for c in cols if isinstance(value, str) == (c in text_cols(df)) and not is_time(df, c)] if column is None else cols
    return fill_values(df, dict.fromkeys(fits, value))


@operator("clean.fill_mode")
def fill_mode(df: DataFrame, column: str | None = None) -> DataFrame:
    cols = pick_many(df, column, "any")
    shares = null_shares(df.select(*[col(c) for c in cols]))
    need = [c for c in cols if shares[c] > 0]
    return fill_values(df, mode_values(df, need)) if need else df


@operator("clean.fill_median_by_group")
def fill_median_by_group(df: DataFrame, group_column: str | None = None, column: str | None = None,
                         value_column: str | None = None) -> DataFrame:
    g = resolve(df, group_column or column)
    cols = [resolve(df, value_column)] if value_column else [c for c in numeric_cols(df) if c != g]
    q = quantiles(df.where(col(g).isNotNull()), cols, [0.5], [g])
    wide = q.groupBy(col(g).alias("value")).agg(
        *[F.max(F.when(F.col("column") == c, F.col("q0"))).alias(f"_m{i}") for i, c in enumerate(cols)])
    out = attach(df, wide, g)
    return out.withColumns({c: F.coalesce(num(c), F.col(f"_m{i}")) for i, c in enumerate(cols)}).drop(
        *[f"_m{i}" for i in range(len(cols))])


def filled_along(df: DataFrame, cols: Sequence[str], order_by, partition_by=None, forward=True, backward=False):
    """Carry the previous (and then the next) value into nulls, in row order."""
    ix = index_rows(df, order_by, partition_by).running(
        lasts={f"_f{i}": col(c) for i, c in enumerate(cols)} if forward else None,
        nexts={f"_b{i}": col(c) for i, c in enumerate(cols)} if backward else None)
    both = {c: F.coalesce(*([F.col(f"_f{i}")] if forward else []), *([F.col(f"_b{i}")] if backward else []))
            for i, c in enumerate(cols)}
    return ix.result().withColumns(both).select(*[col(c) for c in df.columns])


@operator("clean.fill_forward_backward")
def fill_forward_backward(df: DataFrame, column: str | None = None, order_by: Sequence[str] = (),
                          partition_by=None) -> DataFrame:
    return filled_along(df, pick_many(df, column, "any"), order_by, partition_by, True, True)


def interpolated(df: DataFrame, cols: Sequence[str], order_by, partition_by=None) -> DataFrame:
    """Linear in the row position between known values; after the last known value it stays."""
    ix = index_rows(df, order_by, partition_by)
    known = {c: F.when(col(c).isNotNull(), F.struct(F.col("_idx").alias("i"), num(c).alias("x"))) for c in cols}
    ix = ix.running(lasts={f"_f{i}": known[c] for i, c in enumerate(cols)},
                    nexts={f"_b{i}": known[c] for i, c in enumerate(cols)})
    new = {}
    for i, c in enumerate(cols):
        f, b = F.col(f"_f{i}"), F.col(f"_b{i}")
        span = (b["i"] - f["i"]).cast("double")
        line = f["x"] + (b["x"] - f["x"]) * (F.col("_idx") - f["i"]) / F.when(span > 0, span)
        new[c] = F.when(col(c).isNotNull(), num(c)).when(f.isNull(), None).when(b.isNull(), f["x"]).otherwise(line)
    return ix.df.withColumns(new).select(*[col(c) for c in df.columns])


@operator("clean.fill_interpolate")
def fill_interpolate(df: DataFrame, method: str = "linear", column: str | None = None,
                     order_by: Sequence[str] = (), partition_by=None) -> DataFrame:
    if method in ("ffill", "bfill"):
        return filled_along(df, pick_many(df, column, "any"), order_by, partition_by, method == "ffill", method == "bfill")
    return interpolated(df, pick_many(df, column, "numeric"), order_by, partition_by)


@operator("clean.fill_with_distribution")
def fill_with_distribution(df: DataFrame, column: str | None = None, seed: int = 42,
                           key: Sequence[str] | None = None) -> DataFrame:
    """Nulls take an observed value, drawn evenly by a seeded hash of the row."""
    cols = pick_many(df, column, "any")
    shares = null_shares(df.select(*[col(c) for c in cols]))
    out = df
    for c in (c for c in cols if 0 < shares[c] < 1):
        values = df.where(col(c).isNotNull()).select(col(c).alias("_v"))
        ix = index_rows(values, ["_v"])
        draw = F.pmod(F.xxhash64(F.lit(seed), F.lit(c), *[col(k) for k in (key or df.columns)]), F.lit(ix.rows))
        known = out.where(col(c).isNotNull())
        missing = out.where(col(c).isNull()).withColumn("_draw", draw).join(
            ix.df, F.col("_draw") == F.col("_idx"), "left").withColumn(c, F.col("_v")).drop("_draw", "_idx", "_v")
        out = known.unionByName(missing)
    return out


@operator("clean.coalesce_columns")
def coalesce_columns(df: DataFrame, columns: Sequence[str] = (), new_name: str = "coalesced") -> DataFrame:
    if len(columns) < 2:
        raise ValueError("at least two columns are needed")
    return df.withColumn(new_name, F.coalesce(*[col(c) for c in resolve_all(df, columns)]))


@operator("clean.remove_duplicates")
def remove_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def keep_one(df: DataFrame, keys: Sequence[str], order: Column, last: bool = False) -> DataFrame:
    """One row per key: smallest (or largest) order value. Partial aggregation keeps one candidate per key and task."""
    pick_row = (F.max_by if last else F.min_by)(F.struct(*[col(c) for c in df.columns]), order)
    return df.groupBy(*[col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(pick_row.alias("_row")).select("_row.*")


def row_order(df: DataFrame, order_by: Sequence[str]) -> Column:
    """A total order: the order columns, then every other column."""
    names = [order_by] if isinstance(order_by, str) else list(order_by)
    if not names:
        raise ValueError("order_by is required: Spark rows have no order of their own")
    rest = [c for c in df.columns if c not in names]
    return F.struct(*[col(c) for c in resolve_all(df, names)], *[col(c) for c in rest])


@operator("clean.deduplicate_by")
def deduplicate_by(df: DataFrame, columns: Sequence[str] = (), column: str | None = None, keep: str = "first",
                   order_by: Sequence[str] = ()) -> DataFrame:
    keys = resolve_all(df, columns) if columns else ([resolve(df, column)] if column else [])
    if not keys:
        return df.dropDuplicates()
    return keep_one(df, keys, row_order(df, order_by), keep == "last")


@operator("clean.dedup_keep_latest")
def dedup_keep_latest(df: DataFrame, column: str | None = None, key_column: str | None = None,
                      date_column: str | None = None, sort_column: str | None = None) -> DataFrame:
    """Latest row per key; among equal dates the largest remaining columns win."""
    return keep_one(df, [resolve(df, key_column or column)], row_order(df, [resolve(df, date_column or sort_column)]), True)


@operator("clean.remove_empty_rows")
def remove_empty_rows(df: DataFrame) -> DataFrame:
    blank = [(F.trim(col(c)) == "") | col(c).isNull() if c in text_cols(df) else col(c).isNull() for c in df.columns]
    return df.where(~reduce(lambda a, b: a & b, blank))


@operator("clean.remove_zero_rows")
def remove_zero_rows(df: DataFrame, column: str | None = None) -> DataFrame:
    zero = [F.coalesce(col(c) == 0, F.lit(False)) for c in pick_many(df, column)]
    return df.where(~reduce(lambda a, b: a & b, zero))


@operator("clean.remove_negative")
def remove_negative(df: DataFrame, column: str | None = None) -> DataFrame:
    low = [F.coalesce(col(c) < 0, F.lit(False)) for c in pick_many(df, column)]
    return df.where(~reduce(lambda a, b: a | b, low))


def outlier_bounds(df: DataFrame, cols: Sequence[str], method: str) -> dict[str, tuple[float, float]]:
    if method == "iqr":
        return iqr_fences(df, cols)
    if method == "zscore":
        return sigma_bounds(df, cols)
    raise ValueError(f"unknown method {method!r}: use iqr or zscore")


@operator("clean.remove_outliers")
def remove_outliers(df: DataFrame, method: str = "iqr", column: str | None = None) -> DataFrame:
    """Rows with a null in a checked column are dropped too, as a comparison with null is not true."""
    b = outlier_bounds(df, pick_many(df, column), method)
    return df.where(reduce(lambda x, y: x & y, [num(c).between(lo, hi) for c, (lo, hi) in b.items()], F.lit(True)))


@operator("clean.clip_outliers")
def clip_outliers(df: DataFrame, method: str = "iqr", column: str | None = None) -> DataFrame:
    return clip_columns(df, outlier_bounds(df, pick_many(df, column), method))


@operator("clean.cap_outliers_percentile")
def cap_outliers_percentile(df: DataFrame, column: str | None = None, lower: float = 1, upper: float = 99) -> DataFrame:
    return clip_columns(df, quantile_bounds(df, pick_many(df, column), lower / 100, upper / 100))


@operator("clean.drop_column")
def drop_column(df: DataFrame, columns: Sequence[str] = (), column: str | None = None) -> DataFrame:
    names = list(columns) or ([column] if column else [])
    if not names:
        raise ValueError("name a column to drop")
    return df.drop(*resolve_all(df, names))


def constant_columns(df: DataFrame) -> list[str]:
    """Columns with at most one value; null counts as a value."""
    s = fit(df, **{f"a{i}": F.min(col(c)) for i, c in enumerate(df.columns)},
            **{f"b{i}": F.max(col(c)) for i, c in enumerate(df.columns)},
            **{f"n{i}": nulls(col(c)) for i, c in enumerate(df.columns)})
    return [c for i, c in enumerate(df.columns)
            if s[f"a{i}"] is None or (s[f"a{i}"] == s[f"b{i}"] and s[f"n{i}"] == 0)]


@operator("clean.drop_constant")
def drop_constant(df: DataFrame) -> DataFrame:
    return df.drop(*constant_columns(df))


def has_id_name(name: str) -> bool:
    low = name.lower().strip("_")
    return low in ID_NAMES or (low.endswith("id") and len(low) <= 6) or low == "unnamed: 0"


@operator("clean.drop_id_columns")
def drop_id_columns(df: DataFrame) -> DataFrame:
    """ID-like by name, or more than 95% distinct numbers of which more than 95% follow at one step."""
    out = [c for c in df.columns if has_id_name(c)]
    nums = [c for c in numeric_cols(df) if c not in out]
    if nums:
        s = fit(df, n=F.count(F.lit(1)), **{f"u{i}": F.count_distinct(col(c)) for i, c in enumerate(nums)})
        for i, c in enumerate(nums):
            if s["n"] and s[f"u{i}"] / s["n"] > 0.95:
                values = df.where(col(c).isNotNull()).select(num(c).alias("v"))
                step = index_rows(values, ["v"]).windowed(
                    lambda w: {"d": F.col("v") - F.lag("v").over(w)}, before=1).df.where(F.col("d").isNotNull())
                first = step.agg(F.min_by("d", "_idx").alias("f")).first()["f"]
                if first is not None and fit(step, s=F.avg((F.col("d") == F.lit(first)).cast("int")))["s"] > 0.95:
                    out.append(c)
    return df.drop(*out)


@operator("clean.remove_high_null_cols")
def remove_high_null_cols(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    return df.drop(*[c for c, s in null_shares(df).items() if s > threshold])


@operator("clean.rename_column")
def rename_column(df: DataFrame, column: str, new_name: str | None = None, value: str | None = None) -> DataFrame:
    name = new_name or value
    if not name:
        raise ValueError("new_name is required")
    return df.withColumnRenamed(resolve(df, column), str(name))


def snake_case(name: str) -> str:
    parts = re.sub("([a-z])([A-Z])", r"\1_\2", name)
    return re.sub("_+", "_", re.sub("[^A-Za-z0-9]", "_", parts)).strip("_").lower()


@operator("clean.lowercase_columns")
def lowercase_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[snake_case(c) for c in df.columns])


@operator("clean.clean_column_names")
def clean_column_names(df: DataFrame) -> DataFrame:
    return lowercase_columns(df)


def cast_to(df: DataFrame, name: str, dtype: str) -> Column:
    c = col(name)
    if dtype in ("datetime", "date"):
        return c if is_time(df, name) else parse(c.cast("string"))
    if dtype in ("int", "integer", "int64"):
        return c.try_cast("double").try_cast("bigint")
    if dtype in ("float", "numeric", "float64"):
        return c.try_cast("double")
    if dtype in ("bool", "boolean"):
        if is_numeric(df, name):
            return c != 0
        return c if isinstance(df.schema[name].dataType, T.BooleanType) else c != ""
    if dtype in ("str", "string", "object", "category"):
        return c.cast("string")
    raise ValueError(f"unknown dtype {dtype!r}")


@operator("clean.change_dtype")
def change_dtype(df: DataFrame, column: str, dtype: str = "str") -> DataFrame:
    name = resolve(df, column)
    meta = {"category": True} if dtype == "category" else None
    return df.withColumn(name, cast_to(df, name, dtype).alias(name, metadata=meta) if meta else cast_to(df, name, dtype))


def parse_rates(df: DataFrame, cols: Sequence[str]) -> dict[str, dict]:
    """Share of non-null texts that read as number, whole number, flag or date: all rows, one pass."""
    aggs = {}
    for i, c in enumerate(cols):
        x, t = col(c), col(c).try_cast("double")
        aggs |= {f"n{i}": F.count(x), f"num{i}": F.count(t),
                 f"whole{i}": F.coalesce(F.bool_and(F.when(t.isNotNull(), t == F.floor(t))), F.lit(False)),
                 f"flag{i}": F.coalesce(F.bool_and(F.lower(x).isin(*PLAIN_TRUE, *PLAIN_FALSE)), F.lit(False)),
                 f"date{i}": F.count(parse(x))}
    s = fit(df, **aggs)
    return {c: {"n": s[f"n{i}"], "number": s[f"num{i}"] / max(s[f"n{i}"], 1), "whole": s[f"whole{i}"],
                "flag": s[f"flag{i}"], "date": s[f"date{i}"] / max(s[f"n{i}"], 1)} for i, c in enumerate(cols)}


@operator("clean.fix_dtypes")
def fix_dtypes(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    cols = text_cols(df)
    rates = parse_rates(df, cols) if cols else {}
    new = {}
    for c in cols:
        if rates[c]["n"] and rates[c]["number"] >= threshold:
            new[c] = col(c).try_cast("double")
        elif rates[c]["n"] and rates[c]["date"] >= threshold:
            new[c] = parse(col(c))
    return df.withColumns(new) if new else df


@operator("clean.auto_dtype_infer")
def auto_dtype_infer(df: DataFrame) -> DataFrame:
    cols = text_cols(df)
    if not cols:
        return df
    rates = parse_rates(df, cols)
    s = fit(df, n=F.count(F.lit(1)), **{f"u{i}": F.count_distinct(col(c)) for i, c in enumerate(cols)},
            **{f"l{i}": F.count_distinct(F.lower(col(c))) for i, c in enumerate(cols)})
    new = {}
    for i, c in enumerate(cols):
        k = rates[c]
        if not k["n"]:
            continue
        if k["number"] >= 0.8:
            new[c] = col(c).try_cast("double").try_cast("bigint") if k["whole"] else col(c).try_cast("double")
        elif k["flag"] and s[f"l{i}"] <= 3:
            new[c] = F.when(F.lower(col(c)).isin(*PLAIN_TRUE), True).when(F.lower(col(c)).isin(*PLAIN_FALSE), False)
        elif k["date"] >= 0.7:
            new[c] = parse(col(c))
        elif s[f"u{i}"] < s["n"] * 0.05:
            new[c] = col(c).alias(c, metadata={"category": True})
    return df.withColumns(new) if new else df


@operator("clean.fix_numeric_strings")
def fix_numeric_strings(df: DataFrame, column: str | None = None) -> DataFrame:
    cols = pick_many(df, column, "text")
    bare = {c: F.regexp_replace(col(c).cast("string"), r"[^\d.,\-]", "") for c in cols}
    us = {c: F.regexp_replace(bare[c], ",", "").try_cast("double") for c in cols}
    eu = {c: F.regexp_replace(F.regexp_replace(bare[c], r"\.", ""), ",", ".").try_cast("double") for c in cols}
    s = fit(df, **{f"e{i}": F.bool_or(bare[c].rlike(r"\d\.\d{3},")) for i, c in enumerate(cols)},
            **{f"n{i}": F.count(col(c)) for i, c in enumerate(cols)},
            **{f"us{i}": F.count(us[c]) for i, c in enumerate(cols)}, **{f"eu{i}": F.count(eu[c]) for i, c in enumerate(cols)})
    new = {}
    for i, c in enumerate(cols):
        good = s[f"eu{i}"] if s[f"e{i}"] else s[f"us{i}"]
        if s[f"n{i}"] and good / s[f"n{i}"] >= 0.6:
            new[c] = eu[c] if s[f"e{i}"] else us[c]
    return df.withColumns(new) if new else df


@operator("clean.clean_currency")
def clean_currency(df: DataFrame, column: str | None = None) -> DataFrame:
    cols = pick_many(df, column, "text")
    new = {c: F.regexp_replace(col(c).cast("string"), rf"[{CURRENCY},\s]", "").try_cast("double") for c in cols}
    s = fit(df, n=F.count(F.lit(1)), **{f"h{i}": F.bool_or(col(c).cast("string").rlike(f"[{CURRENCY}]")) for i, c in enumerate(cols)},
            **{f"k{i}": F.count(new[c]) for i, c in enumerate(cols)})
    keep = {c: new[c] for i, c in enumerate(cols) if s[f"h{i}"] and s[f"k{i}"] / s["n"] >= 0.5}
    return df.withColumns(keep) if keep else df


@operator("clean.fix_boolean")
def fix_boolean(df: DataFrame, column: str | None = None) -> DataFrame:
    cols = pick_many(df, column, "text")
    word = {c: F.lower(F.trim(col(c).cast("string"))) for c in cols}
    s = fit(df, **{f"a{i}": F.bool_and(word[c].isin(*TRUE_WORDS, *FALSE_WORDS)) for i, c in enumerate(cols)})
    new = {c: F.when(word[c].isin(*TRUE_WORDS), True).when(word[c].isin(*FALSE_WORDS), False)
           for i, c in enumerate(cols) if s[f"a{i}"]}
    return df.withColumns(new) if new else df


@operator("clean.fix_mixed_types")
def fix_mixed_types(df: DataFrame, column: str | None = None, threshold: float = 0.7) -> DataFrame:
    """A text column with both numbers and other text becomes numeric when enough rows parse."""
    cols = [c for c in pick_many(df, column, "text") if c in text_cols(df)]
    s = fit(df, n=F.count(F.lit(1)), **{f"k{i}": F.count(col(c).try_cast("double")) for i, c in enumerate(cols)})
    new = {c: col(c).try_cast("double") for i, c in enumerate(cols) if s["n"] and s[f"k{i}"] / s["n"] >= threshold}
    return df.withColumns(new) if new else df


@operator("clean.standardize_dates")
def standardize_dates(df: DataFrame, column: str | None = None, format: str = "%Y-%m-%d",
                      threshold: float = 0.7) -> DataFrame:
    cols = [resolve(df, column)] if column else text_cols(df)
    stamp = {c: col(c) if is_time(df, c) else parse(col(c)) for c in cols}
    s = fit(df, **{f"n{i}": F.count(col(c)) for i, c in enumerate(cols)},
            **{f"k{i}": F.count(stamp[c]) for i, c in enumerate(cols)})
    new = {c: F.date_format(stamp[c], java_pattern(format)) for i, c in enumerate(cols)
           if s[f"n{i}"] and s[f"k{i}"] / s[f"n{i}"] >= threshold}
    return df.withColumns(new) if new else df


@operator("clean.fix_date_outliers")
def fix_date_outliers(df: DataFrame, column: str, min_date: str = "1900-01-01", max_date: str = "2099-12-31",
                      action: str = "remove") -> DataFrame:
    c = resolve(df, column)
    if not is_time(df, c):
        df = df.withColumn(c, parse(col(c)))
    kind = df.schema[c].dataType
    lo, hi = F.lit(min_date).cast(kind), F.lit(max_date).cast(kind)
    if action == "clip":
        return df.withColumn(c, F.when(col(c) < lo, lo).when(col(c) > hi, hi).otherwise(col(c)))
    return df.where(col(c).between(lo, hi) | col(c).isNull())


def on_text(df: DataFrame, column, fn) -> DataFrame:
    return replace_columns(df, pick_many(df, column, "text"), lambda c: fn(c.cast("string")))


SPACE = r"(?U)\s+"


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


@operator("clean.strip_whitespace")
def strip_whitespace(df: DataFrame) -> DataFrame:
    return on_text(df, None, strip)


@operator("clean.clean_text_whitespace")
def clean_text_whitespace(df: DataFrame, column: str | None = None) -> DataFrame:
    return on_text(df, column, lambda c: strip(F.regexp_replace(F.regexp_replace(c, r"[\t\n\r]+", " "), r"(?U)\s{2,}", " ")))


@operator("clean.fix_whitespace_names")
def fix_whitespace_names(df: DataFrame, column: str | None = None) -> DataFrame:
    return on_text(df, column, lambda c: F.regexp_replace(strip(c), SPACE, " "))


@operator("clean.lowercase_values")
def lowercase_values(df: DataFrame, column: str | None = None) -> DataFrame:
    return on_text(df, column, F.lower)


def title_case(c: Column) -> Column:
    """Capital after every non-letter: letter runs are capitalised one by one."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, sentence_case), "")


def sentence_case(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


@operator("clean.normalize_text_case")
def normalize_text_case(df: DataFrame, column: str | None = None, case: str = "lower") -> DataFrame:
    forms = {"upper": F.upper, "title": title_case, "sentence": sentence_case, "lower": F.lower}
    return on_text(df, column, forms.get(case, F.lower))


def unescape(c: Column) -> Column:
    """HTML entities to characters; rows without an ampersand never leave the JVM."""
    return rewritten(c, c.contains("&"), html.unescape)


@operator("clean.remove_html_tags")
def remove_html_tags(df: DataFrame, column: str | None = None) -> DataFrame:
    return on_text(df, column, lambda c: unescape(F.regexp_replace(c, r"<[^>]+>", "")))


@operator("clean.remove_urls")
def remove_urls(df: DataFrame, column: str | None = None) -> DataFrame:
    return on_text(df, column, lambda c: strip(F.regexp_replace(c, "(?U)" + URL, "")))


@operator("clean.remove_emails")
def remove_emails(df: DataFrame, column: str | None = None) -> DataFrame:
    return on_text(df, column, lambda c: strip(F.regexp_replace(c, EMAIL, "")))


@operator("clean.remove_non_ascii")
def remove_non_ascii(df: DataFrame, column: str | None = None) -> DataFrame:
    return on_text(df, column, lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", ""))


@operator("clean.remove_special_chars")
def remove_special_chars(df: DataFrame, column: str | None = None, pattern: str = r"[^\w\s]") -> DataFrame:
    return on_text(df, column, lambda c: strip(F.regexp_replace(c, "(?U)" + pattern, "")))


@operator("clean.fix_encoding")
def fix_encoding(df: DataFrame, column: str | None = None) -> DataFrame:
    return on_text(df, column, lambda c: reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), MOJIBAKE, c))


@operator("clean.clean_phone_numbers")
def clean_phone_numbers(df: DataFrame, column: str) -> DataFrame:
    c = resolve(df, column)
    return df.withColumn(c, F.trim(F.regexp_replace(col(c).cast("string"), r"[^\d+]", ""), F.lit("+")))


@operator("clean.split_name")
def split_name(df: DataFrame, column: str) -> DataFrame:
    parts = F.split(strip(col(resolve(df, column)).cast("string")), SPACE, 2)
    return df.withColumns({"first_name": F.get(parts, 0), "last_name": F.get(parts, 1)})


@operator("clean.replace_values")
def replace_values(df: DataFrame, column: str | None = None, old_value="?", new_value=None) -> DataFrame:
    cols = pick_many(df, column, "any")
    if column is None:
        cols = [c for c in cols if isinstance(old_value, str) == (c in text_cols(df)) and not is_time(df, c)]
    return df.withColumns({c: F.when(col(c) == F.lit(old_value), typed(df, c, new_value)).otherwise(col(c)) for c in cols})


def mapped(c: Column, mapping: Mapping) -> Column:
    """Value mapping held as one literal map; values without an entry stay."""
    pairs = [F.lit(x) for k, v in mapping.items() for x in (str(k), None if v is None else str(v))]
    table = F.create_map(*pairs)
    key = c.cast("string")
    return F.when(F.map_contains_key(table, F.coalesce(key, F.lit("\0"))), table[key]).otherwise(key)


@operator("clean.map_values")
def map_values(df: DataFrame, column: str, mapping: Mapping) -> DataFrame:
    if not mapping:
        raise ValueError("mapping is required")
    c = resolve(df, column)
    out = mapped(col(c), mapping)
    same = all(isinstance(v, (int, float)) for v in mapping.values()) and is_numeric(df, c)
    return df.withColumn(c, out.cast("double") if same else out)


@operator("clean.standardize_categories")
def standardize_categories(df: DataFrame, column: str, mapping: Mapping | None = None) -> DataFrame:
    c = resolve(df, column)
    low = F.lower(strip(col(c).cast("string")))
    return df.withColumn(c, mapped(low, mapping) if mapping else low)


def rare_to_other(df: DataFrame, name: str, min_count: int, replacement: str, out: str) -> DataFrame:
    counts = value_counts(df, name).withColumnRenamed("count", "_count")
    return attach(df, counts, name).withColumn(
        out, F.when(F.col("_count") < min_count, F.lit(replacement)).otherwise(col(name).cast("string"))).drop("_count")


@operator("clean.remove_rare_categories")
def remove_rare_categories(df: DataFrame, column: str, min_count: int = 5, replacement: str = "Other") -> DataFrame:
    c = resolve(df, column)
    return rare_to_other(df, c, min_count, replacement, c).select(*[col(x) for x in df.columns])


@operator("clean.anonymize_column")
def anonymize_column(df: DataFrame, column: str, method: str = "hash") -> DataFrame:
    c = resolve(df, column)
    s = col(c).cast("string")
    if method == "hash":
        out = F.when(s == "", s).otherwise(F.substring(F.sha2(s, 256), 1, 12))
    elif method == "mask":
        n = F.length(s)
        out = F.when(n <= 2, "**").otherwise(F.concat(F.substring(s, 1, 1), F.repeat(F.lit("*"), n - 2), F.right(s, F.lit(1))))
    else:
        out = F.lit("[REDACTED]")
    return df.withColumn(c, out)


def flat_fields(schema: T.StructType, path: str, prefix: str) -> list[Column]:
    out = []
    for f in schema.fields:
        here = f"{path}.`{f.name}`"
        if isinstance(f.dataType, T.StructType):
            out += flat_fields(f.dataType, here, f"{prefix}{f.name}.")
        else:
            out.append(F.col(here).alias(f"{prefix}{f.name}"))
    return out


@operator("clean.parse_json_column")
def parse_json_column(df: DataFrame, column: str, schema: str | None = None) -> DataFrame:
    """Fields become columns ``<column>_<path>``; unreadable text gives nulls.

    Without ``schema`` the merged schema of all rows is inferred in one distributed pass.
    """
    c = resolve(df, column)
    if schema is None:
        text = df.agg(F.schema_of_variant_agg(F.try_parse_json(col(c)))).first()[0] or "OBJECT<>"
        schema = text.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING")
    kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    parsed = df.withColumn("_json", F.from_json(col(c), kind))
    return parsed.select(*[col(x) for x in df.columns], *flat_fields(kind, "_json", f"{c}_"))


@operator("clean.trim_text_length")
def trim_text_length(df: DataFrame, column: str, max_length: int = 100) -> DataFrame:
    c = resolve(df, column)
    return df.withColumn(c, F.substring(col(c).cast("string"), 1, max_length))


@operator("clean.round_to_nearest")
def round_to_nearest(df: DataFrame, column: str, nearest: float = 10) -> DataFrame:
    c = resolve(df, column)
    return df.withColumn(c, F.bround(num(c) / F.lit(float(nearest)), 0) * F.lit(float(nearest)))


@operator("clean.random_oversample")
def random_oversample(df: DataFrame, column: str | None = None, target: str | None = None, seed: int = 42) -> DataFrame:
    return oversample(df, label_column(df, target or column), seed)


@operator("clean.random_undersample")
def random_undersample(df: DataFrame, column: str | None = None, target: str | None = None, seed: int = 42) -> DataFrame:
    return undersample(df, label_column(df, target or column), seed)


def class_points(df: DataFrame, label: str) -> tuple[DataFrame, list[str]]:
    """(id, v, label): rows with a class, nulls of the numeric columns filled with the median."""
    work = df.where(col(label).isNotNull())
    nums = [c for c in numeric_cols(work) if c != label]
    if not nums:
        raise ValueError("numeric features are needed")
    med = {c: q[0] for c, q in fit_quantiles(work, nums, [0.5]).items()}
    v = F.array(*[F.coalesce(num(c), F.lit(med.get(c, 0.0))) for c in nums])
    ix = index_rows(work.select(v.alias("v"), col(label).cast("string").alias("label")), ["label", "v"])
    return ix.df.select(F.col("_idx").alias("id"), "v", "label"), nums


def interpolate(base: DataFrame, near: DataFrame, seed: int) -> DataFrame:
    """New points between a base point and one of its neighbours; ``base`` has (id, v, copy)."""
    h = lambda s: F.xxhash64(F.lit(seed + s), "id", "copy")
    t = base.join(near, "id").withColumn("_n", F.get("near", F.pmod(h(1), F.size("near").cast("long")).cast("int")))
    u = F.pmod(h(2), F.lit(1_000_000)) / F.lit(1_000_000.0)
    return t.select(F.zip_with("v", F.col("_n.v"), lambda a, b: a + u * (b - a)).alias("v"))


def synthesise(df: DataFrame, label: str, k: int, weighted: bool, seed: int) -> DataFrame:
    points, nums = class_points(df, label)
    points = reliable_checkpoint(points)
    sizes = {x["label"]: x["count"] for x in points.groupBy("label").count().collect()}  # one row per class
    top = max(sizes.values())
    k = min(k, max(min(sizes.values()) - 1, 1))
    parts = [points.select("v", "label")]
    for name, n in sorted(sizes.items()):
        need = top - n
        if need <= 0 or n < 2:
            continue
        mine = points.where(F.col("label") == name)
        own = nearest(mine, mine.select(F.col("id").alias("pid"), "v", "label"), k, seed)
        if weighted:
            around = nearest(mine, points.select(F.col("id").alias("pid"), "v", "label"), k, seed)
            foreign = around.select("id", (F.size(F.filter("near", lambda x: x["label"] != name)) / F.size("near")).alias("r"))
            total = fit(foreign, s=F.sum("r"))["s"]
            if not total:
                raise ValueError(f"class {name!r} has no neighbour of another class")
            copies = foreign.select("id", F.bround(F.col("r") / F.lit(total) * F.lit(float(need)), 0).cast("int").alias("m"))
            base = mine.join(copies, "id").where(F.col("m") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("m"))))
        else:
            # need rows spread evenly: every point floor(need / n) times, the first need % n in hash order once more
            ix = index_rows(mine.select("id", "v", F.xxhash64(F.lit(seed), "id").alias("_h")), ["_h", "id"])
            m = F.lit(need // n) + F.when(F.col("_idx") < need % n, 1).otherwise(0)
            base = ix.df.withColumn("m", m).where(F.col("m") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
        parts.append(interpolate(base.select("id", "v", "copy"), own, seed).withColumn("label", F.lit(name)))
    out = reduce(DataFrame.unionByName, parts)
    return out.select(*[F.col("v")[i].alias(c) for i, c in enumerate(nums)], F.col("label").cast(df.schema[label].dataType).alias(label))


@operator("clean.smote_oversample")
def smote_oversample(df: DataFrame, column: str | None = None, target: str | None = None, k_neighbors: int = 5, seed: int = 42) -> DataFrame:
    """Every class grows to the largest by points between a row and one of its k nearest rows of the same class."""
    return synthesise(df, label_column(df, target or column), k_neighbors, False, seed)


@operator("clean.adasyn_oversample")
def adasyn_oversample(df: DataFrame, column: str | None = None, target: str | None = None, n_neighbors: int = 5, seed: int = 42) -> DataFrame:
    """As SMOTE, with more new points where more of the nearest rows belong to other classes."""
    return synthesise(df, label_column(df, target or column), n_neighbors, True, seed)
