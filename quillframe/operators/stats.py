"""Reports and hypothesis tests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.columns import (col, dtype, is_numeric, num, numeric_cols, pick, pick_many, pick_pair, quoted,
                                resolve, text_cols)
from quillframe.functions import dist
from quillframe.functions.bins import bin_number, quantile_edges
from quillframe.functions.freq import cumulative, freq_long, modes, top_counts, value_counts as counts_of
from quillframe.functions.ordered import index_rows
from quillframe.functions.profile import (fit, kurt_g2, matrix, nulls, pair_stats, profile, r, rows_of, safe_corr,
                                          safe_div, skew_g1)
from quillframe.functions.mutual import neighbour_mi
from quillframe.functions.quantile import quantiles
from quillframe.functions.ranks import ecdf, with_rank
from quillframe.registry import operator

DEFAULT_QUANTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)

# Storage width in bytes of the fixed-size types.
TYPE_BYTES = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "boolean": 1,
              "date": 4, "timestamp": 8, "timestamp_ntz": 8}


def pct(part, whole):
    return safe_div(part * 100.0, whole)


def _width(df: DataFrame, name: str):
    kind = dtype(df, name)
    if kind == "string":
        return F.octet_length(col(name))
    if kind in TYPE_BYTES:
        return F.when(col(name).isNotNull(), TYPE_BYTES[kind])
    return F.octet_length(F.to_json(F.struct(col(name))))


def duplicate_count(df: DataFrame) -> DataFrame:
    """(rows, distinct_rows): rows are hashed into groups, so copies merge before the shuffle."""
    groups = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_c"))
    return groups.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_rows"))


@operator("stats.shape")
def shape(df: DataFrame) -> DataFrame:
    size = reduce(lambda a, b: a + b, [F.coalesce(F.sum(_width(df, c)), F.lit(0)) for c in df.columns])
    missing = reduce(lambda a, b: a + b, [nulls(col(c)) for c in df.columns])
    one = df.agg(missing.alias("total_nulls"), size.alias("_bytes"))
    return one.crossJoin(F.broadcast(duplicate_count(df))).select(
        "rows", F.lit(len(df.columns)).cast("long").alias("columns"),
        F.lit(len(numeric_cols(df))).cast("long").alias("numeric_cols"),
        F.lit(len(text_cols(df))).cast("long").alias("categorical_cols"),
        "total_nulls", (F.col("rows") - F.col("distinct_rows")).alias("duplicates"),
        F.round(F.col("_bytes") / (1024 * 1024), 2).alias("memory_mb"))


@operator("stats.describe")
def describe(df: DataFrame, column: str | None = None) -> DataFrame:
    if column is not None:
        c = resolve(df, column)
        if is_numeric(df, c):
            one = df.agg(F.count(num(c)).cast("double").alias("count"), F.avg(num(c)).alias("mean"),
                         F.stddev_samp(num(c)).alias("std"), F.min(num(c)).alias("min"), F.max(num(c)).alias("max"))
            q = quantiles(df, [c], [0.25, 0.5, 0.75])
            names = {"count": "count", "mean": "mean", "std": "std", "min": "min", "25%": "q0", "50%": "q1",
                     "75%": "q2", "max": "max"}
            return rows_of(one.crossJoin(F.broadcast(q)), [
                F.struct(F.lit(k).alias("stat"), r(F.col(v)).alias("value")) for k, v in names.items()])
        m = modes(freq_long(df, [c]))
        return rows_of(m, [F.struct(F.lit(k).alias("stat"), F.col(v).cast("string").alias("value"))
                           for k, v in {"count": "total", "unique": "distinct", "top": "mode",
                                        "freq": "mode_count"}.items()])
    nums = numeric_cols(df)
    other = [c for c in df.columns if c not in nums]
    base = profile(df, df.columns, {"non_null": F.count, "null_count": nulls}, dtypes=True)
    out = base.join(modes(freq_long(df, df.columns)), "column", "left")
    if nums:
        moments = profile(df, nums, {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}, numeric=True)
        out = (out.join(F.broadcast(moments.drop("n")), "column", "left")
               .join(F.broadcast(quantiles(df, nums, [0.25, 0.5, 0.75])), "column", "left"))
    else:
        out = out.withColumns({k: F.lit(None).cast("double") for k in ("mean", "std", "min", "max", "q0", "q1", "q2")})
    text = F.col("column").isin(other)
    return out.select(
        "column", "dtype", "non_null", "null_count", F.round(pct(F.col("null_count"), F.col("n")), 1).alias("null_pct"),
        F.coalesce("distinct", F.lit(0)).alias("unique"),
        r(F.col("mean"), 2).alias("mean"), r(F.col("std"), 2).alias("std"), r(F.col("min"), 2).alias("min"),
        r(F.col("q0"), 2).alias("25%"), r(F.col("q1"), 2).alias("50%"), r(F.col("q2"), 2).alias("75%"),
        r(F.col("max"), 2).alias("max"), F.when(text, F.col("mode")).alias("top"),
        F.when(text, F.coalesce("mode_count", F.lit(0))).alias("freq"))


@operator("stats.null_report")
def null_report(df: DataFrame) -> DataFrame:
    p = profile(df, df.columns, {"null_count": nulls}, dtypes=True)
    return p.select("column", "null_count", r(pct(F.col("null_count"), F.col("n")), 2).alias("null_pct"),
                    "dtype").orderBy(F.desc("null_count"), "column")


def distinct_counts(df: DataFrame, cols: Sequence[str], approx: bool = False, dtypes: bool = True) -> DataFrame:
    fn = F.approx_count_distinct if approx else F.count_distinct
    return profile(df, cols, {"unique": fn, "null_count": nulls}, dtypes=dtypes)


@operator("stats.dtypes")
def dtypes(df: DataFrame, approx: bool = False) -> DataFrame:
    p = distinct_counts(df, df.columns, approx)
    return p.select("column", "dtype", F.round(pct(F.col("null_count"), F.col("n")), 1).alias("null_pct"), "unique")


@operator("stats.value_counts")
def value_counts(df: DataFrame, column: str | None = None, n: int = 10) -> DataFrame:
    c = pick(df, column, "category")
    total = df.agg(F.count(col(c)).alias("_total"))
    return top_counts(df, c, n, c).crossJoin(F.broadcast(total)).select(
        col(c), "count", r(pct(F.col("count"), F.col("_total")), 2).alias("percentage")).orderBy(F.desc("count"), col(c))


@operator("stats.unique_values")
def unique_values(df: DataFrame, approx: bool = False) -> DataFrame:
    p = distinct_counts(df, df.columns, approx)
    return p.select("column", F.col("unique").alias("unique_count"), "dtype").orderBy(F.desc("unique_count"), "column")


@operator("stats.cardinality_report")
def cardinality_report(df: DataFrame, approx: bool = False) -> DataFrame:
    p = distinct_counts(df, df.columns, approx)
    share = F.coalesce(r(pct(F.col("unique"), F.col("n")), 2), F.lit(0.0))
    u = F.col("unique")
    return p.select("column", "unique", share.alias("unique_pct"), "dtype").withColumn(
        "cardinality", F.when(F.col("unique_pct") > 90, "ID-like").when(u <= 2, "Binary").when(u <= 10, "Low")
        .when(F.col("unique_pct") > 50, "High").otherwise("Medium")).orderBy(F.desc("unique"), "column")


@operator("stats.mode_report")
def mode_report(df: DataFrame) -> DataFrame:
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    names = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")
    m = names.join(modes(freq_long(df, df.columns)), "column", "left").crossJoin(F.broadcast(total))
    return m.select("column", F.coalesce("mode", F.lit("N/A")).alias("mode"),
                    F.coalesce("mode_count", F.lit(0)).alias("mode_count"),
                    F.coalesce(r(pct(F.col("mode_count"), F.col("_n")), 2), F.lit(0.0)).alias("mode_pct"),
                    F.coalesce("n_modes", F.lit(0)).alias("n_modes"))


@operator("stats.frequency_table")
def frequency_table(df: DataFrame, column: str | None = None) -> DataFrame:
    c = pick(df, column, "category")
    return cumulative(counts_of(df, c)).select(
        F.col("value").alias(c), "count", r(F.col("pct"), 2).alias("pct"),
        r(F.col("cumulative_pct"), 2).alias("cumulative_pct"))


def hash_order(df: DataFrame, seed: int, key: Sequence[str] | None = None) -> list:
    """Repeatable pseudo-random order: a seeded hash of the key columns (all columns by default)."""
    cols = [col(c) for c in (key or df.columns)]
    return [F.xxhash64(F.lit(seed), *cols), *cols]


@operator("stats.data_sample")
def data_sample(df: DataFrame, n: int = 10, seed: int = 42, key: Sequence[str] | None = None) -> DataFrame:
    return df.orderBy(*hash_order(df, seed, key)).limit(n)


@operator("stats.top_bottom_values")
def top_bottom_values(df: DataFrame, column: str | None = None, n: int = 5,
                      order_by: Sequence[str] = ()) -> DataFrame:
    c = pick(df, column, "numeric")
    ties = [col(t) for t in order_by]
    some = df.where(col(c).isNotNull())
    top = some.orderBy(col(c).desc(), *ties).limit(n).withColumn("_group", F.lit("top"))
    return top.unionByName(some.orderBy(col(c).asc(), *ties).limit(n).withColumn("_group", F.lit("bottom")))


@operator("stats.missing_pattern")
def missing_pattern(df: DataFrame, n: int = 10) -> DataFrame:
    found = fit(df, **{f"c{i}": nulls(col(c)) for i, c in enumerate(df.columns)})
    cols = [c for i, c in enumerate(df.columns) if found[f"c{i}"]]
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    g = df.groupBy(*[col(c).isNull().alias(c) for c in cols]).agg(F.count(F.lit(1)).alias("count"))
    return (g.orderBy(F.desc("count"), *[col(c) for c in cols]).limit(n).crossJoin(F.broadcast(total))
            .withColumn("pct", r(pct(F.col("count"), F.col("_n")), 2)).drop("_n"))


@operator("stats.duplicate_report")
def duplicate_report(df: DataFrame, n: int = 5) -> DataFrame:
    """The first n repeated rows with the number of surplus copies and the table-wide total."""
    g = (df.groupBy(*[col(c) for c in df.columns]).agg((F.count(F.lit(1)) - 1).alias("copies"))
         .where(F.col("copies") > 0))
    total = g.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("duplicate_rows"))
    return g.orderBy(*[col(c) for c in df.columns]).limit(n).crossJoin(F.broadcast(total))


@operator("stats.memory_report")
def memory_report(df: DataFrame) -> DataFrame:
    one = df.agg(*[F.coalesce(F.sum(_width(df, c)), F.lit(0)).cast("long").alias(f"_{i}")
                   for i, c in enumerate(df.columns)])
    total = reduce(lambda a, b: a + b, [F.col(f"_{i}") for i in range(len(df.columns))])
    return rows_of(one, [
        F.struct(F.lit(c).alias("column"), F.lit(dtype(df, c)).alias("dtype"), F.col(f"_{i}").alias("memory_bytes"),
                 r(F.col(f"_{i}") / 1024, 2).alias("memory_kb"), r(pct(F.col(f"_{i}"), total), 2).alias("pct_of_total"))
        for i, c in enumerate(df.columns)]).orderBy(F.desc("memory_bytes"), "column")


def _zeros(df: DataFrame, c: str):
    if is_numeric(df, c):
        return F.count_if(col(c) == 0)
    return F.count_if(col(c).cast("string").isin("0", "", " "))


@operator("stats.zero_report")
def zero_report(df: DataFrame) -> DataFrame:
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[_zeros(df, c).alias(f"_{i}") for i, c in enumerate(df.columns)])
    return rows_of(one, [
        F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("zero_count"),
                 r(pct(F.col(f"_{i}"), F.col("_n")), 2).alias("zero_pct"))
        for i, c in enumerate(df.columns)]).orderBy(F.desc("zero_count"), "column")


@operator("stats.sparsity_report")
def sparsity_report(df: DataFrame) -> DataFrame:
    one = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[nulls(col(c)).alias(f"_m{i}") for i, c in enumerate(df.columns)],
                 *[F.coalesce(F.sum((col(c) == 0).cast("long")), F.lit(0)).alias(f"_z{i}")
                   if is_numeric(df, c) else F.count_if(F.lit(False)).alias(f"_z{i}")
                   for i, c in enumerate(df.columns)])
    return rows_of(one, [
        F.struct(F.lit(c).alias("column"), F.col(f"_m{i}").alias("null_count"), F.col(f"_z{i}").alias("zero_count"),
                 (F.col(f"_m{i}") + F.col(f"_z{i}")).alias("sparse_count"),
                 r(pct(F.col(f"_m{i}") + F.col(f"_z{i}"), F.col("_n")), 2).alias("sparsity_pct"))
        for i, c in enumerate(df.columns)]).orderBy(F.desc("sparsity_pct"), "column")


@operator("stats.variance_report")
def variance_report(df: DataFrame) -> DataFrame:
    p = profile(df, pick_many(df, None), {"variance": F.var_samp}, numeric=True)
    return p.select("column", r(F.col("variance")).alias("variance")).orderBy(F.desc("variance"), "column")


@operator("stats.range_report")
def range_report(df: DataFrame) -> DataFrame:
    p = profile(df, pick_many(df, None), {"min": F.min, "max": F.max}, numeric=True)
    return p.select("column", r(F.col("min")).alias("min"), r(F.col("max")).alias("max"),
                    r(F.col("max") - F.col("min")).alias("range")).orderBy(F.desc("range"), "column")


@operator("stats.iqr_report")
def iqr_report(df: DataFrame) -> DataFrame:
    q = quantiles(df, pick_many(df, None), [0.25, 0.75])
    return q.select("column", r(F.col("q0")).alias("Q1"), r(F.col("q1")).alias("Q3"),
                    r(F.col("q1") - F.col("q0")).alias("IQR")).orderBy(F.desc("IQR"), "column")


@operator("stats.percentile")
def percentile(df: DataFrame, column: str | None = None,
               quantiles_: Sequence[float] = DEFAULT_QUANTILES, **kw) -> DataFrame:
    """``quantiles=[...]`` chooses the points; columns are named p1, p5, ..."""
    qs = list(kw.pop("quantiles", quantiles_))
    if kw:
        raise ValueError(f"unknown parameters {sorted(kw)}")
    q = quantiles(df, pick_many(df, column), qs)
    return q.select("column", *[r(F.col(f"q{i}")).alias(f"p{int(round(p * 100))}") for i, p in enumerate(qs)])


@operator("stats.quantile_detail")
def quantile_detail(df: DataFrame, column: str | None = None) -> DataFrame:
    return percentile(df, column)


@operator("stats.summary_extended")
def summary_extended(df: DataFrame) -> DataFrame:
    nums = pick_many(df, None)
    p = profile(df, nums, {"mean": F.avg, "std": F.stddev_samp, "variance": F.var_samp, "lo": F.min, "hi": F.max,
                           "skewness": skew_g1, "kurtosis": kurt_g2}, numeric=True)
    m = modes(freq_long(df, nums)).select("column", "mode_num")
    q = quantiles(df, nums, [0.25, 0.5, 0.75])
    return p.join(m, "column", "left").join(q, "column", "left").select(
        "column", r(F.col("mean")).alias("mean"), r(F.col("q1")).alias("median"), r(F.col("mode_num")).alias("mode"),
        r(F.col("std")).alias("std"), r(F.col("variance")).alias("variance"),
        r(F.col("hi") - F.col("lo")).alias("range"), r(F.col("q2") - F.col("q0")).alias("IQR"),
        r(F.col("skewness")).alias("skewness"), r(F.col("kurtosis")).alias("kurtosis"))


@operator("stats.skewness")
def skewness(df: DataFrame) -> DataFrame:
    p = profile(df, pick_many(df, None), {"skewness": skew_g1}, numeric=True)
    return p.select("column", r(F.col("skewness")).alias("skewness")).orderBy(F.desc(F.abs("skewness")), "column")


@operator("stats.kurtosis")
def kurtosis(df: DataFrame) -> DataFrame:
    k = F.col("kurtosis")
    p = profile(df, pick_many(df, None), {"kurtosis": kurt_g2}, numeric=True)
    return p.select("column", r(k).alias("kurtosis")).withColumn(
        "shape", F.when(F.abs(k) < 1, "Normal-like").when(k > 1, "Heavy-tailed").otherwise("Light-tailed")).orderBy(
        F.desc(F.abs("kurtosis")), "column")


@operator("stats.coefficient_variation")
def coefficient_variation(df: DataFrame) -> DataFrame:
    p = profile(df, pick_many(df, None), {"mean": F.avg, "std": F.stddev_samp}, numeric=True)
    cv = F.when(F.col("mean") == 0, F.lit(float("inf"))).otherwise(r(safe_div(F.col("std"), F.col("mean")) * 100, 2))
    return p.select("column", r(F.col("mean")).alias("mean"), r(F.col("std")).alias("std"),
                    cv.alias("cv_pct")).orderBy(F.desc("cv_pct"), "column")


@operator("stats.z_score_report")
def z_score_report(df: DataFrame, column: str | None = None) -> DataFrame:
    cols = pick_many(df, column)
    s = fit(df, **{f"m{i}": F.avg(num(c)) for i, c in enumerate(cols)},
            **{f"s{i}": F.stddev_samp(num(c)) for i, c in enumerate(cols)})
    aggs, structs = [], []
    for i, c in enumerate(cols):
        z = F.lit(0.0) if not s[f"s{i}"] else F.abs((num(c) - F.lit(s[f"m{i}"])) / F.lit(s[f"s{i}"]))
        aggs += [F.max(z).alias(f"_m{i}"), F.count_if(z > 2).alias(f"_a{i}"), F.count_if(z > 3).alias(f"_b{i}")]
        structs.append(F.struct(F.lit(c).alias("column"), r(F.col(f"_m{i}")).alias("max_abs_z"),
                                F.col(f"_a{i}").alias("n_beyond_2"), F.col(f"_b{i}").alias("n_beyond_3")))
    return rows_of(df.agg(*aggs), structs).orderBy(F.desc("max_abs_z"), "column")


def iqr_fences(df: DataFrame, cols: Sequence[str], k: float = 1.5, quartiles: Mapping[str, Sequence[float]] | None = None) -> dict[str, tuple[float, float]]:
    """Lower and upper fence of each column that has values; ``quartiles`` (all three) by column, if they are known."""
    if quartiles is not None:
        ends = {c: (quartiles[c][0], quartiles[c][2]) for c in cols if c in quartiles}
    else:
        rows = quantiles(df, cols, [0.25, 0.75]).collect()  # one row per column
        ends = {x["column"]: (x["q0"], x["q1"]) for x in rows if x["q0"] is not None}
    return {c: (a - k * (b - a), b + k * (b - a)) for c, (a, b) in ends.items()}


@operator("stats.outlier_report")
def outlier_report(df: DataFrame, quartiles: Mapping[str, Sequence[float]] | None = None) -> DataFrame:
    fences = iqr_fences(df, pick_many(df, None), quartiles=quartiles)
    one = df.agg(*[F.count_if((num(c) < F.lit(lo)) | (num(c) > F.lit(hi))).alias(f"_{i}")
                   for i, (c, (lo, hi)) in enumerate(fences.items())])
    return rows_of(one, [
        F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("outlier_count"),
                 r(F.lit(lo), 2).alias("lower_bound"), r(F.lit(hi), 2).alias("upper_bound"))
        for i, (c, (lo, hi)) in enumerate(fences.items())]).orderBy(F.desc("outlier_count"), "column")


def _with_total(freq: DataFrame) -> DataFrame:
    total = freq.groupBy("column").agg(F.sum("count").alias("_total"))
    return freq.join(F.broadcast(total), "column").withColumn("p", F.col("count") / F.col("_total"))


@operator("stats.entropy_report")
def entropy_report(df: DataFrame) -> DataFrame:
    types = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.lit(dtype(df, c)))])
    e = _with_total(freq_long(df, df.columns)).groupBy("column").agg(
        r(F.sum(-F.col("p") * F.log2("p"))).alias("entropy"), F.count(F.lit(1)).alias("unique"))
    return e.withColumn("dtype", types[F.col("column")]).orderBy(F.desc("entropy"), "column")


@operator("stats.gini_report")
def gini_report(df: DataFrame) -> DataFrame:
    cols = text_cols(df)
    if not cols:
        found = distinct_counts(df, df.columns).where(F.col("unique") <= 20).collect()  # one row per column
        cols = [x["column"] for x in found]
    g = _with_total(freq_long(df, cols)).groupBy("column").agg(
        r(1 - F.sum(F.col("p") * F.col("p"))).alias("gini"), F.count(F.lit(1)).alias("unique"))
    return g.orderBy(F.desc("gini"), "column")


def label_column(df: DataFrame, name: str | None, max_levels: int = 10) -> str:
    """The given column, else the first numeric one with few levels, else the first text one."""
    if name is not None:
        return resolve(df, name)
    nums = numeric_cols(df)
    if nums:
        few = fit(df, **{f"c{i}": F.count_distinct(col(c)) for i, c in enumerate(nums)})
        for i, c in enumerate(nums):
            if few[f"c{i}"] <= max_levels:
                return c
    return pick(df, None, "category")


@operator("stats.class_balance")
def class_balance(df: DataFrame, column: str | None = None) -> DataFrame:
    c = label_column(df, column)
    vc = counts_of(df, c)
    totals = df.agg(F.count(F.lit(1)).alias("_n"))
    span = vc.agg((F.max("count") / F.min("count")).alias("_ratio"))
    return vc.crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(span)).select(
        F.col("value").cast("string").alias("class"), "count",
        r(pct(F.col("count"), F.col("_n")), 2).alias("percentage"),
        F.when(F.col("_ratio") < 2, "Balanced").when(F.col("_ratio") < 5, "Moderate imbalance")
        .otherwise("Severe imbalance").alias("balance")).orderBy(F.desc("count"), "class")


@operator("stats.class_weight_calc")
def class_weight_calc(df: DataFrame, column: str | None = None, target: str | None = None) -> DataFrame:
    c = label_column(df, target or column)
    vc = counts_of(df, c)
    t = vc.agg(F.sum("count").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return vc.crossJoin(F.broadcast(t)).select(
        F.col("value").cast("string").alias("class"), "count",
        r(pct(F.col("count"), F.col("_n")), 2).alias("percentage"),
        r(F.col("_n") / (F.col("_k") * F.col("count"))).alias("weight")).orderBy("class")


@operator("stats.correlation")
def correlation(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return matrix(df, pick_many(df, columns), safe_corr)


@operator("stats.correlation_rank")
def correlation_rank(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Spearman matrix: average ranks per column, then Pearson."""
    cols = pick_many(df, columns)
    ranked = df.select(*[num(c).alias(c) for c in cols])
    for i, c in enumerate(cols):
        ranked = with_rank(ranked, c, out=f"_r{i}")
    ranked = ranked.select(*[F.col(f"_r{i}").alias(c) for i, c in enumerate(cols)])
    return matrix(ranked, cols, safe_corr)


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, r) of every column pair, unrounded."""
    return pair_stats(df, cols, {"r": safe_corr})


@operator("stats.top_correlations")
def top_correlations(df: DataFrame, n: int = 10) -> DataFrame:
    return correlations(df, pick_many(df, None)).select(
        F.col("a").alias("feature_1"), F.col("b").alias("feature_2"), r(F.col("r")).alias("correlation"),
        r(F.abs("r")).alias("abs_correlation")).orderBy(
        F.desc("abs_correlation"), "feature_1", "feature_2").limit(n)


@operator("stats.covariance")
def covariance(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return matrix(df, pick_many(df, columns), F.covar_samp)


@operator("stats.pairwise_stats")
def pairwise_stats(df: DataFrame, max_columns: int | None = None) -> DataFrame:
    cols = pick_many(df, None)[:max_columns]
    corr = correlations(df, cols)
    p = profile(df, cols, {"mean": F.avg, "std": F.stddev_samp}, numeric=True).drop("n")
    a = p.select(F.col("column").alias("a"), F.col("mean").alias("ma"), F.col("std").alias("sa"))
    b = p.select(F.col("column").alias("b"), F.col("mean").alias("mb"), F.col("std").alias("sb"))
    return corr.join(F.broadcast(a), "a").join(F.broadcast(b), "b").select(
        F.col("a").alias("col_a"), F.col("b").alias("col_b"), r(F.col("r")).alias("pearson_corr"),
        r(F.col("ma") - F.col("mb")).alias("mean_diff"),
        r(F.col("sa") / F.greatest(F.col("sb"), F.lit(1e-10))).alias("std_ratio")).orderBy(
        F.desc(F.abs("pearson_corr")), "col_a", "col_b")


@operator("stats.ratio_report")
def ratio_report(df: DataFrame, max_columns: int | None = None) -> DataFrame:
    cols = pick_many(df, None)[:max_columns]
    one = df.agg(*[F.avg(num(c)).alias(f"_{i}") for i, c in enumerate(cols)])
    structs = []
    for i, j in combinations(range(len(cols)), 2):
        a, b = F.col(f"_{i}"), F.col(f"_{j}")
        structs.append(F.struct(F.lit(cols[i]).alias("col_a"), F.lit(cols[j]).alias("col_b"), r(a).alias("mean_a"),
                                r(b).alias("mean_b"),
                                F.when(b == 0, F.lit(float("inf"))).otherwise(r(safe_div(a, b))).alias("ratio")))
    return rows_of(one, structs).orderBy(F.desc("ratio"), "col_a", "col_b")


@operator("stats.column_compare")
def column_compare(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    a, b = pick_pair(df, columns, "numeric")
    aggs = {}
    for k, c in (("a", a), ("b", b)):
        x = num(c)
        aggs |= {f"count_{k}": F.count(x).cast("double"), f"mean_{k}": F.avg(x), f"std_{k}": F.stddev_samp(x),
                 f"min_{k}": F.min(x), f"max_{k}": F.max(x)}
    both = num(a).isNotNull() & num(b).isNotNull()
    rho = safe_corr(F.when(both, num(a)), F.when(both, num(b)))
    one = df.agg(*[v.alias(k) for k, v in aggs.items()], rho.alias("correlation_a"), rho.alias("correlation_b"))
    q = quantiles(df, [a, b], [0.5]).agg(F.max(F.when(F.col("column") == a, F.col("q0"))).alias("median_a"),
                                         F.max(F.when(F.col("column") == b, F.col("q0"))).alias("median_b"))
    return rows_of(one.crossJoin(F.broadcast(q)), [
        F.struct(F.lit(s).alias("stat"), r(F.col(f"{s}_a")).alias(a), r(F.col(f"{s}_b")).alias(b))
        for s in ("count", "mean", "std", "min", "median", "max", "correlation")])


def levels_of(df: DataFrame, name: str, limit: int = 1000) -> list:
    """Distinct non-null values of a column that becomes output columns; more than ``limit`` is an error."""
    rows = (df.select(col(name).alias("v")).where(F.col("v").isNotNull()).distinct().limit(limit + 1).collect())
    if len(rows) > limit:
        raise ValueError(f"column {name!r} has more than {limit} levels")
    return sorted(x["v"] for x in rows)


@operator("stats.cross_tab")
def cross_tab(df: DataFrame, columns: Sequence[str] | None = None, normalize: bool = False,
              max_levels: int = 1000) -> DataFrame:
    a, b = pick_pair(df, columns, "text")
    levels = levels_of(df, b, max_levels)
    some = df.where(col(a).isNotNull() & col(b).isNotNull())
    out = some.groupBy(col(a).alias(a)).agg(*[F.count_if(col(b) == F.lit(v)).alias(str(v)) for v in levels])
    if normalize:
        total = out.agg(reduce(lambda x, y: x + y, [F.sum(quoted(str(v))) for v in levels]).alias("_n"))
        out = out.crossJoin(F.broadcast(total)).select(
            col(a), *[r(pct(col(str(v)), F.col("_n")), 2).alias(str(v)) for v in levels])
    return out.orderBy(col(a))


def chi2_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], yates: bool = True) -> DataFrame:
    """(a, b, chi2, dof, n, rows, cols) per pair: one pass counts the cells of every pair."""
    cells = (df.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), col(a).cast("string").alias("u"),
                 col(b).cast("string").alias("v")) for a, b in pairs])))
        .where(F.col("u").isNotNull() & F.col("v").isNotNull())
        .groupBy("a", "b", "u", "v").agg(F.count(F.lit(1)).alias("o")))
    rows = cells.groupBy("a", "b", "u").agg(F.sum("o").alias("nr"))
    cols = cells.groupBy("a", "b", "v").agg(F.sum("o").alias("nc"))
    size = cells.groupBy("a", "b").agg(F.sum("o").alias("n"), F.count_distinct("u").alias("kr"),
                                       F.count_distinct("v").alias("kc"))
    # cells that never occur add their expected count: n - sum of expected counts over seen cells
    e = F.col("nr") * F.col("nc") / F.col("n")
    seen = cells.join(rows, ["a", "b", "u"]).join(cols, ["a", "b", "v"]).join(F.broadcast(size), ["a", "b"])
    small = (F.col("kr") == 2) & (F.col("kc") == 2) & F.lit(yates)
    gap = F.abs(F.col("o") - e)
    gap = F.when(small, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    part = seen.groupBy("a", "b").agg(F.sum(gap * gap / e).alias("s"), F.sum(e).alias("se"),
                                      F.first(F.col("n")).alias("n"), F.first("kr").alias("kr"),
                                      F.first("kc").alias("kc"), F.first(small).alias("small"),
                                      F.count(F.lit(1)).alias("k"))
    # an empty cell of a corrected 2 x 2 table: |0 - e| is reduced as well
    empty = F.col("n") - F.col("se")
    fix = F.when(F.col("small") & (F.col("k") == 3) & (empty > 0),
                 (empty - F.least(F.lit(0.5), empty)) * (empty - F.least(F.lit(0.5), empty)) / empty).otherwise(empty)
    return part.select("a", "b", (F.col("s") + F.greatest(fix, F.lit(0.0))).alias("chi2"),
                       ((F.col("kr") - 1) * (F.col("kc") - 1)).alias("dof"), "n", F.col("kr").alias("rows"),
                       F.col("kc").alias("cols"))


def verdict(p, yes: str = "Yes", no: str = "No"):
    return F.when(p < 0.05, yes).otherwise(no)


@operator("stats.chi2_test")
def chi2_test(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    a, b = pick_pair(df, columns, "text")
    t = chi2_pairs(df, [(a, b)]).withColumn("p", dist.p_value(dist.chi2_sf, F.col("chi2"), F.col("dof")))
    return t.select(F.col("a").alias("column_1"), F.col("b").alias("column_2"), r(F.col("chi2")).alias("chi2"),
                    r(F.col("p"), 6).alias("p_value"), "dof", verdict(F.col("p")).alias("significant"))


@operator("stats.cramers_v")
def cramers_v(df: DataFrame, max_levels: int = 50, max_columns: int | None = None) -> DataFrame:
    cats = text_cols(df)
    few = fit(df, **{f"c{i}": F.count_distinct(col(c)) for i, c in enumerate(cats)}) if cats else {}
    cats = [c for i, c in enumerate(cats) if few[f"c{i}"] <= max_levels][:max_columns]
    if len(cats) < 2:
        raise ValueError("two text columns with few levels are needed")
    k = F.least("rows", "cols") - 1
    v = F.when((k > 0) & (F.col("n") > 0), F.sqrt(F.col("chi2") / (F.col("n") * k))).otherwise(0.0)
    t = chi2_pairs(df, list(combinations(cats, 2))).select(F.col("a").alias("col_a"), F.col("b").alias("col_b"),
                                                           v.alias("v"))
    return t.select("col_a", "col_b", r(F.col("v")).alias("cramers_v"),
                    F.when(F.col("v") >= 0.5, "strong").when(F.col("v") >= 0.3, "moderate").otherwise("weak")
                    .alias("strength")).orderBy(F.desc("cramers_v"), "col_a", "col_b")


@operator("stats.point_biserial")
def point_biserial(df: DataFrame) -> DataFrame:
    """The smaller of the two values is coded 0, the larger 1."""
    counts = fit(df, **{f"c{i}": F.count_distinct(col(c)) for i, c in enumerate(df.columns)})
    binary = [c for i, c in enumerate(df.columns) if counts[f"c{i}"] == 2]
    nums = numeric_cols(df)
    tops = fit(df, **{f"c{i}": F.max(col(c)) for i, c in enumerate(binary)}) if binary else {}
    pairs = [(b, c) for b in binary for c in nums if b != c]
    if not pairs:
        raise ValueError("a binary and a numeric column are needed")
    aggs, structs = [], []
    for i, (b, c) in enumerate(pairs):
        y = F.when(col(b).isNotNull() & num(c).isNotNull(),
                   (col(b) == F.lit(tops[f"c{binary.index(b)}"])).cast("double"))
        x = F.when(col(b).isNotNull(), num(c))
        aggs += [safe_corr(y, x).alias(f"_r{i}"), F.count(y).alias(f"_n{i}")]
        structs.append(F.struct(F.lit(b).alias("binary_col"), F.lit(c).alias("numeric_col"),
                                F.col(f"_r{i}").alias("r"), F.col(f"_n{i}").alias("n")))
    t = rows_of(df.agg(*aggs), structs).where(F.col("n") >= 3)
    rho = F.col("r")
    t = t.withColumn("p", dist.p_value(dist.t_two_sided, rho * F.sqrt((F.col("n") - 2) / F.greatest(
        1 - rho * rho, F.lit(1e-300))), F.col("n") - 2))
    return t.select("binary_col", "numeric_col", r(rho).alias("correlation"),
                    r(F.col("p"), 6).alias("p_value")).orderBy(F.desc(F.abs("correlation")), "binary_col", "numeric_col")


def two_level_group(df: DataFrame, name: str | None) -> str:
    """The given column, else the first text column with two values, else the first text column."""
    if name is not None:
        return resolve(df, name)
    cats = text_cols(df)
    if not cats:
        raise ValueError("a group column is needed")
    few = fit(df, **{f"c{i}": F.count_distinct(col(c)) for i, c in enumerate(cats)})
    return next((c for i, c in enumerate(cats) if few[f"c{i}"] == 2), cats[0])


def first_two_levels(df: DataFrame, group: str) -> list:
    """The two smallest values of the group column: rows have no order, so the first two met are not defined."""
    rows = df.where(col(group).isNotNull()).select(col(group).alias("v")).distinct().orderBy("v").limit(2).collect()
    if len(rows) < 2:
        raise ValueError(f"column {group!r} has fewer than two groups")
    return [x["v"] for x in rows]


def two_group_moments(df: DataFrame, value: str, group: str, levels: Sequence) -> DataFrame:
    """One row n1, m1, v1, n2, m2, v2."""
    aggs = []
    for i, level in enumerate(levels, 1):
        x = F.when(col(group) == F.lit(level), num(value))
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.var_samp(x).alias(f"v{i}")]
    return df.agg(*aggs)


@operator("stats.t_test")
def t_test(df: DataFrame, column: str | None = None, group_column: str | None = None) -> DataFrame:
    c, g = pick(df, column, "numeric"), two_level_group(df, group_column)
    lv = first_two_levels(df, g)
    m = two_group_moments(df, c, g, lv)
    s1, s2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    t = safe_div(F.col("m1") - F.col("m2"), F.sqrt(s1 + s2))
    dof = safe_div((s1 + s2) * (s1 + s2), s1 * s1 / (F.col("n1") - 1) + s2 * s2 / (F.col("n2") - 1))
    m = m.withColumns({"t": t, "dof": dof})
    m = m.withColumn("p", dist.p_value(dist.t_two_sided, F.col("t"), F.col("dof")))
    return m.select(F.lit(c).alias("numeric_col"), F.lit(g).alias("group_col"), F.lit(str(lv[0])).alias("group_1"),
                    F.lit(str(lv[1])).alias("group_2"), r(F.col("m1")).alias("mean_1"), r(F.col("m2")).alias("mean_2"),
                    r(F.col("t")).alias("t_stat"), r(F.col("p"), 6).alias("p_value"),
                    verdict(F.col("p")).alias("significant"))


def anova_table(groups: DataFrame) -> DataFrame:
    """F from a frame of per-group (n, mean, var): one row k, n, f, d1, d2."""
    t = groups.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("s"),
                   F.sum(F.when(F.col("n") > 1, (F.col("n") - 1) * F.col("var")).otherwise(0.0)).alias("ssw"))
    mean = groups.crossJoin(F.broadcast(t.select((F.col("s") / F.col("n")).alias("gm"))))
    b = mean.agg(F.sum(F.col("n") * (F.col("mean") - F.col("gm")) * (F.col("mean") - F.col("gm"))).alias("ssb"))
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    return t.crossJoin(F.broadcast(b)).select(
        "k", "n", safe_div(F.col("ssb") / d1, F.col("ssw") / d2).alias("f"), d1.alias("d1"), d2.alias("d2"))


def group_moments(df: DataFrame, value: str, group: str, least: int = 1) -> DataFrame:
    return (df.where(col(group).isNotNull()).groupBy(col(group).alias("g"))
            .agg(F.count(num(value)).alias("n"), F.avg(num(value)).alias("mean"), F.var_samp(num(value)).alias("var"))
            .where(F.col("n") >= least))


@operator("stats.anova_test")
def anova_test(df: DataFrame, column: str | None = None, group_column: str | None = None) -> DataFrame:
    c, g = pick(df, column, "numeric"), pick(df, group_column, "text")
    a = anova_table(group_moments(df, c, g))
    a = a.withColumn("p", dist.p_value(dist.f_sf, F.col("f"), F.col("d1"), F.col("d2")))
    return a.select(F.lit(c).alias("numeric_col"), F.lit(g).alias("group_col"), F.col("k").alias("n_groups"),
                    r(F.col("f")).alias("f_stat"), r(F.col("p"), 6).alias("p_value"),
                    verdict(F.col("p")).alias("significant"))


def rank_sum(df: DataFrame, value: str, group: str, levels: Sequence) -> DataFrame:
    """One row u, z, n1, n2 of the two-sided Mann-Whitney test with tie correction."""
    some = df.where(col(group).isin(list(levels)) & num(value).isNotNull())
    first = (col(group) == F.lit(levels[0])).cast("long")
    e = ecdf(some, value, extra={"n1": first})
    mid = F.col("upto") - F.col("count") + (F.col("count") + 1) / 2
    t = e.agg(F.sum(F.col("n1") * mid).alias("r1"), F.sum("n1").alias("n1"), F.sum("count").alias("n"),
              F.sum(F.col("count").cast("double") * F.col("count") * F.col("count") - F.col("count")).alias("ties"))
    n1, n = F.col("n1").cast("double"), F.col("n").cast("double")
    n2 = n - n1
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    top = F.greatest(u, n1 * n2 - u)
    return t.select(u.alias("u"), safe_div(top - n1 * n2 / 2 - 0.5, sigma).alias("z"),
                    n1.alias("n1"), n2.alias("n2"))


@operator("stats.mann_whitney")
def mann_whitney(df: DataFrame, column: str | None = None, group_column: str | None = None) -> DataFrame:
    c, g = pick(df, column, "numeric"), two_level_group(df, group_column)
    lv = first_two_levels(df, g)
    u = rank_sum(df, c, g, lv)
    u = u.withColumn("p", F.least(dist.p_value(dist.norm_two_sided, F.greatest(F.col("z"), F.lit(0.0))), F.lit(1.0)))
    return u.select(F.lit(c).alias("numeric_col"), F.lit(g).alias("group_col"), F.lit(str(lv[0])).alias("group_1"),
                    F.lit(str(lv[1])).alias("group_2"), r(F.col("u")).alias("u_stat"),
                    r(F.col("p"), 6).alias("p_value"), verdict(F.col("p")).alias("significant"))


@operator("stats.levene_test")
def levene_test(df: DataFrame, column: str | None = None, group: str | None = None) -> DataFrame:
    c, g = pick(df, column, "numeric"), pick(df, group, "text")
    some = df.where(col(g).isNotNull() & num(c).isNotNull())
    med = quantiles(some, [c], [0.5], [g]).select(col(g).alias("_g"), F.col("q0").alias("_med"))
    dev = some.join(med, col(g) == F.col("_g")).select(col(g).alias("g"), F.abs(num(c) - F.col("_med")).alias("z"))
    a = anova_table(group_moments(dev, "z", "g", 2))
    a = a.withColumn("p", dist.p_value(dist.f_sf, F.col("f"), F.col("d1"), F.col("d2")))
    return a.select(F.lit("Levene").alias("test"), F.lit(c).alias("column"), F.lit(g).alias("group_by"),
                    r(F.col("f")).alias("statistic"), r(F.col("p"), 6).alias("p_value"),
                    verdict(F.col("p"), "significant", "not significant").alias("result"),
                    F.col("k").alias("n_groups"))


def ks_distance(df: DataFrame, name: str, cdf) -> DataFrame:
    """(ks, n): largest gap between the empirical distribution and ``cdf(x)``."""
    e = ecdf(df, name)
    total = df.agg(F.count(num(name)).alias("_n"))
    e = e.crossJoin(F.broadcast(total)).withColumn("_f", cdf(F.col("x")))
    gap = F.greatest(F.col("upto") / F.col("_n") - F.col("_f"),
                     F.col("_f") - (F.col("upto") - F.col("count")) / F.col("_n"))
    return e.agg(F.max(gap).alias("ks"), F.max("_n").alias("n"))


@operator("stats.ks_test")
def ks_test(df: DataFrame, column: str | None = None) -> DataFrame:
    parts = []
    for c in pick_many(df, column):
        s = fit(df, n=F.count(num(c)), m=F.avg(num(c)), s=F.stddev_samp(num(c)))
        if s["n"] < 3:
            continue
        m, sd = (s["m"], s["s"]) if s["s"] > 0 else (0.0, 1.0)
        k = ks_distance(df, c, lambda x, m=m, sd=sd: dist.norm_cdf_expr((x - F.lit(m)) / F.lit(sd)))
        parts.append(k.select(F.lit(c).alias("column"), "ks", "n"))
    if not parts:
        raise ValueError("no column with three values")
    t = reduce(DataFrame.unionByName, parts)
    t = t.withColumn("p", dist.p_value(dist.kolmogorov_sf, F.col("ks"), F.col("n")))
    return t.select("column", r(F.col("ks")).alias("ks_stat"), r(F.col("p"), 6).alias("p_value"),
                    F.when(F.col("p") > 0.05, "Yes").otherwise("No").alias("normal"))


def _skew_z(g1, n):
    """z of D'Agostino's skewness test from population skewness."""
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (b2 - 1))
    delta = 1 / F.sqrt(0.5 * F.log(w2))
    alpha = F.sqrt(2 / (w2 - 1))
    return delta * F.log(y / alpha + F.sqrt(y * y / (alpha * alpha) + 1))


def _kurt_z(g2, n):
    """z of the Anscombe-Glynn kurtosis test from population excess kurtosis."""
    b2 = g2 + 3
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (b2 - mean) / F.sqrt(var)
    sb = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / sb * (2 / sb + F.sqrt(1 + 4 / (sb * sb)))
    base = (1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4)))
    root = F.signum(base) * F.pow(F.abs(base), F.lit(1 / 3))
    return ((1 - 2 / (9 * a)) - root) / F.sqrt(2 / (9 * a))


def moment_tests(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, n, dagostino, jarque_bera, skewness, kurtosis): all rows, one pass."""
    p = profile(df, cols, {"cnt": F.count, "g1": F.skewness, "g2": F.kurtosis, "skewness": skew_g1,
                           "kurtosis": kurt_g2}, numeric=True)
    n, g1, g2 = F.col("cnt").cast("double"), F.col("g1"), F.col("g2")
    zs, zk = _skew_z(g1, n), _kurt_z(g2, n)
    ok = n >= 8
    return p.select("column", F.col("cnt").alias("n"), F.when(ok, zs * zs + zk * zk).alias("dagostino"),
                    F.when(n > 0, n / 6 * (g1 * g1 + g2 * g2 / 4)).alias("jarque_bera"), "skewness", "kurtosis")


@operator("stats.normality_test")
def normality_test(df: DataFrame, column: str | None = None) -> DataFrame:
    """D'Agostino K2 and Jarque-Bera on all rows."""
    t = moment_tests(df, pick_many(df, column))
    t = t.withColumn("p", dist.p_value(dist.chi2_sf, F.col("dagostino"), F.lit(2)))
    t = t.withColumn("pj", dist.p_value(dist.chi2_sf, F.col("jarque_bera"), F.lit(2)))
    return t.select("column", r(F.col("dagostino")).alias("dagostino_stat"), r(F.col("p"), 6).alias("p_value"),
                    r(F.col("jarque_bera")).alias("jarque_bera_stat"), r(F.col("pj"), 6).alias("jarque_bera_p"),
                    F.when(F.col("p") > 0.05, "Yes").otherwise("No").alias("normal"),
                    r(F.col("skewness")).alias("skewness"), r(F.col("kurtosis")).alias("kurtosis"))


def anderson_darling(df: DataFrame, name: str, mean: float, std: float) -> DataFrame:
    """A2 against the fitted normal; tied values share one closed-form block of positions."""
    e = ecdf(df, name)
    total = df.agg(F.count(num(name)).alias("n"))
    z = (F.col("x") - F.lit(mean)) / F.lit(std)
    n, hi = F.col("n").cast("double"), F.col("upto").cast("double")
    lo = hi - F.col("count")
    # sum over i in (lo, hi] of (2i - 1) is hi^2 - lo^2; the mirrored weights follow from n - i
    w = hi * hi - lo * lo
    mirrored = 2 * n * F.col("count") - w
    low = F.log(F.greatest(dist.norm_cdf_expr(z), F.lit(1e-300)))
    high = F.log(F.greatest(dist.norm_cdf_expr(-z), F.lit(1e-300)))
    s = e.crossJoin(F.broadcast(total)).agg(F.sum(w * low + mirrored * high).alias("s"), F.max("n").alias("n"))
    return s.select((-F.col("n") - F.col("s") / F.col("n")).alias("a2"), "n")


# Fixed value: 5% point of the Anderson-Darling statistic for a fitted normal, before the size correction.
ANDERSON_5PCT = 0.787


@operator("stats.normality_comprehensive")
def normality_comprehensive(df: DataFrame, column: str | None = None) -> DataFrame:
    """D'Agostino, Jarque-Bera and Anderson-Darling on all rows; normal when two of three agree."""
    cols = pick_many(df, column)
    parts = []
    for c in cols:
        s = fit(df, m=F.avg(num(c)), s=F.stddev_samp(num(c)))
        if s["s"]:
            parts.append(anderson_darling(df, c, s["m"], s["s"]).select(F.lit(c).alias("column"), "a2",
                                                                        F.col("n").alias("an")))
    t = moment_tests(df, cols).join(F.broadcast(reduce(DataFrame.unionByName, parts)), "column")
    t = t.withColumn("pd", dist.p_value(dist.chi2_sf, F.col("dagostino"), F.lit(2)))
    t = t.withColumn("pj", dist.p_value(dist.chi2_sf, F.col("jarque_bera"), F.lit(2)))
    n = F.col("an")
    cv = r(ANDERSON_5PCT / (1 + 4 / n - 25 / (n * n)), 3)
    normal = F.col("a2") < cv
    votes = ((F.col("pd") > 0.05).cast("int") + (F.col("pj") > 0.05).cast("int") + normal.cast("int"))
    return t.select("column", r(F.col("dagostino")).alias("dagostino_stat"), r(F.col("pd"), 6).alias("dagostino_p"),
                    r(F.col("jarque_bera")).alias("jarque_bera_stat"), r(F.col("pj"), 6).alias("jarque_bera_p"),
                    r(F.col("a2")).alias("anderson_stat"), cv.alias("anderson_cv_5pct"),
                    F.when(normal, "Yes").otherwise("No").alias("anderson_normal"),
                    F.when(votes >= 2, "Normal").otherwise("Not normal").alias("consensus"))


@operator("stats.distribution_fit")
def distribution_fit(df: DataFrame, column: str | None = None) -> DataFrame:
    """Maximum-likelihood normal, lognormal and exponential fits, compared by their KS distance."""
    c = pick(df, column, "numeric")
    x = num(c)
    s = fit(df, m=F.avg(x), s=F.stddev_pop(x), lo=F.min(x), lm=F.avg(F.when(x > 0, F.log(x))),
            ls=F.stddev_pop(F.when(x > 0, F.log(x))))
    fits = {}
    if s["s"]:
        fits["normal"] = lambda v: dist.norm_cdf_expr((v - F.lit(s["m"])) / F.lit(s["s"]))
    if s["lo"] is not None and s["lo"] > 0 and s["ls"]:
        fits["lognormal"] = lambda v: dist.norm_cdf_expr((F.log(v) - F.lit(s["lm"])) / F.lit(s["ls"]))
    if s["lo"] is not None and s["m"] > s["lo"]:
        fits["exponential"] = lambda v: 1 - F.exp(-(v - F.lit(s["lo"])) / F.lit(s["m"] - s["lo"]))
    parts = [ks_distance(df, c, cdf).select(F.lit(k).alias("distribution"), "ks", "n") for k, cdf in fits.items()]
    if not parts:
        raise ValueError(f"column {c!r} is constant or empty")
    t = reduce(DataFrame.unionByName, parts)
    t = t.withColumn("p", dist.p_value(dist.kolmogorov_sf, F.col("ks"), F.col("n")))
    return t.select("distribution", r(F.col("ks")).alias("ks_stat"), r(F.col("p"), 6).alias("p_value")).orderBy(
        F.desc("p_value"), "ks_stat")


@operator("stats.confidence_interval")
def confidence_interval(df: DataFrame, confidence: float = 0.95, column: str | None = None) -> DataFrame:
    p = profile(df, pick_many(df, column), {"cnt": F.count, "mean": F.avg, "std": F.stddev_samp}, numeric=True)
    p = p.where(F.col("cnt") >= 2)
    half = dist.p_value(dist.t_ppf, F.lit(0.5 + confidence / 2), F.col("cnt") - 1) * F.col("std") / F.sqrt("cnt")
    p = p.withColumn("half", half)
    return p.select("column", r(F.col("mean")).alias("mean"), r(F.col("mean") - F.col("half")).alias("ci_lower"),
                    r(F.col("mean") + F.col("half")).alias("ci_upper"), F.lit(float(confidence)).alias("confidence"),
                    F.col("cnt").alias("n"))


def _bin_column(df: DataFrame, name: str, bins: int, levels: int):
    """Quantile bin of a numeric column, or the value itself for text."""
    if not is_numeric(df, name):
        return col(name).cast("string")
    few = df.select(num(name).alias("v")).where(F.col("v").isNotNull()).distinct().limit(levels + 1).count()
    if few <= levels:
        return col(name).cast("string")
    return bin_number(num(name), quantile_edges(df, name, bins)).cast("string")


def binned_mi(df: DataFrame, features: Sequence[str], target: str, bins: int = 10) -> DataFrame:
    """(feature, mi): mutual information in nats of quantile-binned features with the (binned) target."""
    y = _bin_column(df, target, bins, bins)
    structs = [F.struct(F.lit(f).alias("feature"), _bin_column(df, f, bins, bins).alias("u"), y.alias("v"))
               for f in features]
    cells = (df.select(F.inline(F.array(*structs))).where(F.col("u").isNotNull() & F.col("v").isNotNull())
             .groupBy("feature", "u", "v").agg(F.count(F.lit(1)).alias("o")))
    wf, wu, wv = (Window.partitionBy("feature", *k) for k in ([], ["u"], ["v"]))  # few cells: bins x levels
    t = cells.withColumns({"n": F.sum("o").over(wf), "nu": F.sum("o").over(wu), "nv": F.sum("o").over(wv)})
    mi = F.sum(F.col("o") / F.col("n") * F.log(F.col("o") * F.col("n") / (F.col("nu") * F.col("nv"))))
    return t.groupBy("feature").agg(F.greatest(mi, F.lit(0.0)).alias("mi"))


def mi_scores(df: DataFrame, features: Sequence[str], target: str, bins: int = 10, method: str = "bins", k: int = 3, classes: bool = False) -> DataFrame:
    """(feature, mi) by quantile bins or by the k nearest neighbours."""
    if method == "bins":
        return binned_mi(df, features, target, bins)
    if method == "neighbours":
        return neighbour_mi(df, features, target, k, classes)
    raise ValueError(f"unknown method {method!r}: bins or neighbours")


@operator("stats.mutual_info_report")
def mutual_info_report(df: DataFrame, column: str | None = None, bins: int = 10, method: str = "bins", k: int = 3) -> DataFrame:
    """(feature, mutual_info) in nats, largest first; ``method`` is bins or neighbours (k nearest rows, continuous target)."""
    nums = pick_many(df, None)
    target = resolve(df, column) if column else nums[-1]
    feats = [c for c in nums if c != target]
    return mi_scores(df, feats, target, bins, method, k).select("feature", r(F.col("mi")).alias("mutual_info")).orderBy(
        F.desc("mutual_info"), "feature")


def grouped_stats(df: DataFrame, group: str, value: str, aggs: dict, median: str | None = "median") -> DataFrame:
    """Named aggregates of a value per group, with an exact median."""
    out = df.where(col(group).isNotNull()).groupBy(col(group).alias(group)).agg(
        *[fn(num(value)).alias(k) for k, fn in aggs.items()])
    if median:
        q = quantiles(df.where(col(group).isNotNull()), [value], [0.5], [group])
        out = out.join(q.select(col(group), F.col("q0").alias(median)), group, "left")
    return out


@operator("stats.group_stats")
def group_stats(df: DataFrame, column: str | None = None, value_column: str | None = None) -> DataFrame:
    g, v = pick(df, column, "text"), pick(df, value_column, "numeric")
    t = grouped_stats(df, g, v, {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max})
    return t.select(col(g), "count", *[r(F.col(k)).alias(k) for k in ("mean", "std", "min", "median", "max")])


def with_half(df: DataFrame, order_by) -> DataFrame:
    """Add ``_second``: false for the first floor(n/2) rows in order."""
    ix = index_rows(df, order_by)
    return ix.df.withColumn("_second", F.col("_idx") >= ix.rows // 2).drop("_idx")


@operator("stats.stability_report")
def stability_report(df: DataFrame, order_by: Sequence[str] = ()) -> DataFrame:
    nums = pick_many(df, None)
    half = with_half(df, order_by)
    aggs, structs = [], []
    for i, c in enumerate(nums):
        a, b = F.when(~F.col("_second"), num(c)), F.when(F.col("_second"), num(c))
        aggs += [F.avg(a).alias(f"_a{i}"), F.avg(b).alias(f"_b{i}"), F.stddev_samp(a).alias(f"_s{i}"),
                 F.stddev_samp(b).alias(f"_t{i}")]
        structs.append(F.struct(F.lit(c).alias("column"), F.col(f"_a{i}").alias("m1"), F.col(f"_b{i}").alias("m2"),
                                F.col(f"_s{i}").alias("s1"), F.col(f"_t{i}").alias("s2")))
    t = rows_of(half.agg(*aggs), structs)
    drift = F.abs(F.col("m1") - F.col("m2")) / F.greatest(F.abs("m1"), F.lit(1e-10))
    return t.select("column", r(F.col("m1")).alias("mean_first"), r(F.col("m2")).alias("mean_second"),
                    r(F.col("s1")).alias("std_first"), r(F.col("s2")).alias("std_second"),
                    r(drift * 100, 2).alias("mean_drift_pct"),
                    F.when(drift < 0.1, "Yes").otherwise("No").alias("stable")).orderBy(
        F.desc("mean_drift_pct"), "column")


def autocorrelations(df: DataFrame, name: str, order_by, lags: Sequence[int]) -> DataFrame:
    """(lag, r): Pearson correlation of the non-null series with its lagged self."""
    ix = index_rows(df.where(num(name).isNotNull()), order_by)
    lags = [k for k in lags if k < ix.rows]
    x = num(name)
    t = ix.windowed(lambda w: {f"_l{k}": F.lag(x, k).over(w) for k in lags}, before=max(lags, default=0)).df
    one = t.agg(*[safe_corr(F.when(F.col(f"_l{k}").isNotNull(), x), F.col(f"_l{k}")).alias(f"_{k}") for k in lags])
    return rows_of(one, [F.struct(F.lit(k).cast("long").alias("lag"), F.col(f"_{k}").alias("r")) for k in lags])


@operator("stats.time_stats")
def time_stats(df: DataFrame, column: str | None = None, order_by: Sequence[str] = ()) -> DataFrame:
    c = pick(df, column, "numeric")
    a = autocorrelations(df, c, order_by, [1, 2, 5, 10])
    half = with_half(df.where(num(c).isNotNull()), order_by)
    m = half.agg(F.avg(F.when(~F.col("_second"), num(c))).alias("m1"), F.avg(F.when(F.col("_second"), num(c))).alias("m2"))
    drift = F.abs(F.col("m1") - F.col("m2")) / F.greatest(F.abs("m1"), F.lit(1e-10))
    return a.crossJoin(F.broadcast(m)).select(
        "lag", r(F.col("r")).alias("autocorrelation"),
        F.when(drift < 0.1, "Likely stationary").otherwise("Non-stationary hint").alias("stationarity"))


@operator("stats.cluster_tendency")
def cluster_tendency(df: DataFrame, probes: int = 200, seed: int = 42) -> DataFrame:
    """Hopkins statistic: every row meets only the probe points (at most 2 x ``probes``).

    The second smallest distance of a probe is kept by a pre-aggregated top two, so
    no pair of rows is ever stored.
    """
    nums = pick_many(df, None)
    if len(nums) < 2:
        raise ValueError("two numeric columns are needed")
    data = df.select(*[num(c).alias(c) for c in nums]).na.drop()
    s = fit(data, **{f"a{i}": F.min(col(c)) for i, c in enumerate(nums)},
            **{f"b{i}": F.max(col(c)) for i, c in enumerate(nums)}, n=F.count(F.lit(1)))
    if s["n"] < 10:
        raise ValueError("ten complete rows are needed")
    m = min(s["n"], probes)
    drawn = data.orderBy(*hash_order(data, seed)).limit(m).collect()  # at most ``probes`` rows
    rng = np.random.default_rng(seed)
    lo, hi = np.array([s[f"a{i}"] for i in range(len(nums))]), np.array([s[f"b{i}"] for i in range(len(nums))])
    real = np.array([[float(x[c]) for c in nums] for x in drawn])
    points = np.vstack([rng.uniform(lo, hi, (m, len(nums))), real])
    kind = np.repeat([0, 1], m)

    def nearest(batches):
        import pandas as pd

        best = np.full((len(points), 2), np.inf)
        for pdf in batches:
            x = pdf[nums].to_numpy(dtype=float)
            for start in range(0, len(x), 2048):
                part = x[start:start + 2048]
                d = np.sqrt(((points[:, None, :] - part[None, :, :]) ** 2).sum(axis=2))
                best = np.sort(np.hstack([best, np.sort(d, axis=1)[:, :2]]), axis=1)[:, :2]
        yield pd.DataFrame({"probe": np.repeat(np.arange(len(points)), 2), "kind": np.repeat(kind, 2),
                            "d": best.ravel()})

    near = data.mapInPandas(nearest, "probe long, kind long, d double")
    two = near.groupBy("probe", "kind").agg(F.array_sort(F.collect_list("d"))[1].alias("d2"))  # 2 values per task
    t = two.agg(F.sum(F.when(F.col("kind") == 0, F.col("d2"))).alias("u"),
                F.sum(F.when(F.col("kind") == 1, F.col("d2"))).alias("w"))
    h = r(F.col("u") / (F.col("u") + F.col("w")))
    return t.select(h.alias("hopkins_stat"), F.when(h > 0.5, "Clusterable").otherwise("Uniform (not clusterable)")
                    .alias("interpretation"), F.lit(len(nums)).cast("long").alias("n_features"))
