"""Feature engineering."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.columns import (col, is_numeric, is_time, num, numeric_cols, pick, pick_many, pick_pair, resolve,
                                resolve_all, text_cols, time_cols)
from quillframe.functions import dist
from quillframe.functions.bins import bin_number, equal_edges, quantile_edges
from quillframe.functions.dates import parse
from quillframe.functions.forest import importances, is_class_target, labelled
from quillframe.functions.gram import moment_matrix
from quillframe.functions.levels import attach, level_stats
from quillframe.functions.ordered import Indexed, index_rows, reliable_checkpoint
from quillframe.functions.power import best_lambda, box_cox, yeo_johnson
from quillframe.functions.profile import fit, nulls, r, safe_corr, skew_g1
from quillframe.functions.quantile import fit_quantiles
from quillframe.functions.ranks import with_rank
from quillframe.functions.running import expanding_median, weighted_moments
from quillframe.functions.scale import clip_columns, moments, quantile_bounds, shift_scale
from quillframe.functions.tokens import spaced
from quillframe.operators.clean import rare_to_other
from quillframe.operators.stats import anova_table, correlations, group_moments, levels_of, mi_scores
from quillframe.operators.transform import frequency_encoded, level_codes, rolling_exprs
from quillframe.registry import operator

# Month-day of the fixed holidays.
HOLIDAYS = ("01-01", "07-04", "12-25", "12-31", "01-26", "05-01")
# Period length suggested by a column name.
NAME_PERIODS = {"month": 12, "day": 31, "hour": 24, "weekday": 7, "dow": 7, "quarter": 4, "minute": 60}


def column_facts(df: DataFrame, cols: Sequence[str]) -> dict[str, dict]:
    """min, max, skew and nulls of each column in one pass."""
    s = fit(df, **{f"a{i}": F.min(num(c)) for i, c in enumerate(cols)}, **{f"b{i}": F.max(num(c)) for i, c in enumerate(cols)},
            **{f"s{i}": skew_g1(num(c)) for i, c in enumerate(cols)}, **{f"n{i}": nulls(col(c)) for i, c in enumerate(cols)})
    return {c: {"min": s[f"a{i}"], "max": s[f"b{i}"], "skew": s[f"s{i}"] or 0.0, "nulls": s[f"n{i}"]} for i, c in enumerate(cols)}


def unary(df: DataFrame, column: str | None, suffix: str, given, auto=None, keep=None) -> DataFrame:
    """Add ``<column><suffix>``: ``given`` for a named column, else ``auto`` on every column passing ``keep``."""
    if column is not None:
        c = resolve(df, column)
        return df.withColumn(f"{c}{suffix}", given(num(c)))
    cols = pick_many(df, None)
    if keep is not None:
        facts = column_facts(df, cols)
        cols = [c for c in cols if facts[c]["min"] is not None and keep(facts[c])]
    return df.withColumns({f"{c}{suffix}": (auto or given)(num(c)) for c in cols}) if cols else df


def full_non_negative(f: dict) -> bool:
    return f["min"] >= 0 and f["nulls"] == 0


@operator("feature.abs_transform")
def abs_transform(df: DataFrame, column: str | None = None) -> DataFrame:
    return unary(df, column, "_abs", F.abs, keep=lambda f: f["min"] < 0)


@operator("feature.log_transform")
def log_transform(df: DataFrame, column: str | None = None) -> DataFrame:
    return unary(df, column, "_log", F.log1p, keep=lambda f: abs(f["skew"]) > 1 and full_non_negative(f))


@operator("feature.log1p_transform")
def log1p_transform(df: DataFrame, column: str | None = None) -> DataFrame:
    return unary(df, column, "_log1p", lambda x: F.log1p(F.when(x < 0, 0.0).otherwise(x)), F.log1p, full_non_negative)


@operator("feature.sqrt_transform")
def sqrt_transform(df: DataFrame, column: str | None = None) -> DataFrame:
    return unary(df, column, "_sqrt", lambda x: F.sqrt(F.when(x < 0, 0.0).otherwise(x)), F.sqrt,
                 lambda f: abs(f["skew"]) > 0.5 and full_non_negative(f))


@operator("feature.exponential_transform")
def exponential_transform(df: DataFrame, column: str | None = None) -> DataFrame:
    return unary(df, column, "_exp", lambda x: F.exp(F.when(x > 700, 700.0).otherwise(x)), F.exp, lambda f: f["max"] <= 700)


@operator("feature.reciprocal_transform")
def reciprocal_transform(df: DataFrame, column: str | None = None) -> DataFrame:
    return unary(df, column, "_reciprocal", lambda x: F.round(1 / F.when(x != 0, x), 6))


def positive_columns(df: DataFrame, column: str | None) -> list[str]:
    cols = pick_many(df, column)
    facts = column_facts(df, cols)
    cols = [c for c in cols if facts[c]["min"] is not None and facts[c]["min"] > 0]
    if not cols:
        raise ValueError("no strictly positive numeric column")
    return cols


@operator("feature.boxcox_transform")
def boxcox_transform(df: DataFrame, column: str | None = None) -> DataFrame:
    cols = positive_columns(df, column)
    lam = {c: best_lambda(df, num(c), box_cox, F.log(num(c))) for c in cols}
    return df.withColumns({f"{c}_boxcox": F.round(box_cox(num(c), lam[c]), 4) for c in cols})


def power_fit(df: DataFrame, cols: Sequence[str], method: str) -> dict[str, tuple]:
    """(expression, mean, population std) of the fitted transform of each column, over complete rows."""
    rows = df.select(*[num(c).alias(c) for c in cols]).na.drop()
    out = {}
    for c in cols:
        x = num(c)
        fn = yeo_johnson if method == "yeo-johnson" else box_cox
        jac = F.signum(x) * F.log1p(F.abs(x)) if method == "yeo-johnson" else F.log(x)
        y = fn(x, best_lambda(rows, x, fn, jac))
        s = fit(rows, m=F.avg(y), s=F.stddev_pop(y))
        out[c] = (y, s["m"], s["s"] or 1.0)
    return out


def complete(cols: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & col(c).isNotNull()
    return out


@operator("feature.yeo_johnson_transform")
def yeo_johnson_transform(df: DataFrame, column: str | None = None) -> DataFrame:
    cols = pick_many(df, column)
    fits = power_fit(df, cols, "yeo-johnson")
    return df.withColumns({f"{c}_yeojohnson": F.when(complete(cols), F.round((y - F.lit(m)) / F.lit(s), 4))
                           for c, (y, m, s) in fits.items()})


@operator("feature.power_transform")
def power_transform(df: DataFrame, column: str | None = None, method: str = "yeo-johnson") -> DataFrame:
    if method not in ("yeo-johnson", "box-cox"):
        raise ValueError(f"unknown method {method!r}")
    cols = pick_many(df, column)
    fits = power_fit(df, cols, method)
    return df.withColumns({c: F.when(complete(cols), (y - F.lit(m)) / F.lit(s)).otherwise(num(c)) for c, (y, m, s) in fits.items()})


def knots(df: DataFrame, name: str, n: int, accuracy: int) -> list[float]:
    """n evenly spaced quantiles by a sketch whose rank error is at most rows / ``accuracy``."""
    grid = [i / (n - 1) for i in range(n)]
    return list(df.agg(F.percentile_approx(num(name), F.lit(grid), F.lit(accuracy)).alias("q")).first()["q"])


@lru_cache(maxsize=1)
def _normal_table() -> tuple[np.ndarray, np.ndarray]:
    z = np.linspace(-5.25, 5.25, 42_001)
    return np.array([NormalDist().cdf(v) for v in z]), z


def quantile_share(q: np.ndarray, normal: bool):
    """Position of a value among the quantile knots, as a uniform or normal score."""
    p = np.linspace(0, 1, len(q))

    @F.pandas_udf("double")
    def share(x: pd.Series) -> pd.Series:
        u = (np.interp(x, q, p) - np.interp(-x, -q[::-1], -p[::-1])) / 2
        if normal:
            u = np.interp(np.clip(u, 1e-7, 1 - 1e-7), *_normal_table())
        return pd.Series(u, index=x.index).where(x.notna())

    return share


@operator("feature.quantile_transform")
def quantile_transform(df: DataFrame, column: str | None = None, distribution: str = "normal", n_quantiles: int = 1000, accuracy: int = 100_000) -> DataFrame:
    """Empirical quantile of a value (ties get the middle), mapped to uniform or normal; knots have rank error rows / ``accuracy``."""
    cols = pick_many(df, column)
    new = {}
    for c in cols:
        n = min(n_quantiles, df.where(num(c).isNotNull()).limit(n_quantiles).count())
        if n < 2:
            raise ValueError(f"column {c!r} has fewer than two values")
        new[c] = quantile_share(np.array(knots(df, c, n, accuracy)), distribution == "normal")(num(c))
    return df.withColumns(new)


def share_rank(df: DataFrame, cols: Sequence[str], suffix: str, factor: float, digits: int) -> DataFrame:
    counts = fit(df, **{f"n{i}": F.count(num(c)) for i, c in enumerate(cols)})
    out = df
    for i, c in enumerate(cols):
        out = with_rank(out, c, out="_rank").withColumn(
            f"{c}{suffix}", F.round(F.col("_rank") / F.lit(float(counts[f"n{i}"] or 1)) * factor, digits)).drop("_rank")
    return out


@operator("feature.rank_transform")
def rank_transform(df: DataFrame, column: str | None = None) -> DataFrame:
    return share_rank(df, pick_many(df, column), "_pctrank", 1.0, 4)


@operator("feature.percentile_rank")
def percentile_rank(df: DataFrame, column: str | None = None) -> DataFrame:
    return share_rank(df, pick_many(df, column), "_pct_rank", 100.0, 2)


@operator("feature.zscore_features")
def zscore_features(df: DataFrame, column: str | None = None) -> DataFrame:
    s = moments(df, pick_many(df, column))
    return df.withColumns({f"{c}_zscore": r((num(c) - F.lit(m)) / F.lit(sd)) for c, (m, sd) in s.items() if sd})


@operator("feature.distance_from_mean")
def distance_from_mean(df: DataFrame, column: str | None = None, method: str = "mean") -> DataFrame:
    cols = pick_many(df, column)
    centre = {c: m for c, (m, _) in moments(df, cols).items()} if method == "mean" else {
        c: q[0] for c, q in fit_quantiles(df, cols, [0.5]).items()}
    return df.withColumns({f"{c}_dist_{method}": r(num(c) - F.lit(v)) for c, v in centre.items()})


@operator("feature.clip_features")
def clip_features(df: DataFrame, column: str | None = None, lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    return clip_columns(df, quantile_bounds(df, pick_many(df, column), lower, upper))


@operator("feature.winsorize")
def winsorize(df: DataFrame, column: str | None = None, lower: float = 0.05, upper: float = 0.95) -> DataFrame:
    return clip_columns(df, quantile_bounds(df, pick_many(df, column), lower, upper))


def interval_label(lo: float, hi: float) -> str:
    return f"({lo:.6g}, {hi:.6g}]"


@operator("feature.bin_numeric")
def bin_numeric(df: DataFrame, column: str | None = None, n: int = 5, labels: Sequence[str] | None = None) -> DataFrame:
    c = pick(df, column, "numeric")
    edges = equal_edges(df, c, n)
    names = list(labels) if labels and len(labels) == n else [interval_label(a, b) for a, b in zip(edges, edges[1:])]
    return df.withColumn(f"{c}_bin", F.get(F.lit(names), bin_number(num(c), edges, lowest=False)))


def kbin_edges(df: DataFrame, name: str, n: int, strategy: str) -> list[float]:
    if strategy == "quantile":
        return quantile_edges(df, name, n)
    s = fit(df, a=F.min(num(name)), b=F.max(num(name)))
    if strategy == "uniform":
        return [s["a"] + (s["b"] - s["a"]) * i / n for i in range(n + 1)]
    if strategy != "kmeans":
        raise ValueError(f"unknown strategy {strategy!r}")
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(df.select(num(name).alias("x")).na.drop())
    centres = sorted(float(v[0]) for v in KMeans(k=n, seed=42).fit(rows).clusterCenters())
    return [s["a"], *[(a + b) / 2 for a, b in zip(centres, centres[1:])], s["b"]]


@operator("feature.kbins_discretize")
def kbins_discretize(df: DataFrame, column: str | None = None, n: int = 5, strategy: str = "quantile") -> DataFrame:
    """Left-closed ordinal bins over rows that are complete in the chosen columns."""
    cols = pick_many(df, column)
    rows = df.where(complete(cols))
    new = {}
    for c in cols:
        inner = kbin_edges(rows, c, n, strategy)[1:-1]
        number = sum((F.when(num(c) >= F.lit(float(e)), 1).otherwise(0) for e in inner), F.lit(0))
        new[f"{c}_kbin"] = F.when(complete(cols), number)
    return df.withColumns(new)


@operator("feature.target_binary_encode")
def target_binary_encode(df: DataFrame, column: str | None = None) -> DataFrame:
    c = pick(df, column, "numeric")
    m = fit_quantiles(df, [c], [0.5])[c][0]
    return df.withColumn(f"{c}_binary", F.coalesce((num(c) >= F.lit(m)).cast("int"), F.lit(0)))


@operator("feature.ordinal_encode")
def ordinal_encode(df: DataFrame, column: str | None = None) -> DataFrame:
    out = df
    for c in pick_many(df, column, "text"):
        out = attach(out, level_codes(df, c), c).withColumnRenamed("_code", f"{c}_ordinal")
    return out


@operator("feature.count_encode")
def count_encode(df: DataFrame, column: str | None = None) -> DataFrame:
    out = df
    for c in pick_many(df, column, "text"):
        out = attach(out, level_stats(df, c, _n=F.count(F.lit(1))), c).withColumnRenamed("_n", f"{c}_count")
    return out


@operator("feature.frequency_encode")
def frequency_encode(df: DataFrame, column: str | None = None) -> DataFrame:
    """Share among non-null values; null stays null."""
    out = df
    for c in pick_many(df, column, "text"):
        name = f"{c}_freq"
        out = frequency_encoded(out, c, name, True).withColumn(name, F.when(col(c).isNotNull(), r(col(name))))
    return out


@operator("feature.rare_category_encode")
def rare_category_encode(df: DataFrame, column: str | None = None, min_count: int = 5) -> DataFrame:
    out = df
    for c in pick_many(df, column, "text"):
        out = rare_to_other(out, c, min_count, "Other", c)
    return out.select(*[col(c) for c in df.columns])


@operator("feature.hash_encode")
def hash_encode(df: DataFrame, column: str | None = None, n: int = 8) -> DataFrame:
    return df.withColumns({f"{c}_hash{i}": F.pmod(F.xxhash64(col(c).cast("string"), F.lit(i)), F.lit(2)).cast("int")
                           for c in pick_many(df, column, "text") for i in range(n)})


@operator("feature.label_binarize")
def label_binarize(df: DataFrame, column: str | None = None, max_levels: int = 1000) -> DataFrame:
    """One 0/1 column per class; two classes share one column, as one is the complement of the other."""
    c = pick(df, column, "category")
    value = F.coalesce(col(c).cast("string"), F.lit("__MISSING__"))
    levels = levels_of(df.select(value.alias("v")), "v", max_levels)
    if len(levels) == 2:
        return df.withColumns({f"{c}_{v}": (value == F.lit(levels[1])).cast("int") for v in levels})
    return df.withColumns({f"{c}_{v}": (value == F.lit(v)).cast("int") for v in levels})


@operator("feature.target_encode")
def target_encode(df: DataFrame, target: str | None = None, column: str | None = None, encode_column: str | None = None) -> DataFrame:
    y = resolve(df, target or column) if (target or column) else numeric_cols(df)[-1]
    overall = fit(df, m=F.avg(num(y)))["m"]
    out = df
    for c in (c for c in pick_many(df, encode_column, "text") if c != y):
        out = attach(out, level_stats(df, c, _m=F.avg(num(y))), c).withColumn(
            f"{c}_target_enc", F.coalesce("_m", F.lit(overall))).drop("_m")
    return out


@operator("feature.woe_encode")
def woe_encode(df: DataFrame, column: str | None = None, target: str | None = None) -> DataFrame:
    if target is None:
        raise ValueError("target is required")
    c, y = pick(df, column, "text"), resolve(df, target)
    s = fit(df, k=F.count_distinct(col(y)), e=F.sum(num(y)), n=F.count(F.lit(1)))
    if s["k"] != 2:
        raise ValueError("target must have two values")
    events, others = s["e"], s["n"] - s["e"]
    table = level_stats(df, c, _e=F.coalesce(F.sum(num(y)), F.lit(0.0)), _n=F.count(F.lit(1)))
    de = F.greatest(F.col("_e") / F.lit(float(events)), F.lit(1e-4)) if events > 0 else F.lit(1e-4)
    dn = F.greatest((F.col("_n") - F.col("_e")) / F.lit(float(others)), F.lit(1e-4)) if others > 0 else F.lit(1e-4)
    return attach(df, table.select("value", r(F.log(dn / de)).alias(f"{c}_woe")), c)


@operator("feature.feature_cross")
def feature_cross(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    a, b = pick_pair(df, columns, "text")
    return df.withColumn(f"{a}_x_{b}", F.concat(col(a).cast("string"), F.lit("_x_"), col(b).cast("string")))


def chosen(df: DataFrame, columns) -> list[str]:
    return resolve_all(df, columns) if columns else pick_many(df, None)


@operator("feature.interaction_features")
def interaction_features(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.withColumns({f"{a}_x_{b}": num(a) * num(b) for a, b in combinations(chosen(df, columns), 2)})


@operator("feature.polynomial_features")
def polynomial_features(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return interaction_features(df, chosen(df, columns))


@operator("feature.ratio_features")
def ratio_features(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.withColumns({f"{a}_per_{b}": r(num(a) / F.when(num(b) != 0, num(b))) for a, b in combinations(chosen(df, columns), 2)})


@operator("feature.aggregation_features")
def aggregation_features(df: DataFrame, column: str | None = None, agg_column: str | None = None) -> DataFrame:
    g = pick(df, column, "text")
    cols = [resolve(df, agg_column)] if agg_column else [c for c in numeric_cols(df) if c != g]
    aggs = {}
    for c in cols:
        aggs |= {f"{c}_mean_by_{g}": r(F.avg(num(c))), f"{c}_std_by_{g}": r(F.stddev_samp(num(c))), f"{c}_count_by_{g}": F.count(num(c))}
    return attach(df, level_stats(df, g, **aggs), g)


@operator("feature.is_null_features")
def is_null_features(df: DataFrame) -> DataFrame:
    s = fit(df, **{f"n{i}": nulls(col(c)) for i, c in enumerate(df.columns)})
    new = {f"{c}_is_null": col(c).isNull().cast("int") for i, c in enumerate(df.columns) if s[f"n{i}"]}
    return df.withColumns(new) if new else df


@operator("feature.is_zero_features")
def is_zero_features(df: DataFrame) -> DataFrame:
    cols = pick_many(df, None)
    s = fit(df, **{f"n{i}": F.count_if(col(c) == 0) for i, c in enumerate(cols)})
    new = {f"{c}_is_zero": F.coalesce((col(c) == 0).cast("int"), F.lit(0)) for i, c in enumerate(cols) if s[f"n{i}"]}
    return df.withColumns(new) if new else df


def ordered_columns(df: DataFrame, column) -> list[str]:
    return [resolve(df, column)] if column else pick_many(df, None)


@operator("feature.lag_features")
def lag_features(df: DataFrame, column: str | None = None, lags: Sequence[int] | int = (1, 2, 3), order_by: Sequence[str] = (),
                 partition_by=None) -> DataFrame:
    steps = list(range(1, lags + 1)) if isinstance(lags, int) else list(lags)
    cols = ordered_columns(df, column)
    return index_rows(df, order_by, partition_by).windowed(
        lambda w: {f"{c}_lag{k}": F.lag(col(c), k).over(w) for c in cols for k in steps}, before=max(steps)).result()


@operator("feature.diff_features")
def diff_features(df: DataFrame, column: str | None = None, periods: int = 1, order_by: Sequence[str] = (), partition_by=None) -> DataFrame:
    cols = ordered_columns(df, column)
    return index_rows(df, order_by, partition_by).windowed(
        lambda w: {f"{c}_diff{periods}": col(c) - F.lag(col(c), periods).over(w) for c in cols}, before=periods).result()


def stats_list(stats) -> list[str]:
    return [s.strip() for s in stats.split(",")] if isinstance(stats, str) else list(stats)


@operator("feature.rolling_window")
def rolling_window(df: DataFrame, window: int = 7, column: str | None = None, stats: Sequence[str] = ("mean", "std", "min", "max"),
                   order_by: Sequence[str] = (), partition_by=None) -> DataFrame:
    cols = pick_many(df, column)
    return index_rows(df, order_by, partition_by).windowed(
        lambda w: {k: v for c in cols for k, v in rolling_exprs(c, w, window, stats_list(stats), f"{c}_rolling{window}_{{stat}}").items()},
        before=window - 1).result()


@operator("feature.rolling_stats_features")
def rolling_stats_features(df: DataFrame, column: str | None = None, window: int = 3, order_by: Sequence[str] = (),
                           partition_by=None) -> DataFrame:
    cols = ordered_columns(df, column)
    return index_rows(df, order_by, partition_by).windowed(
        lambda w: {k: v for c in cols for k, v in rolling_exprs(
            c, w, window, ["mean", "std", "min", "max"], f"{c}_roll{window}_{{stat}}", 4).items()}, before=window - 1).result()


def expanding(df: DataFrame, cols: Sequence[str], order_by, partition_by) -> Indexed:
    """Running count, sum, centred sums, min and max of each column (``_n0``, ``_s0``, ``_q0``, ``_a0``, ``_b0``...)."""
    centre = {c: m for c, (m, _) in moments(df, cols).items()}
    d = {c: num(c) - F.lit(centre.get(c, 0.0)) for c in cols}
    sums, maxs, mins = {}, {}, {}
    for i, c in enumerate(cols):
        sums |= {f"_n{i}": num(c).isNotNull().cast("long"), f"_s{i}": num(c), f"_d{i}": d[c], f"_q{i}": d[c] * d[c]}
        maxs[f"_b{i}"], mins[f"_a{i}"] = num(c), num(c)
    return index_rows(df, order_by, partition_by).running(sums=sums, maxs=maxs, mins=mins)


@operator("feature.expanding_window")
def expanding_window(df: DataFrame, column: str | None = None, stats: Sequence[str] = ("mean", "std", "min", "max"),
                     order_by: Sequence[str] = (), partition_by=None) -> DataFrame:
    cols = pick_many(df, column)
    names = stats_list(stats)
    known = {"mean", "std", "min", "max", "sum", "median"}
    if not set(names) <= known:
        raise ValueError(f"unknown statistics {sorted(set(names) - known)}")
    out, new = expanding(df, cols, order_by, partition_by), {}
    if "median" in names:
        ix = Indexed(reliable_checkpoint(out.df), out.rows, out.keys)
        for i, c in enumerate(cols):
            ix = expanding_median(ix, num(c), f"_m{i}")
        out = ix
    out = out.df
    for i, c in enumerate(cols):
        n, dev = F.col(f"_n{i}"), F.col(f"_q{i}") - F.col(f"_d{i}") * F.col(f"_d{i}") / F.col(f"_n{i}")
        exprs = {"mean": F.col(f"_s{i}") / F.when(n > 0, n), "sum": F.col(f"_s{i}"), "min": F.col(f"_a{i}"), "max": F.col(f"_b{i}"), "median": F.col(f"_m{i}") if "median" in names else None,
                 "std": F.sqrt(F.greatest(dev, F.lit(0.0)) / F.when(n > 1, n - 1))}
        new |= {f"{c}_expanding_{s}": exprs[s] for s in names}
    return out.withColumns(new).select(*[col(c) for c in df.columns], *[col(k) for k in new])


@operator("feature.cumulative_features")
def cumulative_features(df: DataFrame, column: str | None = None, order_by: Sequence[str] = (), partition_by=None) -> DataFrame:
    c = pick(df, column, "numeric")
    out = expanding(df, [c], order_by, partition_by).df
    here = num(c).isNotNull()
    new = {f"{c}_cumsum": F.when(here, F.col("_s0")), f"{c}_cummean": F.col("_s0") / F.when(F.col("_n0") > 0, F.col("_n0")),
           f"{c}_cummax": F.when(here, F.col("_b0")), f"{c}_cummin": F.when(here, F.col("_a0"))}
    return out.withColumns(new).select(*[col(x) for x in df.columns], *[col(k) for k in new])


@operator("feature.ewm_features")
def ewm_features(df: DataFrame, column: str | None = None, span: float = 5, order_by: Sequence[str] = (), partition_by=None) -> DataFrame:
    """Exponentially weighted mean and std of all rows so far (see ``functions.running.weighted_moments``)."""
    cols = ordered_columns(df, column)
    centre = {c: m for c, (m, _) in moments(df, cols).items()}  # keeps squares small; added again below
    ix = index_rows(df, order_by, partition_by)
    out = weighted_moments(ix, {f"_e{i}": num(c).cast("double") - F.lit(centre.get(c, 0.0)) for i, c in enumerate(cols)}, 2 / (span + 1)).df
    new = {}
    for i, c in enumerate(cols):
        new |= {f"{c}_ewm_mean": F.round(F.col(f"_e{i}_mean") + F.lit(centre.get(c, 0.0)), 4), f"{c}_ewm_std": F.round(F.col(f"_e{i}_std"), 4)}
    return out.withColumns(new).select(*[col(c) for c in df.columns], *[col(k) for k in new])


def stamps(df: DataFrame, column: str | None) -> tuple[DataFrame, list[str]]:
    """The named column as a timestamp, or every timestamp column."""
    if column is None:
        return df, pick_many(df, None, "time")
    c = resolve(df, column)
    return (df if is_time(df, c) else df.withColumn(c, parse(col(c).cast("string")))), [c]


def max_hours(df: DataFrame, cols: Sequence[str]) -> list[int]:
    s = fit(df, **{f"h{i}": F.max(F.hour(col(c))) for i, c in enumerate(cols)})
    return [s[f"h{i}"] or 0 for i in range(len(cols))]


@operator("feature.datetime_features")
def datetime_features(df: DataFrame, column: str | None = None) -> DataFrame:
    df, cols = stamps(df, column)
    new = {}
    for c, h in zip(cols, max_hours(df, cols)):
        new |= {f"{c}_year": F.year(col(c)), f"{c}_month": F.month(col(c)), f"{c}_day": F.dayofmonth(col(c)), f"{c}_dayofweek": F.weekday(col(c))}
        if h:
            new[f"{c}_hour"] = F.hour(col(c))
    return df.withColumns(new)


def wave(x: Column, period: float) -> tuple[Column, Column]:
    a = F.lit(2 * math.pi) * x / F.lit(float(period))
    return F.sin(a), F.cos(a)


@operator("feature.cyclical_encode")
def cyclical_encode(df: DataFrame, column: str | None = None, period: float | None = None) -> DataFrame:
    c = pick(df, column, "numeric")
    x = col(c).try_cast("double")
    if period is None:
        top = fit(df, m=F.max(x))["m"]
        period = int(top) + 1 if top and top > 0 else 12
    s, k = wave(x, period)
    return df.withColumns({f"{c}_sin": r(s), f"{c}_cos": r(k)})


@operator("feature.seasonal_features")
def seasonal_features(df: DataFrame, column: str | None = None) -> DataFrame:
    new = {}
    if column is not None or time_cols(df):
        df, cols = stamps(df, column)
        for c, h in zip(cols, max_hours(df, cols)):
            parts = {"month": (F.month(col(c)), 12), "dow": (F.weekday(col(c)), 7), "day": (F.dayofmonth(col(c)), 31)}
            if h:
                parts["hour"] = (F.hour(col(c)), 24)
            for name, (x, p) in parts.items():
                new[f"{c}_{name}_sin"], new[f"{c}_{name}_cos"] = wave(x, p)
    else:
        for c in numeric_cols(df):
            p = next((v for k, v in NAME_PERIODS.items() if k in c.lower()), None)
            if p:
                new[f"{c}_sin"], new[f"{c}_cos"] = wave(num(c), p)
    if not new:
        raise ValueError("no date column and no column named after a period")
    return df.withColumns(new)


@operator("feature.sin_cos_hour")
def sin_cos_hour(df: DataFrame, column: str | None = None) -> DataFrame:
    c = pick(df, column, "time")
    s, k = wave(F.hour(col(c)) if is_time(df, c) else col(c).try_cast("double"), 24)
    return df.withColumns({f"{c}_hour_sin": r(s), f"{c}_hour_cos": r(k)})


@operator("feature.is_weekend")
def is_weekend(df: DataFrame, column: str | None = None) -> DataFrame:
    df, cols = stamps(df, column)
    return df.withColumns({f"{c}_is_weekend": F.coalesce((F.weekday(col(c)) >= 5).cast("int"), F.lit(0)) for c in cols})


@operator("feature.is_holiday")
def is_holiday(df: DataFrame, column: str | None = None) -> DataFrame:
    df, cols = stamps(df, column)
    return df.withColumns({f"{c}_is_holiday": F.coalesce(
        ((F.weekday(col(c)) >= 5) | F.date_format(col(c), "MM-dd").isin(*HOLIDAYS)).cast("int"), F.lit(0)) for c in cols})


@operator("feature.time_since")
def time_since(df: DataFrame, column: str | None = None, reference: str | None = None) -> DataFrame:
    """Whole days since the reference date, or since the earliest date of the column."""
    df, cols = stamps(df, column)
    if reference is not None:
        base = {c: F.unix_micros(F.lit(reference).cast("timestamp")) for c in cols}
    else:
        s = fit(df, **{f"m{i}": F.min(F.unix_micros(col(c).cast("timestamp"))) for i, c in enumerate(cols)})
        base = {c: F.lit(s[f"m{i}"]) for i, c in enumerate(cols)}
    return df.withColumns({f"{c}_days_since": F.floor((F.unix_micros(col(c).cast("timestamp")) - base[c]) / F.lit(86_400_000_000))
                           for c in cols})


@operator("feature.string_length_features")
def string_length_features(df: DataFrame, column: str | None = None, max_columns: int | None = None) -> DataFrame:
    new = {}
    for c in pick_many(df, column, "text")[:max_columns]:
        new |= {f"{c}_char_len": F.length(col(c)), f"{c}_word_count": F.size(spaced(col(c)))}
    return df.withColumns(new)


@operator("feature.text_features")
def text_features(df: DataFrame, column: str | None = None) -> DataFrame:
    new = {}
    for c in pick_many(df, column, "text"):
        s = F.coalesce(col(c), F.lit(""))
        n = F.length(s)
        new |= {f"{c}_len": n, f"{c}_word_count": F.size(spaced(s)), f"{c}_digit_count": F.regexp_count(s, F.lit(r"(?U)\d")),
                f"{c}_upper_ratio": r(F.regexp_count(s, F.lit("[A-Z]")) / F.greatest(n, F.lit(1)))}
    return df.withColumns(new)


def variances(df: DataFrame, cols: Sequence[str], fn=F.var_samp) -> dict[str, float]:
    s = fit(df, **{f"v{i}": fn(num(c)) for i, c in enumerate(cols)})
    return {c: s[f"v{i}"] for i, c in enumerate(cols)}


@operator("feature.variance_filter")
def variance_filter(df: DataFrame, value: float = 0.01) -> DataFrame:
    v = variances(df, pick_many(df, None))
    return df.drop(*[c for c, x in v.items() if x is not None and x < value])


@operator("feature.variance_threshold")
def variance_threshold(df: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Population variance after filling nulls with the median; the filled values are not kept."""
    nums = pick_many(df, None)
    med = {c: q[0] for c, q in fit_quantiles(df, nums, [0.5]).items()}
    filled = df.select(*[F.coalesce(num(c), F.lit(med.get(c, 0.0))).alias(c) for c in nums])
    v = variances(filled, nums, F.var_pop)
    return df.drop(*[c for c, x in v.items() if x <= threshold])


def correlated_later(df: DataFrame, cols: Sequence[str], threshold: float) -> list[str]:
    """The later column of every pair with |r| above the threshold."""
    if len(cols) < 2:
        return []
    rows = correlations(df, cols).where(F.abs("r") > threshold).select("b").distinct().collect()  # at most one per column
    bad = {x["b"] for x in rows}
    return [c for c in cols if c in bad]


@operator("feature.correlation_filter")
def correlation_filter(df: DataFrame, value: float = 0.95) -> DataFrame:
    return df.drop(*correlated_later(df, pick_many(df, None), value))


@operator("feature.correlation_select")
def correlation_select(df: DataFrame, threshold: float = 0.95, column: str | None = None, target: str | None = None) -> DataFrame:
    keep = target or column
    return df.drop(*correlated_later(df, [c for c in pick_many(df, None) if c != keep], threshold))


@operator("feature.auto_feature_select")
def auto_feature_select(df: DataFrame, var_threshold: float = 0.01, corr_threshold: float = 0.95) -> DataFrame:
    v = variances(df, pick_many(df, None))
    low = [c for c, x in v.items() if x is not None and x < var_threshold]
    return df.drop(*low, *correlated_later(df, [c for c in v if c not in low], corr_threshold))


def last_numeric(df: DataFrame, column: str | None) -> str:
    return resolve(df, column) if column else pick_many(df, None)[-1]


@operator("feature.mutual_info")
def mutual_info(df: DataFrame, column: str | None = None, bins: int = 10, method: str = "bins", k: int = 3) -> DataFrame:
    """(feature, mutual_info) in nats; by neighbours, a target with at most ten values is taken as classes."""
    y = last_numeric(df, column)
    feats = [c for c in pick_many(df, None) if c != y]
    rows = df.select(*[col(c) for c in dict.fromkeys([*feats, y])]).na.drop()
    classes = method == "neighbours" and is_class_target(rows, y)
    return mi_scores(rows, feats, y, bins, method, k, classes).select("feature", r(F.col("mi")).alias("mutual_info")).orderBy("mutual_info", "feature")


@operator("feature.mutual_info_select")
def mutual_info_select(df: DataFrame, column: str | None = None, target: str | None = None, threshold: float = 0.01,
                       top_k: int | None = None, bins: int = 10, method: str = "bins", k: int = 3) -> DataFrame:
    y = resolve(df, target or column)
    work = df.where(col(y).isNotNull())
    feats = [c for c in pick_many(df, None) if c != y]
    med = {c: q[0] for c, q in fit_quantiles(work, feats, [0.5]).items()}
    filled = work.select(*[F.coalesce(num(c), F.lit(med.get(c, 0.0))).alias(c) for c in feats], col(y))
    classes = method == "neighbours" and is_class_target(work, y)
    scores = mi_scores(filled, feats, y, bins, method, k, classes).orderBy(F.desc("mi"), "feature").collect()  # one row per feature
    if top_k:
        keep = [x["feature"] for x in scores[:top_k]]
    else:
        keep = [x["feature"] for x in scores if x["mi"] >= threshold]
    keep = keep or [x["feature"] for x in scores[:max(len(feats) // 2, 1)]]
    return work.select(*[col(c) for c in keep], col(y))


def univariate_scores(df: DataFrame, feats: Sequence[str], target: str) -> dict[str, float]:
    """ANOVA F for a target with at most ten values, else the regression F of a single feature."""
    rows = df.select(*[num(c).alias(c) for c in feats], col(target).alias(target)).na.drop()
    k = fit(rows, k=F.count_distinct(col(target)))["k"]
    out = {}
    if k <= 10:
        for c in feats:
            f = anova_table(group_moments(rows, c, target)).first()["f"]
            out[c] = f if f is not None else 0.0
        return out
    s = fit(rows, n=F.count(F.lit(1)), **{f"r{i}": safe_corr(num(c), num(target)) for i, c in enumerate(feats)})
    for i, c in enumerate(feats):
        r2 = (s[f"r{i}"] or 0.0) ** 2
        out[c] = r2 / max(1 - r2, 1e-300) * (s["n"] - 2)
    return out


@operator("feature.select_k_best")
def select_k_best(df: DataFrame, column: str | None = None, k: int = 10) -> DataFrame:
    y = last_numeric(df, column)
    feats = [c for c in pick_many(df, None) if c != y]
    scores = univariate_scores(df, feats, y)
    best = sorted(feats, key=lambda c: -scores[c])[:k]
    return df.select(*[col(c) for c in feats if c in best], col(y))


def forest_input(df: DataFrame, target: str):
    work = df.where(col(target).isNotNull())
    feats = [c for c in pick_many(df, None) if c != target]
    if len(feats) < 2:
        raise ValueError("two numeric features are needed")
    med = {c: q[0] for c, q in fit_quantiles(work, feats, [0.5]).items()}
    filled = work.select(*[F.coalesce(num(c), F.lit(med.get(c, 0.0))).alias(c) for c in feats], col(target))
    classify = is_class_target(work, target)
    return work, feats, labelled(filled, feats, target, classify), classify


@operator("feature.rfe_select")
def rfe_select(df: DataFrame, column: str | None = None, target: str | None = None, n_features: int | None = None,
               trees: int = 50, depth: int = 5, seed: int = 42) -> DataFrame:
    """Drop the least important feature of a forest, one at a time."""
    y = resolve(df, target or column)
    work, feats, rows, classify = forest_input(df, y)
    rows = rows.cache()
    left = list(range(len(feats)))
    want = int(n_features) if n_features else max(len(feats) // 2, 1)
    while len(left) > want:
        imp = importances(rows, left, classify, trees, depth, seed)
        left.pop(int(np.argmin(imp)))
    rows.unpersist()
    return work.select(*[col(feats[i]) for i in left], col(y))


@operator("feature.boruta_select")
def boruta_select(df: DataFrame, column: str | None = None, target: str | None = None, max_iter: int = 50, trees: int = 50,
                  depth: int = 5, seed: int = 42) -> DataFrame:
    """Features whose forest importance beats every shuffled copy significantly often.

    A shadow feature pairs each row with another row's values by position in a seeded hash
    order, so the shuffle is a join and never a collect.
    """
    y = resolve(df, target or column)
    work, feats, rows, classify = forest_input(df, y)
    n = len(feats)
    names = [f"_{i}" for i in range(n)]
    base = index_rows(rows.withColumn("_h", F.xxhash64(F.lit(seed), *names)), ["_h", *names])
    hits, undecided, verdict = [0] * n, set(range(n)), {}
    total = max(base.rows, 1)
    for turn in range(1, max_iter + 1):
        jump = 1 + (turn * 7919) % max(total - 1, 1)
        shadow = base.df.select(F.pmod(F.col("_idx") + F.lit(jump), F.lit(total)).alias("_idx"),
                                *[F.col(c).alias(f"_{n + i}") for i, c in enumerate(names)])
        imp = importances(base.df.join(shadow, "_idx"), range(2 * n), classify, trees, depth, seed + turn)
        bar = max(imp[n:])
        for i in undecided:
            hits[i] += imp[i] > bar
        for i in list(undecided):
            level = 0.05 / n
            if dist.binom_sf(hits[i], turn, 0.5) < level:
                verdict[i] = "Confirmed"
            elif 1 - dist.binom_sf(hits[i] + 1, turn, 0.5) < level:
                verdict[i] = "Rejected"
            if i in verdict:
                undecided.discard(i)
        if not undecided:
            break
    good = [i for i in range(n) if verdict.get(i) == "Confirmed"] or sorted(undecided)
    return work.select(*[col(feats[i]) for i in good], col(y)) if good else work


@operator("feature.feature_importance")
def feature_importance(df: DataFrame, column: str | None = None, trees: int = 100, depth: int = 10, seed: int = 42) -> DataFrame:
    y = last_numeric(df, column)
    feats = [c for c in pick_many(df, None) if c != y]
    classify = fit(df, k=F.count_distinct(col(y)))["k"] <= 10
    imp = importances(labelled(df, feats, y, classify), range(len(feats)), classify, trees, depth, seed)
    return df.sparkSession.createDataFrame(list(zip(feats, imp)), "feature string, importance double").orderBy("importance")


def principal_axes(df: DataFrame, cols: Sequence[str], n: int) -> tuple[list[Column], np.ndarray]:
    """Component expressions of the standardised columns and their variance shares.

    The correlation matrix comes from one aggregation; its k x k eigenvectors are found on the driver.
    The largest loading of a component is made positive.
    """
    rows = df.select(*[num(c).alias(c) for c in cols]).na.drop()
    s = moments(rows, cols, F.stddev_pop)
    z = [(num(c) - F.lit(s[c][0])) / F.lit(s[c][1] or 1.0) for c in cols]
    gram, count = moment_matrix(rows, z, intercept=False)
    values, vectors = np.linalg.eigh(gram / max(count, 1))
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order]
    out = []
    for k in range(min(n, len(cols))):
        v = vectors[:, k]
        v = v * (1 if v[np.argmax(np.abs(v))] >= 0 else -1)
        out.append(sum((e * F.lit(float(w)) for e, w in zip(z, v)), F.lit(0.0)))
    return out, values / values.sum()


@operator("feature.pca")
def pca(df: DataFrame, n: int = 2, columns: Sequence[str] | None = None) -> DataFrame:
    cols = pick_many(df, columns)
    axes, _ = principal_axes(df, cols, n)
    return df.where(complete(cols)).select(*[a.alias(f"PC{i + 1}") for i, a in enumerate(axes)])


@operator("feature.svd_features")
def svd_features(df: DataFrame, n_components: int = 3) -> DataFrame:
    """Truncated singular vectors of the raw numeric columns, nulls as zero, no centring."""
    cols = pick_many(df, None)
    if len(cols) < 2:
        raise ValueError("two numeric columns are needed")
    x = [F.coalesce(num(c), F.lit(0.0)) for c in cols]
    gram, _ = moment_matrix(df, x, intercept=False)
    values, vectors = np.linalg.eigh(gram)
    new = {}
    for k in range(min(n_components, len(cols))):
        v = vectors[:, -1 - k]
        v = v * (1 if v[np.argmax(np.abs(v))] >= 0 else -1)
        new[f"svd_{k + 1}"] = sum((e * F.lit(float(w)) for e, w in zip(x, v)), F.lit(0.0))
    return df.withColumns(new)
