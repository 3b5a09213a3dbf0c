"""One wide aggregation per table, turned into one row per column."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.columns import col, dtype, num

Stat = Callable[[Column], Column]


def rows_of(one: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """Spread one aggregated row into one row per struct."""
    return one.select(F.inline(F.array(*structs)))


def profile(df: DataFrame, cols: Sequence[str], stats: Mapping[str, Stat], *,
            numeric: bool = False, dtypes: bool = False) -> DataFrame:
    """(column, [dtype], n, stat...) with every statistic of every column in a single pass."""
    get = num if numeric else col
    aggs = [F.count(F.lit(1)).alias("_n")]
    structs = []
    for i, c in enumerate(cols):
        fields = [F.lit(c).alias("column")]
        if dtypes:
            fields.append(F.lit(dtype(df, c)).alias("dtype"))
        fields.append(F.col("_n").alias("n"))
        for name, fn in stats.items():
            aggs.append(fn(get(c)).alias(f"_{i}_{name}"))
            fields.append(F.col(f"_{i}_{name}").alias(name))
        structs.append(F.struct(*fields))
    return rows_of(df.agg(*aggs), structs)


def nulls(c: Column) -> Column:
    return F.count_if(c.isNull())


def r(c: Column, digits: int = 4) -> Column:
    return F.round(c, digits)


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null when b is zero or null."""
    return a / F.when(b != 0, b)


def skew_g1(c: Column) -> Column:
    """Bias-corrected skewness."""
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def kurt_g2(c: Column) -> Column:
    """Bias-corrected excess kurtosis."""
    n = F.count(c).cast("double")
    return F.when(n > 3, ((n + 1) * F.kurtosis(c) + 6) * (n - 1) / ((n - 2) * (n - 3)))


def pair_stats(df: DataFrame, cols: Sequence[str], stats: Mapping[str, Callable[[Column, Column], Column]],
               pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """(a, b, stat...) for column pairs, nulls removed pairwise, in one aggregation."""
    pairs = list(combinations(cols, 2)) if pairs is None else list(pairs)
    if not pairs:
        raise ValueError("at least two columns are needed")
    aggs, structs = [], []
    for i, (a, b) in enumerate(pairs):
        x, y = num(a), num(b)
        both = x.isNotNull() & y.isNotNull()
        fields = [F.lit(a).alias("a"), F.lit(b).alias("b")]
        for name, fn in stats.items():
            aggs.append(fn(F.when(both, x), F.when(both, y)).alias(f"_{i}_{name}"))
            fields.append(F.col(f"_{i}_{name}").alias(name))
        structs.append(F.struct(*fields))
    return rows_of(df.agg(*aggs), structs)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both are known; null when a side is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.covar_pop(a, b) / F.when(spread > 0, spread)


def matrix(df: DataFrame, cols: Sequence[str], fn: Callable[[Column, Column], Column],
           digits: int = 4) -> DataFrame:
    """Symmetric pair matrix: one row per column, one value column per column."""
    aggs = {}
    for i, a in enumerate(cols):
        for j in range(i, len(cols)):
            both = num(a).isNotNull() & num(cols[j]).isNotNull()
            aggs[i, j] = F.round(fn(F.when(both, num(a)), F.when(both, num(cols[j]))), digits)
    one = df.agg(*[v.alias(f"_{i}_{j}") for (i, j), v in aggs.items()])
    structs = [
        F.struct(F.lit(a).alias("column"),
                 *[F.col(f"_{min(i, j)}_{max(i, j)}").alias(b) for j, b in enumerate(cols)])
        for i, a in enumerate(cols)
    ]
    return rows_of(one, structs)


def fit(df: DataFrame, **aggs: Column) -> dict:
    """Small statistics brought to the driver: a single row of scalars."""
    return df.agg(*[v.alias(k) for k, v in aggs.items()]).first().asDict()
