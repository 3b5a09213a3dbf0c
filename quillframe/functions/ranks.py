"""Ranks and empirical distributions from the table of distinct values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.columns import col, num
from quillframe.functions.ordered import running


def ecdf(df: DataFrame, name: str, by: Sequence[str] = (), extra: dict | None = None) -> DataFrame:
    """(by..., x, count, upto, [extra running sums]): distinct values with rows up to and including x.

    ``extra`` maps names to per-row expressions that are summed along the order.
    """
    extra = extra or {}
    freq = (df.select(*[col(k) for k in by], num(name).alias("x"), *[e.alias(k) for k, e in extra.items()])
            .where(F.col("x").isNotNull()).groupBy(*[col(k) for k in by], "x")
            .agg(F.count(F.lit(1)).alias("count"), *[F.sum(k).alias(k) for k in extra]))
    sums = {"upto": F.col("count"), **{f"{k}_upto": F.col(k) for k in extra}}
    return running(freq, ["x"], list(by), sums=sums)


def with_rank(df: DataFrame, name: str, method: str = "average", out: str = "_rank",
              ascending: bool = True) -> DataFrame:
    """Add the rank of a numeric column (average or min of ties); null stays null.

    Ranks are computed on distinct values and joined back; a hot value is split
    by the adaptive skew join.
    """
    table = ecdf(df, name)
    if not ascending:
        total = df.agg(F.count(num(name)).alias("_all"))
        table = table.crossJoin(F.broadcast(total)).withColumn(
            "upto", F.col("_all") - F.col("upto") + F.col("count"))
    low = F.col("upto") - F.col("count")
    rank = low + 1 if method == "min" else low + (F.col("count") + 1) / 2
    ranks = table.select(F.col("x").alias("_x"), rank.cast("double").alias(out))
    return df.join(ranks, num(name) == F.col("_x"), "left").drop("_x")
