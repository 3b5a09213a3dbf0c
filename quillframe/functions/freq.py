"""Value counts. Every count is pre-aggregated before its shuffle, so hot values are cheap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.columns import col, is_numeric
from quillframe.functions import ordered


def value_counts(df: DataFrame, name: str, out: str = "value") -> DataFrame:
    """(value, count) over non-null values."""
    return (df.where(col(name).isNotNull()).groupBy(col(name).alias(out))
            .agg(F.count(F.lit(1)).alias("count")))


def top_counts(df: DataFrame, name: str, n: int, out: str = "value") -> DataFrame:
    """The n most frequent values, ties by value."""
    return value_counts(df, name, out).orderBy(F.desc("count"), F.asc(out)).limit(n)


def freq_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, num, count) of many columns at once; nulls left out.

    ``num`` orders numbers as numbers, ``value`` is their text.
    """
    structs = [
        F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value"),
                 (col(c).cast("double") if is_numeric(df, c) else F.lit(None).cast("double")).alias("num"))
        for c in cols
    ]
    return (df.select(F.inline(F.array(*structs))).where(F.col("value").isNotNull())
            .groupBy("column", "value", "num").agg(F.count(F.lit(1)).alias("count")))


def modes(freq: DataFrame) -> DataFrame:
    """(column, mode, mode_num, mode_count, n_modes, distinct, total): smallest value wins a tie."""
    per = freq.groupBy("column").agg(
        F.max("count").alias("mode_count"), F.count(F.lit(1)).alias("distinct"),
        F.sum("count").alias("total"))
    tied = (freq.join(F.broadcast(per.select("column", "mode_count")),
                      ["column"]).where(F.col("count") == F.col("mode_count")))
    return (tied.groupBy("column").agg(
        F.min(F.struct("num", "value")).alias("_m"), F.count(F.lit(1)).alias("n_modes"))
        .join(per, "column")
        .select("column", F.col("_m.value").alias("mode"), F.col("_m.num").alias("mode_num"),
                "mode_count", "n_modes", "distinct", "total"))


def cumulative(counts: DataFrame, value: str = "value", label: str = "cumulative_pct") -> DataFrame:
    """Share and running share of a value-count frame, most frequent first."""
    total = counts.agg(F.sum("count").alias("_total"))
    order = [F.desc("count"), F.asc(value)]
    run = ordered.running(counts, order, sums={"_run": F.col("count")})
    return (run.crossJoin(F.broadcast(total))
            .withColumn("pct", F.col("count") / F.col("_total") * 100)
            .withColumn(label, F.col("_run") / F.col("_total") * 100)
            .drop("_run", "_total"))
