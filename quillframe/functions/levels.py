"""Per-level statistics joined back to rows, and class rebalancing by replication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.columns import col
from quillframe.functions.ordered import index_rows, narrow_table


def attach(df: DataFrame, table: DataFrame, key: str, level: str = "value") -> DataFrame:
    """Left join a per-level table, which is made and counted first (see ``narrow_table``)."""
    right = narrow_table(table.withColumnRenamed(level, "_level"), F.col("_level"))
    return df.join(right, col(key) == F.col("_level"), "left").drop("_level")


def level_stats(df: DataFrame, key: str, **aggs: Column) -> DataFrame:
    return (df.where(col(key).isNotNull()).groupBy(col(key).alias("value"))
            .agg(*[a.alias(k) for k, a in aggs.items()]))


def shuffled_position(df: DataFrame, label: str, seed: int, key: Sequence[str] | None = None) -> DataFrame:
    """Add ``_pos``: position inside the class in a seeded hash order, never one task per class."""
    cols = [col(c) for c in (key or df.columns)]
    hashed = df.where(col(label).isNotNull()).withColumn("_h", F.xxhash64(F.lit(seed), *cols))
    ix = index_rows(hashed, ["_h", *cols], label).key_position()
    return ix.df.drop("_idx", "_h")


def oversample(df: DataFrame, label: str, seed: int = 42) -> DataFrame:
    """Repeat rows of every class up to the size of the largest one."""
    sizes = level_stats(df, label, _n=F.count(F.lit(1)))
    top = sizes.agg(F.max("_n").alias("_top"))
    rows = attach(shuffled_position(df, label, seed), sizes.crossJoin(F.broadcast(top)), label)
    copies = F.floor(F.col("_top") / F.col("_n")) + F.when(F.col("_pos") < F.col("_top") % F.col("_n"), 1).otherwise(0)
    return (rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
            .drop("_copy", "_pos", "_n", "_top").select(*[col(c) for c in df.columns]))


def undersample(df: DataFrame, label: str, seed: int = 42) -> DataFrame:
    """Keep as many rows of every class as the smallest one has."""
    sizes = level_stats(df, label, _n=F.count(F.lit(1)))
    low = sizes.agg(F.min("_n").alias("_low"))
    rows = shuffled_position(df, label, seed).crossJoin(F.broadcast(low))
    return rows.where(F.col("_pos") < F.col("_low")).select(*[col(c) for c in df.columns])
