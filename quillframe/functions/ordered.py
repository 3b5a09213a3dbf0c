"""Work that depends on row order, without one giant partition and without one task per key.

``index_rows`` range-partitions by (keys, order), sorts, and gives every row a
contiguous 0-based position. ``blocks`` cuts the positions into equal blocks, so
that a window is ``partitionBy(block, keys)``: no task ever holds more than one
block, however many rows one key has. Rolling frames see their neighbours through
a copied edge (halo); running totals add the totals of the blocks before.

The indexed rows are written to the checkpoint folder: their positions must not
change between the count and the use, also when an executor is lost.
"""

from __future__ import annotations

import math
import re
import tempfile
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from quillframe.columns import col, resolve_all

_SENT_ROWS, _SENT_BYTES = 200_000, 8 << 20  # fixed values: rows, and bytes of their text, of a table that is broadcast
_POSITION_BITS = 33  # fixed value: monotonically_increasing_id keeps the row position in 33 bits


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder named by ``spark.checkpoint.dir``."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def narrow_table(df: DataFrame, text: Column | None = None) -> DataFrame:
    """A table of one row per key or level, made once and broadcast by name if it was counted to be small.

    With few keys a shuffle would send all rows that it is joined to to as many tasks. A larger table is left to the
    adaptive planner, which splits a hot key. ``text`` is the column whose bytes count.
    """
    made = reliable_checkpoint(df)
    size = made.agg(F.count(F.lit(1)).alias("n"), F.sum(F.lit(0) if text is None else F.octet_length(text.cast("string"))).alias("b")).first()
    return F.broadcast(made) if size["n"] <= _SENT_ROWS and (size["b"] or 0) <= _SENT_BYTES else made


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a local session without one gets a temporary folder; on a cluster it is an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def _order(order_by) -> list[Column]:
    items = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
    if not items:
        raise ValueError("order_by is required: Spark rows have no order of their own")
    return [col(c).asc_nulls_last() if isinstance(c, str) else c for c in items]


def _names(partition_by) -> list[str]:
    return [partition_by] if isinstance(partition_by, str) else list(partition_by or [])


@dataclass
class Indexed:
    """Rows with a contiguous position ``_idx`` in (keys, order)."""

    df: DataFrame
    rows: int
    keys: list[str]

    def block_size(self, halo: int) -> int:
        parts = int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return max(math.ceil(self.rows / parts), halo, 1)

    def windowed(self, build: Callable[[WindowSpec], Mapping[str, Column]],
                 before: int = 0, after: int = 0) -> Indexed:
        """Add window columns whose frames reach at most ``before`` and ``after`` rows."""
        size = self.block_size(before + after)
        block = F.floor(F.col("_idx") / size)
        at = F.col("_idx") % size
        homes = [block]
        if before:
            homes.append(F.when(at >= size - before, block + 1))
        if after:
            homes.append(F.when(at < after, block - 1))
        spread = self.df.withColumn("_block", F.explode(F.array_compact(F.array(*homes))))
        w = Window.partitionBy("_block", *[col(k) for k in self.keys]).orderBy("_idx")
        out = spread.withColumns(dict(build(w))).where(F.col("_block") == block)
        return Indexed(out.drop("_block"), self.rows, self.keys)

    def grouped(self, fn, schema, before: int = 0) -> DataFrame:
        """Like ``windowed`` for pandas code over (block, keys): ``fn`` gets ``_own`` on rows to keep."""
        size = self.block_size(before)
        block = F.floor(F.col("_idx") / size)
        homes = [block]
        if before:
            homes.append(F.when(F.col("_idx") % size >= size - before, block + 1))
        spread = (self.df.withColumn("_home", block)
                  .withColumn("_block", F.explode(F.array_compact(F.array(*homes))))
                  .withColumn("_own", F.col("_home") == F.col("_block")))
        return spread.groupBy("_block", *[col(k) for k in self.keys]).applyInPandas(fn, schema)

    def running(self, sums: Mapping[str, Column] | None = None, maxs: Mapping[str, Column] | None = None,
                mins: Mapping[str, Column] | None = None, lasts: Mapping[str, Column] | None = None,
                nexts: Mapping[str, Column] | None = None) -> Indexed:
        """Running totals from the first row of a key: local windows plus earlier block totals.

        ``lasts`` is the last non-null value so far, ``nexts`` the first non-null value
        from this row on.
        """
        size = self.block_size(1)
        df = self.df.withColumn("_block", F.floor(F.col("_idx") / size))
        keys = [col(k) for k in self.keys]
        w = Window.partitionBy("_block", *keys).orderBy("_idx")
        up = w.rowsBetween(Window.unboundedPreceding, 0)
        wb = Window.partitionBy(*keys).orderBy("_block")
        earlier = wb.rowsBetween(Window.unboundedPreceding, -1)
        # the next value is the last one in descending order: such a frame grows by a row at a time, while one that ends
        # at the last row is evaluated anew for every row
        down = Window.partitionBy("_block", *keys).orderBy(F.desc("_idx")).rowsBetween(Window.unboundedPreceding, 0)
        later = Window.partitionBy(*keys).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
        local, totals, carry, merge = {}, [], {}, {}

        def pair(name, c, total, here, frame_total, combine):
            local[f"_l_{name}"] = here
            totals.append(total.alias(f"_t_{name}"))
            carry[f"_c_{name}"] = frame_total(F.col(f"_t_{name}"))
            merge[name] = combine(F.col(f"_l_{name}"), F.col(f"_c_{name}"))

        def add(here, before):
            return F.when(here.isNull() & before.isNull(), None).otherwise(
                F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0)))

        for name, c in (sums or {}).items():
            pair(name, c, F.sum(c), F.sum(c).over(up), lambda t: F.sum(t).over(earlier), add)
        for name, c in (maxs or {}).items():
            pair(name, c, F.max(c), F.max(c).over(up), lambda t: F.max(t).over(earlier), F.greatest)
        for name, c in (mins or {}).items():
            pair(name, c, F.min(c), F.min(c).over(up), lambda t: F.min(t).over(earlier), F.least)
        for name, c in (lasts or {}).items():
            pair(name, c, F.max_by(c, F.when(c.isNotNull(), F.col("_idx"))), F.last(c, ignorenulls=True).over(up),
                 lambda t: F.last(t, ignorenulls=True).over(earlier), F.coalesce)
        for name, c in (nexts or {}).items():
            pair(name, c, F.min_by(c, F.when(c.isNotNull(), F.col("_idx"))), F.last(c, ignorenulls=True).over(down),
                 lambda t: F.last(t, ignorenulls=True).over(later), F.coalesce)
        names = ["_block", *self.keys]
        blocks = df.groupBy("_block", *keys).agg(*totals).withColumns(carry)
        blocks = blocks.select(*[col(k).alias(f"_k{i}") for i, k in enumerate(names)], *carry)
        on = [col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(names)]
        out = df.withColumns(local).join(blocks, on, "left").withColumns(merge)
        drop = ["_block", *local, *carry, *[f"_k{i}" for i in range(len(names))]]
        return Indexed(out.drop(*drop), self.rows, self.keys)

    def key_position(self, name: str = "_pos") -> Indexed:
        """0-based position inside the key."""
        if not self.keys:
            return Indexed(self.df.withColumn(name, F.col("_idx")), self.rows, self.keys)
        first = self.df.groupBy(*[col(k) for k in self.keys]).agg(F.min("_idx").alias("_first"))
        first = first.select(*[col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)], "_first")
        on = [col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.keys)]
        out = self.df.join(narrow_table(first, F.to_json(F.struct(*[f"_k{i}" for i in range(len(self.keys))]))), on, "left").withColumn(name, F.col("_idx") - F.col("_first"))
        return Indexed(out.drop("_first", *[f"_k{i}" for i in range(len(self.keys))]), self.rows, self.keys)

    def result(self) -> DataFrame:
        return self.df.drop("_idx")


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns; what has no hash (maps) is hashed as JSON."""
    return F.xxhash64(*[F.to_json(col(f.name)) if "map<" in f.dataType.simpleString() else col(f.name) for f in df.schema])


def index_rows(df: DataFrame, order_by, partition_by: str | Sequence[str] | None = None) -> Indexed:
    """Give each row its 0-based position in (partition_by, order_by).

    Rows that tie are ordered by a hash of the row, so that they spread over partitions
    and keep their places in a rerun; only identical rows may swap.
    """
    keys = resolve_all(df, _names(partition_by))
    spec = [col(k).asc_nulls_first() for k in keys] + _order(order_by) + [row_hash(df)]
    laid = (df.repartitionByRange(*spec).sortWithinPartitions(*spec)
            .withColumn("_m", F.monotonically_increasing_id()))
    saved = reliable_checkpoint(laid)
    part = F.shiftright("_m", _POSITION_BITS).cast("int")
    counts = saved.groupBy(part.alias("p")).count().collect()  # one row per partition
    size = {row["p"]: row["count"] for row in counts}
    offsets, total = [], 0
    for p in range(max(size, default=0) + 1):
        offsets.append(total)
        total += size.get(p, 0)
    base = F.element_at(F.lit(offsets).cast("array<bigint>"), part + 1)
    pos = F.col("_m").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return Indexed(saved.withColumn("_idx", base + pos).drop("_m"), total, keys)


def running(df: DataFrame, order_by, partition_by=None, **specs) -> DataFrame:
    return index_rows(df, order_by, partition_by).running(**specs).result()
