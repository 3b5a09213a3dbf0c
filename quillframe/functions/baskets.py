"""Counts of item pairs in baskets by prefix trees.

Items are numbered by falling frequency and cut into shards. For every shard that a basket has an
item of, it sends its items up to the last one of that shard; equal prefixes merge
before the shuffle. A task reads a shard's prefixes in order, which walks the tree of all
prefixes: at a node of the shard, the baskets below it are added to the counts of its
item with every item above. So a basket of m items costs m rows at most and never its
m (m - 1) / 2 pairs, and a task holds one row of counts per item of its shard.
"""

from __future__ import annotations

from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.functions.ordered import index_rows, reliable_checkpoint

SHARD_BYTES = 64 << 20  # counts that a task holds at most


def frequent(held: DataFrame, least: float) -> tuple[DataFrame, int]:
    """Rows ``i, k, n`` of the items (column ``i`` of distinct ``g, i``) in at least ``least`` baskets, numbered by falling count, and how many."""
    counted = held.groupBy("i").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= F.lit(least))
    ix = index_rows(counted, [F.desc("k"), "i"])
    return ix.df.select("i", "k", F.col("_idx").alias("n")), ix.rows


def pair_counts(held: DataFrame, items: DataFrame, count: int) -> DataFrame:
    """Rows ``x, y, k``: the baskets that hold both items, x numbered before y; pairs that never meet are left out."""
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(min(parts, count), -(-4 * count * count // SHARD_BYTES), 1)
    baskets = held.join(items.select("i", F.col("n").cast("int").alias("n")), "i").groupBy("g").agg(F.sort_array(F.collect_list("n")).alias("s"))
    own = F.transform("s", lambda n: F.pmod(n, F.lit(shards)))
    last = F.transform(F.array_distinct(own), lambda c: F.struct(
        c.alias("shard"), (F.size("s") - F.array_position(F.reverse(own), c) + 1).cast("int").alias("to")))
    sent = baskets.select("s", F.inline(last)).select("shard", F.slice("s", F.lit(1), F.col("to")).alias("path"))
    merged = sent.where(F.size("path") > 1).groupBy("shard", "path").agg(F.count(F.lit(1)).alias("k"))
    laid = merged.repartition(parts, "shard", F.xxhash64("path")) if shards < parts else merged.repartition(parts, "shard")

    def run(batches):
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for shard, group in groupby(rows, key=itemgetter(0)):
            counts: dict[int, np.ndarray] = {}
            path: list[int] = []
            below: list[int] = []  # baskets at each node of the path and under it

            def close(depth: int) -> None:
                while len(path) > depth:
                    item, k = path.pop(), below.pop()
                    if path:
                        below[-1] += k
                        if item % shards == shard:
                            if item not in counts:
                                counts[item] = np.zeros(item, np.int64)
                            counts[item][path] += k

            for _, items_, k in group:
                same = 0
                while same < min(len(path), len(items_)) and path[same] == items_[same]:
                    same += 1
                close(same)
                path += items_[same:]
                below += [0] * (len(items_) - same)
                below[-1] += k
            close(0)
            for item, row in counts.items():
                at = np.nonzero(row)[0]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(np.full(len(at), item), pa.int64()), pa.array(row[at], pa.int64())], ["x", "y", "k"])

    found = laid.sortWithinPartitions("shard", "path").select("shard", "path", "k").mapInArrow(run, "x long, y long, k long")
    return reliable_checkpoint(found.groupBy("x", "y").agg(F.sum("k").alias("k")))
