"""Running statistics whose state is more than a sum: the median of all rows so far, and exponentially weighted moments."""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping, Sequence
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from quillframe.columns import col
from quillframe.functions.ordered import Indexed, index_rows, reliable_checkpoint


def _group(keys: Sequence[str]) -> Column:
    """The keys as one text that is never null."""
    return F.to_json(F.struct(*[col(k).alias(f"k{i}") for i, k in enumerate(keys)])) if keys else F.lit("")


def expanding_median(ix: Indexed, value: Column, name: str) -> Indexed:
    """Adds ``name``: the median of the non-null values of the key's rows up to this one.

    Rows lie in blocks by position and, a second time, by value. The counts of (position block,
    value block), summed over the blocks before, are a rank tree that tells where the earlier values' middle lies.
    A block of b rows moves the median by b / 2 ranks at most, so it fetches only the value blocks
    within that reach, and how many earlier values lie below them; two heaps then follow the median row by
    row. A task holds a block's rows and about three times as many fetched values, however long the series.
    """
    size = ix.block_size(1)
    rows = ix.df.select(_group(ix.keys).alias("g"), F.col("_idx").alias("pos"), F.floor(F.col("_idx") / size).cast("long").alias("tb"), value.cast("double").alias("v"))
    valued = index_rows(rows.where("v is not null"), ["v", "pos"], ["g"]).df.withColumn("vb", F.floor(F.col("_idx") / size).cast("long"))
    cells = valued.groupBy("g", "tb", "vb").agg(F.count(F.lit(1)).alias("n"))
    blocks = rows.groupBy("g", "tb").agg(F.count(F.lit(1)).alias("b"))
    grid = blocks.join(cells.select("g", "vb").distinct(), "g").join(cells, ["g", "tb", "vb"], "left")
    past = Window.partitionBy("g", "vb").orderBy("tb").rowsBetween(Window.unboundedPreceding, -1)
    lower = Window.partitionBy("g", "tb").orderBy("vb").rowsBetween(Window.unboundedPreceding, -1)
    held = grid.withColumn("c", F.coalesce(F.sum("n").over(past), F.lit(0))).withColumns({
        "below": F.coalesce(F.sum("c").over(lower), F.lit(0)), "total": F.sum("c").over(Window.partitionBy("g", "tb"))})
    low, high = F.floor((F.col("total") - 1 - F.col("b")) / 2) - 1, F.floor((F.col("total") + F.col("b")) / 2) + 1
    need = reliable_checkpoint(held.where((F.col("c") > 0) & (F.col("below") + F.col("c") > low) & (F.col("below") <= high)).select("g", "tb", "vb", "below", "total"))
    heads = need.groupBy("g", "tb").agg(F.lit(0).alias("kind"), F.max("total").alias("pos"), F.min("below").cast("double").alias("v"))
    earlier = valued.select("g", "vb", F.col("tb").alias("t0"), "v").join(need.select("g", "vb", "tb"), ["g", "vb"]).where("t0 < tb")
    sent = heads.unionByName(earlier.select("g", "tb", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("pos"), "v")).unionByName(
        rows.select("g", "tb", F.lit(2).alias("kind"), "pos", "v"))

    def run(batches):
        given = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, group in groupby(given, key=itemgetter(0, 1)):
            total = below = 0
            old: list[float] = []
            small: list[float] | None = None
            places, medians = [], []
            for _, _, kind, pos, v in group:
                if kind == 0:
                    total, below = pos, int(v)
                    continue
                if kind == 1:
                    old.append(v)
                    continue
                if small is None:  # the lower half, negated, and the upper one
                    old.sort()
                    half = (total + 1) // 2 - below
                    small, large = [-x for x in reversed(old[:half])], old[half:]
                if v is not None:
                    under = v <= -small[0] if small else below == 0 and (not large or v <= large[0])
                    heapq.heappush(small, -v) if under else heapq.heappush(large, v)
                    total += 1
                    while below + len(small) > (total + 1) // 2:
                        heapq.heappush(large, -heapq.heappop(small))
                    while below + len(small) < (total + 1) // 2:
                        heapq.heappush(small, -heapq.heappop(large))
                places.append(pos)
                medians.append(None if not total else -small[0] if total % 2 else (large[0] - small[0]) / 2)
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(medians, pa.float64())], ["_idx", name])

    laid = sent.repartition("g", "tb").sortWithinPartitions("g", "tb", "kind", "pos").select("g", "tb", "kind", "pos", "v")
    found = laid.mapInArrow(run, f"_idx long, `{name}` double")
    return Indexed(ix.df.join(found, "_idx"), ix.rows, ix.keys)


def weighted_moments(ix: Indexed, values: Mapping[str, Column], alpha: float) -> Indexed:
    """Adds ``<name>_mean`` and ``<name>_std`` of each value: exponentially weighted, weights (1 - alpha) ** age, std without bias.

    A decayed prefix scan. A piece of consecutive rows keeps the sums of its weights, squared weights, values and squares, all scaled to the
    piece's first row; its running sums are plain windows. What earlier pieces leave over is the sum of their totals,
    decayed by the distance. Pieces are as long as the scaled weights stay within a double, and no longer than a block.
    Null rows age the others and repeat the last result, until all weights lie below 1e-40 (then null).
    """
    keys = [col(k) for k in ix.keys]
    decay = -math.log1p(-alpha) if alpha < 1 else math.inf
    size = max(min(ix.block_size(1), int(270 / decay) if decay else ix.rows), 1)
    back = max(math.ceil(92 / (size * decay)), 1) if decay else ix.rows  # pieces whose weight is above 1e-40
    grown = F.exp((F.col("_idx") % size) * F.lit(min(decay, 700.0)))
    parts = {}
    for n, x in values.items():
        u = F.when(x.isNotNull(), grown)
        parts |= {f"_{n}_w": u, f"_{n}_v": u * u, f"_{n}_s": u * x, f"_{n}_q": u * x * x, f"_{n}_n": x.isNotNull().cast("double")}
    df = ix.df.withColumn("_piece", F.floor(F.col("_idx") / size).cast("long"))
    here = Window.partitionBy("_piece", *keys).orderBy("_idx").rowsBetween(Window.unboundedPreceding, 0)
    local = df.select("*", *[F.coalesce(F.sum(c).over(here), F.lit(0.0)).alias(n) for n, c in parts.items()])
    totals = df.groupBy("_piece", _group(ix.keys).alias("_g")).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(n) for n, c in parts.items()])
    near = Window.partitionBy("_g").orderBy("_piece").rowsBetween(-back, -1)
    ever = Window.partitionBy("_g").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)

    def carried(name: str) -> Column:
        if name.endswith("_n"):
            return F.coalesce(F.sum(name).over(ever), F.lit(0.0))
        rate = decay * size * (2 if name.endswith("_v") else 1)
        return F.aggregate(F.collect_list(F.struct("_piece", F.col(name).alias("x"))).over(near), F.lit(0.0),
                           lambda t, p: t + p["x"] * F.exp((p["_piece"] - F.col("_piece")) * F.lit(rate)))

    over = totals.select(F.col("_piece").alias("_p"), "_g", *[carried(n).alias(f"{n}0") for n in parts])
    both = local.withColumn("_h", _group(ix.keys)).join(over, (F.col("_piece") == F.col("_p")) & (F.col("_h") == F.col("_g")))
    new, aged = {}, F.exp(-(F.col("_idx") % size) * F.lit(min(decay, 700.0)))
    for n in values:
        w, v, s, q, k = (F.col(f"_{n}_{e}") + F.col(f"_{n}_{e}0") for e in "wvsqn")
        w, v, s, q = w * aged, v * aged * aged, s * aged, q * aged
        spread = F.greatest(q - s * s / w, F.lit(0.0)) * w / (w * w - v)
        new |= {f"{n}_mean": F.when((k > 0) & (w > 0), s / w), f"{n}_std": F.when((k > 1) & (w * w > v), F.sqrt(spread))}
    out = both.withColumns(new).drop("_piece", "_p", "_g", "_h", *parts, *[f"{n}0" for n in parts])
    return Indexed(out, ix.rows, ix.keys)
