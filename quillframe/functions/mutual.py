"""Mutual information from nearest neighbours, for continuous, discrete and mixed values.

For each row: the distance to its k-th neighbour in (x, y) under the maximum norm, and how many rows lie
strictly within that distance in x alone and in y alone (Kraskov, Stoegbauer and Grassberger 2004). Where k or more
other rows have the same (x, y), these copies take the place of the k neighbours, and the rows with the same x
or y are counted (Gao et al. 2017); no noise is added, so a result repeats. A target of classes keeps its
classes further apart than any two values, which gives the estimator of Ross (2014).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.columns import col, num
from quillframe.functions.ordered import reliable_checkpoint
from quillframe.functions.space import SAMPLE, build_cells

#: Values are whole multiples of 2**-32 standard deviations, so that sums and differences of distances are exact.
STEP = 2.0 ** 32
#: Farther apart than any two values: classes, and features.
CLASS_GAP, FEATURE_GAP = 2.0 ** 54, 2.0 ** 60
BLOCKS = 100_000  # values of short axes, each a block of its own
BLOCK_ROWS, PIECE_ROWS = 20_000, 200_000  # values of a block, and rows that ask a block in one task, about


def digamma(x: Column) -> Column:
    """The logarithmic derivative of the gamma function for x >= 1: six steps up, then its series."""
    z = x.cast("double") + 6
    tail = F.log(z) - 0.5 / z - 1 / (12 * z ** 2) + 1 / (120 * z ** 4) - 1 / (252 * z ** 6)
    return tail - sum((1 / (x.cast("double") + i) for i in range(6)), F.lit(0.0))


def _scaled(df: DataFrame, features: Sequence[str], target: str, classes: bool) -> tuple[DataFrame, dict[int, int]]:
    """(f, x, y, w): counted distinct points of every feature, scaled; and the rows of each feature."""
    if classes:
        levels = sorted(r[0] for r in df.select(col(target)).where(col(target).isNotNull()).distinct().collect())  # a few classes
        code = F.create_map(*[v for i, level in enumerate(levels) for v in (F.lit(level), F.lit(float(i)))]) if levels else None
        y = code[col(target)] if levels else F.lit(None).cast("double")
    else:
        y = num(target)
    long = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("f"), num(c).alias("x"), y.alias("y")) for i, c in enumerate(features)])))
    long = long.where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
    facts = {r["f"]: r for r in long.groupBy("f").agg(
        F.count(F.lit(1)).alias("n"), *[g(c).alias(f"{c}{e}") for c in "xy" for e, g in (("m", F.avg), ("s", F.stddev_pop))]).collect()}

    def z(c: str) -> Column:
        out = F.lit(None).cast("double")
        for f, r in facts.items():
            out = F.when(F.col("f") == f, F.round((F.col(c) - F.lit(r[f"{c}m"])) / F.lit(r[f"{c}s"] or 1.0) * F.lit(STEP))).otherwise(out)
        return out

    x, y = z("x"), F.col("y") * F.lit(CLASS_GAP) if classes else z("y")
    points = long.select("f", x.alias("x"), y.alias("y")).groupBy("f", "x", "y").agg(F.count(F.lit(1)).alias("w"))
    return points, {f: r["n"] for f, r in facts.items()}


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.abs(a - b).max(axis=-1)


def _axis(at: np.ndarray) -> int:
    """The axis with the most distinct values, the widest of equal ones."""
    return max(range(at.shape[1]), key=lambda i: (len(np.unique(at[:, i])), np.ptp(at[:, i]))) if len(at) else 0


def _kth(dist: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """The distance at which the weights of sorted neighbours reach k, or infinity."""
    enough = weight.cumsum(axis=1) >= k
    return np.where(enough.any(axis=1), np.take_along_axis(dist, enough.argmax(axis=1)[:, None], axis=1)[:, 0], np.inf)


def _among(at: np.ndarray, w: np.ndarray, k: int, chunk: int = 8_192) -> tuple[np.ndarray, np.ndarray]:
    """Distances and weights of each point's own copies and its k nearest other points, nearest first; infinite where there are fewer.

    The points are sorted along one axis and met at growing steps to both sides, until the next point on either side
    is farther along this axis alone than the k-th neighbour found.
    """
    n, axis = len(at), _axis(at)
    order = np.argsort(at[:, axis], kind="stable")
    p, v, line = at[order], w[order], at[order, axis]
    dist, held = np.full((n, k + 1), np.inf), np.zeros((n, k + 1), np.int64)
    dist[:, 0], held[:, 0] = 0.0, v - 1
    for begin in range(0, n, chunk):
        live, step, width = np.arange(begin, min(begin + chunk, n)), 1, k + 1
        while len(live):
            off = np.arange(step, step + width)
            j = live[:, None] + np.concatenate([off, -off])
            outside = (j < 0) | (j >= n)
            j[outside] = 0
            d = _distance(p[live][:, None, :], p[j])
            d[outside | (d >= FEATURE_GAP)] = np.inf
            d, c = np.concatenate([dist[live], d], axis=1), np.concatenate([held[live], v[j]], axis=1)
            some = np.argpartition(d, k, axis=1)[:, :k + 1]
            some = np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, axis=1), axis=1), axis=1)
            dist[live], held[live] = np.take_along_axis(d, some, axis=1), np.take_along_axis(c, some, axis=1)
            step, width = step + width, min(2 * width, 32)
            up, down = live + step, live - step
            gap = np.minimum(np.where(up < n, line[np.minimum(up, n - 1)] - line[live], np.inf), np.where(down >= 0, line[live] - line[np.maximum(down, 0)], np.inf))
            live = live[_kth(dist[live], held[live], k) > gap]
    back = np.argsort(order, kind="stable")
    return dist[back], held[back]


def _from_outside(at: np.ndarray, radius: np.ndarray, points: np.ndarray, w: np.ndarray, k: int, pairs: int = 1_000_000):
    """Chunks of (row, distance, weight): the k nearest of ``points`` within the radius of each row; no row is one of them."""
    axis = _axis(points)
    order = np.argsort(points[:, axis], kind="stable")
    p, v = points[order], w[order]
    lo = np.searchsorted(p[:, axis], at[:, axis] - radius, "left")
    counts = np.searchsorted(p[:, axis], at[:, axis] + radius, "right") - lo
    chunk = np.cumsum(counts) // pairs
    for c in np.unique(chunk):
        mine = np.flatnonzero(chunk == c)
        rows = np.repeat(mine, counts[mine])
        cols = np.arange(len(rows)) - np.repeat(np.cumsum(counts[mine]) - counts[mine], counts[mine]) + lo[rows]
        d = _distance(at[rows], p[cols])
        near = (d <= radius[rows]) & (d < FEATURE_GAP)
        rows, cols, d = rows[near], cols[near], d[near]
        sort = np.lexsort((d, rows))
        rows, cols, d = rows[sort], cols[sort], d[sort]
        first = np.arange(len(rows)) - np.searchsorted(rows, rows, "left") < k
        yield rows[first], d[first], v[cols[first]]


def _places(t: pa.Table) -> np.ndarray:
    return np.column_stack([t["f"].to_numpy() * FEATURE_GAP, t["x"].to_numpy(), t["y"].to_numpy()])


def kth_distances(points: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Adds ``rho``: the distance under the maximum norm to the k-th other row; null where there are fewer.

    ``points`` has (id, f, x, y, w), w rows at each point. Most points find their neighbours in their own cell; one whose
    ball leaves the cell also meets the points within it in the other cells that it touches.
    """
    cells = build_cells(points.select(F.array(F.col("f") * F.lit(FEATURE_GAP), F.col("x"), F.col("y")).alias("v")), "v", seed)

    @F.pandas_udf("int")
    def cell(f: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        rows, where = cells.touched(np.column_stack([f * FEATURE_GAP, x, y]), np.zeros(len(f)))
        out = np.zeros(len(f), np.int32)
        out[rows] = where
        return pd.Series(out)

    home = points.select("id", "f", "x", "y", "w", cell("f", "x", "y").alias("_cell"))

    def own(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        at = _places(t)
        dist, held = _among(at, t["w"].to_numpy(), k)
        r = np.minimum(_kth(dist, held, k), 1e300)
        others = [c[c != key[0].as_py()].tolist() for c in cells.lists(at, r)]
        near = [[{"d": a, "n": b} for a, b in zip(x, y, strict=True) if a < np.inf] if o else None
                for x, y, o in zip(dist.tolist(), held.tolist(), others, strict=True)]
        return pa.table({**{c: t[c] for c in ("id", "f", "x", "y", "w")}, "r": r, "others": pa.array(others, pa.list_(pa.int32())),
                         "near": pa.array(near, pa.list_(pa.struct([("d", pa.float64()), ("n", pa.int64())])))})

    fields = "id long, f int, x double, y double, w long"
    met = reliable_checkpoint(home.groupBy("_cell").applyInArrow(own, f"{fields}, r double, others array<int>, near array<struct<d: double, n: long>>"))
    closed = met.where("size(others) = 0").select("id", "f", "x", "y", "w", F.expr("CASE WHEN r < 1e300 THEN r END").alias("rho"))
    open_ = met.where("size(others) > 0")

    def search(p: pa.Table, q: pa.Table) -> pa.Table:
        ids, found = p["id"].to_numpy(), [(np.zeros(0, int), np.zeros(0), np.zeros(0, int))]
        if len(p) and len(q):
            found += _from_outside(_places(p), p["r"].to_numpy(), _places(q), q["w"].to_numpy(), k)
        rows, d, n = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"id": pa.array(ids[rows], pa.int64()), "d": pa.array(d, pa.float64()), "n": pa.array(n, pa.int64())})

    away = open_.select("id", "f", "x", "y", "r", F.explode("others").alias("_cell")).groupBy("_cell").cogroup(
        home.groupBy("_cell")).applyInArrow(search, "id long, d double, n long")
    kept = open_.select("id", "f", "x", "y", "w", F.inline_outer("near")).unionByName(away, allowMissingColumns=True)
    merged = kept.groupBy("id").agg(*[F.max(c).alias(c) for c in ("f", "x", "y", "w")], F.array_sort(F.collect_list(F.struct("d", "n"))).alias("near"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("d"))
    rho = F.aggregate("near", start, lambda t, e: F.struct((t["n"] + F.coalesce(e["n"], F.lit(0))).alias("n"), F.when(t["n"] < k, F.when(t["n"] + e["n"] >= k, e["d"])).otherwise(t["d"]).alias("d")))
    return closed.unionByName(merged.select("id", "f", "x", "y", "w", rho["d"].alias("rho")))


class _Ranks:
    """Values along the axes in blocks: of each axis the ends of its blocks, ascending, the rows before each, and their numbers."""

    def __init__(self, blocks: pd.DataFrame):
        self.axes = {}
        for g, t in blocks.sort_values(["g", "lo"]).groupby("g"):
            self.axes[int(g)] = (t["lo"].to_numpy(), t["hi"].to_numpy(), np.concatenate([[0], t["w"].to_numpy().cumsum()]), np.append(t["block"].to_numpy(), -1))

    def before(self, g: int, pos: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows in whole blocks below ``pos`` (or up to it, where ``same``), and the block that it cuts, or -1."""
        lo, hi, total, block = self.axes[g]
        e = np.where(same, np.searchsorted(hi, pos, "right"), np.searchsorted(hi, pos, "left"))
        start = np.append(lo, np.inf)[e]
        return total[e], np.where(np.where(same, start <= pos, start < pos), block[e], -1)


def _blocks(values: DataFrame, seed: int = 42) -> tuple[DataFrame, pd.DataFrame]:
    """The values ``g, pos, w`` of the long axes with their ``block``; and g, block, lo, hi, w of all blocks.

    A short axis has a block for each value. Longer ones are cut at a bounded sample of their values.
    """
    sizes = values.groupBy("g").count().orderBy("count").collect()  # two axes a feature
    short = [r["g"] for r, total in zip(sizes, np.cumsum([r["count"] for r in sizes]), strict=True) if total <= BLOCKS]
    long, n = values.where(~F.col("g").isin(short)), sum(r["count"] for r in sizes if r["g"] not in short)
    some = long.where(F.xxhash64(F.lit(seed), "g", "pos") < F.lit(int(-2**63 + 2**64 * min(SAMPLE / max(n, 1), 0.99)))).select("g", "pos").toPandas()
    every = max(int(len(some) * BLOCK_ROWS / max(n, 1)), 8)
    cuts, at = {}, 0
    for r in sizes:
        if r["g"] not in short:
            cuts[r["g"]] = (np.sort(some["pos"][some["g"] == r["g"]].to_numpy())[every::every], at)
            at += len(cuts[r["g"]][0]) + 1

    @F.pandas_udf("int")
    def block(g: pd.Series, pos: pd.Series) -> pd.Series:
        out = np.zeros(len(g), np.int32)
        for axis, (ends, first) in cuts.items():
            here = (g == axis).to_numpy()
            out[here] = first + np.searchsorted(ends, pos[here], "right")
        return pd.Series(out)

    long = long.withColumn("block", block("g", "pos"))
    cut = long.groupBy("g", "block").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.sum("w").alias("w"))
    whole = values.where(F.col("g").isin(short)).select("g", F.lit(-1).alias("block"), F.col("pos").alias("lo"), F.col("pos").alias("hi"), "w")
    return long, pd.concat([cut.toPandas(), whole.toPandas()])


def _rows_within(points: DataFrame) -> DataFrame:
    """(id, f, w, rho, nx, ny): the rows strictly within rho along each axis; those of equal value where rho is 0.

    The rows below both ends of an interval are counted: whole blocks of values from a small table, and the rest in the
    one block that an end cuts. No pair of rows is formed.
    """
    values = reliable_checkpoint(reduce(DataFrame.unionByName, [points.groupBy((F.col("f") * 2 + i).alias("g"), F.col(c).alias("pos")).agg(
        F.sum("w").alias("w")) for i, c in enumerate("xy")]))
    long, table = _blocks(values)
    ranks = _Ranks(table)
    schema = pa.schema([("id", pa.int64()), ("f", pa.int32()), ("w", pa.int64()), ("rho", pa.float64()), ("nx", pa.int64()), ("ny", pa.int64()),
                        ("block", pa.int32()), ("axis", pa.int32()), ("low", pa.float64()), ("high", pa.float64())])
    names = "id long, f int, w long, rho double, nx long, ny long, block int, axis int, low double, high double"

    def ends(batches):
        for b in batches:
            f, rho, n = b["f"].to_numpy(), b["rho"].to_numpy(), np.zeros((2, len(b)), np.int64)
            cut, pos = np.full((2, 2, len(b)), -1), np.zeros((2, 2, len(b)))
            for axis, c in enumerate("xy"):
                pos[axis] = b[c].to_numpy() - rho, b[c].to_numpy() + rho
                for one in np.unique(f):
                    here = np.flatnonzero(f == one)
                    for end, sign, same in ((0, -1, rho[here] > 0), (1, 1, rho[here] == 0)):
                        rows, cut[axis, end, here] = ranks.before(int(one) * 2 + axis, pos[axis, end, here], same)
                        n[axis, here] += sign * rows
            nothing = np.full(len(b), np.nan)

            def batch(rows, axis, end, first):
                low = pos[axis, 0] if end == 0 else nothing
                high = np.where(cut[axis, 0] == cut[axis, 1], pos[axis, 1], nothing) if end == 0 else pos[axis, 1]
                zero = np.zeros(len(rows), np.int64)
                made = {"id": b["id"].to_numpy()[rows], "f": f[rows], "w": b["w"].to_numpy()[rows], "rho": rho[rows], "nx": n[0, rows] if first else zero, "ny": n[1, rows] if first else zero,
                        "block": cut[axis, end, rows].astype(np.int32), "axis": np.full(len(rows), axis, np.int32), "low": low[rows], "high": high[rows]}
                return pa.RecordBatch.from_arrays([pa.array(made[c.name], c.type) for c in schema], schema=schema)

            yield batch(np.arange(len(b)), 0, 0, True)  # with the counts of whole blocks
            for axis, end in ((0, 1), (1, 0), (1, 1)):
                more = np.flatnonzero((cut[axis, end] >= 0) & ((end == 0) | (cut[axis, 0] != cut[axis, 1])))
                if len(more):
                    yield batch(more, axis, end, False)

    asked = points.select("id", "f", "x", "y", "w", "rho").mapInArrow(ends, names)
    cutting = asked.where("block >= 0")
    pieces = F.ceil(F.count(F.lit(1)) / F.lit(PIECE_ROWS)).cast("int")
    hot = cutting.groupBy("block").agg(pieces.alias("pieces")).where("pieces > 1")
    asks = cutting.join(F.broadcast(hot), "block", "left").withColumn("piece", F.pmod(F.xxhash64("id"), F.coalesce("pieces", F.lit(1))).cast("int")).drop("pieces")
    shared = long.join(F.broadcast(hot), "block", "left").select("block", "pos", "w", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)).alias("piece"))

    def count(p: pa.Table, q: pa.Table) -> pa.Table:
        n = {"nx": p["nx"].to_numpy().copy(), "ny": p["ny"].to_numpy().copy()}
        if len(p):
            order = np.argsort(q["pos"].to_numpy(), kind="stable")
            at, total = q["pos"].to_numpy()[order], np.concatenate([[0], q["w"].to_numpy()[order].cumsum()])
            zero, axis = p["rho"].to_numpy() == 0, p["axis"].to_numpy()
            for c, sign, same in (("low", -1, ~zero), ("high", 1, zero)):
                v = p[c].to_numpy()
                below = np.where(same, total[np.searchsorted(at, v, "right")], total[np.searchsorted(at, v, "left")])
                rows = np.where(np.isnan(v), 0, sign * below)
                n["nx"] += np.where(axis == 0, rows, 0)
                n["ny"] += np.where(axis == 1, rows, 0)
        return pa.table({**{c: p[c] for c in ("id", "f", "w", "rho")}, **{c: pa.array(v, pa.int64()) for c, v in n.items()}})

    fields = ["id", "f", "w", "rho", "nx", "ny"]
    counted = asks.groupBy("block", "piece").cogroup(shared.groupBy("block", "piece")).applyInArrow(count, "id long, f int, w long, rho double, nx long, ny long")
    return asked.where("block < 0").select(*fields).unionByName(counted).groupBy("id").agg(
        *[F.max(c).alias(c) for c in ("f", "w", "rho")], *[F.sum(c).alias(c) for c in ("nx", "ny")])


def neighbour_mi(df: DataFrame, features: Sequence[str], target: str, k: int = 3, classes: bool = False) -> DataFrame:
    """(feature, mi): mutual information in nats with the target, not below 0.

    Rows with a null, NaN or infinite value of the feature or the target are left out of that feature. A feature with k rows or fewer
    has 0, one without rows is missing.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    points, rows = _scaled(df, features, target, classes)
    points = reliable_checkpoint(points.withColumn("id", F.monotonically_increasing_id()))
    known = reliable_checkpoint(kth_distances(points, k).where("rho is not null"))
    per = _rows_within(known)
    n = F.create_map(*[F.lit(v) for f, c in rows.items() for v in (f, c)]) if rows else F.create_map(F.lit(0), F.lit(0))
    same = F.when(F.col("rho") == 0, F.col("w")).otherwise(F.lit(k))
    term = digamma(same) + digamma(n[F.col("f")]) - digamma(F.col("nx")) - digamma(F.col("ny"))
    scores = per.groupBy("f").agg((F.sum(term * F.col("w")) / F.sum("w")).alias("s"))
    names = df.sparkSession.createDataFrame([(f, features[f]) for f in rows], "f int, feature string")
    return names.join(scores, "f", "left").select("feature", F.greatest(F.coalesce("s", F.lit(0.0)), F.lit(0.0)).alias("mi"))
