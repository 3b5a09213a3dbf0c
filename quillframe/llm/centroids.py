"""k-means over integer vectors with a VA-file.

Every vector is compressed to a few bits a dimension: the number of a cell between
quantiles of that dimension. For the centroids of a round, tables of (dimension, cell)
give the least and the greatest contribution to a distance, so 64 lookups give an
interval that holds the distance to a centroid. A centroid whose interval lies above
another's whole interval is out; a full vector is fetched only where intervals overlap.

|x|^2 is part of every distance of x, so the intervals are those of |c|^2 - 2 x.c, which
are narrower. All numbers are integers: results are exact and do not depend on the order
in which tasks end.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import arrow_rows, saved

BITS = 5  # bits a dimension of the compressed vectors
ACCURACY = 1_000  # of the quantile sketches behind the cells: they shape the cells, not the result
LARGEST = 1 << 26  # largest component, so that a squared distance fits 64 bits
_BLOCK = 2_048  # rows that a task works on at once


@dataclass(frozen=True)
class Cells:
    """Cell borders of every dimension: ``cuts`` (dims, cells - 1) are the last values of all cells but the last,
    ``low`` and ``high`` (dims, cells) the least and the greatest value a cell may hold."""

    cuts: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.cuts[d], x[:, d], "left") for d in range(x.shape[1])], axis=1).astype(np.uint8)

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest -2 x c for each (dimension, cell, centroid)."""
        a, b = (-2 * edge[:, :, None] * centroids.T[:, None, :] for edge in (self.low, self.high))
        return np.minimum(a, b), np.maximum(a, b)


def components(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of every component, as numbers."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def usable(vector: Column, dims: int, scale: int) -> Column:
    """``dims`` components, none null, infinite, NaN, or too large for a squared distance in 64 bits."""
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) <= F.lit(LARGEST / scale), F.lit(False)))
    return F.coalesce((F.size(vector) == dims) & fine, F.lit(False))


def fit_cells(vectors: DataFrame, dims: int, bits: int = BITS) -> Cells:
    """Cells with about equally many vectors each, by quantile sketches of all rows (column ``v``); one row comes to the driver."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    aggs = [f(F.col("v")[d]) for d in range(dims) for f in (lambda c: F.percentile_approx(c, shares, ACCURACY), F.min, F.max)]
    got = vectors.agg(*[a.alias(f"_{i}") for i, a in enumerate(aggs)]).first()
    cuts = np.array([got[3 * d] or [0] * len(shares) for d in range(dims)], np.int64)
    least, most = (np.array([[got[3 * d + i] or 0] for d in range(dims)], np.int64) for i in (1, 2))
    return Cells(cuts, np.hstack([least, np.minimum(cuts + 1, most)]), np.hstack([cuts, most]))


def _full(raw: list[bytes], dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.int32).reshape(-1, dims).astype(np.int64)


def _codes(raw: list[bytes], dims: int, bits: int) -> np.ndarray:
    """Cells from packed bits."""
    packed = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
    bit = np.unpackbits(packed, axis=1, count=dims * bits).reshape(len(raw), dims, bits)
    return (bit << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)


def _pack(codes: np.ndarray, bits: int) -> list[bytes]:
    bit = (codes[:, :, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8)) & np.uint8(1)
    return [row.tobytes() for row in np.packbits(bit.reshape(len(codes), -1), axis=1)]


def survivors(codes: np.ndarray, cells: Cells, centroids: np.ndarray) -> np.ndarray:
    """(rows, centroids): whether the centroid may be the nearest, by intervals alone."""
    low, high = cells.tables(centroids)
    own = (centroids ** 2).sum(axis=1)
    least, most = np.tile(own, (len(codes), 1)), np.tile(own, (len(codes), 1))
    for d in range(codes.shape[1]):
        least += low[d, codes[:, d]]
        most += high[d, codes[:, d]]
    return least <= most.min(axis=1)[:, None]


def nearest(x: np.ndarray, open_: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid among the open ones (ties: the smaller number) and its squared distance."""
    best, far = np.full(len(x), -1), np.full(len(x), np.iinfo(np.int64).max)
    for c, centre in enumerate(centroids):
        rows = np.nonzero(open_[:, c])[0]
        d = ((x[rows] - centre) ** 2).sum(axis=1)
        better = d < far[rows]
        best[rows[better]], far[rows[better]] = c, d[better]
    return best, far


def _blocks(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == _BLOCK:
            yield held
            held = []
    if held:
        yield held


def _sums(moves: DataFrame, dims: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Change of every centroid's count and component sums by rows ``old, new, vector`` (-1: none)."""

    def rows(given):
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for block in _blocks(given):
            old, new, raw = zip(*block, strict=True)
            x = _full(raw, dims)
            for sign, ends in ((-1, np.array(old)), (1, np.array(new))):
                for c in np.unique(ends[ends >= 0]):
                    count[c] += sign * (ends == c).sum()
                    total[c] += sign * x[ends == c].sum(axis=0)
        for c in range(k):
            yield c, int(count[c]), total[c].tolist()

    parts = arrow_rows(moves.select("old", "new", "vector"), rows, "c int, n bigint, s array<bigint>")
    got = parts.groupBy("c").agg(F.sum("n"), *[F.sum(F.col("s")[d]) for d in range(dims)]).collect()  # a row per centroid
    count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
    for row in got:
        count[row[0]], total[row[0]] = row[1], row[2:]
    return count, total


def _moved(centroids: np.ndarray, count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Componentwise floor of the means; a centroid without vectors stays."""
    return np.where(count[:, None] > 0, total // np.maximum(count, 1)[:, None], centroids)


def _judged(codes: DataFrame, cells: Cells, centroids: np.ndarray, dims: int, bits: int) -> DataFrame:
    """``row, code, old`` with ``new`` (-1 where intervals overlap) and the ``open`` centroids as bytes."""

    def rows(given):
        for block in _blocks(given):
            number, raw, old = zip(*block, strict=True)
            left = survivors(_codes(raw, dims, bits), cells, centroids)
            new = np.where(left.sum(axis=1) == 1, left.argmax(axis=1), -1)
            for i, n in enumerate(new.tolist()):
                yield number[i], raw[i], old[i], n, np.packbits(left[i]).tobytes() if n < 0 else None

    return arrow_rows(codes.select("row", "code", "old"), rows, "row bigint, code binary, old int, new int, open binary")


def _settled(fetched: DataFrame, centroids: np.ndarray, dims: int) -> DataFrame:
    """``row, old, new, vector`` of fetched rows; the vector is kept where the cluster changed."""
    k = len(centroids)

    def rows(given):
        for block in _blocks(given):
            number, old, new, mask, raw = zip(*block, strict=True)
            new = np.array(new)
            at = np.nonzero(new < 0)[0]
            if len(at):
                open_ = np.array([np.unpackbits(np.frombuffer(mask[i], np.uint8), count=k) for i in at]).astype(bool)
                new[at] = nearest(_full([raw[i] for i in at], dims), open_, centroids)[0]
            for i, n in enumerate(new.tolist()):
                yield number[i], old[i], n, raw[i] if n != old[i] else None

    return arrow_rows(fetched.select("row", "old", "new", "open", "vector"), rows, "row bigint, old int, new int, vector binary")


def cluster(vectors: DataFrame, key: str, vector: str, first: DataFrame, dims: int, scale: int, rounds: int, bits: int = BITS) -> tuple[DataFrame, np.ndarray]:
    """Rows ``key, cluster, distance`` (squared) of every usable vector after ``rounds`` rounds, and the final centroids.

    ``first`` holds the first centroids in order, as usable vectors in column ``v``: a bounded number of rows, which
    come to the driver. Full vectors are read three times: when they are compressed and first assigned, for the sums
    of that round, and for the distances at the end. In between, a round reads the compressed vectors and joins
    the full ones of those rows whose intervals overlap or whose cluster changed.
    Vectors that are not ``usable`` take no part. Repeated rows and ids are rows of their own. No usable vector: no rows.
    """
    good = vectors.where(usable(F.col(f"`{vector}`"), dims, scale)).select(F.col(f"`{key}`").alias("key"), components(F.col(f"`{vector}`"), scale).alias("v"))
    empty = good.select("key", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0)
    centroids = np.array([r[0] for r in first.select(components(F.col("v"), scale)).collect()], np.int64)
    if not len(centroids):
        return empty, centroids
    k, cells, kind = len(centroids), fit_cells(good, dims, bits), good.schema["key"].dataType.simpleString()

    def compressed(given):
        for block in _blocks(given):
            ids, values = zip(*block, strict=True)
            x = np.array(values, np.int64)
            codes = cells.encode(x)
            best = nearest(x, survivors(codes, cells, centroids0), centroids0)[0]
            yield from zip(ids, _pack(codes, bits), [r.tobytes() for r in x.astype(np.int32)], best.tolist(), strict=True)

    centroids0 = centroids
    table = saved(arrow_rows(good, compressed, f"key {kind}, code binary, vector binary, cluster int")
                  .withColumn("row", F.monotonically_increasing_id()))
    count, total = _sums(table.select(F.lit(-1).alias("old"), F.col("cluster").alias("new"), "vector"), dims, k)
    centroids = _moved(centroids, count, total)
    state = table.select("row", "code", F.col("cluster").alias("old"))
    for _ in range(rounds - 1):
        judged = saved(_judged(state, cells, centroids, dims, bits))
        needed = judged.where("new < 0 or new != old").select("row", "old", "new", "open")
        settled = saved(_settled(needed.join(table.select("row", "vector"), "row"), centroids, dims))
        change, shift = _sums(settled.where("vector is not null"), dims, k)
        count, total = count + change, total + shift
        centroids = _moved(centroids, count, total)
        late = settled.select("row", F.col("new").alias("_new"))
        state = judged.join(late, "row", "left").select("row", "code", F.coalesce("_new", "new").alias("old"))

    def measured(given):
        for block in _blocks(given):
            ids, raw, full = zip(*block, strict=True)
            best, far = nearest(_full(full, dims), survivors(_codes(raw, dims, bits), cells, last), last)
            yield from zip(ids, best.tolist(), far.tolist(), strict=True)

    last = centroids
    return arrow_rows(table.select("key", "code", "vector"), measured, f"key {kind}, cluster int, distance bigint"), centroids
