"""Nearest neighbours by low-dimensional stable projections.

Every vector is projected on ``dims`` Gaussian directions. The squared projected distance
of two vectors over their true one is then chi-square distributed with ``dims`` degrees of
freedom. A kd-tree of the projections is searched outward from the query: candidates come
in order of their projected distance and are verified on the full vectors, until the next
one lies so far out that a true neighbour would be found there with probability at most
``1 - confidence``. Every true neighbour is therefore found with ``confidence`` at least.

The upper levels of the tree, cut on a sample, deal the vectors into parts of bounded size;
below them a task builds the lower levels for the part that it holds and streams the queries past
it. A query first visits the part it lies in, for a bound on its k-th distance, and then the
parts that the stopping test does not rule out. Copies of a vector are one point.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm.common import arrow_rows, saved, shuffle_partitions

DIMS = 12  # projected dimensions, an even number
CONFIDENCE = 0.98
SAMPLE = 32_768  # projected points, expected, that the upper cuts are made on
PART_ROWS = 131_072  # points of a part at most
LEAST_ROWS = 256  # points of a part that are worth a task
LEAF = 32  # points of a leaf of the lower tree
_STEP = 8  # leaves taken at once
SEED = 42


def chi_square_limit(share: float, dims: int) -> float:
    """The value that a chi-square variable with an even number of degrees of freedom exceeds with probability 1 - ``share``."""
    low, high = 0.0, 4.0 * dims + 1000
    for _ in range(200):
        x = (low + high) / 2
        tail = sum(math.exp(i * math.log(x / 2) - x / 2 - math.lgamma(i + 1)) for i in range(dims // 2))
        low, high = (x, high) if tail > 1 - share else (low, x)
    return high


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, and not all zero."""
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce(fine & F.exists(vector, lambda x: x.cast("double") != 0), F.lit(False))


def directions(size: int, dims: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, size]).standard_normal((size, dims))


def project(vectors: DataFrame, dims: int) -> DataFrame:
    """``ids`` (or any first column), the vector as bytes of doubles and its projection, from rows of two columns."""
    name, kind = vectors.dtypes[0]

    def rows(given):
        known = {}
        for ids, values in given:
            x = np.array(values, np.float64)
            if len(x) not in known:
                known[len(x)] = directions(len(x), dims)
            yield ids, x.tobytes(), (x @ known[len(x)]).tolist()

    return arrow_rows(vectors, rows, f"{name} {kind}, v binary, p array<double>")


@dataclass(frozen=True)
class Tree:
    """kd-tree by inner nodes (dim, cut, left, right); a negative child -i - 1 is leaf i with the box low[i], high[i]."""

    dim: list[int]
    cut: list[float]
    left: list[int]
    right: list[int]
    low: np.ndarray
    high: np.ndarray

    def leaf_of(self, p: np.ndarray) -> int:
        node = 0 if self.dim else -1
        while node >= 0:
            node = self.left[node] if p[self.dim[node]] <= self.cut[node] else self.right[node]
        return -node - 1

    def distances(self, p: np.ndarray) -> np.ndarray:
        """Squared distance of a point to every leaf's box."""
        return (np.maximum(np.maximum(self.low - p, p - self.high), 0) ** 2).sum(axis=1)


def build_tree(p: np.ndarray, leaf: int, whole: bool) -> tuple[Tree, list[np.ndarray]]:
    """Tree with at most ``leaf`` points a leaf (more only where all are equal) and the points of each leaf.

    ``whole``: the boxes cover all space, as for points not seen; else they are the bounds of the leaf's points.
    """
    dim, cut, left, right, low, high, members = [], [], [], [], [], [], []

    def grow(at: np.ndarray, a: np.ndarray, b: np.ndarray) -> int:
        x = p[at]
        if len(at) > leaf:
            d = int(np.argmax(np.ptp(x, axis=0)))
            c = float(np.partition(x[:, d], (len(at) - 1) // 2)[(len(at) - 1) // 2])
            under = x[:, d] <= c
            if not under.all():
                node = len(dim)
                dim.append(d), cut.append(c), left.append(0), right.append(0)
                inner, outer = b.copy(), a.copy()
                inner[d] = outer[d] = c
                left[node], right[node] = grow(at[under], a, inner), grow(at[~under], outer, b)
                return node
        members.append(at)
        low.append(a if whole or not len(at) else x.min(axis=0)), high.append(b if whole or not len(at) else x.max(axis=0))
        return -len(members)

    n = p.shape[1]
    grow(np.arange(len(p)), np.full(n, -np.inf), np.full(n, np.inf))
    return Tree(dim, cut, left, right, np.array(low), np.array(high)), members


class Part:
    """The points of one part and one vector size, laid out leaf by leaf."""

    def __init__(self, ids: list[list[int]], v: np.ndarray, p: np.ndarray):
        self.tree, members = build_tree(p, LEAF, whole=False)
        at = np.concatenate(members)
        self.v, self.p, self.ids = v[at], p[at], [ids[i] for i in at]
        self.ends = np.cumsum([0, *map(len, members)])

    def search(self, query: int, v: np.ndarray, p: np.ndarray, k: int, limit: float, far: float) -> list[tuple[float, int]]:
        """The best ``k`` (distance, id), nearest first, that are verified before the stopping test holds; ``far`` bounds the k-th distance."""
        lower, best = self.tree.distances(p), []
        order = np.argsort(lower, kind="stable")
        for start in range(0, len(order), _STEP):
            step = order[start:start + _STEP]
            if lower[step[0]] > limit * far * far:
                break
            rows = np.concatenate([np.arange(self.ends[i], self.ends[i + 1]) for i in step])
            ahead = ((self.p[rows] - p) ** 2).sum(axis=1)
            rows = rows[ahead <= limit * far * far]
            d = np.sqrt(((self.v[rows] - v) ** 2).sum(axis=1))
            close = d <= far
            best += [(x, i) for x, r in zip(d[close].tolist(), rows[close].tolist(), strict=True) for i in self.ids[r] if i != query]
            best = sorted(best)[:k]
            if len(best) == k:
                far = min(far, best[-1][0])
        return best


def _upper_cuts(points: DataFrame, dims: int) -> tuple[Tree, DataFrame]:
    """Tree over a hash-drawn sample of about ``SAMPLE`` points and the points with their leaf as ``region``."""
    n = points.count()
    parts = max(min(shuffle_partitions(points.sparkSession), n // LEAST_ROWS), -(-n // PART_ROWS), 1)
    drawn = F.pmod(F.xxhash64(F.lit(SEED), "v"), F.lit(1 << 40)) < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 40))
    some = np.array([r[0] for r in points.where(drawn).select("p").collect()], np.float64)
    tree = build_tree(some.reshape(-1, dims), max(-(-len(some) // parts), 8), whole=True)[0]

    @F.arrow_udf("int")
    def region(p: pa.Array) -> pa.Array:
        x = p.flatten().to_numpy(zero_copy_only=False).reshape(len(p), -1)
        return pa.array([tree.leaf_of(row) for row in x], pa.int32())

    return tree, points.withColumn("region", region("p"))


def _pieces(points: DataFrame, regions: int) -> list[int]:
    """Where the part numbers of each region end: a region with more than ``PART_ROWS`` points has several. A row per region comes to the driver."""
    count = dict(points.groupBy("region").count().collect())
    return list(accumulate(max(-(-count.get(i, 0) // PART_ROWS), 1) for i in range(regions)))


def _piece(region: Column, ends: list[int]) -> Column:
    first, last = (F.element_at(F.lit(x), region + 1) for x in ([0, *ends[:-1]], ends))
    return (first + F.pmod(F.xxhash64("v"), last - first)).cast("int")


def _parts_near(tree: Tree, ends: list[int], limit: float, first: bool = False) -> Column:
    """The parts of the regions that the stopping test does not rule out for a query with the bound ``far``; ``first``: one part of the own region."""
    starts = [0, *ends[:-1]]

    @F.arrow_udf("array<int>")
    def near(p: pa.Array, far: pa.Array) -> pa.Array:
        x, out = p.flatten().to_numpy(zero_copy_only=False).reshape(len(p), -1), []
        for row, r in zip(x, far.to_numpy(zero_copy_only=False), strict=True):
            if first:
                out.append([starts[tree.leaf_of(row)]])
            else:
                out.append([i for leaf in np.nonzero(tree.distances(row) <= limit * r * r)[0] for i in range(starts[leaf], ends[leaf])])
        return pa.array(out, pa.list_(pa.int32()))

    return near("p", "far")


def _streams(laid: DataFrame, work, schema: str) -> DataFrame:
    """Runs ``work(points, queries)`` on every part; ``laid`` is dealt by ``part`` and sorted, points (``query`` 0) first."""

    def rows(given: Iterable[tuple]) -> Iterator[tuple]:
        for _, group in groupby(given, key=itemgetter(0)):
            held: dict[int, tuple[list, list, list]] = {}
            parts: dict[int, Part] | None = None
            for _, is_query, ids, v, p, far in group:
                if not is_query:
                    for kept, value in zip(held.setdefault(len(v), ([], [], [])), (ids, v, p), strict=True):
                        kept.append(value)
                    continue
                if parts is None:
                    parts = {n: Part(i, np.frombuffer(b"".join(x), np.float64).reshape(len(x), -1), np.array(y)) for n, (i, x, y) in held.items()}
                    held = {}
                if len(v) in parts:
                    yield from work(parts[len(v)], ids[0], np.frombuffer(v, np.float64), np.array(p), far)

    return arrow_rows(laid.select("part", "query", "ids", "v", "p", "far"), rows, schema)


def _dealt(points: DataFrame, queries: DataFrame, to: Column) -> DataFrame:
    """Points and, after them, the queries of every part; ``to`` names the parts of a query."""
    sent = queries.select(F.explode(to).alias("part"), F.lit(1).alias("query"), F.array("id").alias("ids"), "v", "p", "far")
    both = points.select("part", F.lit(0).alias("query"), "ids", "v", "p", F.lit(0.0).alias("far")).unionByName(sent)
    return both.repartition("part").sortWithinPartitions("part", "query", "ids")


def search(vectors: DataFrame, wanted: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding",
           dims: int = DIMS, confidence: float = CONFIDENCE) -> DataFrame:
    """Rows ``query_id, rank, vec_id, score``: the ``k`` nearest found of every row for which ``wanted`` holds.

    ``score`` is the Euclidean distance in double precision; ties go to the smaller id. Rows without an
    id and vectors that are not ``usable`` take no part; vectors of different sizes are never near. A
    query leaves out the rows of its own id; a queried id with several vectors is searched with the
    smallest one. Repeated rows count once. With ``k`` candidates or fewer all that are found are returned. No rows: no rows.
    """
    limit = chi_square_limit(confidence, dims)
    good = vectors.where(F.col(f"`{key}`").isNotNull() & usable(F.col(f"`{vector}`"))).select(
        F.col(f"`{key}`").cast("long").alias("id"), F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double")).alias("v"), wanted.alias("wanted"))
    # of copies only the k + 1 smallest ids can be among anybody's k nearest; every task cuts its rows to them before the shuffle
    ranked = good.select("v", "id").distinct().withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("id")))
    distinct = ranked.where(F.col("_n") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    points = saved(project(distinct.select("ids", "v"), dims))
    queries = saved(project(good.where("wanted").groupBy("id").agg(F.min("v").alias("v")), dims))
    tree, points = _upper_cuts(points, dims)
    ends = _pieces(points, len(tree.low))
    points = points.withColumn("part", _piece(F.col("region"), ends))

    def found(part: Part, query: int, x: np.ndarray, y: np.ndarray, far: float) -> Iterator[tuple]:
        yield from ((query, i, d) for d, i in part.search(query, x, y, k, limit, far))

    def visit(asked: DataFrame, to: Column) -> DataFrame:
        return _streams(_dealt(points, asked, to), found, "query_id bigint, vec_id bigint, score double")

    first = saved(visit(queries.withColumn("far", F.lit(float("inf"))), _parts_near(tree, ends, limit, first=True)))
    kth = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.max("score")).alias("far"))
    bounded = queries.join(kth, F.col("id") == F.col("query_id"), "left").withColumn("far", F.coalesce("far", F.lit(float("inf"))))
    each = first.unionByName(visit(bounded, _parts_near(tree, ends, limit))).distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
