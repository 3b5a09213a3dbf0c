"""Density clustering over the cells of a grid."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions.graph import components
from quillframe.functions.ordered import index_rows, reliable_checkpoint
from quillframe.functions.space import build_cells, spread

PIECE_ROWS = 20_000  # points of a cell in one task, about


def _vectors(t: pa.Table, name: str) -> np.ndarray:
    flat = t[name].combine_chunks()
    return np.asarray(flat.flatten(), dtype=float).reshape(len(t), -1) if len(t) else np.zeros((0, 1))


def _within(x: np.ndarray, y: np.ndarray, eps: float, size: int = 1_000_000):
    """(start, matrix) for chunks of x: which rows of y lie within eps."""
    chunk = max(size // max(len(y), 1), 1)
    for a in range(0, len(x), chunk):
        yield a, ((x[a:a + chunk, None, :] - y[None, :, :]) ** 2).sum(axis=2) <= eps * eps


def _total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _near(x: Sequence[Column], lo: str, hi: str) -> Column:
    """Squared distance of a point to a box."""
    return _total([F.pow(F.greatest(F.col(lo)[i] - c, c - F.col(hi)[i], F.lit(0.0)), 2) for i, c in enumerate(x)])


def _far(x: Sequence[Column], lo: str, hi: str) -> Column:
    """Squared distance of a point to the farthest place of a box."""
    return _total([F.pow(F.greatest(F.abs(F.col(lo)[i] - c), F.abs(F.col(hi)[i] - c)), 2) for i, c in enumerate(x)])


def _pieces(rows: Column) -> Column:
    return F.ceil(rows / F.lit(PIECE_ROWS)).cast("int")


def box_pairs(boxes: DataFrame, eps: float) -> DataFrame:
    """Rows ``a, b`` of the numbered boxes ``cell, lo, hi`` (no longer than eps) that come within eps, both ways."""
    middle = boxes.select("cell", "lo", "hi", F.zip_with("lo", "hi", lambda a, b: (a + b) / 2).alias("v"))
    spaces = build_cells(middle, "v")
    own = reliable_checkpoint(spread(middle, "v", spaces).withColumnRenamed("_cell", "_own"))
    halo = reliable_checkpoint(spread(own.withColumn("_r", F.lit(2.0 * eps)), "v", spaces, "_r"))

    def met(t: pa.Table) -> pa.Table:
        lo, hi, ids = _vectors(t, "lo"), _vectors(t, "hi"), t["cell"].to_numpy()
        mine, found = np.flatnonzero(t["_own"].to_numpy() == t["_cell"].to_numpy()), []
        chunk = max(1_000_000 // len(t), 1)
        for at in range(0, len(mine), chunk):
            m = mine[at:at + chunk]
            gap = np.maximum(np.maximum(lo[m, None] - hi[None], lo[None] - hi[m, None]), 0.0)
            i, j = np.nonzero((gap ** 2).sum(axis=2) <= eps * eps)
            found.append((ids[m[i]], ids[j]))
        a, b = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (ids[:0], ids[:0])
        return pa.table({"a": a[a != b], "b": b[a != b]})

    return halo.select("cell", "lo", "hi", "_own", "_cell").groupBy("_cell").applyInArrow(met, "a long, b long")


def _probed(probes: DataFrame, points: DataFrame, eps: float) -> DataFrame:
    """Rows ``v, cell, n``: how many rows of ``points`` (cell, pieces, v, w) in the cell of a probe (v, cell) lie within eps of it.

    A cell's points are read once, in pieces; its probes meet every piece.
    """
    sizes = points.select("cell", "pieces").distinct()
    asked = probes.select("v", "cell").join(sizes, "cell").select("v", "cell", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    given = points.join(probes.select("cell").distinct(), "cell", "left_semi").select("cell", F.pmod(F.xxhash64("v"), "pieces").cast("int").alias("piece"), "v", "w")

    def count(p: pa.Table, q: pa.Table) -> pa.Table:
        n = np.zeros(len(p), np.int64)
        if len(p) and len(q):
            w = q["w"].to_numpy()
            for a, near in _within(_vectors(p, "v"), _vectors(q, "v"), eps):
                n[a:a + len(near)] = near @ w
        return pa.table({"v": p["v"], "cell": p["cell"], "n": n})

    # toDF names the columns of both sides anew, as both may come from the same rows
    some = asked.toDF("v", "cell", "piece").groupBy("cell", "piece").cogroup(given.toDF("cell", "piece", "v", "w").groupBy("cell", "piece")).applyInArrow(count, "v array<double>, cell long, n long")
    return some.groupBy("v", "cell").agg(F.sum("n").alias("n"))


def _touching(pairs: DataFrame, points: DataFrame, boxes: DataFrame, eps: float, dims: int) -> DataFrame:
    """The ``a, b`` of the pairs of cells that have a point each within eps; only points near the other cell are compared."""
    x = [F.col("v")[i] for i in range(dims)]
    sides = []
    for mine, other in (("a", "b"), ("b", "a")):
        p = pairs.join(points.select(F.col("cell").alias(mine), "v"), mine).join(boxes.select(F.col("cell").alias(other), "lo", "hi"), other)
        sides.append(reliable_checkpoint(p.where(_near(x, "lo", "hi") <= eps * eps).select("a", "b", "v")))
    cut = [s.groupBy("a", "b").agg(_pieces(F.count(F.lit(1))).alias(f"p{i}")) for i, s in enumerate(sides)]
    sizes = cut[0].join(cut[1], ["a", "b"])
    laid = []
    for i, s in enumerate(sides):
        own, every = F.pmod(F.xxhash64("v"), f"p{i}").cast("int"), F.explode(F.sequence(F.lit(0), F.col(f"p{1 - i}") - 1))
        named = s.join(sizes, ["a", "b"]).select("a", "b", "v", own.alias(f"i{i}"), every.alias(f"i{1 - i}"))
        laid.append(named.toDF(*named.columns).groupBy("a", "b", "i0", "i1"))

    def test(key: tuple[pa.Scalar, ...], p: pa.Table, q: pa.Table) -> pa.Table:
        hit = len(p) and len(q) and any(near.any() for _, near in _within(_vectors(p, "v"), _vectors(q, "v"), eps))
        return pa.table({"a": pa.array([key[0].as_py()] if hit else [], pa.int64()), "b": pa.array([key[1].as_py()] if hit else [], pa.int64())})

    return laid[0].cogroup(laid[1]).applyInArrow(test, "a long, b long").distinct()


def dbscan(df: DataFrame, features: Sequence[str], eps: float, min_samples: int, out: str) -> DataFrame:
    """Add the cluster number of each row, -1 for noise; a row with a null, NaN or infinite value is noise.

    Equal rows are merged with a weight. A grid whose cells are no longer than eps from corner to corner spares most comparisons:
    the points of a cell are all near each other, so those of a cell of ``min_samples`` rows are core points, and the core points of any cell are in one cluster.
    Only the few points of the other cells are compared with points around them, and two cells of core points are compared where their outermost
    points do not touch and other links have not joined them. The work follows the rows, however many lie within eps of one.
    """
    dims, limit = len(features), float(eps) * float(eps)
    side = eps / math.sqrt(dims) * (1 - 1e-6)
    rows = df.withColumn("_v", F.array(*[F.col(c).cast("double") for c in features]))
    finite = reduce(lambda a, b: a & b, [F.abs(F.col(c).cast("double")) < float("inf") for c in features])
    merged = rows.where(finite).groupBy("_v").agg(F.count(F.lit(1)).alias("w"))
    placed = reliable_checkpoint(merged.select(F.col("_v").alias("v"), "w", F.transform("_v", lambda x: F.floor(x / F.lit(side))).alias("c")))
    x = [F.col("v")[i] for i in range(dims)]

    def box(*more: Column) -> list[Column]:
        return [F.array(*[F.min(c) for c in x]).alias("lo"), F.array(*[F.max(c) for c in x]).alias("hi"), *more]

    boxes = reliable_checkpoint(placed.groupBy("c").agg(*box(F.sum("w").alias("weight"), _pieces(F.count(F.lit(1))).alias("pieces")))
                                .withColumn("cell", F.monotonically_increasing_id()))
    points = reliable_checkpoint(placed.join(boxes.select("c", "cell", "weight", "pieces"), "c").select("cell", "pieces", "v", "w", "weight"))
    pairs = reliable_checkpoint(box_pairs(boxes, eps))

    # the points of cells with few rows: whole boxes around them count at once, the others are looked into
    few = points.where(F.col("weight") < min_samples).select("v", F.col("cell").alias("a"), "weight")
    around = few.join(pairs, "a").join(boxes.select(F.col("cell").alias("b"), "lo", "hi", F.col("weight").alias("_w")), "b").where(_near(x, "lo", "hi") <= limit)
    around = reliable_checkpoint(around.select("v", F.col("b").alias("cell"), "_w", (_far(x, "lo", "hi") <= limit).alias("whole")))
    sure = few.select("v", F.col("weight").alias("n")).unionByName(around.where("whole").select("v", F.col("_w").alias("n"))).groupBy("v").agg(F.sum("n").alias("n"))
    sure = reliable_checkpoint(sure)
    looked = _probed(around.where("not whole").join(sure.where(F.col("n") < min_samples).select("v"), "v"), points, eps)
    dense = reliable_checkpoint(sure.unionByName(looked.select("v", "n")).groupBy("v").agg(F.sum("n").alias("n")).where(F.col("n") >= min_samples).select("v"))
    core = points.where(F.col("weight") >= min_samples).unionByName(points.where(F.col("weight") < min_samples).join(dense, "v", "left_semi").select(*points.columns))
    core = reliable_checkpoint(core.select("cell", "pieces", "v", "w"))

    # cells of core points: linked by their outermost points, or by any two
    outer = F.array_distinct(F.array(*[g("v", c) for c in x for g in (F.min_by, F.max_by)])).alias("outer")
    held = reliable_checkpoint(core.groupBy("cell").agg(*box(outer, F.min("v").alias("least"))))
    end = {s: held.select(*[F.col(c).alias(f"{c}_{s}") for c in ("cell", "lo", "hi", "outer")]) for s in "ab"}
    met = pairs.where("a < b").join(end["a"], F.col("a") == F.col("cell_a")).join(end["b"], F.col("b") == F.col("cell_b"))
    gap = _total([F.pow(F.greatest(F.col("lo_a")[i] - F.col("hi_b")[i], F.col("lo_b")[i] - F.col("hi_a")[i], F.lit(0.0)), 2) for i in range(dims)])
    touch = F.exists("outer_a", lambda p: F.exists("outer_b", lambda q: _total([F.pow(p[i] - q[i], 2) for i in range(dims)]) <= limit))
    known = reliable_checkpoint(met.where(gap <= limit).select("a", "b", touch.alias("touch")))
    links = known.where("touch").select("a", "b")
    roots = reliable_checkpoint(components(links))
    named = known.where("not touch").join(roots.select(F.col("node").alias("a"), F.col("root").alias("_ra")), "a", "left").join(
        roots.select(F.col("node").alias("b"), F.col("root").alias("_rb")), "b", "left")
    unsure = reliable_checkpoint(named.where(F.coalesce("_ra", "a") != F.coalesce("_rb", "b")).select("a", "b"))
    if not unsure.isEmpty():
        roots = reliable_checkpoint(components(links.unionByName(_touching(unsure, core, held, eps, dims))))
    rooted = held.select("cell", "least").join(roots, F.col("cell") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cell"))
    names = index_rows(rooted.groupBy("root").agg(F.min("least").alias("least")), ["least"]).df.select("root", F.col("_idx").alias("_n"))
    numbers = reliable_checkpoint(rooted.join(names, "root").select("cell", "_n"))

    # other points follow the first cluster with a core point near them
    rest = few.join(dense, "v", "left_anti")
    own = rest.select("v", F.col("a").alias("cell"))
    close = own.unionByName(around.select("v", "cell").join(own.select("v"), "v", "left_semi")).join(held.select("cell", "lo", "hi"), "cell").where(_near(x, "lo", "hi") <= limit)
    close = reliable_checkpoint(close.select("v", "cell", (_far(x, "lo", "hi") <= limit).alias("whole")))
    edge = close.where("whole").select("v", "cell").unionByName(_probed(close.where("not whole"), core, eps).where("n > 0").select("v", "cell"))
    border = edge.join(numbers, "cell").groupBy("v").agg(F.min("_n").alias("_n"))
    table = core.select("cell", "v").join(numbers, "cell").select("v", "_n").unionByName(border).withColumnRenamed("v", "_pv")
    return rows.join(table, F.col("_v") == F.col("_pv"), "left").withColumn(out, F.coalesce("_n", F.lit(-1).cast("long"))).drop("_v", "_pv", "_n")


@dataclass
class Density:
    """Estimator and model over a vector column ``features``. Density clusters are those of the rows given to ``transform``:
    the method has no rule for rows it has not seen."""

    eps: float = 0.5
    min_samples: int = 5

    def fit(self, data: DataFrame) -> Density:
        return self

    def transform(self, data: DataFrame) -> DataFrame:
        size = data.select(F.size(vector_to_array("features"))).first()
        names = [f"_f{i}" for i in range(size[0] if size else 0)]
        flat = data.withColumns({n: vector_to_array("features")[i] for i, n in enumerate(names)})
        return dbscan(flat, names, self.eps, self.min_samples, "prediction").withColumn("prediction", F.col("prediction").cast("int")).drop(*names)
