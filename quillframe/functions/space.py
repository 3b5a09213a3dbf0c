"""Partition numeric space into cells of bounded size for exact neighbour work.

A k-d tree of a bounded sample cuts the space; Spark groups the rows by cell and
numpy works inside one cell at a time. A row meets other cells only where its search
ball touches them, so results are exact and no pair of rows is ever written out.
Equal points are merged beforehand, so copies cannot fill a cell.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 50_000
CELL = 2_000


@dataclass
class Cells:
    """Axis-aligned cells: inner nodes (dim, cut, left, right); a negative child is a leaf."""

    dim: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaves: int

    def touched(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) for every cell within ``radius`` of each row along the cut axes."""
        if not len(self.dim):
            return np.arange(len(x)), np.zeros(len(x), dtype=int)
        rows, cells, stack = [], [], [(0, np.arange(len(x)))]
        while stack:
            node, idx = stack.pop()
            if not len(idx):
                continue
            if node < 0:
                rows.append(idx)
                cells.append(np.full(len(idx), -node - 1))
                continue
            v = x[idx, self.dim[node]]
            stack.append((self.left[node], idx[v - radius[idx] <= self.cut[node]]))
            stack.append((self.right[node], idx[v + radius[idx] > self.cut[node]]))
        return np.concatenate(rows), np.concatenate(cells)

    def lists(self, x: np.ndarray, radius: np.ndarray) -> list[np.ndarray]:
        """The touched cells of each row."""
        rows, where = self.touched(x, radius)
        order = np.argsort(rows, kind="stable")
        return np.split(where[order], np.cumsum(np.bincount(rows, minlength=len(x)))[:-1]) if len(x) else []


def build_cells(df: DataFrame, column: str, seed: int = 42) -> Cells:
    """Cells of about ``CELL`` rows from a hash-drawn sample of at most ``SAMPLE`` points."""
    n = df.count()
    some, h = df.select(column), F.xxhash64(F.lit(seed), column)
    if n > SAMPLE:  # the smallest hashes; twice as many as needed are let through to the sort
        some = some.where(h < F.lit(int(-2**63 + 2**64 * min(2 * SAMPLE / n, 0.99)))).orderBy(h).limit(SAMPLE)
    x = np.array([r[0] for r in some.collect()], dtype=float)
    size = max(int(len(x) * CELL / max(n, 1)), 8) if n > SAMPLE else CELL
    dim, cut, left, right, leaves = [], [], [], [], 0

    def grow(idx):
        nonlocal leaves
        if len(idx) > size:
            for d in np.argsort(-np.ptp(x[idx], axis=0), kind="stable"):
                v = x[idx, d]
                c = float(np.median(v))
                if c == v.max():  # a value of half the rows or more: cut below it
                    if c == v.min():
                        continue
                    c = float(v[v < c].max())
                low = v <= c
                a, b = float(v[low].max()), float(v[~low].min())
                c = a + (b - a) / 2 if a + (b - a) / 2 < b else a  # between two values: a ball about either does not touch the other side for nothing
                node = len(dim)
                dim.append(int(d)), cut.append(c), left.append(0), right.append(0)
                left[node] = grow(idx[low])
                right[node] = grow(idx[~low])
                return node
        leaves += 1
        return -leaves

    if len(x):
        grow(np.arange(len(x)))
    return Cells(np.array(dim, int), np.array(cut), np.array(left, int), np.array(right, int), max(leaves, 1))


def spread(df: DataFrame, column: str, cells: Cells, radius: str | None = None) -> DataFrame:
    """Add ``_cell``: one row per touched cell."""
    @F.pandas_udf("array<int>")
    def touched(v: pd.Series, r: pd.Series) -> pd.Series:
        x = np.array(v.tolist(), dtype=float).reshape(len(v), -1)
        return pd.Series(cells.lists(x, r.to_numpy(dtype=float)), index=v.index)

    r = F.col(radius) if radius else F.lit(0.0)
    return df.withColumn("_cell", F.explode(touched(F.col(column), r.cast("double"))))


def _top(x: np.ndarray, y: np.ndarray, k: int, chunk: int = 512):
    """(row, index into y, distance) of the k nearest rows of y for every row of x."""
    for a in range(0, len(x), chunk):
        d = np.sqrt(np.maximum(((x[a:a + chunk, None, :] - y[None, :, :]) ** 2).sum(axis=2), 0))
        near = np.argsort(d, axis=1, kind="stable")[:, :k]
        yield a, near, np.take_along_axis(d, near, axis=1)


def nearest(probes: DataFrame, points: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(id, near): the k nearest points of each probe, nearest first, itself excluded.

    ``probes`` has (id, v), ``points`` has (pid, v, label). ``near`` is an array of
    (d, pid, v, label).
    """
    cells = build_cells(points, "v", seed)
    home = spread(points, "v", cells)

    def radius(key: tuple, p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p):
            return pd.DataFrame({"id": [], "v": [], "r": []})
        x = np.array(p["v"].tolist(), dtype=float).reshape(len(p), -1)
        far = np.full(len(p), np.inf)
        if len(q) > k:  # one place for the probe itself
            y = np.array(q["v"].tolist(), dtype=float).reshape(len(q), -1)
            for a, _, d in _top(x, y, k + 1):
                far[a:a + len(d)] = d[:, -1]
        return pd.DataFrame({"id": p["id"], "v": p["v"], "r": np.minimum(far * (1 + 1e-9) + 1e-12, 1e300)})

    first = spread(probes.select("id", "v"), "v", cells)
    balls = first.groupBy("_cell").cogroup(home.groupBy("_cell")).applyInPandas(radius, "id long, v array<double>, r double")

    def search(key: tuple, p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(p) and len(q):
            x = np.array(p["v"].tolist(), dtype=float).reshape(len(p), -1)
            y = np.array(q["v"].tolist(), dtype=float).reshape(len(q), -1)
            ids, pid, label, vs = p["id"].to_numpy(), q["pid"].to_numpy(), q["label"].to_numpy(), q["v"].to_numpy()
            for a, near, d in _top(x, y, k + 1):
                for i in range(len(near)):
                    out += [(ids[a + i], float(d[i, j]), pid[n], vs[n], label[n]) for j, n in enumerate(near[i]) if pid[n] != ids[a + i]][:k]
        return pd.DataFrame(out, columns=["id", "d", "pid", "v", "label"])

    ball_cells = spread(balls, "v", cells, "r").select("id", "v", "_cell")
    found = ball_cells.groupBy("_cell").cogroup(home.groupBy("_cell")).applyInPandas(
        search, "id long, d double, pid long, v array<double>, label string")
    # at most k candidates per touched cell
    return found.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "pid", "v", "label"))), 1, k).alias("near"))
