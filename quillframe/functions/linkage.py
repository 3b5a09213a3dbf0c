"""Agglomerative clustering of all rows by cluster features.

A cluster feature is the number and the mean of some rows; features of different tasks add
up, and a set of them is cut down by splitting where their spread is largest. Every task keeps a
bounded set, sets are merged in a tree of rounds, and linkage joins what is left. Up to the bound
a feature is one distinct row, so that small tables get exact linkage.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.functions.ordered import reliable_checkpoint

FEATURES = 500  # cluster features that linkage starts from, at most
_FAN = 16  # sets that are merged in one task


def summarise(x: np.ndarray, n: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``limit`` cluster features for weighted points: the one with the largest sum of squares is split at its mean, along its widest column."""

    def entry(at: np.ndarray):
        own, w = x[at], n[at][:, None]
        if not np.ptp(own, axis=0).any():
            return 0.0, int(at[0]), at, 0, 0.0
        mean = (own * w).sum(axis=0) / w.sum()
        squares = (w * (own - mean) ** 2).sum(axis=0)
        d = int(np.argmax(squares))
        return -float(squares.sum()), int(at[0]), at, d, float(mean[d])

    heap = [entry(np.arange(len(x)))] if len(x) else []
    while heap and len(heap) < limit and heap[0][0] < 0:
        _, _, at, d, cut = heapq.heappop(heap)
        under = x[at, d] <= cut
        if under.all() or not under.any():  # a mean rounded onto an end
            under = x[at, d] == x[at, d].min()
        heapq.heappush(heap, entry(at[under]))
        heapq.heappush(heap, entry(at[~under]))
    parts = [e[2] for e in sorted(heap, key=lambda e: e[1])]
    size = np.array([n[at].sum() for at in parts])
    means = [x[at[0]] if not np.ptp(x[at], axis=0).any() else (x[at] * n[at][:, None]).sum(axis=0) / n[at].sum() for at in parts]
    return np.array(means).reshape(len(parts), -1), size


def cluster_features(points: DataFrame, limit: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Means and sizes of at most ``limit`` cluster features of the rows' arrays ``v``; a bounded number of rows reaches the driver."""

    def reduce_task(frames):
        held, sizes = [], []

        def cut():
            x, n = summarise(np.concatenate(held), np.concatenate(sizes), limit)
            held[:], sizes[:] = [x], [n]

        for pdf in frames:
            for start in range(0, len(pdf), 4 * limit):
                part = pdf.iloc[start:start + 4 * limit]
                held.append(np.array(part["v"].tolist(), dtype=float).reshape(len(part), -1))
                sizes.append(part["n"].to_numpy(dtype=float))
                if sum(map(len, held)) > 8 * limit:
                    cut()
        if held:
            cut()
            yield pd.DataFrame({"v": list(held[0]), "n": sizes[0]})

    def step(df: DataFrame) -> DataFrame:
        return reliable_checkpoint(df.mapInPandas(reduce_task, "v array<double>, n double"))

    rows = points.groupBy("v").agg(F.count(F.lit(1)).cast("double").alias("n"))
    state = step(rows)
    while (count := state.count()) > _FAN * limit:
        state = step(state.repartition(max(count // (_FAN * limit), 1)))
    got = sorted((tuple(r["v"]), r["n"]) for r in state.collect())  # at most _FAN * limit rows
    return summarise(np.array([v for v, _ in got], dtype=float).reshape(len(got), -1), np.array([n for _, n in got]), limit)


@dataclass
class LinkageModel:
    """Rows follow their nearest cluster feature."""

    centres: np.ndarray
    labels: np.ndarray

    def transform(self, data: DataFrame) -> DataFrame:
        centres, labels = self.centres, self.labels
        own = (centres ** 2).sum(axis=1)

        @F.pandas_udf("int")
        def place(v: pd.Series) -> pd.Series:
            x = np.array(v.tolist(), dtype=float).reshape(len(v), -1)
            return pd.Series(labels[np.argmin(own - 2 * x @ centres.T, axis=1)] if len(x) else [], index=v.index, dtype="int32")

        return data.withColumn("prediction", place(vector_to_array("features")))


@dataclass
class Linkage:
    """Estimator over a vector column ``features``."""

    clusters: int
    method: str = "ward"
    limit: int = FEATURES

    def fit(self, data: DataFrame) -> LinkageModel:
        centres, sizes = cluster_features(data.select(vector_to_array("features").alias("v")), max(self.limit, self.clusters))
        return LinkageModel(centres, agglomerate(centres, sizes, self.clusters, self.method))


def agglomerate(centres: np.ndarray, sizes: np.ndarray, clusters: int, method: str = "ward") -> np.ndarray:
    """Cluster number of each centre after merging down to ``clusters`` (ward, complete or average linkage)."""
    if method not in ("ward", "complete", "average"):
        raise ValueError(f"unknown linkage {method!r}")
    x, n = centres.astype(float).copy(), sizes.astype(float).copy()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    if method == "ward":
        d *= np.sqrt(2 * np.outer(n, n) / (n[:, None] + n[None]))
    np.fill_diagonal(d, np.inf)
    owner = np.arange(len(x))
    alive = list(range(len(x)))
    while len(alive) > max(clusters, 1):
        sub = d[np.ix_(alive, alive)]
        i, j = (alive[k] for k in np.unravel_index(np.argmin(sub), sub.shape))
        for k in alive:
            if k in (i, j):
                continue
            if method == "complete":
                v = max(d[i, k], d[j, k])
            elif method == "average":
                v = (n[i] * d[i, k] + n[j] * d[j, k]) / (n[i] + n[j])
            else:
                t = n[i] + n[j] + n[k]
                v = np.sqrt(((n[i] + n[k]) * d[i, k] ** 2 + (n[j] + n[k]) * d[j, k] ** 2 - n[k] * d[i, j] ** 2) / t)
            d[i, k] = d[k, i] = v
        n[i] += n[j]
        owner[owner == j] = i
        alive.remove(j)
    return np.array([alive.index(o) for o in owner])
