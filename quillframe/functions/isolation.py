"""Isolation forest: trees grown in parallel from small samples, rows scored where they lie."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.columns import col

PSI = 256


def _average(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _grow(x: np.ndarray, rng, depth: int, limit: int):
    spans = np.ptp(x, axis=0) if len(x) else np.zeros(x.shape[1])
    open_ = np.flatnonzero(spans > 0)
    if depth >= limit or len(x) <= 1 or not len(open_):
        return depth + _average(len(x))
    d = int(rng.choice(open_))
    cut = float(rng.uniform(x[:, d].min(), x[:, d].max()))
    low = x[:, d] <= cut
    return [d, cut, _grow(x[low], rng, depth + 1, limit), _grow(x[~low], rng, depth + 1, limit)]


def _table(tree) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A tree as arrays over its nodes: column, cut (a leaf: infinite), children (a leaf: itself twice) and path length."""
    nodes: list[list] = []

    def add(t) -> int:
        at = len(nodes)
        nodes.append([0, math.inf, at, at, t if not isinstance(t, list) else 0.0])
        if isinstance(t, list):
            nodes[at][:4] = t[0], t[1], add(t[2]), add(t[3])
        return at

    add(tree)
    dim, cut, low, high, length = zip(*nodes, strict=True)
    return np.array(dim), np.array(cut), np.array([low, high]), np.array(length)


def _lengths(tree: tuple, x: np.ndarray, levels: int) -> np.ndarray:
    """Path length of every row: all rows go down one level at a time."""
    dim, cut, children, length = tree
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(levels):
        at = children[(~(x[rows, dim[at]] <= cut[at])).astype(np.int64), at]
    return length[at]


def isolation_scores(df: DataFrame, cols: Sequence[str], trees: int, seed: int) -> DataFrame:
    """Add ``score`` in (0, 1); higher is more isolated."""
    names = list(cols)
    drawn = df.withColumn("_h", F.xxhash64(F.lit(seed), *[col(c) for c in names])).orderBy("_h").limit(trees * PSI)
    tagged = drawn.withColumn("_tree", F.pmod(F.xxhash64("_h", F.lit(seed + 1)), F.lit(trees)))

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("_h")[names].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, int(key[0])])
        return pd.DataFrame({"tree": [json.dumps(_grow(x, rng, 0, math.ceil(math.log2(max(len(x), 2)))))], "n": [len(x)]})

    grown = tagged.groupBy("_tree").applyInPandas(grow, "tree string, n long").collect()  # one small tree per row
    forest = [_table(json.loads(g["tree"])) for g in grown]
    levels = max(math.ceil(math.log2(max(g["n"], 2))) for g in grown)
    scale = _average(float(np.mean([g["n"] for g in grown])))

    @F.pandas_udf("double")
    def score(v: pd.DataFrame) -> pd.Series:
        x = v.to_numpy(dtype=float)
        total = np.zeros(len(x))
        for t in forest:
            total += _lengths(t, x, levels)
        return pd.Series(2.0 ** (-total / len(forest) / max(scale, 1e-9)))

    return df.withColumn("score", score(F.struct(*[col(c).cast("double").alias(c) for c in names])))
