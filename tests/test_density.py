"""Density clusters against plain Python over all pairs."""

import random
from itertools import product

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from quillframe.functions import density, space
from quillframe.functions.density import dbscan


def plain(x, eps, least):
    """Cluster numbers by the smallest core point; a border point joins the first cluster near it."""
    x = np.array(x, float)
    near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= least
    label, out, n = {}, [-1] * len(x), 0
    for i in sorted(np.flatnonzero(core), key=lambda i: tuple(x[i])):
        if i in label:
            continue
        front = [i]
        label[i] = n
        while front:
            for j in np.flatnonzero(near[front.pop()] & core):
                if j not in label:
                    label[j] = n
                    front.append(j)
        n += 1
    for i in range(len(x)):
        out[i] = label.get(i, min((label[j] for j in np.flatnonzero(near[i] & core)), default=-1))
    return out


@pytest.mark.parametrize("dims,least,cell", [(1, 3, 2_000), (2, 5, 2_000), (2, 4, 16), (3, 6, 40)])
def test_clusters_equal_all_pairs(spark, monkeypatch, dims, least, cell):
    monkeypatch.setattr(space, "CELL", cell)
    monkeypatch.setattr(density, "PIECE_ROWS", 7)
    rnd = random.Random(dims * 10 + cell)
    centres = [tuple(rnd.uniform(-3, 3) for _ in range(dims)) for _ in range(5)]
    x = [tuple(rnd.gauss(c, 0.25) for c in rnd.choice(centres)) for _ in range(260)] + [tuple(rnd.uniform(-4, 4) for _ in range(dims)) for _ in range(90)]
    x += x[:30] + [tuple([9.0] * dims)] * least
    names = [f"x{i}" for i in range(dims)]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(x)], ["i", *names]).repartition(4)
    got = {r["i"]: r["c"] for r in dbscan(df, names, 0.4, least, "c").collect()}
    assert [got[i] for i in range(len(x))] == plain(x, 0.4, least)


def test_cells_that_only_inner_points_join(spark):
    """Two blocks whose outermost points are apart, a bridge of inner points between them; and rows without values."""
    left, right = ([(s * (0.02 + u / 100), v / 10) for u, v in product(range(5), (-5, -4, 0, 4, 5))] for s in (-1, 1))
    x = left + right + [(None, 0.0), (float("nan"), 0.0)]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(x)], "i long, a double, b double")
    got = {r["i"]: r["c"] for r in dbscan(df, ["a", "b"], 0.11, 3, "c").collect()}
    assert [got[i] for i in range(len(x) - 2)] == plain(x[:-2], 0.11, 3) and got[len(x) - 1] == got[len(x) - 2] == -1


def test_a_dense_place_is_not_compared_with_itself(spark, monkeypatch):
    """150,000 points within eps of each other: their halves alone would be 5 billion pairs."""
    monkeypatch.setattr(density, "_within", lambda *_: pytest.fail("points were compared"))
    df = spark.range(150_000).selectExpr("id * 1e-9 AS a", "id % 7 * 1e-9 AS b")
    assert [tuple(r) for r in dbscan(df, ["a", "b"], 0.5, 5, "c").groupBy("c").count().collect()] == [(0, 150_000)]


def test_estimator_does_not_compare_a_dense_place_with_itself(spark, monkeypatch):
    """The clusterer that ``plans.train_clusters`` trains, over a vector column."""
    monkeypatch.setattr(density, "_within", lambda *_: pytest.fail("points were compared"))
    rows = [(Vectors.dense(i * 1e-6, 5.0 * (i % 2)),) for i in range(5_000)]
    out = density.Density().transform(spark.createDataFrame(rows, ["features"]))
    assert sorted(tuple(r) for r in out.groupBy("prediction").count().collect()) == [(0, 2_500), (1, 2_500)]
