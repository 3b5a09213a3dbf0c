"""Mutual information by neighbours against plain Python over all pairs of rows."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import quillframe as qf
from quillframe.functions import mutual, space
from quillframe.functions.mutual import CLASS_GAP, STEP, neighbour_mi
from quillframe.queries import catalogue
from quillframe.queries.base import NUM, Tables


def psi(n):
    n = float(n)
    z = n + 6
    return math.log(z) - 0.5 / z - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6) - sum(1 / (n + i) for i in range(6))


def plain(x, y, k=3, classes=False):
    x, y = np.array(x, float), np.array(y, float)
    whole = lambda v: np.round((v - v.mean()) / (v.std() or 1.0) * STEP)
    x, y = whole(x), np.unique(y, return_inverse=True)[1] * CLASS_GAP if classes else whole(y)
    total, n = 0.0, len(x)
    if n <= k:
        return 0.0
    for i in range(n):
        dx, dy = np.abs(x - x[i]), np.abs(y - y[i])
        d = np.maximum(dx, dy)
        rho = np.sort(np.delete(d, i))[k - 1]
        inside = (lambda a: (a < rho).sum()) if rho > 0 else (lambda a: (a == 0).sum())
        total += psi(k if rho > 0 else (d == 0).sum()) + psi(n) - psi(inside(dx)) - psi(inside(dy))
    return max(total / n, 0.0)


def scores(df):
    return {r["feature"]: r["mi"] for r in df.collect()}


@pytest.mark.parametrize("cell", [2_000, 16])
def test_mixed_values_match_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(space, "CELL", cell)
    rnd = random.Random(4)
    rows = []
    for i in range(400):
        y = rnd.choice([rnd.gauss(0, 1), float(rnd.randrange(3)), 2.0])
        rows.append((y + rnd.gauss(0, 0.2), float(int(y * 2)), rnd.gauss(0, 1), 5.0, None if i % 9 == 0 else -y, y))
    df = spark.createDataFrame(rows, "near double, steps double, noise double, same double, gaps double, y double").repartition(5)
    got = scores(neighbour_mi(df, df.columns[:5], "y"))
    for j, name in enumerate(df.columns[:5]):
        kept = [(r[j], r[5]) for r in rows if r[j] is not None]
        assert got[name] == pytest.approx(plain(*zip(*kept)), abs=1e-9), name
    assert got["near"] > got["noise"] and got["same"] < 0.05


def test_independent_and_known_information(spark):
    rng = np.random.default_rng(3)
    a, b = rng.standard_normal((2, 3000))
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), (0.8 * a + 0.6 * b).tolist())), "a double, b double, y double")
    got = scores(neighbour_mi(df, ["a", "b"], "y"))
    assert got["a"] == pytest.approx(-0.5 * math.log(1 - 0.64), abs=0.05) and got["b"] == pytest.approx(-0.5 * math.log(1 - 0.36), abs=0.05)


def test_class_targets(spark):
    rnd = random.Random(8)
    rows = [(rnd.gauss(c, 1), float(rnd.randrange(4)), c) for c in (rnd.choice([0, 0, 0, 2, 7]) for _ in range(300))] + [(1.0, 1.0, 9)]
    df = spark.createDataFrame(rows, "a double, b double, c long")
    out = {r["feature"]: r["mutual_info"] for r in qf.apply(df, "feature.mutual_info", column="c", method="neighbours").collect()}
    for j, name in enumerate("ab"):
        assert out[name] == pytest.approx(plain([r[j] for r in rows], [r[2] for r in rows], classes=True), abs=1e-4)
    assert qf.apply(df, "feature.mutual_info_select", target="c", top_k=1, method="neighbours").columns == ["a", "c"]


@pytest.mark.parametrize("rows", [[], [(None, 1.0)], [(1.0, 2.0), (2.0, 1.0)], [(1.0, 1.0)] * 10, [(float("nan"), 1.0), (float("inf"), 2.0), (1.0, None)]])
def test_few_rows_and_rows_without_values(spark, rows):
    df = spark.createDataFrame(rows, "a double, y double")
    assert all(v == 0 for v in scores(neighbour_mi(df, ["a"], "y")).values())


def test_whole_line_item_table(spark, folder):
    rows = [tuple(r) for r in Tables(spark, folder).measures.collect()]
    got = {r["feature"]: r["mutual_info"] for r in catalogue()["stats.mutual_info_neighbours"][0](spark, folder).collect()}
    for j, name in enumerate(NUM[:3]):
        kept = [(r[j], r[3]) for r in rows if r[j] is not None]
        assert got[name] == pytest.approx(plain(*zip(*kept)), abs=1e-4)


def test_cells_are_cut_below_a_frequent_value(spark, monkeypatch):
    monkeypatch.setattr(space, "CELL", 50)
    points = spark.range(1000).select(F.array(F.when(F.col("id") % 3 == 0, 0.0).otherwise(1e6), F.col("id") * 1.0).alias("v"))
    sizes = [r["count"] for r in space.spread(points, "v", space.build_cells(points, "v")).groupBy("_cell").count().collect()]
    assert max(sizes) <= 50 and sum(sizes) == 1000


def test_neighbours_in_one_cell_do_not_meet_all_others():
    rng = np.random.default_rng(6)
    some = np.column_stack([rng.integers(0, 2, 400) * 2.0 ** 60, rng.integers(0, 300, 400), rng.integers(0, 3, 400) * 1000]).astype(float)
    at, w = np.unique(some, axis=0, return_counts=True)
    dist, held = mutual._among(at, w, 3)
    for i in range(len(at)):
        d = np.abs(at - at[i]).max(axis=1)
        d[i] = np.inf
        near = sorted((x, n) for x, n in zip([*d, 0.0], [*w, w[i] - 1]) if x < 2.0 ** 60 and n)
        kth = next((x for j, (x, _) in enumerate(near) if sum(n for _, n in near[:j + 1]) >= 3), np.inf)
        assert mutual._kth(dist, held, 3)[i] == kth
    lines = np.column_stack([np.zeros(300_000), rng.permutation(300_000) * 1.0, np.full(300_000, 5.0)])
    begun = time.process_time()
    dist, _ = mutual._among(lines, np.ones(300_000, int), 3)
    assert time.process_time() - begun < 30 and dist[:, 1].max() == 1.0
