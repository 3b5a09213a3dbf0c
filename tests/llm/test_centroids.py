import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.llm import centroids

SCHEMA = "vec_id bigint, embedding array<float>, cluster string"


def brute(rows, first, dims, scale, rounds):
    fine = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(c is not None and np.isfinite(c) and abs(c) <= centroids.LARGEST / scale for c in v)]
    x = np.floor(np.array([v for _, v in fine], np.float32).astype(float) * scale).astype(int)
    c = np.floor(np.array(first, np.float32).astype(float) * scale).astype(int)
    for turn in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        own = d.argmin(axis=1)
        if turn < rounds:
            c = np.array([x[own == k].sum(axis=0) // (own == k).sum() if (own == k).any() else c[k] for k in range(len(c))])
    return sorted((i, int(k), int(s)) for (i, _), k, s in zip(fine, own, d.min(axis=1))), c


def run(spark, rows, first, dims, scale=64, rounds=3, bits=centroids.BITS):
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], SCHEMA)
    start = spark.createDataFrame([(v,) for v in first], "v array<float>")
    out, c = centroids.cluster(df, "vec_id", "embedding", start, dims, scale, rounds, bits)
    return sorted(((r.key, r.cluster, r.distance) for r in out.collect()), key=lambda r: (r[0] is None, r)), c


@pytest.mark.parametrize("bits", [1, 3, 5])
def test_equals_plain_k_means(spark, bits):
    rng = np.random.default_rng(bits)
    x = np.concatenate([rng.standard_normal((300, 8)) * 0.3 + rng.standard_normal(8) * 2 for _ in range(5)]).round(3)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, c = run(spark, rows, x[:7].tolist(), 8, rounds=4, bits=bits)
    want, centres = brute(rows, x[:7].tolist(), 8, 64, 4)
    assert got == want and (c == centres).all()


def test_odd_rows_ties_and_empty_clusters(spark):
    rows = [(1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.5]), (3, None), (4, []), (5, [1.0]), (6, [None, 1.0]), (7, [float("nan"), 0.0]),
            (8, [float("-inf"), 0.0]), (9, [3e30, 0.0]), (10, [-0.001, 0.0]), (11, [500.0, -700.0])]
    first = [[0.0, 0.0], [0.0, 0.0], [1.0, 1.0], [9e3, 9e3]]
    assert run(spark, rows, first, 2)[0] == brute(rows, first, 2, 64, 3)[0]


def test_no_vectors(spark):
    assert run(spark, [], [], 2)[0] == [] and run(spark, [(1, None)], [], 2)[0] == []


def test_intervals_hold_the_distance():
    rng = np.random.default_rng(0)
    x, c = rng.integers(-60, 60, (500, 6)), rng.integers(-60, 60, (9, 6))
    cuts = np.sort(rng.integers(-50, 50, (6, 7)), axis=1)
    low = np.hstack([x.min(axis=0)[:, None], cuts + 1])
    cells = centroids.Cells(cuts, low, np.hstack([cuts, x.max(axis=0)[:, None]]))
    left = centroids.survivors(cells.encode(x), cells, c)
    nearest = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert left[np.arange(500), nearest].all() and left.sum() < 0.8 * left.size


def test_packed_codes_come_back():
    codes = np.random.default_rng(1).integers(0, 32, (40, 9)).astype(np.uint8)
    assert (centroids._codes(centroids._pack(codes, 5), 9, 5) == codes).all()


def test_usable_in_a_frame(spark):
    df = spark.createDataFrame([([1.0, 2.0],), (None,), ([1.0],)], "v array<double>")
    assert [r[0] for r in df.select(centroids.usable(F.col("v"), 2, 64)).collect()] == [True, False, False]
