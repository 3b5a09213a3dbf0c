import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.llm import neighbours

SCHEMA = "vec_id bigint, embedding array<float>, id string"


def found(spark, rows, **how):
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], SCHEMA)
    out = {}
    for r in sorted(neighbours.search(df, F.col("vec_id") % 100 == 0, **how).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def brute(rows, k=10):
    x = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    out = {}
    for q in (i for i in x if i % 100 == 0):
        near = sorted((float(np.sqrt(((x[q] - x[i]) ** 2).sum())), i) for i in x if i != q and len(x[i]) == len(x[q]))[:k]
        out[q] = [(n + 1, i, d) for n, (d, i) in enumerate(near)]
    return {q: v for q, v in out.items() if v}


def vectors(n, dims, seed=1):
    x = np.random.default_rng(seed).standard_normal((n, dims))
    return [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)]


def test_recall_of_isotropic_vectors(spark):
    rows = vectors(3000, 32)
    got, want = found(spark, rows), brute(rows)
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values())) and all(len(v) == 10 for v in got.values())
    assert all(math.isclose(d, dict((i, d) for _, i, d in want[q]).get(i, d), rel_tol=1e-12) for q in got for _, i, d in got[q])


def test_many_small_parts(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART_ROWS", 40)
    rows = vectors(900, 8, 2) + [(1000 + i, [0.5, 0.5] + [0.0] * 6) for i in range(120)]  # a cell of copies
    got, want = found(spark, rows, confidence=0.9999), brute(rows)
    assert got.keys() == want.keys() and [[i for _, i, _ in got[q]] for q in want] == [[i for _, i, _ in want[q]] for q in want]


def test_ties_copies_and_odd_rows(spark):
    one = [1.0, 0.0, 0.0]
    rows = [(i, one) for i in range(30)] + [(100, one), (100, one), (200, [0.0, 2.0, 0.0]), (300, None), (301, []), (302, [0.0] * 3), (303, [1.0, None, 0.0]),
            (304, [float("nan"), 1.0, 0.0]), (305, [float("inf"), 1.0, 0.0]), (None, one), (400, [1.0, 0.0])]
    got = found(spark, rows)
    assert got == brute([r for r in rows if r != (100, one)] + [(100, one)])
    assert [i for _, i, _ in got[0]] == list(range(1, 11)) and got[100][0][1] == 0 and 400 not in got


@pytest.mark.parametrize("rows", [[], [(100, [1.0])], [(1, [1.0]), (2, [2.0])], [(100, [1.0]), (2, [2.0])]])
def test_few_rows(spark, rows):
    assert found(spark, rows) == brute(rows)


def test_chi_square_limit():
    assert neighbours.chi_square_limit(0.95, 2) == pytest.approx(5.991, abs=1e-3)
    assert neighbours.chi_square_limit(0.99, 10) == pytest.approx(23.209, abs=1e-3)
