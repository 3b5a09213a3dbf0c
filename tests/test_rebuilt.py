"""Operators over their own mechanisms, against plain Python."""

import math
import random
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import quillframe as qf
from quillframe.functions import linkage, ordered, sparse
from quillframe.functions.linkage import agglomerate


def plain_linkage(x, k):
    """Ward clusters as a set of row sets."""
    groups = [[i] for i in range(len(x))]
    cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(axis=0) - x[b].mean(axis=0)) ** 2).sum()
    while len(groups) > k:
        i, j = min(combinations(range(len(groups)), 2), key=lambda p: cost(groups[p[0]], groups[p[1]]))
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


def test_linkage_of_distinct_rows_is_exact(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((25, 2)) + c for c in ([0, 0], [6, 1], [2, 7])]).round(3)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "i long, a double, b double").repartition(5)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    out = qf.apply(df.select("a", "b"), "analysis.hierarchical_clustering", n_clusters=4)
    place = {tuple(v): i for i, v in enumerate(x.tolist())}
    got = {}
    for r in out.collect():
        got.setdefault(r["_cluster"], set()).add(place[r["a"], r["b"]])
    assert {frozenset(v) for v in got.values()} == plain_linkage(z, 4)


def test_cluster_features_are_bounded_and_keep_the_rows(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal((900, 3)) * 0.1 + c for c in np.eye(3) * 5])
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").repartition(6)
    means, sizes = linkage.cluster_features(df, 30)
    assert len(means) == 30 and sizes.sum() == 2700
    assert np.allclose((means * sizes[:, None]).sum(axis=0) / 2700, x.mean(axis=0))
    assert sorted(np.bincount(agglomerate(means, sizes, 3), weights=sizes)) == [900, 900, 900]


@pytest.mark.parametrize("keys", [None, "k"])
def test_expanding_median_over_many_blocks(spark, monkeypatch, keys):
    monkeypatch.setattr(ordered.Indexed, "block_size", lambda self, halo: max(7, halo))
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["a", "a", "a", "b", None]), rnd.choice([None, *[rnd.choice([1.0, 2.0, rnd.gauss(i, 40)])] * 4])) for i in range(240)]
    df = spark.createDataFrame(rows, "i long, k string, x double")
    out = qf.apply(df, "feature.expanding_window", column="x", stats=["median"], order_by=["i"], partition_by=keys)
    pdf = pd.DataFrame(rows, columns=["i", "k", "x"])
    want = pdf.groupby("k", dropna=False)["x"].expanding().median().reset_index(level=0, drop=True) if keys else pdf["x"].expanding().median()
    got = {r["i"]: r["x_expanding_median"] for r in out.collect()}
    assert all((got[i] is None and math.isnan(w)) or got[i] == pytest.approx(w) for i, w in want.items()) and len(got) == 240


@pytest.mark.parametrize(("span", "keys"), [(5, None), (5, "k"), (400, None), (1, None)])
def test_exponential_weights_equal_pandas(spark, monkeypatch, span, keys):
    monkeypatch.setattr(ordered.Indexed, "block_size", lambda self, halo: max(11, halo))
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["a", "b"]), rnd.choice([rnd.gauss(1000, 5), rnd.gauss(1000, 5), None]) if i and span > 1 else 1000.0 + i) for i in range(150)]
    df = spark.createDataFrame(rows, "i long, k string, x double")
    got = {r["i"]: r for r in qf.apply(df, "feature.ewm_features", column="x", span=span, order_by=["i"], partition_by=keys).collect()}
    pdf = pd.DataFrame(rows, columns=["i", "k", "x"])
    for name in ("mean", "std"):
        one = lambda s: getattr(s.ewm(span=span, min_periods=1), name)()  # noqa: B023, E731
        want = pdf.groupby("k", group_keys=False)["x"].apply(one) if keys else one(pdf["x"])
        for i, w in want.items():
            v = got[i][f"x_ewm_{name}"]
            assert (v is None and math.isnan(w)) or v == pytest.approx(w, abs=2e-3), (name, i)


def unit(rows, stop=()):
    from collections import Counter

    tf = [Counter(w for w in t.split() if w not in stop) for t in rows]
    seen = Counter(w for t in tf for w in t)
    raw = [{w: k * (math.log((1 + len(rows)) / (1 + seen[w])) + 1) for w, k in t.items()} for t in tf]
    return [{w: v / math.sqrt(sum(x * x for x in t.values())) for w, v in t.items()} for t in raw]


def texts(n, seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(80)]
    out = []
    for _ in range(n):
        base = list(rnd.choice(out).split()) if out and rnd.random() < 0.6 else [rnd.choice(words) for _ in range(rnd.randint(3, 25))]
        if base and rnd.random() < 0.8:
            base[rnd.randrange(len(base))] = rnd.choice(words)
        out.append(" ".join(base))
    return [*out, "", "zz"]


@pytest.mark.parametrize("threshold", [0.95, 0.8, 0.5])
def test_text_dedup_loses_no_pair(spark, threshold):
    rows = texts(220, 4)
    v = unit(rows)
    near = lambda a, b: sum(x * v[b].get(w, 0) for w, x in v[a].items()) >= threshold - 1e-12
    of, kept = {}, []
    for i in range(len(rows)):
        of[i] = next((k for k in kept if v[i] and near(k, i)), -1)
        if of[i] < 0:
            kept.append(i)
    df = spark.createDataFrame(list(enumerate(rows)), "i long, t string").repartition(3)
    got = {r["i"]: r["_text_duplicate_of"] for r in qf.apply(df, "nlp.text_dedup", column="t", order_by=["i"], threshold=threshold, stop_words=[]).collect()}
    assert got == of and 0 < len(kept) < len(rows)


def first_near(rows, threshold):
    v = unit(rows)
    near = lambda a, b: sum(x * v[b].get(w, 0) for w, x in v[a].items()) >= threshold - 1e-12
    of, kept = {}, []
    for i in range(len(rows)):
        of[i] = next((k for k in kept if v[i] and near(k, i)), -1)
        if of[i] < 0:
            kept.append(i)
    return of


@pytest.mark.parametrize("name, value", [("CROWD", 2), ("SENT_WORDS", 0), ("FIRST_WORDS", 60), ("PLACE_PAIRS", 3), ("TOKENS", 50)])
def test_text_dedup_by_every_path(spark, monkeypatch, name, value):
    """Rounds of heads, words that are too many to be sent, blocks of postings, spread places, and tokens in parts."""
    monkeypatch.setattr(sparse, name, value)
    rows = [*texts(260, 5), *["w1 w2 only w3 w4"] * 2, "w1 w2 lone w3 w4", "w1 w2 w3 w4 w5 w6 w7"]
    df = spark.createDataFrame(list(enumerate(rows)), "i long, t string").repartition(3)
    got = {r["i"]: r["_text_duplicate_of"] for r in qf.apply(df, "nlp.text_dedup", column="t", order_by=["i"], threshold=0.8, stop_words=[]).collect()}
    assert got == first_near(rows, 0.8)


def test_few_far_pairs_are_computed(spark, monkeypatch):
    """Texts that share some of their first words and little else are told apart by what is left of them, without their vectors."""
    asked, checked = [], sparse._checked
    monkeypatch.setattr(sparse, "_checked", lambda maybe, *a: asked.append(maybe.count()) or checked(maybe, *a))
    rnd = random.Random(3)
    rows = [" ".join([f"rare{i // 4}", *(f"w{min(rnd.randrange(60), rnd.randrange(60))}" for _ in range(40))]) for i in range(200)]
    rows += [f"{t} more" for t in rows[:5]]
    df = spark.createDataFrame(list(enumerate(rows)), "i long, t string")
    got = {r["i"]: r["_text_duplicate_of"] for r in qf.apply(df, "nlp.text_dedup", column="t", order_by=["i"], stop_words=[]).collect()}
    assert got == first_near(rows, 0.9) and sum(x >= 0 for x in got.values()) == 5
    assert sum(asked) < 500  # 5,805 pairs share one of their first words


def test_top_neighbours_in_blocks(spark):
    rows = texts(90, 6)
    v = unit(rows)
    want = {}
    for i in range(len(rows)):
        s = sorted((-round(sum(x * v[j].get(w, 0) for w, x in v[i].items()), 12), j) for j in range(len(rows)) if j != i)
        want[i] = [j for d, j in s if d < 0][:4]
    df = spark.createDataFrame(list(enumerate(rows)), "i long, t string")
    vectors = sparse.unit_vectors(sparse.weighted_terms(df, "i", F.filter(F.split("t", " "), lambda w: w != "")), "i")
    got = {}
    for r in sorted(sparse.top_neighbours(vectors, "i", 4, rows=20).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["id"], []).append(r["other"])
    assert got == {i: w for i, w in want.items() if w}


def test_neighbours_meet_without_copies_of_the_vectors(spark, monkeypatch):
    monkeypatch.setattr(sparse, "ROW_WORDS", 6)  # blocks are full by their words before they have 16 rows
    rows = [*texts(60, 8), *["w1 w2 w3 w4"] * 30]
    v = unit(rows)
    want = {}
    for i in range(len(rows)):
        s = sorted((-round(sum(x * v[j].get(w, 0) for w, x in v[i].items()), 12), j) for j in range(len(rows)) if j != i)
        want[i] = [j for d, j in s if d < 0][:3]
    df = spark.createDataFrame(list(enumerate(rows)), "i long, t string")
    vectors = sparse.unit_vectors(sparse.weighted_terms(df, "i", F.filter(F.split("t", " "), lambda w: w != "")), "i")
    near = sparse.top_neighbours(vectors, "i", 3, rows=16)
    got = {}
    for r in sorted(near.collect(), key=lambda r: r["rank"]):
        got.setdefault(r["id"], []).append(r["other"])
    assert got == {i: w for i, w in want.items() if w}
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "explode" not in plan  # no copy of a vector for every block


def test_baskets_of_many_items(spark):
    rnd = random.Random(8)
    baskets = {g: {f"i{min(int(rnd.expovariate(0.02)), 199)}" for _ in range(rnd.choice([2, 5, 120]))} for g in range(60)}
    df = spark.createDataFrame([(g, i) for g, s in baskets.items() for i in s], "g long, i string").repartition(4)
    out = qf.apply(df, "analysis.market_basket", column="i", group="g", min_support=0.15)
    got = {(r["item_a"], r["item_b"]): r["support"] for r in out.collect()}
    items = sorted({i for s in baskets.values() for i in s})
    want = {p: k / 60 for p in combinations(items, 2) if (k := sum(p[0] in s and p[1] in s for s in baskets.values())) / 60 >= 0.15}
    assert got == {p: pytest.approx(s, abs=1e-4) for p, s in want.items()} and len(want) > 50


def test_values_are_carried_back_in_linear_time(spark):
    """The frame of the backward carry grows row by row; one that ends at the last row would not."""
    df = spark.range(1000).select("id", F.when(F.col("id") % 9 == 8, F.col("id")).alias("x"))
    out = qf.apply(df, "clean.fill_forward_backward", column="x", order_by=["id"])
    got = [r["x"] for r in out.orderBy("id").collect()]
    assert got[:9] == [8] * 9 and got[20] == 17 and got[999] == 998
    assert "unboundedfollowing" not in out._jdf.queryExecution().executedPlan().toString().lower()
