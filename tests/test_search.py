import numpy as np
from pyspark.sql import functions as F

from quillframe.plans import search as S, train as T


def prepared(spark, noise_columns=2):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 1 + noise_columns))
    rows = [(*map(float, r), float(3 * r[0] + rng.normal() * 0.5)) for r in x]
    df = spark.createDataFrame(rows, [*[f"a{i}" for i in range(1 + noise_columns)], "y"])
    return T.preprocess(df, "y", "regression", auto=False)


def test_proposals_close_in_on_the_best():
    rng = np.random.default_rng(1)
    done = []
    for _ in range(60):
        p = S.proposal(rng, done, ["u", "v"], 10)
        done.append((p, (p["u"] - 0.8) ** 2 + (p["v"] - 0.1) ** 2))
    early, late = (np.mean([loss for _, loss in part]) for part in (done[:10], done[-10:]))
    assert late < early / 5 and min(loss for _, loss in done) < 0.01


def test_spans():
    assert S.Span(1, 9, whole=True).at(0.5) == 5 and isinstance(S.Span(1, 9, whole=True).at(0.2), int)
    assert abs(S.Span(0.01, 1.0, log=True).at(0.5) - 0.1) < 1e-12
    assert S.Span(2.0, 3.0).at(7) == 3.0 and S.Span(2.0, 3.0).at(-1) == 2.0


def test_search_beats_the_defaults_and_repeats(spark):
    data = prepared(spark)
    spans = {"regParam": S.Span(1e-4, 100.0, log=True)}
    a, b = (S.search(data, "regression", "lasso", trials=5, folds=2, spans=spans) for _ in range(2))
    rows = a.trials.orderBy("trial").collect()
    assert rows == b.trials.orderBy("trial").collect() and len(rows) == 6 and rows[0]["params"] == "defaults"
    whole = [r["score"] for r in rows if not r["stopped"]]
    assert round(a.score, 6) == min(whole) <= rows[0]["score"]
    assert all(r["folds"] == 2 or r["stopped"] for r in rows)
    assert S.search(data, "regression", "lasso", trials=5, folds=2, spans={}).trials.count() == 1


def test_residual_histogram_and_cluster_sizes(spark):
    pred = spark.createDataFrame([(float(i), 0.0) for i in range(31)] + [(None, 1.0)], "label double, prediction double")
    got = {r["bin"]: r["count"] for r in T.residual_histogram(pred).collect()}
    assert got == {**{i: 1 for i in range(29)}, 29: 2}
    assert [tuple(r) for r in T.residual_histogram(pred.where("label = 3")).collect()] == [(0, 3.0, 1)]
    assert T.residual_histogram(pred.limit(0)).collect() == []
    c = pred.select(F.when(F.col("label") < 10, -1).otherwise((F.col("label") % 2).cast("int")).alias("prediction"))
    assert [tuple(r) for r in T.cluster_sizes(c).collect()] == [(0, 11, 0.52381), (1, 10, 0.47619)]


def test_training_with_the_search_predicts(spark):
    rows = [(float(i), float(i % 7), float(2 * i + i % 7)) for i in range(120)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    got = T.train(df, "y", "regression", names=["ridge", "decision_tree_reg"], folds=2, tune_top=1, trials=2)
    assert list(got.extra["trials"]) == [got.algorithm] and got.extra["trials"][got.algorithm].count() == 3
    assert got.predict(df).where("predicted is null").count() == 0
