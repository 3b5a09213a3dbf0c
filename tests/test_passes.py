"""Fits over many rows: what a pass computes, and how often it is made."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import quillframe as qf
from quillframe.functions.power import box_cox, grid_variances, yeo_johnson


@pytest.mark.parametrize("transform, least", [(box_cox, 0.1), (yeo_johnson, -40.0)])
def test_grid_variances_equal_aggregates(spark, transform, least):
    rng, grid = np.random.default_rng(3), np.linspace(-3, 3, 13)
    rows = [(float(v),) for v in rng.uniform(least, 60, 900)] + [(None,)] * 7
    df = spark.createDataFrame(rows, "x double").repartition(5)
    want = df.agg(*[F.var_pop(transform(F.col("x"), float(g))) for g in grid]).first()
    np.testing.assert_allclose(grid_variances(df, F.col("x"), transform, grid), list(want), rtol=1e-9)
    assert np.isnan(grid_variances(df.where("x is null"), F.col("x"), transform, grid)).all()


def test_isolation_lengths_follow_the_tree():
    from quillframe.functions.isolation import _grow, _lengths, _table

    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3))
    tree = _grow(x, rng, 0, 8)

    def walk(node, row):
        return walk(node[2] if row[node[0]] <= node[1] else node[3], row) if isinstance(node, list) else node

    np.testing.assert_array_equal(_lengths(_table(tree), x, 8), [walk(tree, row) for row in x])


def test_isolation_scores_rows_once(spark):
    df = spark.range(3000).select(F.rand(1).alias("a"), F.rand(2).alias("b"))
    out = qf.apply(df, "analysis.outlier_isolation_forest", trees=5)
    assert "Python" not in out._jdf.queryExecution().toString()
    assert {x["label"]: x["count"] for x in out.collect()} == pytest.approx({"Normal": 2850, "Anomaly": 150}, abs=15)


def test_kmeans_leaves_the_vectors_to_the_fit(spark, monkeypatch):
    from quillframe.operators import analysis

    given, fit = [], analysis.KMeans.fit
    monkeypatch.setattr(analysis.KMeans, "fit", lambda self, data, *a: given.append(data.storageLevel) or fit(self, data, *a))
    df = spark.range(400).select((F.col("id") % 2 * 10 + F.rand(1)).alias("a"), (F.col("id") % 2 * 10 + F.rand(2)).alias("b"))
    out = qf.apply(df, "analysis.cluster_kmeans", max_k=3).collect()
    assert [x["k"] for x in out if x["best"]] == [2]
    assert len(given) == 2 and not any(level.useMemory for level in given)


def test_cluster_training_leaves_the_vectors_to_the_fits(spark, monkeypatch):
    from quillframe.plans import train

    given = []
    for kind in (train.KMeans, train.GaussianMixture):
        monkeypatch.setattr(kind, "fit", lambda self, data, *a, fit=kind.fit: given.append(data.storageLevel) or fit(self, data, *a))
    df = spark.range(300).select((F.col("id") % 2 * 10 + F.rand(1)).alias("a"), (F.col("id") % 3 * 10 + F.rand(2)).alias("b"))
    out = train.train_clusters(df, ["kmeans", "gaussian_mixture"]).comparison.collect()
    assert {r["algorithm"] for r in out} == {"kmeans", "gaussian_mixture"}
    assert len(given) == 2 and not any(level.useMemory for level in given)
