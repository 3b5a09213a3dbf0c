"""Kernels against hand-computed results: order, ranks, quantiles, distributions, neighbours."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillframe.functions import dist
from quillframe.functions.density import dbscan
from quillframe.functions.linkage import agglomerate
from quillframe.functions.ordered import index_rows
from quillframe.functions.quantile import quantiles
from quillframe.functions.ranks import with_rank
from quillframe.functions.space import nearest


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice("aaaab"), None if rng.random() < 0.2 else round(rng.gauss(5, 3), 2)) for i in range(400)]
    return spark.createDataFrame(rows, "t long, k string, x double"), pd.DataFrame(rows, columns=["t", "k", "x"])


def test_index_is_contiguous(series):
    df, _ = series
    ix = index_rows(df.orderBy(F.rand(1)), ["t"])
    got = ix.df.select("t", "_idx").collect()
    assert ix.rows == 400 and all(r["t"] == r["_idx"] for r in got)


def test_windows_and_totals_match_pandas_per_hot_key(series):
    df, pdf = series
    ix = index_rows(df, ["t"], "k").windowed(
        lambda w: {"lag2": F.lag("x", 2).over(w), "roll": F.avg("x").over(w.rowsBetween(-4, 0))}, before=4)
    got = ix.running(sums={"cs": F.col("x")}, lasts={"ff": F.col("x")}, nexts={"bf": F.col("x")}).result().toPandas().sort_values("t").reset_index(drop=True)
    g = pdf.groupby("k")["x"]
    assert np.allclose(got["lag2"], g.shift(2), equal_nan=True)
    assert np.allclose(got["roll"], g.transform(lambda s: s.rolling(5, min_periods=1).mean()), equal_nan=True)
    assert np.allclose(got["cs"], g.transform(lambda s: s.fillna(0).cumsum()).where(g.transform(lambda s: s.notna().cumsum()) > 0), equal_nan=True)
    assert np.allclose(got["ff"], g.ffill(), equal_nan=True)
    assert np.allclose(got["bf"], g.bfill(), equal_nan=True)


@pytest.mark.parametrize("by", [[], ["k"]])
def test_quantiles_equal_the_built_in_ones(series, by):
    df, _ = series
    qs = [0.0, 0.1, 0.5, 0.75, 1.0]
    got = {tuple(r[: len(by) + 1]): r for r in quantiles(df, ["x", "t"], qs, by).collect()}
    for c in ("x", "t"):
        for row in df.groupBy(*by).agg(F.percentile(F.col(c).cast("double"), F.lit(qs)).alias("p")).collect():
            mine = got[(*row[: len(by)], c)]
            for i in range(len(qs)):
                want = row["p"][i] if row["p"] else None
                assert mine[f"q{i}"] is want is None or math.isclose(mine[f"q{i}"], want, abs_tol=1e-9)


def test_equal_order_values_spread_over_partitions(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 10 > 0, F.lit(1)).otherwise(F.col("id")).alias("x"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        laid = index_rows(df, "x").df.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in laid) < 6_000 and sum(r["count"] for r in laid) == 20_000


def test_ranks_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,), (None,)], "x double")
    got = {(r["x"], r["_rank"]) for r in with_rank(df, "x").collect()}
    assert got == {(1.0, 1.0), (2.0, 2.5), (5.0, 4.0), (None, None)}


def test_distribution_functions_against_published_values():
    assert math.isclose(dist.t_two_sided(2.228139, 10), 0.05, abs_tol=1e-6)
    assert math.isclose(dist.chi2_sf(5.991465, 2), 0.05, abs_tol=1e-6)
    assert math.isclose(dist.chi2_sf(18.307038, 10), 0.05, abs_tol=1e-6)
    assert math.isclose(dist.f_sf(4.102821, 2, 10), 0.05, abs_tol=1e-6)
    assert math.isclose(dist.t_ppf(0.975, 10), 2.228139, abs_tol=1e-5)
    assert math.isclose(dist.norm_two_sided(1.959964), 0.05, abs_tol=1e-6)
    assert math.isclose(dist.kolmogorov_sf(1.3581 / (math.sqrt(1e8) + 0.12), 1e8), 0.05, abs_tol=1e-4)


def test_normal_cdf_expression(spark):
    zs = [-9.0, -3.1, -0.5, 0.0, 0.7, 2.2, 8.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select(dist.norm_cdf_expr(F.col("z")).alias("p")).collect()
    assert all(math.isclose(r["p"], dist.norm_cdf(z), rel_tol=1e-9, abs_tol=1e-14) for z, r in zip(zs, got))


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    got = nearest(df, df.select(F.col("id").alias("pid"), "v", F.lit("a").alias("label")), 4).collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    for r in got:
        assert [n["pid"] for n in r["near"]] == list(np.argsort(d[r["id"]])[:4])


def test_nearest_equals_brute_force_across_cells(spark, monkeypatch):
    import quillframe.functions.space as space

    monkeypatch.setattr(space, "CELL", 25)
    test_nearest_equals_brute_force(spark)


def test_dbscan_across_cells(spark, monkeypatch):
    import quillframe.functions.space as space

    monkeypatch.setattr(space, "CELL", 20)
    rng = np.random.default_rng(5)
    blobs = np.vstack([rng.normal(0, 0.2, (80, 2)), rng.normal(4, 0.2, (80, 2)), [[20.0, 20.0]]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(blobs)], "i long, a double, b double")
    got = {r["i"]: r["c"] for r in dbscan(df, ["a", "b"], 0.5, 4, "c").collect()}
    assert got[160] == -1
    assert len({got[i] for i in range(80)} - {-1}) == 1 and len({got[i] for i in range(80, 160)} - {-1}) == 1
    assert got[0] != got[80]


def test_ward_linkage_separates_groups():
    x = np.array([[0.0], [0.1], [5.0], [5.1], [9.0]])
    label = agglomerate(x, np.ones(5), 3)
    assert label[0] == label[1] and label[2] == label[3] and len(set(label)) == 3
