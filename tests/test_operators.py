"""Operators on small tables, and checks of every registered id."""

import math

import pytest
from pyspark.sql import functions as F

import quillframe as qf
from quillframe.queries import catalogue
from quillframe.queries.base import Tables


def test_inventory_is_complete():
    names = qf.available()
    count = {c: sum(n.startswith(c + ".") for n in names) for c in ("stats", "clean", "transform", "feature", "nlp", "analysis", "viz")}
    assert count == {"stats": 56, "clean": 59, "transform": 64, "feature": 63, "nlp": 55, "analysis": 62, "viz": 56}
    assert set(names) <= set(catalogue()), sorted(set(names) - set(catalogue()))


def test_bad_parameters_raise(spark):
    df = spark.createDataFrame([(1, "a")], "x int, s string")
    with pytest.raises(ValueError):
        qf.apply(df, "stats.nothing")
    with pytest.raises(ValueError):
        qf.apply(df, "transform.filter", column="y", value=1)
    with pytest.raises(ValueError):
        qf.apply(df, "transform.cumulative", column="x")


def test_p_values(spark):
    rows = [("a", float(v)) for v in (1, 2, 3, 4, 5)] + [("b", float(v)) for v in (4, 5, 6, 7, 9)]
    df = spark.createDataFrame(rows, "g string, x double")
    t = qf.apply(df, "stats.t_test", column="x", group_column="g").first()
    assert math.isclose(t["t_stat"], -3.2 / math.sqrt(1.24), abs_tol=1e-4) and 0.01 < t["p_value"] < 0.05 and t["significant"] == "Yes"
    assert qf.apply(df, "stats.mann_whitney", column="x", group_column="g").first()["u_stat"] == 2.0


def test_constant_and_empty_columns_give_null_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert qf.apply(df, "stats.correlation").where("column = 'a'").first()["b"] is None


def test_rowwise_operators_work_on_a_stream(spark, folder):
    schema = Tables(spark, folder).nation.schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "nation.parquet").parquet(folder)
    out = qf.run(stream, [("transform.filter", {"column": "n_regionkey", "operator": "==", "value": 1}), ("clean.lowercase_values", {"column": "n_name"})])
    q = out.writeStream.format("memory").queryName("nations").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("nations").count() == 5


def test_near_duplicates_keep_the_first(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(0, base), (1, base + " iota"), (2, "red green blue yellow purple orange"), (3, base), (4, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    out = qf.apply(df, "nlp.text_dedup", column="text", order_by=["id"], threshold=0.8, stop_words=[])
    got = {r["id"]: r["_text_duplicate_of"] for r in out.collect()}
    assert got == {0: -1, 1: 0, 2: -1, 3: 0, 4: -1}


def test_oversampling_counts(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(10)] + [("b", 1.0), ("b", 2.0), ("b", 4.0)], "c string, x double")
    for name in ("clean.random_oversample", "clean.smote_oversample"):
        assert {r["c"]: r["count"] for r in qf.apply(df, name, target="c").groupBy("c").count().collect()} == {"a": 10, "b": 10}


def test_plans_have_no_python_and_push_filters(spark, folder):
    t = Tables(spark, folder).lineitem
    plan = qf.apply(t, "transform.filter", column="l_quantity", operator=">", value=10).select("l_tax")._jdf.queryExecution().toString()
    assert "GreaterThan(l_quantity,10.0)" in plan and "l_comment" not in plan
    text = qf.apply(Tables(spark, folder).documents, "nlp.readability_score", column="text")._jdf.queryExecution().toString()
    assert "Python" not in text


def test_ordered_plans_never_use_one_partition(spark, folder):
    df = qf.apply(Tables(spark, folder).series, "transform.rolling", column="value", order_by=["ts", "event_id"])
    assert "SinglePartition" not in df._jdf.queryExecution().toString()


def test_feature_pipeline_replays_without_refitting(spark, tmp_path):
    from quillframe.plans.features import FeatureConfig, Fitted, fit_pipeline

    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", None, 2.0), ("a", 3.0, 3.0)], "s string, x double, y double")
    fitted = fit_pipeline(df, FeatureConfig(target="y", encode_default="ordinal"))
    fitted.save(spark, str(tmp_path / "p"))
    new = spark.createDataFrame([("zzz", None, 0.0)], "s string, x double, y double")
    row = Fitted.load(spark, str(tmp_path / "p")).transform(new).first()
    assert row["s"] == -1.0 and row["x"] == 2.0


def test_model_round_trip(spark, tmp_path):
    from quillframe.plans.train import Trained, train

    df = spark.createDataFrame([("u" if i % 2 else "v", float(i % 2) + i * 1e-3, "yes" if i % 2 else "no") for i in range(80)], "s string, x double, y string")
    model = train(df, "y", "classification", names=["logistic_regression"], folds=2, tune_top=0)
    model.save(spark, str(tmp_path / "m"))
    again = Trained.load(spark, str(tmp_path / "m")).predict(df)
    assert again.where(F.col("predicted") == F.col("y")).count() == 80


def test_arrow_source(spark, tmp_path):
    import pyarrow as pa

    from quillframe.sources.io import read_arrow

    table = pa.table({"a": [1, 2, 3], "b": ["x", "y", None]})
    with pa.OSFile(str(tmp_path / "t.arrow"), "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        w.write_table(table)
    assert read_arrow(spark, str(tmp_path / "t.arrow"), "a bigint, b string").count() == 3
