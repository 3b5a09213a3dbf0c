"""Per-level tables joined to rows: few levels move no rows, many levels give the same result."""

from pyspark.sql import functions as F

import quillframe as qf
from quillframe.functions import levels, ordered


def test_rows_of_few_levels_are_not_shuffled(spark):
    rows = spark.range(3000).select((F.col("id") % 2).cast("string").alias("g"), F.when(F.col("id") % 3 != 0, F.col("id").cast("double")).alias("v")).repartition(4)
    name = "spark.sql.autoBroadcastJoinThreshold"
    kept = spark.conf.get(name)
    spark.conf.set(name, -1)  # no help from the planner's own measure
    try:
        for build in (lambda: qf.apply(rows, "clean.fill_median_by_group", group_column="g", value_column="v"),
                      lambda: levels.attach(rows, levels.level_stats(rows, "g", _m=F.avg("v")), "g"),
                      lambda: ordered.index_rows(rows, ["v"], "g").key_position().df,
                      lambda: qf.apply(rows, "transform.train_test_split", column="g")):
            plan = build()._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set(name, kept)


def test_many_levels_are_joined_alike(spark, monkeypatch):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else f"k{i % 50}") for i in range(500)], "i long, g string").repartition(3)

    def counted():
        out = levels.attach(rows, levels.level_stats(rows, "g", _n=F.count(F.lit(1))), "g")
        return sorted((r["i"], r["g"], r["_n"]) for r in out.collect())

    small = counted()
    assert len(small) == 500 and all((g is None) == (n is None) for _, g, n in small)
    for limit in ("_SENT_ROWS", "_SENT_BYTES"):
        with monkeypatch.context() as m:
            m.setattr(ordered, limit, 0)
            assert counted() == small


def test_position_in_many_keys_is_alike(spark, monkeypatch):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else f"k{i % 50}") for i in range(500)], "i long, g string").repartition(3)

    def placed():
        return sorted((r["i"], r["_pos"]) for r in ordered.index_rows(rows, ["i"], "g").key_position().df.collect())

    small, seen, want = placed(), {}, []
    for i in range(500):
        g = None if i % 7 == 0 else i % 50
        want.append((i, seen.get(g, 0)))
        seen[g] = seen.get(g, 0) + 1
    assert small == want
    for limit in ("_SENT_ROWS", "_SENT_BYTES"):
        with monkeypatch.context() as m:
            m.setattr(ordered, limit, 0)
            assert placed() == want
