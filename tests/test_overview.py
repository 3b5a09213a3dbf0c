"""The frames of the exploratory document equal the operators', and their facts and quartiles are made once."""

from pyspark.sql import functions as F

import quillframe as qf
from quillframe.operators import analysis, stats
from quillframe.plans import facts


def test_overview_makes_facts_and_quartiles_once(spark, monkeypatch):
    df = spark.range(400).select((F.col("id") * F.col("id") % 97).cast("double").alias("a"), F.when(F.col("id") % 5 != 0, F.pow("id", F.lit(3))).alias("b"),
                                 F.lit(None).cast("double").alias("none"), F.concat(F.lit("k"), F.col("id") % 3).alias("g")).repartition(3)
    alone = {"outliers": qf.apply(df, "stats.outlier_report"), "profiles": qf.apply(df, "analysis.data_profiling_report"),
             "quality": qf.apply(df, "analysis.data_quality"), "targets": facts.target_candidates(df), "readiness": facts.ml_readiness(df)}
    calls = []

    def counted(module, name):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, **k: calls.append(name) or real(*a, **k))

    counted(facts, "column_facts")
    for module in (stats, analysis):
        counted(module, "quantiles")
    frames = facts.eda_numbers(df)
    assert calls == ["column_facts"]
    for name, want in alone.items():
        assert sorted(map(repr, frames[name].collect())) == sorted(map(repr, want.collect())), name
