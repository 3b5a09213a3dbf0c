"""Text operators: results on odd texts, and plans without the steps that were slow."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import quillframe as qf

TEXTS = ["b a b, B a c", "", None, "one", "ab ab ab cd ab cd", "  ", "Zeta zeta\nzeta ünï ünï"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string").coalesce(1)


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_diversity_counts_words_without_lambdas(texts):
    out = qf.apply(texts, "nlp.text_diversity_index", column="text")
    assert [x[0] for x in out.orderBy("i").select("text_diversity").collect()] == [0.7333, 0.0, 0.0, 0.0, 0.5333, 0.0, 0.6]
    assert "lambdafunction" not in plan(out)


@pytest.mark.parametrize("operator", ["nlp.spelling_features", "nlp.text_unique_words"])
def test_lone_words_hash_a_text_once_and_aggregate_by_hash(texts, operator):
    shown = plan(qf.apply(texts, operator, column="text")).split("== Physical Plan ==")[1]
    assert "SortAggregate" not in shown
    lines = shown.splitlines()
    above = [x for x in lines if "Project" in x and "xxhash64" in x and "word#" in x]
    assert "Generate" in shown and not above


def test_spelling_features(texts):
    out = qf.apply(texts, "nlp.spelling_features", column="text").orderBy("i").select("text_oov_count", "text_oov_ratio").collect()
    assert [tuple(x) for x in out] == [(0, 0.0), (0, 0.0), (0, 0.0), (1, 1.0), (0, 0.0), (0, 0.0), (0, 0.0)]


def test_grams_overlap_and_need_no_lambdas(spark):
    from quillframe.operators.nlp import grams

    df = spark.createDataFrame([(["a", "a", "a", "b"],), (["a"],), ([],), (["ü", "x1", "_y"],), (None,)], "t array<string>")
    out = df.select(grams(F.col("t"), 2).alias("two"), grams(F.col("t"), 3).alias("three"))
    assert [(x["two"], x["three"]) for x in out.collect()] == [
        (["a a", "a a", "a b"], ["a a a", "a a b"]), ([], []), ([], []), (["ü x1", "x1 _y"], ["ü x1 _y"]), (None, None)]
    assert "lambda" not in plan(out)


def test_collocations_count_the_words_of_the_best_pairs_only(texts, spark):
    out = qf.apply(texts, "nlp.collocations", column="text")
    assert [(x["collocation"], x["frequency"], x["pmi"]) for x in out.collect()] == [("ab cd", 2, 2.0), ("zeta zeta", 2, 1.83), ("ab ab", 2, 1.0)]
    assert "Aggregate" not in plan(out)
    assert qf.apply(texts.where("i = 3"), "nlp.collocations", column="text").count() == 0


def test_vectors_are_made_where_the_texts_were_dealt_to(texts):
    from quillframe.functions.sparse import unit_vectors, weighted_terms
    from quillframe.functions.tokens import words

    made = unit_vectors(weighted_terms(texts, "i", words(F.col("text"))), "i")
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert [(x["i"], len(x["t"])) for x in made.orderBy("i").collect()] == [(0, 3), (3, 1), (4, 2), (6, 2)]
