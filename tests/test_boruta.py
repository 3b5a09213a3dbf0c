"""The binomial tail at its ends, and Boruta where a feature wins every turn."""

import pytest

import quillframe as qf
from quillframe.functions import dist
from quillframe.operators import feature
from quillframe.queries import catalogue


def test_binomial_tail_ends():
    assert [dist.binom_sf(k, 3, 0.5) for k in (-1, 0, 3, 4, 9)] == pytest.approx([1, 1, 0.125, 0, 0])


def test_boruta_with_a_feature_that_always_wins(spark):
    rows = [(i, float(i % 2), float(i * 7919 % 101), float(i * 104729 % 97), i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, a double, b double, c double, y int").drop("i")
    assert "a" in qf.apply(df, "feature.boruta_select", target="y", max_iter=8, trees=5).columns


def test_the_query_takes_enough_turns_to_decide(spark, folder, monkeypatch):
    asked = []

    def fixed(rows, positions, classify, trees, depth, seed):
        asked.append(trees)
        return [0.0, 0.9, 0.0, 0.0, *[0.1] * 4]  # toxic, n_chars, noise, at and their shuffled copies

    monkeypatch.setattr(feature, "importances", fixed)
    build, _ = catalogue()["feature.boruta_select"]
    assert build(spark, folder).columns == ["n_chars", "quality"]
    assert set(asked) == {50} and len(asked) > 6  # no verdict on four features is possible in six turns
