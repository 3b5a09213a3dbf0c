"""Quantiles whose brackets are narrowed several times, against numpy."""

import numpy as np
import pandas as pd
import pytest

from quillframe.functions import quantile
from quillframe.functions.quantile import quantiles


@pytest.mark.parametrize("by", [[], ["g"]])
def test_narrowed_brackets_are_exact(spark, monkeypatch, by):
    for name, value in {"_ACCURACY": 1_000, "_EDGE": 3 / 1_000, "_GRID": 50, "_HELD": 5}.items():
        monkeypatch.setattr(quantile, name, value)
    rng, n, qs = np.random.default_rng(1), 12_000, [0, 0.25, 0.5, 0.999, 1]
    pdf = pd.DataFrame({"g": rng.choice(["a", "a", "a", "b", None], n), "x": rng.standard_normal(n), "e": np.where(rng.random(n) < 0.6, 5.0, rng.random(n) * 10)})
    pdf.loc[::7, "x"] = None
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "g string, x double, e double").repartition(8)
    rows = quantiles(df, ["x", "e"], qs, by).collect()
    assert len(rows) == (6 if by else 2)
    for r in rows:
        part = pdf if not by else pdf[pdf.g.isna()] if r["g"] is None else pdf[pdf.g == r["g"]]
        assert [r[f"q{i}"] for i in range(len(qs))] == pytest.approx(np.quantile(part[r["column"]].dropna(), qs), abs=1e-12)


def test_columns_without_values(spark):
    none = spark.createDataFrame([(None,)], "x double")
    assert [tuple(r) for r in quantiles(none, ["x"], [0.5]).collect()] == [("x", None)]
    assert quantiles(none.limit(0), ["x"], [0.5]).collect() == []
