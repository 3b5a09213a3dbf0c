"""Date features of typed and of text columns, by hand."""

from datetime import datetime

import pytest

import quillframe as qf

DAYS = [datetime(2024, 1, 1), datetime(2024, 7, 6, 13), datetime(2024, 7, 9), None]


@pytest.fixture
def days(spark):
    return spark.createDataFrame([(i, d, d and d.strftime("%Y-%m-%d %H:%M:%S")) for i, d in enumerate(DAYS)], "i long, d timestamp, t string").repartition(2)


def column(out, name):
    return [r[name] for r in sorted(out.collect(), key=lambda r: r["i"])]


@pytest.mark.parametrize("c", ["d", "t"])
def test_is_holiday(days, c):
    assert column(qf.apply(days, "feature.is_holiday", column=c), f"{c}_is_holiday") == [1, 1, 0, 0]


@pytest.mark.parametrize("c", ["d", "t"])
def test_is_weekend(days, c):
    assert column(qf.apply(days, "feature.is_weekend", column=c), f"{c}_is_weekend") == [0, 1, 0, 0]


@pytest.mark.parametrize("c", ["d", "t"])
def test_time_since(days, c):
    assert column(qf.apply(days, "feature.time_since", column=c), f"{c}_days_since") == [0, 187, 190, None]
    assert column(qf.apply(days, "feature.time_since", column=c, reference="2024-07-08"), f"{c}_days_since") == [-189, -2, 1, None]


@pytest.mark.parametrize("c", ["d", "t"])
def test_datetime_features(days, c):
    out = qf.apply(days, "feature.datetime_features", column=c)
    assert [column(out, f"{c}_{p}")[1] for p in ("year", "month", "day", "dayofweek", "hour")] == [2024, 7, 6, 5, 13]
    assert f"{c}_hour" not in qf.apply(days.where("i <> 1"), "feature.datetime_features", column=c).columns


@pytest.mark.parametrize("c", ["d", "t"])
def test_seasonal_features(days, c):
    out = qf.apply(days, "feature.seasonal_features", column=c)
    assert column(out, f"{c}_month_sin")[1] == pytest.approx(-0.5) and column(out, f"{c}_hour_cos")[0] == pytest.approx(1)
    assert f"{c}_hour_sin" not in qf.apply(days.where("i <> 1"), "feature.seasonal_features", column=c).columns
