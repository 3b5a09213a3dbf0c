"""Power transforms: the exponent comes from a few passes over a grid of candidates; numpy takes each batch's variances."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def box_cox(x: Column, lam: float) -> Column:
    return F.log(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(float(lam))) - 1) / F.lit(float(lam))


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(float(lam))) - 1) / F.lit(float(lam))
    rest = 2 - lam
    down = -F.log1p(-x) if abs(rest) < 1e-12 else -(F.pow(1 - x, F.lit(float(rest))) - 1) / F.lit(float(rest))
    return F.when(x >= 0, up).when(x < 0, down)


def _box_cox(x: np.ndarray, lam: float) -> np.ndarray:
    return np.log(x[x > 0]) if abs(lam) < 1e-12 else (np.power(x, lam) - 1) / lam


def _yeo_johnson(x: np.ndarray, lam: float) -> np.ndarray:
    rest, up, down = 2 - lam, x[x >= 0], x[x < 0]
    return np.concatenate([
        np.log1p(up) if abs(lam) < 1e-12 else (np.power(up + 1, lam) - 1) / lam,
        -np.log1p(-down) if abs(rest) < 1e-12 else -(np.power(1 - down, rest) - 1) / rest,
        x[np.isnan(x)]])


_IN_BATCHES = {box_cox: _box_cox, yeo_johnson: _yeo_johnson}


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Counts, means and squared deviations (rows of the arrays) of two parts together."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    d = b[1] - a[1]
    return np.array([n, a[1] + d * share, a[2] + b[2] + d * d * a[0] * share])


def grid_variances(df: DataFrame, x: Column, transform: Callable[[Column, float], Column], grid: np.ndarray) -> np.ndarray:
    """Population variance of the transformed column for every candidate; one small row a task reaches the driver."""
    fn = _IN_BATCHES[transform]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, len(grid)))
        with np.errstate(all="ignore"):
            for batch in batches:
                values, part = batch.column(0).to_numpy(zero_copy_only=False), np.zeros((3, len(grid)))
                for i, lam in enumerate(grid):
                    y = fn(values, float(lam))
                    if len(y):
                        part[:, i] = len(y), y.mean(), np.square(y - y.mean()).sum()
                held = _joined(held, part)
        yield pa.RecordBatch.from_arrays([pa.array([held.ravel().tolist()], pa.list_(pa.float64()))], ["held"])

    rows = df.select(x.cast("double").alias("x")).where("x is not null").mapInArrow(run, "held array<double>").collect()
    total = np.zeros((3, len(grid)))
    with np.errstate(all="ignore"):
        for row in rows:
            total = _joined(total, np.array(row["held"]).reshape(3, len(grid)))
        return np.where(total[0] > 0, total[2] / total[0], np.nan)


def best_lambda(df: DataFrame, x: Column, transform: Callable[[Column, float], Column], jacobian: Column,
                low: float = -5.0, high: float = 5.0, points: int = 21, rounds: int = 4) -> float:
    """Maximum of the profile likelihood: grid, finer grids around the best point, then a parabola."""
    row = df.agg(F.count(x).alias("n"), F.sum(jacobian).alias("j")).first()
    for turn in range(rounds):
        grid = np.linspace(low, high, points)
        ll = np.array([-np.inf if not v or not np.isfinite(v) else (g - 1) * row["j"] - row["n"] / 2 * np.log(v)
                       for v, g in zip(grid_variances(df, x, transform, grid), grid)])
        k = int(np.argmax(ll))
        low, high = grid[max(k - 1, 0)], grid[min(k + 1, points - 1)]
    if 0 < k < points - 1 and np.isfinite(ll[k - 1:k + 2]).all():
        a, b, c = ll[k - 1:k + 2]
        bend = a - 2 * b + c
        if bend < 0:
            return float(grid[k] + (grid[1] - grid[0]) * (a - c) / (2 * bend))
    return float(grid[k])
