"""Fit a few numbers, then apply them in one projection."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.columns import col, num
from quillframe.functions.profile import fit
from quillframe.functions.quantile import fit_quantiles


def clip(c: Column, lo: float | None, hi: float | None) -> Column:
    """Values outside [lo, hi] move to the nearer bound; null stays null."""
    out = c
    if lo is not None:
        out = F.when(out < F.lit(lo), F.lit(lo)).otherwise(out)
    if hi is not None:
        out = F.when(out > F.lit(hi), F.lit(hi)).otherwise(out)
    return out


def clip_columns(df: DataFrame, bounds: Mapping[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": clip(num(c), lo, hi) for c, (lo, hi) in bounds.items()})


def quantile_bounds(df: DataFrame, cols: Sequence[str], lower: float, upper: float) -> dict[str, tuple[float, float]]:
    return {c: (q[0], q[1]) for c, q in fit_quantiles(df, cols, [lower, upper]).items()}


def sigma_bounds(df: DataFrame, cols: Sequence[str], k: float = 3.0) -> dict[str, tuple[float, float]]:
    """mean +- k sample standard deviations; constant columns are left out."""
    s = moments(df, cols)
    return {c: (m - k * sd, m + k * sd) for c, (m, sd) in s.items() if sd}


def moments(df: DataFrame, cols: Sequence[str], std: Callable[[Column], Column] = F.stddev_samp) -> dict:
    s = fit(df, **{f"m{i}": F.avg(num(c)) for i, c in enumerate(cols)}, **{f"s{i}": std(num(c)) for i, c in enumerate(cols)})
    return {c: (s[f"m{i}"], s[f"s{i}"]) for i, c in enumerate(cols) if s[f"m{i}"] is not None}


def shift_scale(df: DataFrame, params: Mapping[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    """(x - shift) / scale per column; a zero scale counts as one."""
    return df.withColumns({f"{c}{suffix}": (num(c) - F.lit(float(a))) / F.lit(float(b) or 1.0)
                           for c, (a, b) in params.items()})


def fit_scaler(df: DataFrame, cols: Sequence[str], method: str) -> dict[str, tuple[float, float]]:
    """(shift, scale) of the standard, minmax or robust scaler."""
    if method == "standard":
        return {c: (m, s or 1.0) for c, (m, s) in moments(df, cols, F.stddev_pop).items()}
    if method == "minmax":
        s = fit(df, **{f"a{i}": F.min(num(c)) for i, c in enumerate(cols)},
                **{f"b{i}": F.max(num(c)) for i, c in enumerate(cols)})
        return {c: (s[f"a{i}"], (s[f"b{i}"] - s[f"a{i}"]) or 1.0) for i, c in enumerate(cols) if s[f"a{i}"] is not None}
    if method == "robust":
        return {c: (q[1], (q[2] - q[0]) or 1.0) for c, q in fit_quantiles(df, cols, [0.25, 0.5, 0.75]).items()}
    raise ValueError(f"unknown scaler {method!r}")


def replace_columns(df: DataFrame, cols: Sequence[str], fn: Callable[[Column], Column]) -> DataFrame:
    return df.withColumns({c: fn(col(c)) for c in cols})
