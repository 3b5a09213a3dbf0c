"""Bin edges and bin numbers (right-closed, as in interval cuts)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.columns import num
from quillframe.functions.profile import fit
from quillframe.functions.quantile import fit_quantiles


def equal_edges(df: DataFrame, name: str, n: int) -> list[float]:
    """n + 1 equal-width edges from minimum to maximum; the lowest edge is moved down by 0.1%."""
    s = fit(df, lo=F.min(num(name)), hi=F.max(num(name)))
    if s["lo"] is None:
        raise ValueError(f"column {name!r} has no values")
    return cut_edges(s["lo"], s["hi"], n)


def cut_edges(lo: float, hi: float, n: int) -> list[float]:
    if lo == hi:
        pad = 0.001 * abs(lo) if lo != 0 else 0.001
        lo, hi = lo - pad, hi + pad
        return [lo + (hi - lo) * i / n for i in range(n)] + [hi]
    edges = [lo + (hi - lo) * i / n for i in range(n)] + [hi]
    edges[0] = lo - (hi - lo) * 0.001
    return edges


def quantile_edges(df: DataFrame, name: str, n: int) -> list[float]:
    """Quantile edges, duplicates dropped."""
    got = fit_quantiles(df, [name], [i / n for i in range(n + 1)])
    if name not in got:
        raise ValueError(f"column {name!r} has no values")
    return sorted(set(got[name]))


def bin_number(x: Column, edges: Sequence[float], lowest: bool = True) -> Column:
    """0-based number of the right-closed interval (e[i], e[i+1]] holding x; else null.

    With ``lowest`` the first interval also holds its left edge.
    """
    first = x >= F.lit(float(edges[0])) if lowest else x > F.lit(float(edges[0]))
    ladder = F.when(~first | (x > F.lit(float(edges[-1]))), None)
    ladder = reduce(lambda acc, i: acc.when(x <= F.lit(float(edges[i + 1])), i),
                    range(len(edges) - 1), ladder)
    return ladder.cast("int")


def histogram_bin(x: Column, lo: float, hi: float, n: int) -> Column:
    """0-based number of the left-closed equal-width bin; the maximum joins the last bin."""
    if hi == lo:
        return F.when(x.isNotNull(), 0)
    width = (hi - lo) / n
    return F.least(F.greatest(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(0)), F.lit(n - 1)).cast("int")
