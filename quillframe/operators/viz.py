"""The bounded frame behind each chart. Nothing is drawn.

Every frame is an aggregate of all rows, so its size does not grow
with the data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.columns import (col, is_time, num, numeric_cols, pick, pick_many, pick_pair, resolve, resolve_all, text_cols,
                                time_cols)
from quillframe.functions import dist
from quillframe.functions.bins import histogram_bin
from quillframe.functions.dates import parse
from quillframe.functions.freq import top_counts, value_counts
from quillframe.functions.ordered import index_rows
from quillframe.functions.profile import fit, matrix, nulls, profile, r, rows_of, safe_corr, safe_div
from quillframe.functions.quantile import quantiles
from quillframe.functions.scale import moments
from quillframe.operators.stats import grouped_stats, pct
from quillframe.registry import operator

POINTS = 1000


def whole(t: DataFrame, total: Column | None = None) -> Column:
    """Total of a bounded frame's counts."""
    return F.sum("count").over(Window.partitionBy(F.lit(1)))


def counts_chart(df: DataFrame, column, n: int, share_of_all: bool = True) -> DataFrame:
    """The n most frequent values with their share of all rows (or of the shown rows)."""
    c = pick(df, column, "category")
    top = top_counts(df, c, n)
    if share_of_all:
        total = df.agg(F.count(F.lit(1)).alias("_n"))
        top = top.crossJoin(F.broadcast(total)).withColumn("pct", r(pct(F.col("count"), F.col("_n")), 2)).drop("_n")
    else:
        top = top.withColumn("pct", r(pct(F.col("count"), whole(top)), 2))
    return top.select(F.col("value").cast("string").alias("category"), "count", "pct").orderBy(F.desc("count"), "category")


def series_chart(df: DataFrame, cols: Sequence[str], order_by, points: int) -> DataFrame:
    """(position, value...): the rows that a line needs. Of each of ``points`` / 4 equal slices of the ordered rows, the first, the last,
    the least and the largest value of every column (M4): a line through them covers the same pixels, and no peak is lost."""
    ix = index_rows(df, order_by)
    size = max(-(-ix.rows // max(points // 4, 1)), 1)
    row, picks = F.struct(F.col("_idx").alias("position"), *[num(c).alias(c) for c in cols]), []
    for c in cols:
        x, known = num(c), num(c).isNotNull()
        at, low = F.when(known, F.col("_idx")), F.when(known, F.struct(x, F.col("_idx")))
        picks += [F.min_by(row, at), F.max_by(row, at), F.min_by(row, low), F.max_by(row, F.when(known, F.struct(x, -F.col("_idx"))))]
    kept = ix.df.groupBy(F.floor(F.col("_idx") / size).alias("_b")).agg(*[p.alias(f"_p{i}") for i, p in enumerate(picks)])
    each = F.array_distinct(F.array_compact(F.array(*[f"_p{i}" for i in range(len(picks))])))
    return kept.select(F.inline(each)).orderBy("position")


def point_cells(df: DataFrame, a: str, b: str, points: int, means: Sequence[str] = (), by: str | None = None) -> DataFrame:
    """([by], x_bin, y_bin, a, b, means..., count): all rows with both coordinates, in at most ``points`` equal cells (of each group), each at the mean of its rows."""
    bins = max(math.isqrt(points), 1)
    s = fit(df, a=F.min(num(a)), b=F.max(num(a)), c=F.min(num(b)), d=F.max(num(b)))
    some = df.where(num(a).isNotNull() & num(b).isNotNull())
    keys = [histogram_bin(num(a), s["a"], s["b"], bins).alias("x_bin"), histogram_bin(num(b), s["c"], s["d"], bins).alias("y_bin")] if s["a"] is not None and s["c"] is not None else [
        F.lit(0).alias("x_bin"), F.lit(0).alias("y_bin")]
    return some.groupBy(*([col(by)] if by else []), *keys).agg(*[F.avg(num(c)).alias(c) for c in dict.fromkeys([a, b, *means])], F.count(F.lit(1)).alias("count"))


def pair_cells(df: DataFrame, pairs: Sequence[tuple[str, str]], points: int) -> DataFrame:
    """(x, y, x_bin, y_bin, x_mean, y_mean, count): the cells of several column pairs, at most ``points`` in all, in one pass."""
    bins = max(math.isqrt(points // max(len(pairs), 1)), 1)
    cols = list(dict.fromkeys(c for p in pairs for c in p))
    s = fit(df, **{f"{e}{i}": f(num(c)) for i, c in enumerate(cols) for e, f in (("a", F.min), ("b", F.max))})
    place = {c: F.when(num(c).isNotNull(), histogram_bin(num(c), s[f"a{i}"], s[f"b{i}"], bins)) if s[f"a{i}"] is not None else F.lit(None).cast("int") for i, c in enumerate(cols)}
    long = df.select(F.inline(F.array(*[F.struct(
        F.lit(a).alias("x"), F.lit(b).alias("y"), place[a].alias("x_bin"), place[b].alias("y_bin"), num(a).cast("double").alias("_a"), num(b).cast("double").alias("_b")) for a, b in pairs])))
    return long.where("x_bin is not null and y_bin is not null").groupBy("x", "y", "x_bin", "y_bin").agg(
        F.avg("_a").alias("x_mean"), F.avg("_b").alias("y_mean"), F.count(F.lit(1)).alias("count"))


def box_stats(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, count, min, q1, median, q3, max, lower, upper, outliers): whiskers end at the last value inside the fences."""
    rows = df if not by else df.where(reduce(lambda a, b: a & b, [col(k).isNotNull() for k in by]))
    q = quantiles(rows, cols, [0.25, 0.5, 0.75], by)
    long = rows.select(*[col(k).alias(f"_g{i}") for i, k in enumerate(by)],
                       F.inline(F.array(*[F.struct(F.lit(c).alias("_c"), num(c).alias("x")) for c in cols]))).where(F.col("x").isNotNull())
    fences = q.select(*[col(k).alias(f"_h{i}") for i, k in enumerate(by)], F.col("column").alias("_d"), "q0", "q1", "q2",
                      (F.col("q0") - 1.5 * (F.col("q2") - F.col("q0"))).alias("_lo"), (F.col("q2") + 1.5 * (F.col("q2") - F.col("q0"))).alias("_hi"))
    on = [F.col("_c") == F.col("_d"), *[F.col(f"_g{i}") == F.col(f"_h{i}") for i in range(len(by))]]
    t = long.join(fences if by else F.broadcast(fences), on)
    inside = F.when(F.col("x").between(F.col("_lo"), F.col("_hi")), F.col("x"))
    return t.groupBy(*[F.col(f"_g{i}").alias(k) for i, k in enumerate(by)], F.col("_c").alias("column")).agg(
        F.count("x").alias("count"), r(F.min("x")).alias("min"), r(F.first("q0")).alias("q1"), r(F.first("q1")).alias("median"), r(F.first("q2")).alias("q3"),
        r(F.max("x")).alias("max"), r(F.min(inside)).alias("lower"), r(F.max(inside)).alias("upper"), (F.count("x") - F.count(inside)).alias("outliers"))


def histogram_frame(df: DataFrame, c: str, bins: int, by: str | None = None) -> DataFrame:
    """([by], bin, left, right, count); empty bins are left out."""
    s = fit(df, lo=F.min(num(c)), hi=F.max(num(c)))
    if s["lo"] is None:
        raise ValueError(f"column {c!r} has no values")
    lo, hi = s["lo"], s["hi"]
    width = (hi - lo) / bins if hi > lo else 1.0
    some = df.where(num(c).isNotNull())
    keys = []
    if by is not None:
        some = some.where(col(by).isNotNull())
        keys = [col(by)]
    g = some.groupBy(*keys, histogram_bin(num(c), lo, hi, bins).alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return g.select(*keys, "bin", r(F.lit(lo) + F.col("bin") * F.lit(width)).alias("left"), r(F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("right"), "count")


def grid_frame(df: DataFrame, a: str, b: str, bins: int) -> DataFrame:
    s = fit(df, a=F.min(num(a)), b=F.max(num(a)), c=F.min(num(b)), d=F.max(num(b)))
    some = df.where(num(a).isNotNull() & num(b).isNotNull())
    return some.groupBy(histogram_bin(num(a), s["a"], s["b"], bins).alias("x_bin"), histogram_bin(num(b), s["c"], s["d"], bins).alias("y_bin")).agg(
        F.count(F.lit(1)).alias("count"))


def pair_counts(df: DataFrame, columns) -> tuple[DataFrame, str, str]:
    a, b = pick_pair(df, columns, "text")
    some = df.where(col(a).isNotNull() & col(b).isNotNull())
    return some.groupBy(col(a), col(b)).agg(F.count(F.lit(1)).alias("count")), a, b


def ordered_series(name: str):
    def run(df: DataFrame, column: str | None = None, order_by: Sequence[str] = (), points: int = POINTS) -> DataFrame:
        return series_chart(df, [pick(df, column, "numeric")], order_by, points)

    run.__doc__ = "Value by row position."
    return operator(name)(run)


area_chart = ordered_series("viz.area_chart")
line_chart = ordered_series("viz.line_chart")
step_chart = ordered_series("viz.step_chart")


def top_chart(name: str, n: int):
    def run(df: DataFrame, column: str | None = None, n: int = n) -> DataFrame:
        return counts_chart(df, column, n)

    run.__doc__ = "Most frequent values with their share of all rows."
    return operator(name)(run)


count_plot = top_chart("viz.count_plot", 20)
funnel_chart = top_chart("viz.funnel_chart", 10)
lollipop_chart = top_chart("viz.lollipop_chart", 15)
polar_chart = top_chart("viz.polar_chart", 12)
top_n_bar = top_chart("viz.top_n_bar", 10)


@operator("viz.bar_chart")
def bar_chart(df: DataFrame, column: str | None = None, percentage: bool = False, n: int = 15) -> DataFrame:
    t = counts_chart(df, column, n)
    return t.withColumn("value", F.col("pct")) if percentage else t.withColumn("value", F.col("count").cast("double"))


def pie_frame(df: DataFrame, column, n: int) -> DataFrame:
    """Top n values and the rest as Other."""
    c = pick(df, column, "category")
    vc = value_counts(df, c)
    top = vc.orderBy(F.desc("count"), "value").limit(n)
    total = vc.agg(F.sum("count").alias("_t"))
    rest = top.agg(F.sum("count").alias("_s")).crossJoin(total).select(F.lit("Other").alias("category"), (F.col("_t") - F.col("_s")).alias("count")).where(F.col("count") > 0)
    t = top.select(F.col("value").cast("string").alias("category"), "count").unionByName(rest)
    return t.crossJoin(F.broadcast(total)).select("category", "count", r(pct(F.col("count"), F.col("_t")), 2).alias("pct"))


@operator("viz.pie_chart")
def pie_chart(df: DataFrame, column: str | None = None, n: int = 6) -> DataFrame:
    return pie_frame(df, column, n)


@operator("viz.donut_chart")
def donut_chart(df: DataFrame, column: str | None = None, n: int = 6) -> DataFrame:
    return pie_frame(df, column, n)


@operator("viz.pie_subplots")
def pie_subplots(df: DataFrame, columns: Sequence[str] | None = None, n: int = 8, max_columns: int | None = None) -> DataFrame:
    cols = resolve_all(df, columns) if columns else pick_many(df, None, "text")
    return reduce(DataFrame.unionByName, [counts_chart(df, c, n, False).withColumn("column", F.lit(c)) for c in cols[:max_columns]])


@operator("viz.treemap")
def treemap(df: DataFrame, column: str | None = None) -> DataFrame:
    c = pick(df, column, "category")
    vc = value_counts(df, c)
    total = vc.agg(F.sum("count").alias("_t"))
    return vc.crossJoin(F.broadcast(total)).select(F.col("value").cast("string").alias("category"), "count", r(pct(F.col("count"), F.col("_t")), 2).alias("pct"))


@operator("viz.pareto_chart")
def pareto_chart(df: DataFrame, column: str | None = None, n: int = 15) -> DataFrame:
    """Top n counts with the running share of the shown rows."""
    t = counts_chart(df, column, n, False)
    w = Window.orderBy(F.desc("count"), "category").rowsBetween(Window.unboundedPreceding, 0)  # at most n rows
    return t.withColumn("cumulative_pct", r(pct(F.sum("count").over(w), whole(t)), 2))


@operator("viz.dot_plot")
def dot_plot(df: DataFrame, column: str | None = None, value: str | None = None, n: int = 15) -> DataFrame:
    c = pick(df, column, "category")
    v = resolve(df, value) if value else next((x for x in numeric_cols(df) if x != c), None)
    if v is None:
        return counts_chart(df, c, n).select("category", F.col("count").cast("double").alias("value"))
    g = df.where(col(c).isNotNull()).groupBy(col(c).cast("string").alias("category")).agg(r(F.avg(num(v))).alias("value"))
    return g.orderBy(F.desc("value"), "category").limit(n)


@operator("viz.box_plot")
def box_plot(df: DataFrame, column: str | None = None, max_columns: int | None = None) -> DataFrame:
    return box_stats(df, pick_many(df, column)[:max_columns])


@operator("viz.box_comparison")
def box_comparison(df: DataFrame, column: str | None = None, group: str | None = None, max_columns: int | None = None) -> DataFrame:
    g = resolve(df, group) if group else (text_cols(df) or [None])[0]
    if g is None:
        return box_stats(df, pick_many(df, column)[:max_columns])
    return box_stats(df, [pick(df, column, "numeric")], [g])


@operator("viz.violin_plot")
def violin_plot(df: DataFrame, column: str | None = None, bins: int = 40) -> DataFrame:
    return distribution(df, column, bins)


@operator("viz.distribution")
def distribution(df: DataFrame, column: str | None = None, bins: int = 30) -> DataFrame:
    """Histogram with the box statistics beside every bin."""
    c = pick(df, column, "numeric")
    box = box_stats(df, [c]).select("median", F.col("q1").alias("box_q1"), F.col("q3").alias("box_q3"), "lower", "upper")
    return histogram_frame(df, c, bins).crossJoin(F.broadcast(box)).orderBy("bin")


@operator("viz.histogram")
def histogram(df: DataFrame, column: str | None = None, bins: int = 30) -> DataFrame:
    return histogram_frame(df, pick(df, column, "numeric"), bins).orderBy("bin")


@operator("viz.density_plot")
def density_plot(df: DataFrame, column: str | None = None, group: str | None = None, bins: int = 50) -> DataFrame:
    """Histogram scaled to unit area, optionally per group."""
    c = pick(df, column, "numeric")
    g = resolve(df, group) if group else None
    h = histogram_frame(df, c, bins, g)
    keys = [g] if g else []
    total = h.groupBy(*[col(k) for k in keys]).agg(F.sum("count").alias("_t"))
    t = h.join(F.broadcast(total), keys) if g else h.crossJoin(F.broadcast(total))
    s = fit(df, lo=F.min(num(c)), hi=F.max(num(c)))
    width = (s["hi"] - s["lo"]) / bins or 1.0
    return t.withColumn("density", F.round(F.col("count") / (F.col("_t") * F.lit(width)), 8)).drop("_t")


@operator("viz.ridgeline")
def ridgeline(df: DataFrame, column: str | None = None, group: str | None = None, bins: int = 30, n: int = 8) -> DataFrame:
    c, g = pick(df, column, "numeric"), pick(df, group, "text")
    top = [x["value"] for x in top_counts(df, g, n).collect()]  # at most n rows
    return histogram_frame(df.where(col(g).isin(top)), c, bins, g)


@operator("viz.density_heatmap")
def density_heatmap(df: DataFrame, x: str | None = None, column: str | None = None, y: str | None = None, bins: int = 30) -> DataFrame:
    a, b = pick_pair(df, [v for v in (x or column, y) if v], "numeric")
    return grid_frame(df, a, b, bins)


@operator("viz.contour_plot")
def contour_plot(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 30) -> DataFrame:
    t = grid_frame(df, *pick_pair(df, columns, "numeric"), bins)
    total = t.agg(F.sum("count").alias("_t"))
    return t.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("count") / F.col("_t"), 8)).drop("_t")


@operator("viz.histogram_2d")
def histogram_2d(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 30) -> DataFrame:
    """2-D counts with the marginal counts of their row and column (at most bins x bins cells)."""
    t = grid_frame(df, *pick_pair(df, columns, "numeric"), bins)
    return t.withColumns({"x_total": F.sum("count").over(Window.partitionBy("x_bin")), "y_total": F.sum("count").over(Window.partitionBy("y_bin"))})


@operator("viz.bubble_chart")
def bubble_chart(df: DataFrame, points: int = POINTS) -> DataFrame:
    """Cells of the first two numeric columns with the means of the others."""
    cols = pick_many(df, None)
    return point_cells(df, *cols[:2], points, cols[2:])


@operator("viz.parallel_coords")
def parallel_coords(df: DataFrame, points: int = POINTS, max_columns: int | None = None) -> DataFrame:
    """Line bundles between neighbouring columns: how many rows run from one bin to another."""
    cols = pick_many(df, None)[:max_columns]
    return pair_cells(df, list(zip(cols, cols[1:])), points)


@operator("viz.pairplot")
def pairplot(df: DataFrame, points: int = POINTS, max_columns: int | None = None) -> DataFrame:
    return pair_cells(df, list(combinations(pick_many(df, None)[:max_columns], 2)), points)


def fitted_points(df: DataFrame, columns, points: int, by: str | None = None) -> DataFrame:
    """Cells of all rows with r and the least-squares line of all rows."""
    a, b = pick_pair(df, columns, "numeric")
    x, y = num(a), num(b)
    both = x.isNotNull() & y.isNotNull()
    line = df.agg(r(safe_corr(x, y)).alias("r"), F.regr_slope(F.when(both, y), F.when(both, x)).alias("slope"),
                  F.regr_intercept(F.when(both, y), F.when(both, x)).alias("intercept"))
    return point_cells(df, a, b, points, by=by).crossJoin(F.broadcast(line)).withColumn("fitted", F.col("intercept") + F.col("slope") * col(a))  # one row


@operator("viz.correlation_scatter")
def correlation_scatter(df: DataFrame, columns: Sequence[str] | None = None, points: int = POINTS) -> DataFrame:
    return fitted_points(df, columns, points)


@operator("viz.scatter")
def scatter(df: DataFrame, columns: Sequence[str] | None = None, color: str | None = None, points: int = POINTS) -> DataFrame:
    return fitted_points(df, columns, points, resolve(df, color) if color else None)


def group_points(df: DataFrame, column, group, bins: int) -> DataFrame:
    """([group], bin, value, count): the values of each group in ``bins`` equal steps, at the mean of the step's rows."""
    c, g = pick(df, column, "numeric"), resolve(df, group) if group else (text_cols(df) or [None])[0]
    s = fit(df, a=F.min(num(c)), b=F.max(num(c)))
    step = histogram_bin(num(c), s["a"], s["b"], bins) if s["a"] is not None else F.lit(0)
    return df.where(num(c).isNotNull()).groupBy(*([col(g)] if g else []), step.alias("bin")).agg(F.avg(num(c)).alias(c), F.count(F.lit(1)).alias("count"))


@operator("viz.strip_plot")
def strip_plot(df: DataFrame, column: str | None = None, group: str | None = None, bins: int = 100) -> DataFrame:
    return group_points(df, column, group, bins)


@operator("viz.swarm_plot")
def swarm_plot(df: DataFrame, column: str | None = None, group: str | None = None, bins: int = 40) -> DataFrame:
    """As ``strip_plot``; ``count`` is the width of the swarm at the step."""
    return group_points(df, column, group, bins)


@operator("viz.candlestick")
def candlestick(df: DataFrame, open: str | None = None, high: str | None = None, low: str | None = None, close: str | None = None,
                time: str | None = None, value: str | None = None, every: str = "day") -> DataFrame:
    """First, highest, lowest and last value of each time bucket; named columns are combined the same way."""
    t = pick(df, time, "time")
    v = pick(df, value or close, "numeric")
    o, h, lo, c = (resolve(df, x) if x else v for x in (open, high, low, close))
    stamp = col(t) if is_time(df, t) else parse(col(t))
    return df.where(stamp.isNotNull()).groupBy(F.date_trunc(every, stamp).alias("time")).agg(
        F.min_by(num(o), stamp).alias("open"), F.max(num(h)).alias("high"), F.min(num(lo)).alias("low"), F.max_by(num(c), stamp).alias("close")).orderBy("time")


@operator("viz.time_series")
def time_series(df: DataFrame, column: str | None = None, time: str | None = None, points: int = POINTS) -> DataFrame:
    """Mean value of at most ``points`` equal time steps."""
    t, c = pick(df, time, "time"), pick(df, column, "numeric")
    us = F.unix_micros((col(t) if is_time(df, t) else parse(col(t))).cast("timestamp"))
    s = fit(df, a=F.min(us), b=F.max(us))
    step = max((s["b"] - s["a"]) // points + 1, 1) if s["a"] is not None else 1
    start = F.lit(s["a"]) + F.floor((us - F.lit(s["a"])) / F.lit(step)) * F.lit(step)
    return df.where(us.isNotNull()).groupBy(F.timestamp_micros(start).alias("time")).agg(r(F.avg(num(c))).alias(c), F.count(F.lit(1)).alias("count")).orderBy("time")


@operator("viz.timeline_chart")
def timeline_chart(df: DataFrame, start: str | None = None, column: str | None = None, end: str | None = None, label: str | None = None,
                   points: int = POINTS) -> DataFrame:
    """First ``points`` intervals by start; without an end the interval lasts one day."""
    a = pick(df, start or column, "time")
    name = pick(df, label, "category")
    stamp = lambda c: (col(c) if is_time(df, c) else parse(col(c))).cast("timestamp")
    finish = stamp(resolve(df, end)) if end else stamp(a) + F.expr("interval 1 day")
    t = df.select(col(name).cast("string").alias("label"), stamp(a).alias("start"), finish.alias("end"))
    return t.where(F.col("start").isNotNull()).orderBy("start", "label", "end").limit(points)


@operator("viz.comparison_bar")
def comparison_bar(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    a, b = pick_pair(df, columns, "numeric")
    p = profile(df, [a, b], {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}, numeric=True)
    p = p.join(F.broadcast(quantiles(df, [a, b], [0.5]).withColumnRenamed("q0", "median")), "column")
    one = p.agg(*[F.max(F.when(F.col("column") == c, F.col(k))).alias(f"{k}_{i}") for i, c in enumerate((a, b)) for k in ("mean", "median", "std", "min", "max")])
    return rows_of(one, [F.struct(F.lit(k).alias("stat"), r(F.col(f"{k}_0")).alias(a), r(F.col(f"{k}_1")).alias(b)) for k in ("mean", "median", "std", "min", "max")])


@operator("viz.cumulative_line")
def cumulative_line(df: DataFrame, column: str | None = None, order_by: Sequence[str] = (), points: int = POINTS) -> DataFrame:
    """Running sum at the last row of each slice."""
    c = pick(df, column, "numeric")
    ix = index_rows(df, order_by).running(sums={"_run": num(c)})
    size = max(-(-ix.rows // points), 1)
    return ix.df.groupBy(F.floor(F.col("_idx") / size).alias("_b")).agg(F.max("_idx").alias("position"), F.max_by("_run", "_idx").alias("cumulative")).drop("_b").orderBy("position")


@operator("viz.dual_axis")
def dual_axis(df: DataFrame, columns: Sequence[str] | None = None, order_by: Sequence[str] = (), points: int = POINTS) -> DataFrame:
    return series_chart(df, list(pick_pair(df, columns, "numeric")), order_by, points)


@operator("viz.ecdf_plot")
def ecdf_plot(df: DataFrame, column: str | None = None, points: int = 100) -> DataFrame:
    """Value at evenly spaced shares of the rows."""
    c = pick(df, column, "numeric")
    grid = [i / points for i in range(points + 1)]
    q = quantiles(df, [c], grid)
    return rows_of(q, [F.struct(F.lit(p).alias("share"), r(F.col(f"q{i}")).alias(c)) for i, p in enumerate(grid)])


@operator("viz.qq_plot")
def qq_plot(df: DataFrame, column: str | None = None, points: int = 50) -> DataFrame:
    """Normal quantiles, sample quantiles and the line mean + std * z."""
    c = pick(df, column, "numeric")
    grid = [(i + 0.5) / points for i in range(points)]
    mean, std = moments(df, [c])[c]
    q = quantiles(df, [c], grid)
    z = [dist.norm_ppf(p) for p in grid]
    return rows_of(q, [F.struct(F.lit(p).alias("share"), F.lit(v).alias("theoretical"), r(F.col(f"q{i}")).alias("sample"), F.lit(mean + (std or 0.0) * v).alias("line"))
                       for i, (p, v) in enumerate(zip(grid, z))])


def per_group(df: DataFrame, column, group, aggs: dict) -> DataFrame:
    c, g = pick(df, column, "numeric"), pick(df, group, "text")
    t = grouped_stats(df, g, c, aggs, median=None)
    return t.select(col(g).cast("string").alias("group"), *[r(F.col(k)).alias(k) if k != "count" else F.col(k) for k in aggs])


@operator("viz.error_bar_chart")
def error_bar_chart(df: DataFrame, column: str | None = None, group: str | None = None) -> DataFrame:
    return per_group(df, column, group, {"mean": F.avg, "std": F.stddev_samp, "count": F.count})


@operator("viz.range_plot")
def range_plot(df: DataFrame, column: str | None = None, group: str | None = None) -> DataFrame:
    return per_group(df, column, group, {"min": F.min, "mean": F.avg, "max": F.max})


@operator("viz.gauge_chart")
def gauge_chart(df: DataFrame, column: str | None = None, agg: str = "mean") -> DataFrame:
    c = pick(df, column, "numeric")
    fns = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "std": F.stddev_samp}
    q = quantiles(df, [c], [0.5]).select(F.col("q0").alias("_med"))
    one = df.agg(F.min(num(c)).alias("_lo"), F.max(num(c)).alias("_hi"), fns.get(agg, F.avg)(num(c)).cast("double").alias("_v")).crossJoin(F.broadcast(q))
    value = F.col("_med") if agg == "median" else F.col("_v")
    return one.select(F.lit(agg).alias("agg"), r(value).alias("value"), r(F.col("_lo")).alias("min"), r(F.col("_med")).alias("median"), r(F.col("_hi")).alias("max"))


@operator("viz.grouped_bar")
def grouped_bar(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return pair_counts(df, columns)[0]


@operator("viz.stacked_bar")
def stacked_bar(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return pair_counts(df, columns)[0]


@operator("viz.percent_bar")
def percent_bar(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Share of the second category inside the first (rows are cells, already aggregated)."""
    t, a, _ = pair_counts(df, columns)
    return t.withColumn("pct", r(pct(F.col("count"), F.sum("count").over(Window.partitionBy(col(a)))), 2))


@operator("viz.marimekko")
def marimekko(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Width of each first category and the share of the second inside it."""
    t, a, _ = pair_counts(df, columns)
    inner = F.sum("count").over(Window.partitionBy(col(a)))
    total = t.agg(F.sum("count").alias("_t"))
    return t.withColumn("_w", inner).crossJoin(F.broadcast(total)).withColumns({
        "width_pct": r(pct(F.col("_w"), F.col("_t")), 2), "share_pct": r(pct(F.col("count"), F.col("_w")), 2)}).drop("_w", "_t")


@operator("viz.sankey_chart")
def sankey_chart(df: DataFrame, columns: Sequence[str] | None = None, n: int = 20) -> DataFrame:
    t, a, b = pair_counts(df, columns)
    return t.select(col(a).cast("string").alias("source"), col(b).cast("string").alias("target"), "count").orderBy(F.desc("count"), "source", "target").limit(n)


def path_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Counts of every prefix of the path; the level is the number of known parts."""
    some = df.where(reduce(lambda a, b: a & b, [col(c).isNotNull() for c in cols]))
    t = some.rollup(*[col(c) for c in cols]).agg(F.count(F.lit(1)).alias("count"))
    level = reduce(lambda a, b: a + b, [col(c).isNotNull().cast("int") for c in cols])
    return t.withColumn("level", level).where(F.col("level") > 0)


@operator("viz.icicle_chart")
def icicle_chart(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return path_counts(df, resolve_all(df, columns) if columns else pick_many(df, None, "text"))


@operator("viz.sunburst")
def sunburst(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return path_counts(df, pick_pair(df, columns, "text"))


@operator("viz.heatmap")
def heatmap(df: DataFrame) -> DataFrame:
    return matrix(df, pick_many(df, None), safe_corr)


@operator("viz.missing_heatmap")
def missing_heatmap(df: DataFrame, order_by: Sequence[str] = (), blocks: int = 100) -> DataFrame:
    """Null share of each column in each of at most ``blocks`` slices of the ordered rows."""
    ix = index_rows(df, order_by)
    size = max(-(-ix.rows // blocks), 1)
    return ix.df.groupBy(F.floor(F.col("_idx") / size).alias("block")).agg(*[r(F.avg(col(c).isNull().cast("int"))).alias(c) for c in df.columns]).orderBy("block")


@operator("viz.null_bar")
def null_bar(df: DataFrame) -> DataFrame:
    p = profile(df, df.columns, {"k": nulls}).where(F.col("k") > 0)
    return p.select("column", r(pct(F.col("k"), F.col("n")), 2).alias("null_pct")).orderBy(F.desc("null_pct"), "column")


@operator("viz.radar_chart")
def radar_chart(df: DataFrame) -> DataFrame:
    """Mean of each column on its own minimum-to-maximum scale of 0 to 100."""
    p = profile(df, pick_many(df, None), {"m": F.avg, "a": F.min, "b": F.max}, numeric=True)
    return p.select("column", r(F.col("m")).alias("mean"), F.coalesce(r(safe_div(F.col("m") - F.col("a"), F.col("b") - F.col("a")) * 100, 2), F.lit(50.0)).alias("scaled"))


@operator("viz.slope_chart")
def slope_chart(df: DataFrame, column: str | None = None, column2: str | None = None, label: str | None = None, order_by: Sequence[str] = (),
                n: int = 50) -> DataFrame:
    """Two values of the first n labelled rows."""
    a = pick(df, column, "numeric")
    b = resolve(df, column2) if column2 else next(c for c in numeric_cols(df) if c != a)
    name = pick(df, label, "category")
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    if not keys:
        raise ValueError("order_by is required: Spark rows have no order of their own")
    some = df.where(num(a).isNotNull() & num(b).isNotNull())
    return some.orderBy(*[col(k) for k in keys]).limit(n).select(col(name).cast("string").alias("label"), num(a).alias(a), num(b).alias(b), r(num(b) - num(a)).alias("change"))


@operator("viz.waterfall_chart")
def waterfall_chart(df: DataFrame, column: str | None = None, category: str | None = None, n: int = 10) -> DataFrame:
    """Sum per category, first n categories in order, with the running total."""
    c, g = pick(df, column, "numeric"), pick(df, category, "text")
    t = df.where(col(g).isNotNull()).groupBy(col(g).cast("string").alias("category")).agg(F.sum(num(c)).alias("value")).orderBy("category").limit(n)
    w = Window.orderBy("category").rowsBetween(Window.unboundedPreceding, 0)  # at most n rows
    return t.withColumn("cumulative", r(F.sum("value").over(w))).withColumn("value", r(F.col("value")))
