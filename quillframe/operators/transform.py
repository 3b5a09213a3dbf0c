"""Relational and reshaping operators."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.columns import (col, dtype, is_numeric, is_time, num, numeric_cols, pick, pick_many, resolve, resolve_all,
                                text_cols, time_cols)
from quillframe.functions.bins import bin_number, equal_edges, quantile_edges
from quillframe.functions.dates import java_pattern, parse
from quillframe.functions.levels import attach, level_stats, shuffled_position
from quillframe.functions.ordered import index_rows
from quillframe.functions.profile import fit
from quillframe.functions.quantile import fit_quantiles, quantiles
from quillframe.functions.ranks import with_rank
from quillframe.functions.scale import clip as clip_expr, clip_columns, fit_scaler, quantile_bounds, shift_scale
from quillframe.operators.clean import cast_to, filled_along, interpolated
from quillframe.operators.stats import hash_order, levels_of
from quillframe.registry import operator

COMPARE = {
    "==": lambda c, v: c == v, "!=": lambda c, v: c != v, ">": lambda c, v: c > v, "<": lambda c, v: c < v,
    ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v,
}
AGGREGATES = {
    "mean": F.avg, "avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "std": F.stddev_samp,
    "var": F.var_samp, "nunique": F.count_distinct,
}


def compare(df: DataFrame, name: str, op: str, value) -> Column:
    if op not in COMPARE:
        raise ValueError(f"unknown operator {op!r}; use one of {sorted(COMPARE)}")
    if is_numeric(df, name):
        value = float(value)
        if value.is_integer() and not isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
            value = int(value)
    return COMPARE[op](col(name), F.lit(value))


@operator("transform.filter")
def filter_rows(df: DataFrame, column: str, operator: str = "==", value=None) -> DataFrame:
    """``!=`` keeps nulls, as a missing value differs from every value."""
    if value is None:
        raise ValueError("value is required")
    c = resolve(df, column)
    test = compare(df, c, operator, value)
    return df.where(test | col(c).isNull() if operator == "!=" else test)


@operator("transform.where")
def where(df: DataFrame, column: str, operator: str = ">", value=None, replacement=None) -> DataFrame:
    if value is None:
        raise ValueError("value is required")
    c = resolve(df, column)
    other = F.lit(replacement) if replacement is not None else F.lit(None).cast(df.schema[c].dataType)
    return df.withColumn(c, F.when(compare(df, c, operator, value), col(c)).otherwise(other))


@operator("transform.sort")
def sort(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    c = col(resolve(df, column))
    return df.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last())


def _keys(df: DataFrame, order_by) -> list[str]:
    names = [order_by] if isinstance(order_by, str) else list(order_by)
    if not names:
        raise ValueError("order_by is required: Spark rows have no order of their own")
    return resolve_all(df, names)


@operator("transform.head")
def head(df: DataFrame, n: int = 10, order_by: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(*[col(c).asc_nulls_last() for c in _keys(df, order_by)]).limit(n)


@operator("transform.tail")
def tail(df: DataFrame, n: int = 10, order_by: Sequence[str] = ()) -> DataFrame:
    keys = _keys(df, order_by)
    last = df.orderBy(*[col(c).desc_nulls_first() for c in keys]).limit(n)
    return last.orderBy(*[col(c).asc_nulls_last() for c in keys])


@operator("transform.nlargest")
def nlargest(df: DataFrame, column: str | None = None, n: int = 10, order_by: Sequence[str] = ()) -> DataFrame:
    c = pick(df, column, "numeric")
    return df.where(col(c).isNotNull()).orderBy(col(c).desc(), *[col(x) for x in order_by]).limit(n)


@operator("transform.nsmallest")
def nsmallest(df: DataFrame, column: str | None = None, n: int = 10, order_by: Sequence[str] = ()) -> DataFrame:
    c = pick(df, column, "numeric")
    return df.where(col(c).isNotNull()).orderBy(col(c).asc(), *[col(x) for x in order_by]).limit(n)


@operator("transform.sample_rows")
def sample_rows(df: DataFrame, n: int = 10, seed: int = 42, key: Sequence[str] | None = None) -> DataFrame:
    return df.orderBy(*hash_order(df, seed, key)).limit(n)


@operator("transform.systematic_sample")
def systematic_sample(df: DataFrame, step: int = 10, offset: int = 0, order_by: Sequence[str] = ()) -> DataFrame:
    step = step if step >= 1 else 10
    ix = index_rows(df, order_by)
    offset = offset if 0 <= offset < ix.rows else 0
    at = F.col("_idx") - offset
    return ix.df.where((at >= 0) & (at % step == 0)).drop("_idx")


@operator("transform.stratified_sample")
def stratified_sample(df: DataFrame, column: str | None = None, target: str | None = None, fraction: float = 0.5,
                      n: int | None = None, seed: int = 42) -> DataFrame:
    """Exact share (half rounded to even) or exact count of every class, chosen by a seeded hash."""
    c = resolve(df, column or target)
    rows = shuffled_position(df, c, seed)
    if n:
        classes = fit(df, k=F.count_distinct(col(c)))["k"]
        return rows.where(F.col("_pos") < max(int(n / max(classes, 1)), 1)).drop("_pos")
    fraction = fraction if 0 < fraction <= 1 else 0.5
    out = attach(rows, level_stats(df, c, _n=F.count(F.lit(1))), c)
    return out.where(F.col("_pos") < F.bround(F.col("_n") * F.lit(float(fraction)), 0)).drop("_pos", "_n")


@operator("transform.shuffle")
def shuffle(df: DataFrame, seed: int = 42, key: Sequence[str] | None = None) -> DataFrame:
    return df.orderBy(*hash_order(df, seed, key))


@operator("transform.drop_rows")
def drop_rows(df: DataFrame, start: int | None = None, end: int | None = None, indices: Sequence[int] | None = None,
              order_by: Sequence[str] = ()) -> DataFrame:
    ix, i = index_rows(df, order_by), F.col("_idx")
    if indices:
        keep = ~i.isin(list(indices))
    elif start is not None and end is not None:
        keep = (i < start) | (i > end)
    elif start is not None:
        keep = i >= start
    else:
        raise ValueError("give indices, or start and end, or start")
    return ix.df.where(keep).drop("_idx")


@operator("transform.chunk_rows")
def chunk_rows(df: DataFrame, chunk_size: int = 50, order_by: Sequence[str] = ()) -> DataFrame:
    if chunk_size < 1:
        raise ValueError("chunk_size must be at least 1")
    return index_rows(df, order_by).df.withColumn("_chunk_id", F.floor(F.col("_idx") / chunk_size)).drop("_idx")


@operator("transform.row_number")
def row_number(df: DataFrame, new_name: str = "_row_number", start: int = 1, order_by: Sequence[str] = (),
               partition_by=None) -> DataFrame:
    return (index_rows(df, order_by, partition_by).key_position().df
            .withColumn(new_name, F.col("_pos") + start).drop("_idx", "_pos"))


@operator("transform.train_test_split")
def train_test_split(df: DataFrame, test_size: float = 0.2, seed: int = 42, column: str | None = None,
                     key: Sequence[str] | None = None) -> DataFrame:
    """A seeded hash of the key decides; with ``column`` every class gives its exact share to the test part."""
    if column is None:
        share = F.pmod(F.xxhash64(F.lit(seed), *[col(c) for c in (key or df.columns)]), F.lit(1_000_000)) / 1_000_000
        return df.withColumn("_split", F.when(share < test_size, "test").otherwise("train"))
    c = resolve(df, column)
    rows = attach(shuffled_position(df, c, seed, key), level_stats(df, c, _n=F.count(F.lit(1))), c)
    test = F.col("_pos") < F.bround(F.col("_n") * F.lit(float(test_size)), 0)
    return rows.withColumn("_split", F.when(test, "test").otherwise("train")).drop("_pos", "_n")


@operator("transform.groupby_agg")
def groupby_agg(df: DataFrame, column: str, agg: str = "count") -> DataFrame:
    """Nulls of the key form a group of their own."""
    c = resolve(df, column)
    if agg == "count":
        out = df.groupBy(col(c)).agg(F.count(F.lit(1)).alias("count"))
    else:
        nums = [x for x in numeric_cols(df) if x != c]
        if not nums:
            raise ValueError("no numeric columns to aggregate")
        if agg == "median":
            out = wide_quantile(df, nums, 0.5, [c])
        else:
            out = df.groupBy(col(c)).agg(*[aggregate(agg)(col(x)).alias(x) for x in nums])
    return out.orderBy(F.desc(out.columns[-1]), col(c))


def aggregate(name: str):
    if name not in AGGREGATES:
        raise ValueError(f"unknown aggregate {name!r}; use median or one of {sorted(AGGREGATES)}")
    return AGGREGATES[name]


def wide_quantile(df: DataFrame, cols: Sequence[str], q: float, by: Sequence[str]) -> DataFrame:
    """One exact quantile of many columns per group, one output column each."""
    long = quantiles(df, cols, [q], by)
    return long.groupBy(*[col(k) for k in by]).agg(
        *[F.max(F.when(F.col("column") == c, F.col("q0"))).alias(c) for c in cols])


@operator("transform.merge")
def merge(df: DataFrame, column: str | None = None, how: str = "inner", right: DataFrame | None = None,
          on: Sequence[str] | None = None) -> DataFrame:
    """With ``right``: a join. Without: one row per key with the sums of the numeric columns."""
    if right is not None:
        keys = [on] if isinstance(on, str) else list(on or ([column] if column else []))
        if not keys:
            raise ValueError("on (or column) is required for a join")
        return df.join(right, keys, how)
    c = resolve(df, column)
    nums = [x for x in numeric_cols(df) if x != c]
    aggs = [F.sum(col(x)).alias(x) for x in nums] or [F.count(col(df.columns[0])).alias(df.columns[0])]
    return df.groupBy(col(c)).agg(*aggs)


@operator("transform.cross_join")
def cross_join(df: DataFrame, columns: Sequence[str] = (), max_levels: int = 10_000) -> DataFrame:
    """All combinations of two columns' values. The smaller list must have at most ``max_levels`` values."""
    names = list(columns) or (text_cols(df)[:2] if len(text_cols(df)) >= 2 else df.columns[:2])
    a, b = resolve_all(df, names[:2])
    left, right = (df.select(col(c)).where(col(c).isNotNull()).distinct() for c in (a, b))
    for side, flip in ((right, False), (left, True)):
        if side.limit(max_levels + 1).count() <= max_levels:
            rows = [x[0] for x in side.collect()]  # at most max_levels values
            kind = df.schema[a if flip else b].dataType
            if not rows:
                return left.limit(0).crossJoin(right.limit(0))
            values = F.explode(F.array(*[F.lit(v).cast(kind) for v in rows]))
            return right.select(values.alias(a), col(b)) if flip else left.select(col(a), values.alias(b))
    raise ValueError(f"both columns have more than {max_levels} values")


def pivoted(df: DataFrame, index: str, columns: str, values: str, agg: str, max_levels: int) -> DataFrame:
    levels = levels_of(df, columns, max_levels)
    some = df.where(col(index).isNotNull() & col(columns).isNotNull())
    if agg == "median":
        long = quantiles(some, [values], [0.5], [index, columns])
        return long.groupBy(col(index)).agg(
            *[F.max(F.when(col(columns) == F.lit(v), F.col("q0"))).alias(str(v)) for v in levels])
    fn = aggregate(agg)
    return some.groupBy(col(index)).agg(*[fn(F.when(col(columns) == F.lit(v), col(values))).alias(str(v)) for v in levels])


@operator("transform.pivot")
def pivot(df: DataFrame, index: str | None = None, column: str | None = None, columns: str | None = None,
          values: str | None = None, agg: str = "mean", max_levels: int = 1000) -> DataFrame:
    """Index by columns, or a plain grouped aggregate; more than ``max_levels`` columns is an error."""
    i = resolve(df, index or column)
    if columns and values:
        return pivoted(df, i, resolve(df, columns), resolve(df, values), agg, max_levels)
    cols = [resolve(df, values)] if values else [c for c in numeric_cols(df) if c != i]
    some = df.where(col(i).isNotNull())
    if agg == "median":
        return wide_quantile(some, cols, 0.5, [i])
    return some.groupBy(col(i)).agg(*[aggregate(agg)(col(c)).alias(c) for c in cols])


@operator("transform.unstack_column")
def unstack_column(df: DataFrame, column: str, index: str, value: str, order_by: Sequence[str] = (),
                   max_levels: int = 1000) -> DataFrame:
    """Long to wide; the first value in ``order_by`` fills a cell."""
    i, c, v = resolve_all(df, [index, column, value])
    order = F.struct(*[col(x) for x in (_keys(df, order_by) if order_by else [v])])
    some = df.where(col(i).isNotNull() & col(c).isNotNull() & col(v).isNotNull())
    return some.groupBy(col(i)).agg(*[F.min_by(F.when(col(c) == F.lit(x), col(v)), F.when(col(c) == F.lit(x), order)).alias(str(x))
                                      for x in levels_of(df, c, max_levels)])


def unpivoted(df: DataFrame, ids: Sequence[str], values: Sequence[str], var: str, val: str) -> DataFrame:
    kinds = {df.schema[c].dataType.simpleString() for c in values}
    if len(kinds) > 1:
        target = "double" if all(is_numeric(df, c) for c in values) else "string"
        df = df.withColumns({c: col(c).cast(target) for c in values})
    return df.unpivot([col(c) for c in ids], [col(c) for c in values], var, val)


@operator("transform.melt")
def melt(df: DataFrame, id_vars: Sequence[str] = (), value_vars: Sequence[str] = ()) -> DataFrame:
    ids = resolve_all(df, id_vars) if id_vars else (text_cols(df)[:2] or df.columns[:1])
    values = resolve_all(df, value_vars) if value_vars else [c for c in df.columns if c not in ids]
    return unpivoted(df, ids, values, "variable", "value")


@operator("transform.stack_columns")
def stack_columns(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    values = resolve_all(df, columns) if columns else list(df.columns)
    return unpivoted(df, [c for c in df.columns if c not in values], values, "col_name", "col_value")


@operator("transform.transpose")
def transpose(df: DataFrame, order_by: Sequence[str] = (), max_rows: int = 500) -> DataFrame:
    """Rows become columns row_0, row_1, ...; more than ``max_rows`` rows is an error."""
    if df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"transpose needs at most {max_rows} rows")
    ix = index_rows(df, order_by)
    long = unpivoted(ix.df.withColumns({c: col(c).cast("string") for c in df.columns}), ["_idx"], df.columns, "feature", "v")
    return long.groupBy("feature").agg(*[F.max(F.when(F.col("_idx") == i, F.col("v"))).alias(f"row_{i}") for i in range(ix.rows)])


@operator("transform.explode")
def explode(df: DataFrame, column: str, delimiter: str = ",") -> DataFrame:
    c = resolve(df, column)
    is_array = isinstance(df.schema[c].dataType, T.ArrayType)
    items = col(c) if is_array else F.split(F.coalesce(col(c).cast("string"), F.lit("")), re.escape(delimiter))
    out = df.withColumn("_item", F.explode_outer(items))
    item = F.col("_item")
    plain = is_array and not isinstance(df.schema[c].dataType.elementType, T.StringType)
    return out.withColumn(c, item if plain else F.trim(item)).drop("_item")


@operator("transform.split_column")
def split_column(df: DataFrame, column: str, delimiter: str = ",", max_parts: int = 1000) -> DataFrame:
    c = resolve(df, column)
    parts = F.split(col(c).cast("string"), re.escape(delimiter))
    width = fit(df, w=F.max(F.size(parts)))["w"] or 0
    if width > max_parts:
        raise ValueError(f"a value splits into {width} parts, more than {max_parts}")
    return df.withColumns({f"{c}_{i + 1}": F.trim(F.get(parts, i)) for i in range(max(width, 0))})


@operator("transform.concat_columns")
def concat_columns(df: DataFrame, columns: Sequence[str] = (), separator: str = "_", new_name: str = "combined") -> DataFrame:
    names = resolve_all(df, columns) if len(columns) >= 2 else (text_cols(df)[:2] if len(text_cols(df)) >= 2 else df.columns[:2])
    return df.withColumn(new_name, F.concat_ws(separator, *[F.coalesce(col(c).cast("string"), F.lit("")) for c in names]))


def python_slice(s: Column, start: int, end: int | None) -> Column:
    """Text between two positions, counted from the end when negative."""
    n = F.length(s)

    def at(i):
        return F.least(F.lit(i), n) if i >= 0 else F.greatest(n + i, F.lit(0))

    a, b = at(start), n if end is None else at(end)
    return F.when(b > a, F.substr(s, a + 1, b - a)).when(s.isNotNull(), "")


@operator("transform.string_slice")
def string_slice(df: DataFrame, column: str, start: int = 0, end: int | None = None, new_name: str | None = None) -> DataFrame:
    c = resolve(df, column)
    return df.withColumn(new_name or f"{c}_slice", python_slice(col(c).cast("string"), start, end))


@operator("transform.add_column")
def add_column(df: DataFrame, column: str, expression: str = "") -> DataFrame:
    return df.withColumn(column, F.expr(expression) if expression else F.lit(0))


@operator("transform.apply_expr")
def apply_expr(df: DataFrame, expression: str, new_name: str = "result") -> DataFrame:
    if not expression:
        raise ValueError("expression is required")
    return df.withColumn(new_name, F.expr(expression))


@operator("transform.assign_value")
def assign_value(df: DataFrame, column: str, value) -> DataFrame:
    if value is None:
        raise ValueError("value is required")
    return df.withColumn(resolve(df, column), F.lit(value))


@operator("transform.duplicate_column")
def duplicate_column(df: DataFrame, column: str, new_name: str | None = None) -> DataFrame:
    c = resolve(df, column)
    return df.withColumn(new_name or f"{c}_copy", col(c))


@operator("transform.conditional_column")
def conditional_column(df: DataFrame, column: str, operator: str = ">", value=None, true_value=1, false_value=0,
                       new_name: str | None = None) -> DataFrame:
    c = resolve(df, column)
    if value is None:
        value = fit_quantiles(df, [c], [0.5])[c][0]
    return df.withColumn(new_name or f"{c}_flag",
                         F.when(compare(df, c, operator, value), F.lit(true_value)).otherwise(F.lit(false_value)))


@operator("transform.reorder_columns")
def reorder_columns(df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    if not order:
        return df.select(*[col(c) for c in sorted(df.columns)])
    first = [c for c in order if c in df.columns]
    return df.select(*[col(c) for c in [*first, *[x for x in df.columns if x not in first]]])


@operator("transform.flatten_columns")
def flatten_columns(df: DataFrame) -> DataFrame:
    """Struct fields become ``outer_inner`` columns; names become snake case."""
    out: list[tuple[str, Column]] = []

    def walk(schema, path, names):
        for f in schema.fields:
            here = f"{path}`{f.name}`"
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, here + ".", [*names, f.name])
            else:
                out.append(("_".join([*names, f.name]), F.col(here)))

    walk(df.schema, "", [])
    named = []
    for i, (name, c) in enumerate(out):
        words = re.sub(r"[^\w\s]", "", name.strip()).split()
        named.append(c.alias("_".join(words).lower().strip("_") or f"col_{i}"))
    return df.select(*named)


@operator("transform.cast_columns")
def cast_columns(df: DataFrame, column: str | None = None, columns: Sequence[str] = (), dtype: str = "float") -> DataFrame:
    names = resolve_all(df, columns or ([column] if column else []))
    if not names:
        raise ValueError("columns are required")
    return df.withColumns({c: cast_to(df, c, dtype) for c in names})


@operator("transform.round_values")
def round_values(df: DataFrame, column: str | None = None, decimals: int = 2) -> DataFrame:
    return df.withColumns({c: F.bround(col(c), decimals) for c in pick_many(df, column)})


@operator("transform.clip")
def clip(df: DataFrame, column: str | None = None, min: float | None = None, max: float | None = None) -> DataFrame:
    lo, hi = (None if v is None else float(v) for v in (min, max))
    return df.withColumns({c: clip_expr(num(c), lo, hi) for c in pick_many(df, column)})


@operator("transform.winsorize")
def winsorize(df: DataFrame, column: str | None = None, lower: float = 0.05, upper: float = 0.95) -> DataFrame:
    return clip_columns(df, quantile_bounds(df, pick_many(df, column), lower, upper))


@operator("transform.bin_column")
def bin_column(df: DataFrame, column: str | None = None, n: int = 5) -> DataFrame:
    c = pick(df, column, "numeric")
    return df.withColumn(f"{c}_bin", bin_number(num(c), equal_edges(df, c, n), lowest=False))


@operator("transform.qcut")
def qcut(df: DataFrame, column: str | None = None, n: int = 4) -> DataFrame:
    c = pick(df, column, "numeric")
    return df.withColumn(f"{c}_qbin", bin_number(num(c), quantile_edges(df, c, n)))


@operator("transform.rank")
def rank(df: DataFrame, column: str | None = None, ascending: bool = True) -> DataFrame:
    c = pick(df, column, "numeric")
    out = f"{c}_rank"
    ranked = with_rank(df, c, "min", out, ascending)
    return ranked.withColumn(out, F.col(f"`{out}`").cast("bigint")).orderBy(F.col(f"`{out}`").asc_nulls_last())


@operator("transform.cumulative")
def cumulative(df: DataFrame, column: str | None = None, agg: str = "sum", order_by: Sequence[str] = (),
               partition_by=None) -> DataFrame:
    """A running value is null where the column is null."""
    c = pick(df, column, "numeric")
    ix = index_rows(df, order_by, partition_by)
    if agg == "count":
        return ix.key_position().df.withColumn(f"{c}_cumcount", F.col("_pos") + 1).drop("_idx", "_pos")
    kinds = {"sum": "sums", "max": "maxs", "min": "mins"}
    if agg not in kinds:
        raise ValueError(f"unknown aggregate {agg!r}; use sum, max, min or count")
    out = f"{c}_cum{agg}"
    done = ix.running(**{kinds[agg]: {out: num(c)}}).result()
    return done.withColumn(out, F.when(num(c).isNotNull(), col(out)))


def middle(values: Column) -> Column:
    """Median of an array that is no longer than a rolling window."""
    a, n = F.array_sort(values), F.size(values)
    low = F.get(a, F.floor((n - 1) / 2).cast("int"))
    return (low + F.get(a, F.floor(n / 2).cast("int"))) / 2


def rolling_exprs(name: str, w, window: int, stats: Sequence[str], prefix: str, digits: int | None = None) -> dict:
    """Rolling statistics over the last ``window`` rows, one value is enough."""
    x, frame = num(name), w.rowsBetween(-(window - 1), 0)
    fns = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp,
           "median": None, "count": F.count}
    out = {}
    for s in stats:
        if s not in fns:
            raise ValueError(f"unknown rolling statistic {s!r}")
        v = middle(F.collect_list(x).over(frame)) if s == "median" else fns[s](x).over(frame)
        if s == "std":
            v = F.when(F.count(x).over(frame) > 1, v)
        out[prefix.format(stat=s)] = F.round(v, digits) if digits is not None else v
    return out


@operator("transform.rolling")
def rolling(df: DataFrame, column: str | None = None, window: int = 3, agg: str = "mean", order_by: Sequence[str] = (),
            partition_by=None) -> DataFrame:
    c = pick(df, column, "numeric")
    return index_rows(df, order_by, partition_by).windowed(
        lambda w: rolling_exprs(c, w, window, [agg], f"{c}_rolling_{{stat}}_{window}", 4), before=window - 1).result()


@operator("transform.shift_column")
def shift_column(df: DataFrame, column: str, periods: int = 1, order_by: Sequence[str] = (), partition_by=None) -> DataFrame:
    c = resolve(df, column)
    shift = (lambda w: {f"{c}_shift_{periods}": F.lag(col(c), periods).over(w)}) if periods >= 0 else (
        lambda w: {f"{c}_shift_{periods}": F.lead(col(c), -periods).over(w)})
    return index_rows(df, order_by, partition_by).windowed(shift, max(periods, 0), max(-periods, 0)).result()


@operator("transform.pct_change")
def pct_change(df: DataFrame, column: str | None = None, periods: int = 1, order_by: Sequence[str] = (),
               partition_by=None) -> DataFrame:
    cols = [resolve(df, column)] if column else pick_many(df, None)
    ix = index_rows(df, order_by, partition_by).running(lasts={f"_f{i}": num(c) for i, c in enumerate(cols)})
    ix = ix.windowed(lambda w: {f"_l{i}": F.lag(f"_f{i}", periods).over(w) for i in range(len(cols))}, before=periods)
    out = ix.result().withColumns({
        f"{c}_pct_change": F.round(F.col(f"_f{i}") / F.when(F.col(f"_l{i}") != 0, F.col(f"_l{i}")) - 1, 4)
        for i, c in enumerate(cols)})
    return out.drop(*[f"_{k}{i}" for i in range(len(cols)) for k in "fl"])


@operator("transform.fill_forward")
def fill_forward(df: DataFrame, column: str | None = None, order_by: Sequence[str] = (), partition_by=None) -> DataFrame:
    return filled_along(df, pick_many(df, column, "any"), order_by, partition_by)


@operator("transform.interpolate_values")
def interpolate_values(df: DataFrame, column: str | None = None, method: str = "linear", order_by: Sequence[str] = (),
                       partition_by=None) -> DataFrame:
    if method != "linear":
        raise ValueError("only linear interpolation is available")
    return interpolated(df, pick_many(df, column), order_by, partition_by)


# Names of the resampling steps.
STEPS = {"d": "D", "daily": "D", "w": "W", "weekly": "W", "m": "M", "me": "M", "monthly": "M", "q": "Q", "qe": "Q",
         "quarterly": "Q", "y": "Y", "ye": "Y", "yearly": "Y"}


def period_end(c: Column, step: str) -> Column:
    """Last day of the period of a date; weeks end on Sunday."""
    if step == "D":
        return F.to_date(c)
    if step == "W":
        return F.date_add(F.to_date(F.date_trunc("week", c)), 6)
    unit, months = {"M": ("month", 0), "Q": ("quarter", 2), "Y": ("year", 11)}[step]
    return F.last_day(F.add_months(F.to_date(F.date_trunc(unit, c)), months))


@operator("transform.resample")
def resample(df: DataFrame, column: str | None = None, freq: str = "M", agg: str = "mean") -> DataFrame:
    """One row per period, empty periods included, labelled by the end of the period."""
    if freq.lower() not in STEPS:
        raise ValueError(f"unknown step {freq!r}")
    step = STEPS[freq.lower()]
    c = pick(df, column, "time")
    stamp = col(c) if is_time(df, c) else parse(col(c))
    nums = [x for x in numeric_cols(df) if x != c]
    if not nums:
        raise ValueError("no numeric columns to aggregate")
    fn = aggregate(agg) if agg != "median" else F.median
    part = df.withColumn("_end", period_end(stamp, step)).where(F.col("_end").isNotNull())
    if agg == "median":
        out = wide_quantile(part, nums, 0.5, ["_end"])
    else:
        out = part.groupBy("_end").agg(*[fn(col(x)).alias(x) for x in nums])
    span = part.agg(F.min("_end").alias("a"), F.max("_end").alias("b"))
    first = {"D": F.col("a"), "W": F.col("a"), "M": F.trunc("a", "month"), "Q": F.trunc("a", "quarter"), "Y": F.trunc("a", "year")}[step]
    every = {"D": "interval 1 day", "W": "interval 7 day", "M": "interval 1 month", "Q": "interval 3 month", "Y": "interval 1 year"}[step]
    days = span.select(F.explode(F.sequence(first, F.col("b"), F.expr(every))).alias("_d")).select(
        (F.col("_d") if step == "W" else period_end(F.col("_d"), step)).alias("_end"))
    filled = days.join(out, "_end", "left")
    zero = {x: F.coalesce(col(x), F.lit(0)) for x in nums} if agg in ("sum", "count", "nunique") else {}
    return filled.withColumns(zero).select(F.col("_end").cast("timestamp").alias(c), *[col(x) for x in nums]).orderBy(col(c))


@operator("transform.date_diff")
def date_diff(df: DataFrame, column: str | None = None, column2: str | None = None, unit: str = "days",
              new_name: str | None = None) -> DataFrame:
    a = pick(df, column, "time")
    b = resolve(df, column2) if column2 else next((c for c in time_cols(df) if c != a), None)
    if b is None:
        raise ValueError("a second date column is needed")
    ta, tb = (col(c).cast("timestamp") if is_time(df, c) else parse(col(c)) for c in (a, b))
    days = F.floor((F.unix_micros(tb) - F.unix_micros(ta)) / F.lit(86_400_000_000))
    if unit == "days":
        out = days
    elif unit in ("months", "years"):
        out = F.bround(days / F.lit(30.44 if unit == "months" else 365.25), 2)
    else:
        raise ValueError(f"unknown unit {unit!r}; use days, months or years")
    return df.withColumn(new_name or f"_diff_{unit}", out)


@operator("transform.datetime_parse")
def datetime_parse(df: DataFrame, column: str, format: str | None = None) -> DataFrame:
    c = resolve(df, column)
    return df.withColumn(c, parse(col(c).cast("string"), format))


@operator("transform.datetime_format")
def datetime_format(df: DataFrame, column: str, format: str = "%Y-%m-%d", new_name: str | None = None) -> DataFrame:
    c = resolve(df, column)
    stamp = col(c) if is_time(df, c) else parse(col(c))
    return df.withColumn(new_name or f"{c}_formatted", F.coalesce(F.date_format(stamp, java_pattern(format)), F.lit("")))


def date_parts(c: Column, name: str) -> dict[str, Column]:
    return {f"{name}_year": F.year(c), f"{name}_month": F.month(c), f"{name}_day": F.dayofmonth(c),
            f"{name}_weekday": F.weekday(c), f"{name}_quarter": F.quarter(c),
            f"{name}_is_weekend": (F.weekday(c) >= 5).cast("int")}


@operator("transform.datetime_decompose")
def datetime_decompose(df: DataFrame, column: str | None = None) -> DataFrame:
    cols = [resolve(df, column)] if column else pick_many(df, None, "time")
    df = df.withColumns({c: parse(col(c)) for c in cols if not is_time(df, c)})
    hours = fit(df, **{f"h{i}": F.max(F.hour(col(c))) for i, c in enumerate(cols)})
    new: dict[str, Column] = {}
    for i, c in enumerate(cols):
        new |= date_parts(col(c), c)
        if hours[f"h{i}"]:
            new[f"{c}_hour"] = F.hour(col(c))
    return df.withColumns(new)


@operator("transform.scale_minmax")
def scale_minmax(df: DataFrame) -> DataFrame:
    return shift_scale(df, fit_scaler(df, pick_many(df, None), "minmax"))


@operator("transform.scale_standard")
def scale_standard(df: DataFrame) -> DataFrame:
    return shift_scale(df, fit_scaler(df, pick_many(df, None), "standard"))


@operator("transform.scale_robust")
def scale_robust(df: DataFrame) -> DataFrame:
    return shift_scale(df, fit_scaler(df, pick_many(df, None), "robust"))


@operator("transform.normalize_pct")
def normalize_pct(df: DataFrame, axis: str = "columns") -> DataFrame:
    nums = pick_many(df, None)
    if axis == "columns":
        total = reduce(lambda a, b: a + b, [F.coalesce(num(c), F.lit(0.0)) for c in nums])
        total = F.when(total == 0, 1.0).otherwise(total)
        return df.withColumns({c: F.round(num(c) / total * 100, 2) for c in nums})
    s = fit(df, **{f"s{i}": F.sum(num(c)) for i, c in enumerate(nums)})
    return df.withColumns({c: F.round(num(c) / F.lit(s[f"s{i}"]) * 100, 2) for i, c in enumerate(nums) if s[f"s{i}"]})


def level_codes(df: DataFrame, name: str) -> DataFrame:
    """(value, code): codes 0.. in the order of the values, for any number of levels."""
    levels = df.where(col(name).isNotNull()).select(col(name).cast("string").alias("value")).distinct()
    ix = index_rows(levels, ["value"])
    return ix.df.select("value", F.col("_idx").cast("int").alias("_code"))


@operator("transform.encode_label")
def encode_label(df: DataFrame, column: str | None = None) -> DataFrame:
    cols = pick_many(df, column, "text")
    out = df
    for c in cols:
        out = attach(out, level_codes(df, c), c).withColumn(c, F.col("_code")).drop("_code")
    return out


@operator("transform.encode_ordinal")
def encode_ordinal(df: DataFrame, column: str, order: Sequence[str] | None = None) -> DataFrame:
    c = resolve(df, column)
    if order:
        table = F.create_map(*[x for i, v in enumerate(order) for x in (F.lit(str(v)), F.lit(i))])
        return df.withColumn(f"{c}_ordinal", table[col(c).cast("string")])
    return attach(df, level_codes(df, c), c).withColumnRenamed("_code", f"{c}_ordinal")


@operator("transform.encode_onehot")
def encode_onehot(df: DataFrame, column: str | None = None, max_levels: int = 1000) -> DataFrame:
    cols = pick_many(df, column, "text")
    new = {f"{c}_{v}": F.coalesce((col(c) == F.lit(v)).cast("int"), F.lit(0)) for c in cols for v in levels_of(df, c, max_levels)[1:]}
    return df.withColumns(new).drop(*cols)


@operator("transform.encode_binary")
def encode_binary(df: DataFrame, column: str, threshold: float | None = None, value=None) -> DataFrame:
    """By threshold, by value, or the smaller of exactly two values becomes 1."""
    c = resolve(df, column)
    if threshold is not None:
        test = num(c) >= float(threshold)
    elif value is not None:
        test = col(c) == F.lit(value)
    else:
        levels = levels_of(df, c, 2)
        if len(levels) != 2:
            raise ValueError(f"column {c!r} does not have two values")
        test = col(c) == F.lit(levels[0])
    return df.withColumn(f"{c}_binary", F.coalesce(test.cast("int"), F.lit(0)))


def frequency_encoded(df: DataFrame, name: str, out: str, share: bool) -> DataFrame:
    table = level_stats(df, name, _f=F.count(F.lit(1)))
    if share:
        total = table.agg(F.sum("_f").alias("_t"))
        table = table.crossJoin(F.broadcast(total)).select("value", (F.col("_f") / F.col("_t")).alias("_f"))
    return attach(df, table, name).withColumn(out, F.coalesce("_f", F.lit(0))).drop("_f")


@operator("transform.frequency_encode_transform")
def frequency_encode_transform(df: DataFrame, column: str | None = None, normalize: bool = False) -> DataFrame:
    out = df
    for c in pick_many(df, column, "text"):
        out = frequency_encoded(out, c, f"{c}_freq_pct" if normalize else f"{c}_freq", normalize)
    return out


@operator("transform.target_encode_transform")
def target_encode_transform(df: DataFrame, column: str | None = None, target: str | None = None,
                            smoothing: float = 10) -> DataFrame:
    if target is None:
        raise ValueError("target is required")
    y = resolve(df, target)
    overall = fit(df, m=F.avg(num(y)))["m"]
    out = df
    for c in (c for c in pick_many(df, column, "text") if c != y):
        table = level_stats(df, c, _m=F.avg(num(y)), _k=F.count(num(y)))
        smooth = (F.col("_k") * F.coalesce("_m", F.lit(0.0)) + F.lit(smoothing * overall)) / (F.col("_k") + F.lit(float(smoothing)))
        out = attach(out, table.select("value", smooth.alias("_e")), c).withColumn(
            f"{c}_target_enc", F.coalesce("_e", F.lit(overall))).drop("_e")
    return out


@operator("transform.leave_one_out_encode")
def leave_one_out_encode(df: DataFrame, column: str | None = None, target: str | None = None) -> DataFrame:
    if target is None:
        raise ValueError("target is required")
    y = resolve(df, target)
    overall = fit(df, m=F.avg(num(y)))["m"]
    out = df
    for c in (c for c in pick_many(df, column, "text") if c != y):
        table = level_stats(df, c, _s=F.sum(num(y)), _k=F.count(num(y)))
        loo = (F.col("_s") - num(y)) / F.when(F.col("_k") > 1, F.col("_k") - 1)
        out = attach(out, table, c).withColumn(f"{c}_loo_enc", F.coalesce(loo, F.lit(overall))).drop("_s", "_k")
    return out


@operator("transform.inject_null")
def inject_null(df: DataFrame, value: float = 15, seed: int = 42, key: Sequence[str] | None = None) -> DataFrame:
    """Each cell is dropped with the given share, decided by a seeded hash of row and column name."""
    share = value / 100 if value > 1 else value
    rows = [col(c) for c in (key or df.columns)]
    return df.select(*[
        F.when(F.pmod(F.xxhash64(F.lit(seed), F.lit(c), *rows), F.lit(1_000_000)) >= F.lit(share * 1_000_000), col(c)).alias(c)
        for c in df.columns])
