"""Column selection by type and by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names that mark an identifier column.
ID_NAMES = ("id", "index", "key", "row", "num", "number", "seq", "serial")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def num(name: str) -> Column:
    return col(name).cast("double")


def numeric_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def time_cols(df: DataFrame) -> list[str]:
    kinds = (T.TimestampType, T.TimestampNTZType, T.DateType)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def dtype(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def is_time(df: DataFrame, name: str) -> bool:
    return name in time_cols(df)


def is_id_name(name: str) -> bool:
    low = name.lower().strip("_")
    return low in ID_NAMES or (low.endswith("id") and len(low) <= 5)


def resolve(df: DataFrame, name: str) -> str:
    """Exact name, then case-insensitive; anything else is an error."""
    if name in df.columns:
        return name
    hits = [c for c in df.columns if c.lower() == name.lower()]
    if len(hits) == 1:
        return hits[0]
    raise ValueError(f"column {name!r} not found; available: {df.columns}")


def resolve_all(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [resolve(df, n) for n in names]


def pick(df: DataFrame, name: str | None, kind: str = "any", at: int = 0) -> str:
    """The given column, or the ``at``-th column of a kind (numeric, text, time, any)."""
    if name is not None:
        return resolve(df, name)
    pool = {
        "numeric": numeric_cols,
        "text": text_cols,
        "time": time_cols,
        "any": lambda d: d.columns,
        "category": lambda d: text_cols(d) or d.columns,
    }[kind](df)
    if len(pool) <= at:
        raise ValueError(f"no {kind} column to use; available: {df.columns}")
    return pool[at]


def pick_many(df: DataFrame, name, kind: str = "numeric") -> list[str]:
    """One given column, a given list, or every column of a kind."""
    if name is None:
        out = {"numeric": numeric_cols, "text": text_cols, "time": time_cols,
               "any": lambda d: list(d.columns)}[kind](df)
        if not out:
            raise ValueError(f"no {kind} columns; available: {df.columns}")
        return out
    return [resolve(df, name)] if isinstance(name, str) else resolve_all(df, name)


def pick_pair(df: DataFrame, columns, kind: str) -> tuple[str, str]:
    columns = list(columns or [])
    a = pick(df, columns[0] if columns else None, kind, 0)
    if len(columns) > 1:
        return a, resolve(df, columns[1])
    pool = [c for c in (text_cols(df) if kind == "text" else numeric_cols(df)) if c != a]
    if not pool:
        raise ValueError(f"a second {kind} column is needed")
    return a, pool[0]
