"""Word tokens."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
TERM = r"[\p{L}\p{N}_]{2,}"
_ROWS = 256  # texts that are Python strings at once


def words(c: Column, pattern: str = WORD) -> Column:
    """Lower-case word tokens as an array."""
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))


def spaced(c: Column) -> Column:
    """Words between white space, without empty ones."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def without(tokens: Column, drop: Iterable[str]) -> Column:
    drop = sorted(drop)
    return F.filter(tokens, lambda w: ~w.isin(drop)) if drop else tokens


def rewritten(c: Column, where: Column, fn: Callable[[str], str]) -> Column:
    """``fn`` of the texts where the condition holds; the others are not sent to Python."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([None if t is None else fn(t) for t in texts.slice(at, _ROWS).to_pylist()], pa.string())
                                 for at in range(0, max(len(texts), 1), _ROWS)])

    return F.when(where, run(F.when(where, c))).otherwise(c)


def word_pairs(joined: Column) -> Column:
    """Struct ``n, same`` of words joined by spaces: how many there are, and how many ordered pairs of places hold the same word."""

    @F.arrow_udf("n long, same long")
    def run(texts: pa.Array) -> pa.Array:
        n, same = [], []
        for at in range(0, len(texts), _ROWS):
            for t in texts.slice(at, _ROWS).to_pylist():
                found = Counter(t.split(" ")) if t else Counter()
                n.append(found.total())
                same.append(sum(k * (k - 1) for k in found.values()))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(same, pa.int64())], ["n", "same"])

    return run(joined)
