"""Helpers shared by the operators of this package.

Texts travel to Python tasks as UTF-8 bytes in Arrow batches (64 MB at most, by
``spark.sql.execution.arrow.maxBytesPerBatch``); a null text counts as empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions.graph import components  # noqa: F401
from quillframe.functions.ordered import checkpoint_folder, reliable_checkpoint

ROWS = 512  # rows that a task turns into Python objects at once


def text_bytes(name: str = "text"):
    """The text as UTF-8 bytes, empty for null."""
    return F.coalesce(F.col(f"`{name}`"), F.lit("")).cast("binary")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder that all executors share."""
    return f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, so that no later step computes them again."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    return reliable_checkpoint(df)


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def arrow_rows(df: DataFrame, rows: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """``mapInArrow`` with a generator: it gets an iterator of row tuples of ``df`` and yields row tuples of ``schema``."""
    target = df.sparkSession.createDataFrame([], schema).schema
    arrow = _arrow(target)

    def run(batches):
        def given():
            for batch in slices(batches):
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        held, size = [], 0
        for row in rows(given()):
            held.append(row)
            size += 64 + sum(len(v) for v in row if isinstance(v, (str, bytes, list)))
            if len(held) >= 4096 or size > 8_000_000:
                yield _batch(held, arrow)
                held, size = [], 0
        if held:
            yield _batch(held, arrow)

    return df.mapInArrow(run, target)


def text_udf(fn: Callable[[bytes], tuple], schema: str):
    """Arrow UDF from UTF-8 bytes to a struct of ``schema``: ``fn`` gets one text and returns the fields in order."""

    kind = _arrow_type(schema)

    @F.arrow_udf(schema)
    def run(texts: pa.Array) -> pa.Array:
        parts = []
        for start in range(0, max(len(texts), 1), ROWS):
            rows = [fn(t) for t in texts.slice(start, ROWS).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [[] for _ in kind]
            parts.append(pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind)))
        return pa.concat_arrays(parts)

    return run


def _arrow_type(schema: str) -> pa.StructType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    return to_arrow_type(StructType.fromDDL(schema))


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def small(df: DataFrame, rows: int = 200_000, size: Column | None = None, most: int = 8 << 20) -> DataFrame:
    """A checkpointed narrow table, broadcast if it was counted to hold at most ``rows`` rows and, where a row's bytes
    are given by ``size``, at most ``most`` bytes; else Spark chooses the join."""
    kept = checkpointed(df)
    n, held = kept.agg(F.count("*"), F.coalesce(F.sum(size if size is not None else F.lit(0)), F.lit(0))).first()
    return F.broadcast(kept) if n <= rows and held <= most else kept


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
