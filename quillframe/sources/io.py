"""Sources and sinks.

Operators treat null as missing. NaN becomes null on the way in for text and Arrow
sources. Parquet is read as it is, so that filters on numbers reach the scan; pass
``nans=True`` for files that hold NaN.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.columns import col


def nan_to_null(df: DataFrame) -> DataFrame:
    kinds = (T.DoubleType, T.FloatType)
    fix = {f.name: F.when(~F.isnan(col(f.name)), col(f.name)) for f in df.schema if isinstance(f.dataType, kinds)}
    return df.withColumns(fix) if fix else df


def read_parquet(spark: SparkSession, path: str | Sequence[str], nans: bool = False) -> DataFrame:
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.parquet(*paths)
    return nan_to_null(df) if nans else df


def read_csv(spark: SparkSession, path: str, schema=None, header: bool = True, **options) -> DataFrame:
    reader = spark.read.options(header=header, **options)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return nan_to_null(reader.csv(path))


def read_json(spark: SparkSession, path: str, schema=None, **options) -> DataFrame:
    reader = spark.read.options(**options)
    return nan_to_null((reader.schema(schema) if schema is not None else reader).json(path))


def read_arrow(spark: SparkSession, path: str, schema) -> DataFrame:
    """Feather / Arrow IPC files: one file per task, decoded to Arrow batches inside the task.

    ``schema`` is given, since reading it would need a driver-side open of a file.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    target = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    names = target.fieldNames()

    def decode(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(target)
        for batch in batches:
            for content in batch.column(0):
                with pa.ipc.open_file(pa.py_buffer(content.as_buffer())) as reader:
                    for i in range(reader.num_record_batches):
                        table = pa.Table.from_batches([reader.get_batch(i)]).select(names).cast(wanted)
                        yield from table.to_batches()

    return nan_to_null(files.mapInArrow(decode, target))


def from_rows(spark: SparkSession, rows: Sequence[Mapping], schema=None) -> DataFrame:
    """A table from row dictionaries held by the caller (small inputs only)."""
    return nan_to_null(spark.createDataFrame([dict(r) for r in rows], schema=schema))


def write(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_table(df: DataFrame, name: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).saveAsTable(name)
