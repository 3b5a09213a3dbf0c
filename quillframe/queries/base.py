"""Test tables and SQL snippets shared by the query modules.

The given tables hold no nulls, so ``Tables.li`` and ``LI`` derive some with the
same expression on both sides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.registry import apply
from quillframe.sources.io import read_parquet

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TXT = ["l_returnflag", "l_linestatus"]
SELECT_LI = """SELECT l_orderkey, l_linenumber,
 CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity, l_extendedprice, l_discount, l_tax,
 CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag, l_linestatus, l_shipdate FROM lineitem"""
LI = f"WITH li AS ({SELECT_LI}) "


class Tables:
    """The given tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return read_parquet(self.spark, f"{self.folder}/{name}.parquet")

    @property
    def li(self) -> DataFrame:
        t = self.lineitem
        return t.select(
            "l_orderkey", "l_linenumber",
            F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("l_quantity"), "l_extendedprice",
            "l_discount", "l_tax", F.when(F.col("l_orderkey") % 11 != 0, F.col("l_returnflag")).alias("l_returnflag"),
            "l_linestatus", "l_shipdate")

    @property
    def facts(self) -> DataFrame:
        """Measures and flags of the line items, with nulls."""
        return self.li.select(*NUM, *TXT)

    @property
    def measures(self) -> DataFrame:
        return self.li.select(*NUM)

    @property
    def series(self) -> DataFrame:
        return self.events.select("event_id", "ts", "user_id", "event_type", "value")


Query = tuple[Callable[[SparkSession, str], DataFrame], str | None]


def query(build: Callable[[Tables], DataFrame], sql: str | None = None) -> Query:
    return (lambda spark, folder: build(Tables(spark, folder)), sql)


def op(op_id: str, table: Callable[[Tables], DataFrame], sql: str | None = None,
       then: Callable[[DataFrame], DataFrame] | None = None, **params) -> Query:
    """One operator on one table."""

    def build(t: Tables) -> DataFrame:
        out = apply(table(t), op_id, **params)
        return then(out) if then else out

    return query(build, sql)


def each(cols: Iterable[str], template: str, prefix: str = "", suffix: str = "") -> str:
    """UNION ALL of a template over columns; ``{c}`` is the column."""
    return prefix + " UNION ALL ".join(template.replace("{c}", c) for c in cols) + suffix


def pairs(cols: list[str], template: str, prefix: str = "", suffix: str = "") -> str:
    parts = [template.replace("{a}", a).replace("{b}", b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    return prefix + " UNION ALL ".join(parts) + suffix
