"""Merkle manifest of a table: a digest per row, a subroot per group, one root, and a proof for every row.

Slot pivot: the children of a parent are spread into ``fanout`` columns by conditional
aggregates over the parent's rows. The columns in order, concatenated and hashed, are the
parent's digest; without the own slot's column they are the siblings that a proof needs.

A tree is climbed in blocks of ``fanout ** levels`` consecutive leaves. One shuffle brings
a block together and one sort lays it by its ancestors, highest first, so the windows of
all its levels need no further exchange or sort. The tops of the blocks are the leaves of
the next phase; a trillion rows take five phases. No group is held by one task, however
many rows it has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions.ordered import index_rows
from quillframe.llm.common import saved, small

FANOUT = 2
LEVELS = 8  # levels of a block: 256 leaves at fanout 2
_PROOF = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value (numbers in decimal)."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return digest(*[field(v) for v in values])


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, start, lambda h, s: digest(s["left"], h, s["right"]))


def siblings(proof: Column) -> Column:
    """All siblings of a proof, from the leaf up and left to right, concatenated."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def _climb(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``nodes`` (``tree, pos, n, h`` and more) with ``block``, the digest ``top`` of the block's highest node, and the ``steps`` up to it.

    A level with one node is the tree's root and has no parent; a run of fewer than
    ``fanout`` nodes, even of one, has.
    """
    own = [F.expr(f"(pos div {fanout ** i}) % {fanout}") for i in range(levels)]
    above = [F.expr(f"pos div {fanout ** i}").alias(f"_p{i}") for i in range(1, levels)]
    df = nodes.select("*", F.expr(f"pos div {fanout ** levels}").alias("block"), *above, F.col("h").alias("top"))
    for level in range(levels):
        parent = Window.partitionBy("tree", "block", *[f"_p{i}" for i in range(levels - 1, level, -1)])
        kids = [f"_s{i}" for i in range(fanout)]
        wide = df.select("*", *[F.max(F.when(own[level] == i, F.col("top"))).over(parent).alias(kid) for i, kid in enumerate(kids)])
        left, right = (F.concat_ws("", *[F.when(side(i), F.col(kid)) for i, kid in enumerate(kids)]) for side in (own[level].__gt__, own[level].__lt__))
        more = F.col("n") > fanout ** level
        up = F.when(more, digest(F.concat_ws("", *kids))).otherwise(F.col("top")).alias("top")
        step = F.when(more, F.struct(left.alias("left"), right.alias("right"))).alias(f"_l{level}")
        df = wide.select(*[c for c in df.columns if c != "top"], up, step)
    steps = [f"_l{i}" for i in range(levels)]
    return df.select(*nodes.columns, "block", "top", F.array_compact(F.array(*steps)).cast(_PROOF).alias("steps"))


def _height(leaves: int, fanout: int) -> int:
    """Levels above the leaves of a tree."""
    height = 0
    while leaves > 1:
        leaves, height = -(-leaves // fanout), height + 1
    return height


def prove(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """``nodes`` with ``root`` and ``proof``, and a row ``tree, root`` of every tree.

    ``nodes`` has ``tree`` (not null), the position ``pos`` of a leaf in its tree (0, 1, ...),
    the tree's number ``n`` of leaves and the digest ``h``, in a table that can be read again.
    A tree of one leaf has that leaf as its root and an empty proof. No rows: no rows.
    """
    phases, steps, most = [nodes], [], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        steps.append(min(levels, _height(most, fanout)))
        tops = _climb(phases[-1].select("tree", "pos", "n", "h"), fanout, steps[-1])
        left = F.ceil(F.col("n") / F.lit(fanout ** steps[-1])).cast("long")
        phases.append(saved(tops.groupBy("tree", F.col("block").alias("pos")).agg(F.max(left).alias("n"), F.max("top").alias("h"))))
        most = -(-most // fanout ** steps[-1])
    roots = phases[-1].select("tree", F.col("h").alias("root"))
    upper = phases[-1].withColumns({"root": F.col("h"), "proof": F.array().cast(_PROOF)})
    for phase, height in zip(reversed(phases[:-1]), reversed(steps), strict=True):
        over = upper.select("tree", F.col("pos").alias("block"), "root", F.col("proof").alias("_more"))
        upper = _climb(phase, fanout, height).join(over, ["tree", "block"]).select(*phase.columns, "root", F.concat("steps", "_more").alias("proof"))
    return upper, roots


def _tree(group: Column) -> Column:
    """A key that is never null and sorts nulls first, the others bytewise."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def manifest(docs: DataFrame, fields: Sequence[str], key: str = "doc_id", group: str = "lang", altered: Sequence[Column] | None = None,
             fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Rows ``key, leaf, altered, subroot, root, proof``, one for every row of ``docs``.

    ``leaf`` hashes ``fields`` (each with its length, so that values cannot run together), ``altered`` the
    columns given for it (by default the fields themselves). Leaves of a group ascend by ``key``, null last; rows
    of one key by leaf, and rows alike in all are leaves of their own. Groups are ordered
    null first, then by their UTF-8 bytes. Long texts are hashed where they are read and
    not shuffled. Other columns are ignored, whatever their names. No rows: no rows.
    """
    given = [F.col(f"`{f}`") for f in fields]
    rows = saved(docs.select(F.col(f"`{key}`").alias("key"), _tree(F.col(f"`{group}`")).alias("tree"), leaf(given).alias("h"),
                             leaf(altered if altered is not None else given).alias("altered")))
    laid = index_rows(rows, ["key", "h"], ["tree"]).df
    spans = laid.groupBy("tree").agg(F.min("_idx").alias("_first"), F.count("*").alias("n"))
    nodes = saved(laid.join(small(spans), "tree").withColumn("pos", F.col("_idx") - F.col("_first")).drop("_idx", "_first"))
    leaves, subroots = prove(nodes, fanout, levels)
    groups = index_rows(subroots, ["tree"])
    over = saved(groups.df.select(F.lit("").alias("tree"), F.col("_idx").alias("pos"), F.lit(groups.rows).cast("long").alias("n"),
                                  F.col("root").alias("h"), F.col("tree").alias("_group")))
    above = prove(over, fanout, levels)[0].select("_group", F.col("root").alias("_root"), F.col("proof").alias("_above"))
    return leaves.join(small(above), F.col("tree") == F.col("_group")).select(
        "key", F.col("h").alias("leaf"), "altered", F.col("root").alias("subroot"), F.col("_root").alias("root"),
        F.concat("proof", "_above").alias("proof"))
