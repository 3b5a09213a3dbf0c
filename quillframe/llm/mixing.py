"""Mixing sources to target weights by Sainte-Lague apportionment.

The corpus is seen as equal blocks of ``block_words`` words. Highest quotients give
every source, and inside a source every shard, an integer number of blocks. A shard's
documents stand in a seeded order on a ring; its blocks are the next words from a
seeded place on that ring, going round again where more than the shard's words are
due. So a document's share is found by arithmetic; no block is written out.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm.common import small

WORD = r"[^\x20\x09-\x0D]++"
REPEATS = 3  # how often a document's words are taken at most
BLOCK_WORDS = 32
SHARD_WORDS = 131_072


def word_count(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """Targets from rows ``source, source_size``: one row per source, all of them in one sort.

    Weights 1, 2, 3 repeat over the sources in code point order, null last. A target
    stops at ``repeats`` times the source; the excess goes to the others by weight. That
    is the level ``x`` with sum(min(weight * x, cap)) = all words, read off the sources
    ordered by cap / weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1).withColumn("cap", repeats * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(all_rows) - before) / rest
    s = s.withColumn("_level", level).withColumn("_place", F.row_number().over(fill))
    open_at = F.when(F.col("cap") >= F.col("_level") * F.col("weight"), F.col("_place"))
    s = s.withColumn("_first", F.min(open_at).over(all_rows))
    chosen = F.max(F.when(F.col("_place") == F.col("_first"), F.col("_level"))).over(all_rows)
    s = s.withColumn("_x", chosen)
    target = F.when(F.col("_x").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("_x") * F.col("weight")))
    return s.select("source", "source_size", "weight", target.alias("target"))


def sainte_lague(parties: DataFrame, votes: str, seats: str, most: str, over: list[str], tie: list[str]) -> DataFrame:
    """Add ``quota``: the group's ``seats`` go one by one to the highest quotient votes / (2 * got + 1), ``most`` at most each.

    ``over`` names the groups, ``tie`` orders equal quotients. Rounding by a divisor
    that is surely too large gives seats that all parties win, and one surely too small
    gives those they may win; only the few quotients between are ranked.
    """
    group = Window.partitionBy(*over) if over else Window.partitionBy(F.lit(0))
    total, n = F.sum(votes).over(group), F.count("*").over(group)
    p = parties.withColumn("_votes", total).withColumn("_parties", n)

    def rounded(seats_at: Column) -> Column:
        return F.when(F.col("_votes") > 0, F.floor(F.col(votes) * seats_at / F.col("_votes") + 0.5)).otherwise(F.lit(0)).cast("long")

    sure = rounded(F.greatest(F.col(seats) - F.col("_parties"), F.lit(0)))
    p = p.withColumn("_may", F.when(F.col(votes) > 0, F.least(F.col(most), rounded(F.col(seats) + F.col("_parties")) + 1)).otherwise(F.lit(0).cast("long")))
    p = p.withColumn("_sure", F.least(F.when(F.col(seats) > F.col("_parties"), sure).otherwise(F.lit(0)), F.col("_may")))
    p = p.withColumn("_left", F.col(seats) - F.sum("_sure").over(group))
    got = F.explode_outer(F.when(F.col("_may") > F.col("_sure"), F.sequence(F.col("_sure"), F.col("_may") - 1)))
    bids = p.select("*", got.alias("_got"))
    by = (Window.partitionBy(*over) if over else Window.partitionBy(F.lit(0))).orderBy(
        F.when(F.col("_got").isNotNull(), F.col(votes) / (2 * F.col("_got") + 1)).desc_nulls_last(), *tie, "_got")
    won = bids.withColumn("_won", (F.col("_got").isNotNull() & (F.row_number().over(by) <= F.col("_left"))).cast("long"))
    keys = list(parties.columns)
    return won.groupBy(*keys, "_sure").agg(F.sum("_won").alias("_extra")).select(*keys, (F.col("_sure") + F.col("_extra")).alias("quota"))


def mix(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", block_words: int = BLOCK_WORDS,
        shard_words: int = SHARD_WORDS, repeats: int = REPEATS, seed: int = 11, carry: list[str] | None = None) -> DataFrame:
    """Every document with ``row`` (its columns ``carry``, all by default), ``size``, ``source_size``, ``target``, ``taken`` and ``from_word``.

    ``taken`` counts the words the mix takes, repeats counted, starting at word
    ``from_word`` of the document and going round. A null text has no words and takes
    none; a null source is a source, the last; repeated rows are separate documents.
    An empty table gives no rows. Shards hold about ``shard_words`` words, so a hot
    source is many groups. So that small sources come near their targets, a block is no
    longer than a quarter of the smallest target.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in (carry or docs.columns)]).alias("row")
    d = docs.select(row, F.col(f"`{key}`").alias("_id"), F.col(f"`{source}`").alias("_source"), word_count(text).alias("size"))
    sizes = d.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size"))
    targets = small(source_targets(sizes, repeats))  # one row per source
    least = targets.where("target > 0").agg(F.min("target")).first()[0]
    block_words = max(min(block_words, int((least or 0) / 4)), 1)
    seats = targets.withColumn("_k", F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block_words).cast("long"))
    seats = seats.withColumn("_most", F.floor(repeats * F.col("source_size") / block_words).cast("long"))
    seats = sainte_lague(seats.withColumnRenamed("_most", "most"), "target", "_k", "most", [], ["source"]).drop("most", "_k")
    shards = F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1))
    source_row = seats.select(F.col("source").alias("_s"), "source_size", "target", F.col("quota").alias("_source_quota"), shards.cast("long").alias("_shards"))
    source_row = small(source_row)  # one row per source
    placed = (d.join(source_row, F.col("_source").eqNullSafe(F.col("_s")), "left")
              .withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed), F.col("_id"), F.col("size")), F.col("_shards"))))
    cells = (placed.groupBy("_s", "_shard", "_source_quota").agg(F.sum("size").alias("_n"))
             .withColumn("_most", F.floor(repeats * F.col("_n") / block_words).cast("long")))
    quotas = sainte_lague(cells.withColumnRenamed("_most", "_cap"), "_n", "_source_quota", "_cap", ["_s"], ["_shard"])
    quotas = quotas.select(F.col("_s").alias("_cs"), F.col("_shard").alias("_cshard"), "_n", (F.col("quota") * block_words).alias("_due"))
    quotas = small(quotas)  # one row per shard_words words
    ring = Window.partitionBy("_s", "_shard").orderBy(F.xxhash64(F.lit(seed + 1), F.col("_id"), F.col("size")), "_id", "size")
    laid = placed.withColumn("_at", F.sum("size").over(ring.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    laid = laid.join(quotas, F.col("_s").eqNullSafe(F.col("_cs")) & (F.col("_shard") == F.col("_cshard")), "left")
    start = F.pmod(F.xxhash64(F.lit(seed + 2), F.col("_s"), F.col("_shard")), F.greatest("_n", F.lit(1)))
    laid = laid.withColumn("_start", start)

    def taken_until(x: Column) -> Column:
        inside = F.least(F.greatest(F.pmod(x, F.col("_n")) - F.col("_at"), F.lit(0)), F.col("size"))
        return F.floor(x / F.col("_n")).cast("long") * F.col("size") + inside

    empty = (F.col("size") == 0) | (F.col("_n") == 0)
    taken = F.when(empty, F.lit(0)).otherwise(taken_until(F.col("_start") + F.col("_due")) - taken_until(F.col("_start"))).cast("long")
    begin = F.when(F.col("_start").between(F.col("_at"), F.col("_at") + F.col("size") - 1), F.col("_start") - F.col("_at")).otherwise(F.lit(0))
    return laid.select("row", "size", "source_size", "target", taken.alias("taken"), begin.cast("long").alias("from_word"))


def some_words(text: str, begin: int, n: int) -> str:
    """``n`` words from word ``begin`` on, as they stand in the text; past its end on a new line from its start."""
    spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    head = text[spans[begin][0]:spans[min(begin + n, len(spans)) - 1][1]]
    over = begin + n - len(spans)
    return head if over <= 0 else f"{head}\n{text[spans[0][0]:spans[over - 1][1]]}"


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: one row per whole copy, one for the words of a part.

    A document that is taken once and a half gives its text and then a row with the
    words of the half (from its first due word, going round); ``n_chars``, if there, is
    that of the row's text. Documents of which nothing is taken give no row.
    """
    names, kinds = docs.columns, dict(docs.dtypes)
    copies = F.floor(F.col("taken") / F.col("size")).cast("int")
    part = F.col("taken") % F.col("size")

    @F.arrow_udf("string")
    def words_of(texts: pa.Array, begin: pa.Array, n: pa.Array) -> pa.Array:
        rows = zip(texts, begin.to_pylist(), n.to_pylist(), strict=True)
        return pa.array([some_words(t.as_py(), b, k) if k else None for t, b, k in rows], pa.string())

    mixed = mix(docs, **how).where("taken > 0").select("row", copies.alias("_copies"), words_of(F.col("row.text"), "from_word", part).alias("_part"))
    texts = F.array_compact(F.concat(F.array_repeat(F.col("row.text"), F.col("_copies")), F.array("_part")))
    out = mixed.select("row", F.explode(texts).alias("_new"))
    new = F.col("_new")
    return out.select(*[new.alias(c) if c == "text" else F.char_length(new).cast(kinds[c]).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in names])
