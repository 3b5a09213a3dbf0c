"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits and mapped to the bit counts
of its segments. The Manhattan distance of two such count vectors never exceeds the
Hamming distance of the fingerprints, so pairs at Hamming distance 3 lie within
Manhattan distance 3. Counts are kept in unary (00, 01, 11), so Manhattan distance is
the number of differing bits and a range of segments is a bit mask.

Grid join: the 32 segments form six ranges. A Manhattan distance of at most 3 changes
at most three ranges, so the two vectors meet in one cell of the grid over some three of
them: 20 cells a fingerprint, complete for every distance up to 3. Inside a cell pairs
are tested by Manhattan distance first and then by Hamming distance. Only distinct
fingerprints take part, and a cell reports links that connect its members, not all
pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations, groupby
from operator import itemgetter

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm import near
from quillframe.llm.common import arrow_rows, checkpointed, components, saved, text_bytes, text_udf

WIDTH = 3  # words of a shingle
DISTANCE = 3  # differing bits at most
SEED = 42
CHUNK = 512  # members of a cell that one group compares
_EVEN = 0x5555555555555555
_RANGES = (5, 5, 5, 5, 6, 6)  # segments per range


def fingerprint(raw: bytes, width: int = WIDTH) -> bytes:
    """Eight bytes, highest bit first. Fewer words than ``width``: the whole sequence; no words: zero."""
    words = raw.lower().split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_digest
    if len(words) <= width:
        return digest(joined, SEED)
    hashes = b"".join([digest(joined[a:b - 1], SEED) for a, b in zip(starts, ends[width - 1:])])
    n = len(hashes) // 8
    ones = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(n, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def _signed(raw: bytes, width: int) -> tuple[int]:
    return (int.from_bytes(fingerprint(raw, width), "big", signed=True),)


def fingerprint_column(text: str = "text", width: int = WIDTH) -> Column:
    """The fingerprint as a signed 64-bit number; a null text is empty."""
    return text_udf(lambda raw: _signed(raw, width), "f bigint")(text_bytes(text))["f"]


def unary_counts(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, in unary."""
    even = F.lit(_EVEN)
    high = F.shiftrightunsigned(fp, 1)
    return F.shiftleft(fp.bitwiseAND(high).bitwiseAND(even), 1).bitwiseOR(fp.bitwiseOR(high).bitwiseAND(even))


def _masks() -> list[int]:
    """Bit masks of every three of the six ranges, as signed numbers."""
    ranges, at = [], 0
    for n in _RANGES:
        ranges.append(((1 << 2 * n) - 1) << at)
        at += 2 * n
    masks = [sum(three) for three in combinations(ranges, 3)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def grid_cells(fps: DataFrame) -> DataFrame:
    """Rows ``fp, grid, cell``: the 20 cells of every fingerprint."""
    cells = F.array(*[F.struct(F.lit(i).alias("grid"), F.col("_u").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(_masks())])
    return fps.select("fp", unary_counts(F.col("fp")).alias("_u")).select("fp", F.explode(cells).alias("c")).select("fp", "c.*")


def _unary(x: np.ndarray) -> np.ndarray:
    even, one = np.uint64(_EVEN), np.uint64(1)
    high = x >> one
    return ((x & high & even) << one) | ((x | high) & even)


def _forest(x: np.ndarray, side: np.ndarray, across: bool, distance: int) -> Iterator[tuple[int, int]]:
    """Links that connect the members exactly as all close pairs would (pairs of both sides only, if ``across``)."""
    u, parent = _unary(x), list(range(len(x)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(x) - 1):
        near = np.bitwise_count(u[i + 1:] ^ u[i]) <= distance
        near &= np.bitwise_count(x[i + 1:] ^ x[i]) <= distance
        if across:
            near &= side[i + 1:] != side[i]
        for j in np.nonzero(near)[0]:
            a, b = find(i), find(i + 1 + int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
                yield i, i + 1 + int(j)


def grid_links(fps: DataFrame, distance: int = DISTANCE, chunk: int = CHUNK) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (column ``fp``) that connect all within ``distance`` bits (3 at most).

    Cells with one member are dropped after counting. A cell with more than ``chunk``
    members is cut into chunks by a hash, and every two chunks meet in a group of their
    own, so no task holds a whole hot cell.
    """
    if distance > DISTANCE:
        raise ValueError(f"the grid is complete for {DISTANCE} bits at most")
    cells = grid_cells(fps)
    counts = cells.groupBy("grid", "cell").agg(F.count("*").alias("n")).where("n > 1")
    members = cells.join(counts, ["grid", "cell"])
    pieces = F.ceil(F.col("n") / chunk).cast("int")
    members = members.withColumn("own", F.pmod(F.xxhash64("fp"), pieces).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), pieces - 1)))
    keyed = members.select("grid", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")
    laid = keyed.repartition("grid", "cell", "i", "j").sortWithinPartitions("grid", "cell", "i", "j", "fp")

    def rows(given: Iterable[tuple]) -> Iterator[tuple]:
        for (_, _, i, j), group in groupby(given, key=itemgetter(0, 1, 2, 3)):
            found = list(group)
            x = np.array([r[5] for r in found], np.int64).view(np.uint64)
            side = np.array([r[4] for r in found])
            for a, b in _forest(x, side, i != j, distance):
                yield found[a][5], found[b][5]

    return arrow_rows(laid, rows, "a bigint, b bigint")


def fingerprint_roots(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Rows ``fp, root``: linked fingerprints share a root; fingerprints without a link are left out."""
    return components(grid_links(fps, distance)).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, distance: int = DISTANCE) -> DataFrame:
    """Every row's ``doc_id``, ``fingerprint`` (hex) and ``component_id``.

    Fingerprints link at ``distance`` or fewer differing bits; the component is the
    smallest id that links lead to (null ids only: null). Copies share a fingerprint and
    are one node; null and empty texts have fingerprint zero. No rows: no rows.
    """
    prints = saved(docs.select(F.col(f"`{key}`").alias("doc_id"), fingerprint_column(text, width).alias("fp")))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = checkpointed(fingerprint_roots(nodes.select("fp"), distance))
    rooted = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    out = prints.join(named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def proposed_pairs(nodes: DataFrame, similarity: float, distance: int = DISTANCE) -> DataFrame:
    """Pairs ``leader, node, size`` of ``nodes`` (``node, size, fp``) within ``distance`` bits whose sizes allow the similarity.

    Nodes of one fingerprint are led by the smallest of them, and that one by the smallest
    node of the smallest linked fingerprint below its own. So a node is led once, however many are near it.
    """
    some = nodes.where("size > 0").select("node", "size", "fp")
    first = checkpointed(some.groupBy("fp").agg(F.min("node").alias("leader"), F.min_by("size", "node").alias("leader_size")))
    links = grid_links(first.select("fp"), distance)
    lower = links.groupBy(F.greatest("a", "b").alias("fp")).agg(F.min(F.least("a", "b")).alias("low"))
    across = first.select("fp", F.col("leader").alias("node"), F.col("leader_size").alias("size")).join(lower, "fp").drop("fp").join(
        first.withColumnRenamed("fp", "low"), "low").drop("low")
    equal = some.join(first, "fp").where("node <> leader").drop("fp")
    return equal.unionByName(across).where(near.sized(F.col("size"), F.col("leader_size"), similarity)).select("leader", "node", "size")


def keep_one(docs: DataFrame, width: int = near.WIDTH, similarity: float = near.SIMILARITY) -> DataFrame:
    """One row of each near-duplicate group, with all columns of ``docs``: the smallest ``doc_id`` (null last), of repeated ones one.

    SimHash links of at most three bits propose pairs, and those whose ``width``-word shingles have a Jaccard similarity of
    ``similarity`` link. Pairs at that similarity that three bits lose are found by bands of minimum hashes (module ``near``). Texts without
    words are one group. Rows are told by their id and a hash of all columns, so repeated or null ids are no matter.
    """
    kind = F.xxhash64("doc_id", F.coalesce("text", F.lit("")), *[F.col(f"`{c}`").cast("string") for c in docs.columns if c not in ("doc_id", "text")])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"), F.col("text").alias("_text"), kind.alias("_kind"))
    place = F.struct(F.col("_id").isNull().alias("last"), F.col("_id").alias("id"), F.col("_kind").alias("kind"))
    marks = text_udf(lambda raw: (*near.signature(raw, width), *_signed(raw, WIDTH)), f"{near.SIGNATURE}, fp bigint")(text_bytes("_text"))
    narrow = saved(rows.select(marks.alias("s"), place.alias("place")).select("s.*", "place"))
    nodes = saved(narrow.groupBy("set").agg(F.min("place").alias("place"), F.min("size").alias("size"), F.first("bands").alias("bands"), F.min_by("fp", "place").alias("fp"))
                  .withColumn("node", F.monotonically_increasing_id()))
    at = F.col("_id").eqNullSafe(F.col("place.id")) & (F.col("_kind") == F.col("place.kind"))
    texts = rows.select("_id", "_kind", "_text").join(nodes.select("node", "place"), at).groupBy("node").agg(F.first("_text").alias("text"))
    roots = checkpointed(near.node_roots(nodes, texts, proposed_pairs(nodes, similarity), width, similarity))
    rooted = nodes.select("node", "place").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    winner = rooted.groupBy("root").agg(F.min("place").alias("place"))
    copies = narrow.groupBy("place").agg(F.count("*").alias("copies"))
    kept = rows.join(winner.join(copies, "place").select("place", "copies"), at)
    single = kept.where("copies = 1").select("_row.*")
    repeated = kept.where("copies > 1").groupBy("place").agg(F.first("_row").alias("_row")).select("_row.*")
    return single.unionByName(repeated)
