"""Near-duplicate groups by the Jaccard similarity of word shingles.

Texts with one shingle set are one node. A node has 128 minimum hashes in 32 bands of
four; nodes that share a band are candidates, and the exact similarity of their shingle
sets decides. A pair at similarity 0.8 shares no band with probability
(1 - 0.8^4)^32 = 4.8e-8, a nearer one with less.

Links connect groups, they do not list all pairs. First the pairs that the caller proposes
(SimHash links, module ``simhash``) are compared, then every node with the smallest node of
each of its bands' cells, where these links have not joined them. Cells that are not joined whole are
then compared inside tasks, all pairs of different groups, and only a link that joins
two groups leaves the task. A large cell is cut into pieces by the bytes of its sets,
and every two pieces meet in a task of their own. Cells with the same members count once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, groupby
from operator import itemgetter

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import arrow_rows, checkpointed, components, saved, text_bytes, text_udf

WIDTH = 5  # words of a shingle
SIMILARITY = 0.8  # Jaccard similarity of linked texts at least
BANDS, ROWS = 32, 4
PIECE_BYTES, PIECE_ROWS = 8 << 20, 4_096  # of the sets of a piece, about
SEED = 42
SIGNATURE = "set binary, size int, bands array<bigint>"
_STEP = 4096  # shingles that are hashed at once
_rng = np.random.default_rng(SEED)
_MULTIPLY = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2)


def shingle_set(raw: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles. Fewer words than ``width``: the whole sequence; no words: none."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    return np.unique(np.array([digest(joined[a:b - 1], SEED) for a, b in zip(starts, ends[width - 1:])], np.uint64))


def _long(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def signature(raw: bytes, width: int = WIDTH) -> tuple[bytes, int, list[int]]:
    """A 128-bit hash of the shingle set (no words: empty), its size, and a hash of each band."""
    found = shingle_set(raw, width)
    if not len(found):
        return b"", 0, []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), _STEP):
        np.minimum(least, (found[at:at + _STEP, None] * _MULTIPLY + _ADD).min(axis=0), out=least)
    bands = [_long(xxhash.xxh64_intdigest(least[i * ROWS:(i + 1) * ROWS].tobytes(), i)) for i in range(BANDS)]
    return xxhash.xxh3_128_digest(found.tobytes(), SEED), len(found), bands


def _set_column(text: str, width: int) -> Column:
    return text_udf(lambda raw: (shingle_set(raw, width).tobytes(),), "s binary")(text_bytes(text))["s"]


def _like(common: np.ndarray, size: np.ndarray, other: int, similarity: float) -> np.ndarray:
    return common >= similarity * (size + other - common) - 1e-9


def sized(n: Column, m: Column, similarity: float) -> Column:
    return F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9


def _pieces(size: Column, rows: Column) -> Column:
    return F.greatest(F.ceil(8 * size / F.lit(PIECE_BYTES)), F.ceil(rows / F.lit(PIECE_ROWS)), F.lit(1)).cast("int")


def cell_members(nodes: DataFrame) -> DataFrame:
    """Rows ``cell, node, size, least`` of the cells with two members or more; ``least`` is the cell's smallest node.

    Of cells with the same members (told by their number and two 64-bit hash sums) one is kept.
    """
    cells = nodes.select("node", "size", F.explode("bands").alias("cell"))
    total = [F.sum(F.xxhash64(F.lit(i), "node").cast("decimal(38,0)")).alias(f"s{i}") for i in (0, 1)]
    counts = cells.groupBy("cell").agg(F.count("*").alias("n"), F.min(F.struct("node", "size")).alias("least"), *total).where("n > 1")
    one = counts.groupBy("n", "least", "s0", "s1").agg(F.min("cell").alias("cell"))
    return cells.join(one.select("cell", "least"), "cell")


def leader_links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links ``a, b`` among rows ``leader, node, size``: a leader's set is sent once to every piece of its nodes."""
    sizes = pairs.groupBy("leader").agg(_pieces(F.sum("size"), F.count("*")).alias("pieces"))
    cut = pairs.join(sizes, "leader").select("leader", "node", F.pmod(F.xxhash64("node"), "pieces").cast("int").alias("piece"))
    heads = sizes.select("leader", F.col("leader").alias("node"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    laid = cut.unionByName(heads).join(sets, "node").withColumn("follows", F.col("node") != F.col("leader"))
    laid = laid.repartition("leader", "piece").sortWithinPartitions("leader", "piece", "follows", "node")

    def rows(given: Iterable[tuple]) -> Iterator[tuple]:
        for (leader, _), group in groupby(given, key=itemgetter(0, 1)):
            head = None
            for _, _, node, raw in group:
                own = np.frombuffer(raw, np.uint64)
                if head is None:
                    head = own
                elif _like(np.array(len(np.intersect1d(head, own, assume_unique=True))), np.array(len(own)), len(head), similarity):
                    yield leader, node

    return arrow_rows(laid.select("leader", "piece", "node", "shingles"), rows, "a bigint, b bigint")


def joining_links(node: np.ndarray, root: np.ndarray, side: np.ndarray, sets: list[np.ndarray], across: bool, similarity: float) -> Iterator[tuple[int, int]]:
    """Links between nodes of different roots that join what all similar pairs would (pairs of both sides only, if ``across``)."""
    label, size = np.unique(root, return_inverse=True)[1], np.array([len(s) for s in sets])
    shingle, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum([0, *size[:-1]])
    mark = np.zeros(len(shingle), np.int32)
    for i in range(len(sets)):
        open_ = label != label[i]
        if across:
            open_ &= side != side[i]
        if not open_.any():
            continue
        own = flat[starts[i]:starts[i] + size[i]]
        mark[own] = 1
        near = open_ & _like(np.add.reduceat(mark[flat], starts), size, size[i], similarity)
        mark[own] = 0
        for j in np.nonzero(near)[0]:
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                yield int(node[i]), int(node[j])


def open_links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links ``a, b`` that join the different roots in each cell of ``cell, node, size, root`` wherever two nodes are similar."""
    sizes = members.groupBy("cell").agg(_pieces(F.sum("size"), F.count("*")).alias("pieces"))
    cut = members.join(sizes, "cell").withColumn("own", F.pmod(F.xxhash64("node"), "pieces").cast("int"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    keyed = met.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root")
    laid = keyed.join(sets, "node").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "node")

    def rows(given: Iterable[tuple]) -> Iterator[tuple]:
        for (_, i, j), group in groupby(given, key=itemgetter(0, 1, 2)):
            _, _, _, own, node, root, raw = zip(*group, strict=True)
            yield from joining_links(np.array(node), np.array(root), np.array(own), [np.frombuffer(r, np.uint64) for r in raw], i != j, similarity)

    return arrow_rows(laid.select("cell", "i", "j", "own", "node", "root", "shingles"), rows, "a bigint, b bigint")


def _rooted(df: DataFrame, roots: DataFrame, node: str, root: str) -> DataFrame:
    """``df`` with the root of its column ``node``: the node itself where it has no link."""
    return df.join(roots.select(F.col("node").alias("_n"), F.col("root").alias("_r")), F.col(node) == F.col("_n"), "left").withColumn(
        root, F.coalesce("_r", node)).drop("_n", "_r")


def node_roots(nodes: DataFrame, texts: DataFrame, proposed: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """Rows ``node, root`` of the nodes with a link. ``nodes`` has ``node, size, bands``, ``texts`` a row ``node, text`` of each node,
    ``proposed`` the pairs ``leader, node, size`` that are compared first; bands find what these leave apart."""
    members, proposed = saved(cell_members(nodes)), saved(proposed)
    needed = members.select(F.col("node").alias("_n")).unionByName(proposed.select(F.explode(F.array("leader", "node")).alias("_n"))).distinct()
    sets = saved(texts.join(needed, F.col("node") == F.col("_n")).select("node", _set_column("text", width).alias("shingles")))
    links = saved(leader_links(proposed, sets, similarity))
    roots = checkpointed(components(links))
    first = members.where((F.col("node") != F.col("least.node")) & sized(F.col("size"), F.col("least.size"), similarity))
    first = first.select(F.col("least.node").alias("leader"), "node", "size").distinct()
    apart = _rooted(_rooted(first, roots, "leader", "_a"), roots, "node", "_b").where("_a <> _b").select("leader", "node", "size")
    links = links.unionByName(saved(leader_links(saved(apart), sets, similarity)))
    roots = checkpointed(components(links))
    named = _rooted(members, roots, "node", "root").select("cell", "node", "size", "root")
    split = named.groupBy("cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("cell")
    more = saved(open_links(named.join(split, "cell"), sets, similarity))
    return components(links.unionByName(more))
