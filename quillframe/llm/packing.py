"""Best-fit packing of tokenised documents after Martello-Toth dominance reduction.

A document is tokenised once; only its piece lengths and checksums go on. As lengths are
whole numbers up to the capacity, the packing problem is a histogram of at most
``capacity`` counts: it is reduced and solved on those counts, with thousands of equal
bins in one step, and the plan is a list of runs (length, first rank, how many,
sequence, offset). Every piece finds its place by its rank among the pieces of its length,
and ranks come from counts per (length, salt), so a hot length is many groups.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm.common import arrow_rows, saved, shuffle_partitions, text_bytes

CAPACITY = 2048
WORDS_HELD = 300_000  # words whose ids a task remembers
PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"


def _class(first: str, last: int) -> str:
    """Character class of the code points up to ``last`` whose Unicode category starts so."""
    out, begin = [], None
    for c in range(last + 2):
        inside = c <= last and unicodedata.category(chr(c))[0] == first
        if inside and begin is None:
            begin = c
        elif not inside and begin is not None:
            out.append(f"\\U{begin:08x}-\\U{c - 1:08x}" if c - 1 > begin else f"\\U{begin:08x}")
            begin = None
    return "".join(out)


_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"  # fixed values: Unicode White_Space


@lru_cache(maxsize=2)
def _pattern(last: int) -> re.Pattern:
    """The tokenizer file's pattern, with its classes spelled out for ``re`` up to a code point; below 0x10000 it is much faster."""
    letters, numbers = _class("L", last), _class("N", last)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{_WHITE}{letters}{numbers}]+")


_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


@lru_cache(maxsize=1)
def _byte_letters() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class WordIds(dict):
    """Ids of a word as little-endian bytes, found by the tokenizer's own model and remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORDS_HELD:
            self.clear()
        spelled = "".join([self.letters[b] for b in word.encode()])
        self[word] = ids = np.array([t.id for t in self.model.tokenize(spelled)], "<u4").tobytes()
        return ids

    def document(self, text: str) -> bytes:
        """Ids of the document and then id 0, four bytes each.

        The steps of the tokenizer file, word by word: NFC, lower case, split, model. A
        text that spells one of its special tokens goes through the tokenizer itself.
        """
        if any(s in text for s in self.special):
            return np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes()
        low = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # no final sigma
        words = _pattern(sys.maxunicode if _ASTRAL.search(low) else 0xFFFF).findall(low)
        return b"".join([*map(self.__getitem__, words), bytes(4)])


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every whole text: ``key``, piece, start, length, ids_crc32. A null or empty text is id 0 alone."""
    part = docs.select(F.col(f"`{key}`").alias("_key"), text_bytes(text).alias("_raw"))

    def rows(given: Iterable[tuple]) -> Iterator[tuple]:
        words = WordIds(tokenizer)
        for k, raw in given:
            ids = words.document(raw.decode("utf-8", "replace"))
            for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                cut = ids[at:at + 4 * capacity]
                yield k, n, at // 4, len(cut) // 4, zlib.crc32(cut)

    return arrow_rows(part, rows, f"_key {dict(part.dtypes)['_key']}, {PIECES}").withColumnRenamed("_key", key)


class _Counts:
    """Lengths still to pack, as counts."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.n[length] = n

    def largest(self, most: int | None = None) -> int:
        """The largest length with a count, up to ``most``; 0 if none."""
        found = np.nonzero(self.n[:len(self.n) if most is None else max(most, 0) + 1])[0]
        return int(found[-1]) if len(found) else 0

    def take(self, lengths: list[int]) -> int:
        """Take as many equal bins of these lengths as there are; returns how many."""
        kinds = {x: lengths.count(x) for x in lengths}
        times = min(int(self.n[x]) // k for x, k in kinds.items())
        for x, k in kinds.items():
            self.n[x] -= times * k
        return times


def _best_pair(c: _Counts, room: int) -> tuple[int, int] | None:
    """Two lengths a >= b with the largest sum that fits ``room``, and of those the longest a; else None."""
    at = np.arange(len(c.n))
    have = np.maximum.accumulate(np.where(c.n > 0, at, 0))  # largest length with a count, up to each length
    a = at[(c.n > 0) & (at < room)]
    if not len(a):
        return None
    b = have[np.minimum(room - a, a)]
    b = np.where((b == a) & (c.n[a] < 2), have[np.maximum(a - 1, 0)], b)
    total = np.where(b > 0, a + b, 0)
    k = len(a) - 1 - int(np.argmax(total[::-1]))
    return (int(a[k]), int(b[k])) if total[k] else None


def _least(c: _Counts, n: int, above: int = 0, without: int = 0) -> list[int]:
    """The ``n`` smallest lengths above ``above``, counted with repetition, one ``without`` left out."""
    out: list[int] = []
    for x in np.nonzero(c.n[above + 1:])[0] + above + 1:
        out += [int(x)] * min(n, int(c.n[x]) - (x == without))
        if len(out) >= n:
            break
    return out[:n]


def reduce_dominated(c: _Counts, capacity: int) -> list[tuple[list[int], int]]:
    """Martello-Toth reduction: fix bins that some optimal packing has; returns (lengths, how many such bins).

    For an item L with room r, longest first, a set is fixed if it dominates all sets that L
    can share a bin with, so that its members could change places with theirs:
    L alone, if nothing fits; L and x, if x fills r, or x is the longest that fits and no
    two fit together, or no two that fit are longer than x while three never fit;
    L, a and b, if a is the longest that fits, a + b is the longest pair, three never fit and
    no two items longer than b fit. Else L waits for best fit. One step takes all
    equal bins at once.
    """
    fixed: list[tuple[list[int], int]] = []
    before = -1
    while len(fixed) > before:  # what is fixed may let a longer item be fixed too
        before = len(fixed)
        for big in range(capacity, 0, -1):
            while c.n[big] and (chosen := _dominating(c, big, capacity - big)):
                fixed.append((chosen, c.take(chosen)))
    return fixed


def _dominating(c: _Counts, big: int, room: int) -> list[int] | None:
    c.n[big] -= 1
    one = c.largest(room)
    three = _least(c, 3)
    only_pairs = len(three) < 3 or sum(three) > room
    two = _best_pair(c, room) if one and one < room and only_pairs else None
    chosen = None
    if not one:
        chosen = [big]
    elif one == room or (only_pairs and (two is None or sum(two) <= one)):
        chosen = [big, one]
    elif two and two[0] == one:
        longer = _least(c, 2, above=two[1], without=one)
        if len(longer) < 2 or sum(longer) > room:
            chosen = [big, *two]
    c.n[big] += 1
    return chosen


def best_fit(c: _Counts, capacity: int) -> list[tuple[list[int], int]]:
    """Best fit decreasing over counts: the largest length goes to the fullest open bin that holds it, equal bins in one step."""
    open_bins: dict[int, list[list]] = {}  # room left: [lengths, how many]
    done: list[tuple[list[int], int]] = []
    while big := c.largest():
        left = int(c.n[big])
        c.n[big] = 0
        for room in sorted(r for r in open_bins if r >= big):
            while left and open_bins[room]:
                lengths, times = open_bins[room][-1]
                used = min(times, left)
                left -= used
                if used == times:
                    open_bins[room].pop()
                else:
                    open_bins[room][-1][1] -= used
                _put(open_bins, done, [*lengths, big], used, room - big)
            if not open_bins[room]:
                del open_bins[room]
            if not left:
                break
        per = capacity // big
        # what still fits nowhere opens new bins, each filled with as many of this length as it holds
        if left >= per:
            _put(open_bins, done, [big] * per, left // per, capacity - per * big)
        if left % per:
            _put(open_bins, done, [big] * (left % per), 1, capacity - left % per * big)
    for kept in open_bins.values():
        done += [(lengths, times) for lengths, times in kept]
    return done


def _put(open_bins: dict, done: list, lengths: list[int], times: int, room: int) -> None:
    if room:
        open_bins.setdefault(room, []).append([lengths, times])
    else:
        done.append((lengths, times))


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Bins as (lengths, how many): the reduction first, best fit for the rest."""
    c = _Counts(counts, capacity)
    return reduce_dominated(c, capacity) + best_fit(c, capacity)


def _runs(bins: list[tuple[list[int], int]]) -> dict[int, tuple[list[int], list[int], list[int]]]:
    """By length: first rank, sequence of the first rank, and offset of each run."""
    next_rank: dict[int, int] = {}
    runs: dict[int, tuple[list[int], list[int], list[int]]] = {}
    sequence = 0
    for lengths, times in bins:
        at = 0
        for x in lengths:
            first = next_rank.get(x, 0)
            begin, seq, off = runs.setdefault(x, ([], [], []))
            begin.append(first)
            seq.append(sequence)
            off.append(at)
            next_rank[x] = first + times
            at += x
        sequence += times
    return runs


def pack(items: DataFrame, length: str = "length", capacity: int = CAPACITY, salt: int | None = None) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a length from 1 to ``capacity``.

    The driver sees one count per length. Rows of equal length are alike to the plan;
    their order comes from a hash of the row, so reruns agree up to identical rows.
    """
    salts = salt or shuffle_partitions(items.sparkSession)
    names = items.columns
    salted = items.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in names]), salts))
    groups = salted.groupBy(F.col(length).alias("_l"), F.col("_salt").alias("_s")).agg(F.count("*").alias("_n"))
    counts = {r["_l"]: r["n"] for r in groups.groupBy("_l").agg(F.sum("_n").alias("n")).collect()}  # at most ``capacity`` rows
    runs = {x: tuple(np.array(v, np.int64) for v in r) for x, r in _runs(plan_bins(counts, capacity)).items()}
    before = F.sum("_n").over(Window.partitionBy("_l").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    base = groups.withColumn("_base", F.coalesce(before, F.lit(0))).drop("_n")
    inside = Window.partitionBy(length, "_salt").orderBy(F.xxhash64(F.lit(3), *[F.col(f"`{c}`") for c in names]))
    ranked = salted.withColumn("_rank", F.row_number().over(inside) - 1)
    ranked = ranked.join(base, (F.col(length) == F.col("_l")) & (F.col("_salt") == F.col("_s")))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(lengths, ranks):
        import pandas as pd

        seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        size, rank = lengths.to_numpy(), ranks.to_numpy()
        for x in np.unique(size):
            rows = np.nonzero(size == x)[0]
            begin, first, at = runs[int(x)]
            run = np.searchsorted(begin, rank[rows], "right") - 1
            seq[rows], off[rows] = first[run] + rank[rows] - begin[run], at[run]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    where = place(F.col(length), F.col("_base") + F.col("_rank")).alias("_place")
    return ranked.select(*[F.col(f"`{c}`") for c in names], where).select(*[F.col(f"`{c}`") for c in names], "_place.*")


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece with its place. No documents: no rows. Repeated rows are packed each."""
    return pack(saved(pieces(docs, tokenizer, key, text, capacity)), capacity=capacity)
