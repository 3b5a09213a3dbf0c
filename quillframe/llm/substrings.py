"""Exact removal of repeated substrings by a distributed suffix sort.

A window is a string of ``LENGTH`` bytes. Every window is served by its anchor, the 32-byte
string inside it with the least hash (leftmost of equals): equal windows have equal anchors
at equal offsets. Windows that follow each other under one anchor form a segment, so a text is
a row of segments of about 35 windows, and only one row per segment is shuffled.

1. Segments meet by anchor. One whose whole string occurred earlier is removed at once.
   Anchors that occur once are done. What is left are different segments with one anchor,
   at the edges of repeated passages.
2. Their suffixes are sorted by a deep-shallow sort: multikey quicksort over eight-byte
   characters down to a shallow depth, then blind tries for the groups that still agree.
   Suffixes that agree on a whole window form a class; all but its first are removed.

Anchors with more segments than a task holds are sorted in chunks whose classes meet again
by their string's hash. No group is held whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import arrow_rows, saved, text_bytes

LENGTH = 100
GRAM = 32  # bytes of an anchor
BUFFER = 1 << 20  # bytes that are cut into segments at once
SHALLOW = 48  # depth of the multikey quicksort
HELD = 20_000  # segments that one suffix sort takes
_POSITION = np.uint64((1 << 21) - 1)
_DOC = "doc bigint, th int"


def _table() -> np.ndarray:
    """A random 64-bit number per byte, the same in every task."""
    return np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray, table: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hashes of all ``gram``-byte strings (a power of two), by doubling."""
    h, width = table[data], 1
    while width < gram:
        h = h[:-width] * np.uint64(0x9E3779B97F4A7C15 + 2 * width) + h[width:]
        h ^= h >> np.uint64(29)
        width *= 2
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def cut_segments(data: np.ndarray, owner: np.ndarray, table: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Segments of a buffer: anchor hash, first window start and number of windows. ``owner`` tells the document of every byte."""
    h = gram_hashes(data, table)
    packed = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
    anchor = (_sliding_least(packed, length - GRAM + 1) & _POSITION).astype(np.int64)
    good = owner[:len(anchor)] == owner[length - 1:length - 1 + len(anchor)]
    starts = np.nonzero(good)[0]
    if not len(starts):
        return (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 2)
    at = anchor[starts]
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1) | (owner[starts[1:]] != owner[starts[:-1]])))
    first = np.nonzero(new)[0]
    return h[at[first]], starts[first], np.diff(np.append(first, len(starts)))


_SEGMENTS = "kind int, part bigint, anchor bigint, segment bigint, doc bigint, th int, lo bigint, n int"


def _segment_rows(docs: DataFrame, length: int) -> DataFrame:
    """One row per segment: kind 0 if it is the first of its string in this task's buffer, else 1 (surely repeated)."""
    schema = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("anchor", pa.int64()), ("segment", pa.int64()),
                        ("doc", pa.int64()), ("th", pa.int32()), ("lo", pa.int64()), ("n", pa.int32())])

    def flush(held: list[tuple], table: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``held``: (doc, th, position in the document, bytes)."""
        raw = b"".join(h[3] for h in held)
        data = np.frombuffer(raw, np.uint8)
        if len(data) < length:
            return
        sizes = [len(h[3]) for h in held]
        owner = np.repeat(np.arange(len(held)), sizes)
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        anchor, lo, n = cut_segments(data, owner, table, length)
        if not len(lo):
            return
        of = owner[lo]
        doc = np.array([np.iinfo(np.int64).max if h[0] is None else h[0] for h in held], np.int64)[of]
        th = np.array([h[1] for h in held], np.int32)[of]
        place = lo - begin[of] + np.array([h[2] for h in held], np.int64)[of]
        view, hashed = memoryview(raw), xxhash.xxh64_intdigest
        segment = np.fromiter((hashed(view[a:b]) for a, b in zip(lo.tolist(), (lo + n + length - 1).tolist())), np.uint64, len(lo)).view(np.int64)
        order = np.lexsort((place, th, doc, segment, anchor))
        a, s = anchor[order], segment[order]
        first = np.concatenate(([True], (a[1:] != a[:-1]) | (s[1:] != s[:-1])))
        kind = np.empty(len(lo), np.int32)
        kind[order] = np.where(first, 0, 1)
        # a repeated row of the same document is not an earlier place
        same = np.concatenate(([False], ~first[1:] & (doc[order][1:] == doc[order][:-1]) & (th[order][1:] == th[order][:-1]) & (place[order][1:] == place[order][:-1])))
        keep = np.ones(len(lo), bool)
        keep[order] = ~same
        part = np.where(kind == 0, anchor.view(np.int64), segment + place)
        columns = [kind, part, anchor.view(np.int64), segment, doc, th, place, n.astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table()
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                doc, th, raw = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                for at in range(0, max(len(raw) - length + 1, 0), BUFFER):
                    piece = raw[at:at + BUFFER + length - 1]  # the next piece begins with the next window
                    if size + len(piece) > 1_900_000:
                        yield from flush(held, table)
                        held, size = [], 0
                    held.append((doc, th, at, piece))
                    size += len(piece)
        yield from flush(held, table)

    return docs.select("doc", "th", "raw").mapInArrow(run, _SEGMENTS)


_MARKS = "kind int, anchor bigint, doc bigint, th int, lo bigint, n int"


def _meet(segments: DataFrame) -> DataFrame:
    """Kind 1: windows lo .. lo + n - 1 are surely repeated. Kind 2: a segment to be compared with others of its anchor.

    Reads rows sorted by (anchor, segment, place) as a stream and remembers one row.
    """
    laid = segments.repartition("part").sortWithinPartitions("kind", "anchor", "segment", "doc", "th", "lo")
    schema = pa.schema([("kind", pa.int32()), ("anchor", pa.int64()), ("doc", pa.int64()), ("th", pa.int32()), ("lo", pa.int64()), ("n", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # anchor, segment, doc, th, lo of the last row
        held = None  # the only segment so far of the last anchor: doc, th, lo, n
        many = False  # whether the last anchor has several segments
        for batch in batches:
            if not batch.num_rows:
                continue
            kind, _, a, s, doc, th, lo, n = (batch.column(i).to_numpy() for i in range(8))
            sure = kind == 1
            if sure.any():
                yield _marks(1, a[sure], doc[sure], th[sure], lo[sure], n[sure], schema)
                a, s, doc, th, lo, n = (x[~sure] for x in (a, s, doc, th, lo, n))
            if not len(a):
                continue
            before = last or (a[0] + 1 if a[0] < 0 else a[0] - 1, 0, 0, 0, 0)
            pa_, ps, pd, pt, pl = (np.concatenate(([b], x[:-1])) for b, x in zip(before, (a, s, doc, th, lo)))
            new_a = a != pa_
            new_s = new_a | (s != ps)
            same = ~new_s & (doc == pd) & (th == pt) & (lo == pl)
            again = ~new_s & ~same
            if again.any():
                yield _marks(1, a[again], doc[again], th[again], lo[again], n[again], schema)
            # the first segment of an anchor waits until a second one comes
            rep = np.nonzero(new_s)[0]
            if len(rep):
                ra, rd, rt, rl, rn, rnew = a[rep], doc[rep], th[rep], lo[rep], n[rep], new_a[rep]
                if not rnew[0]:
                    if held is not None and not many:
                        ra, rd, rt, rl, rn = (np.concatenate(([h], x)) for h, x in zip((before[0], *held), (ra, rd, rt, rl, rn)))
                        rnew = np.concatenate(([True], rnew))
                        carried = False
                    else:
                        carried = True
                else:
                    carried = False
                group = np.cumsum(rnew)
                sizes = np.bincount(group, minlength=group[-1] + 1)
                several = sizes[group] > 1
                if carried:
                    several |= group == 0
                end = group == group[-1]
                many = bool(several[-1])
                held = None if many else tuple(int(x[-1]) for x in (rd, rt, rl, rn))
                out = several if many else several & ~end
                if out.any():
                    yield _marks(2, ra[out], rd[out], rt[out], rl[out], rn[out], schema)
            last = tuple(int(x[-1]) for x in (a, s, doc, th, lo))

    return laid.mapInArrow(run, _MARKS)


def _marks(kind: int, a, doc, th, lo, n, schema: pa.Schema) -> pa.RecordBatch:
    columns = [np.full(len(a), kind, np.int32), a, doc, th.astype(np.int32), lo, n.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, dtype=f.type.to_pandas_dtype())) for c, f in zip(columns, schema)], schema=schema)


def multikey_groups(data: np.ndarray, suffixes: np.ndarray, depth: int) -> list[np.ndarray]:
    """Groups of suffixes that agree on ``depth`` bytes (a multiple of eight), in order.

    Multikey quicksort over eight-byte characters, one level at a time: all groups that are
    left are sorted by their next character in one vector sort, and suffixes that
    are alone leave.
    """
    group = np.zeros(len(suffixes), np.int64)
    powers = np.uint64(1) << (np.uint64(8) * np.arange(7, -1, -1, dtype=np.uint64))
    for at in range(0, depth, 8):
        key = np.zeros(len(suffixes), np.uint64)
        for i in range(8):
            key |= data[suffixes + at + i].astype(np.uint64) * powers[i]
        order = np.lexsort((key, group))
        suffixes, group, key = suffixes[order], group[order], key[order]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])))
        group = np.cumsum(new) - 1
        several = np.bincount(group)[group] > 1
        suffixes, group = suffixes[several], group[several]
        if not len(suffixes):
            return []
    return np.split(suffixes, np.nonzero(group[1:] != group[:-1])[0] + 1)


class BlindTrie:
    """Suffixes that agree on ``depth`` bytes, by the places where they branch.

    A node is [place, {byte: node}], a leaf the list of suffixes that agree up to ``end``.
    A suffix goes down by branching bytes alone, is compared once with the leaf it reaches,
    and is then hung in at the first place where the two differ.
    """

    def __init__(self, raw: bytes, depth: int, end: int):
        self.raw, self.depth, self.end, self.root = raw, depth, end, None

    def add(self, suffix: int) -> None:
        raw = self.raw
        if self.root is None:
            self.root = [self.end, [suffix]]
            return
        node = self.root
        while node[0] < self.end:
            child = node[1].get(raw[suffix + node[0]])
            node = child if child is not None else next(iter(node[1].values()))
        other = node[1][0]
        place = self._differ(suffix, other)
        if place == self.end:
            node[1].append(suffix)
            return
        leaf = [self.end, [suffix]]
        parent, node = None, self.root
        while node[0] < place:
            parent, node = node, node[1][raw[suffix + node[0]]]
        if node[0] == place:
            node[1][raw[suffix + place]] = leaf
            return
        branch = [place, {raw[other + place]: node, raw[suffix + place]: leaf}]
        if parent is None:
            self.root = branch
        else:
            parent[1][raw[suffix + parent[0]]] = branch

    def _differ(self, a: int, b: int) -> int:
        raw = self.raw
        x, y = raw[a + self.depth:a + self.end], raw[b + self.depth:b + self.end]
        if x == y:
            return self.end
        low, high = 0, len(x)
        while low < high:  # first place where they differ
            mid = (low + high + 1) // 2
            low, high = (mid, high) if x[:mid] == y[:mid] else (low, mid - 1)
        return self.depth + low

    def leaves(self) -> Iterator[list[int]]:
        """Leaves in lexicographic order."""
        stack = [self.root] if self.root else []
        while stack:
            place, below = stack.pop()
            if place == self.end:
                yield below
            else:
                stack += [below[b] for b in sorted(below, reverse=True)]


def equal_windows(raw: bytes, suffixes: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> Iterator[list[int]]:
    """Classes of at least two suffixes that agree on ``length`` bytes: deep-shallow sort."""
    shallow = min(shallow, length) // 8 * 8
    data = np.frombuffer(raw, np.uint8)
    for group in multikey_groups(data, suffixes, shallow):
        trie = BlindTrie(raw, shallow, length)
        for s in group.tolist():
            trie.add(s)
        for leaf in trie.leaves():
            if len(leaf) > 1:
                yield leaf


_FOUND = "kind int, w1 bigint, w2 bigint, doc bigint, th int, lo bigint, n int"


def _sort_windows(rows: list[tuple], length: int, across: bool) -> Iterator[tuple]:
    """Sort the suffixes of segments ``(anchor, doc, th, lo, bytes)``; yields rows of ``_FOUND``.

    Kind 1: repeated windows. Kind 3, if the anchor goes on in other chunks (``across``): every
    window that is the first of its class here, with two hashes of its string.
    """
    raw = b"".join(r[4] for r in rows)
    sizes = np.array([len(r[4]) for r in rows])
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    n = sizes - length + 1
    of = np.repeat(np.arange(len(rows)), n)
    suffixes = np.arange(len(of)) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n) + begin[of]
    home = np.zeros(len(raw), np.int64)
    home[suffixes] = of
    repeated = np.zeros(len(raw), bool)

    def place(s: int) -> tuple:
        r = rows[home[s]]
        return r[1], r[2], r[3] + s - int(begin[home[s]])

    for found in equal_windows(raw, suffixes, length):
        places = [place(s) for s in found]
        least = min(places)
        for s, p in zip(found, places):
            repeated[s] = p != least
    flags = repeated[suffixes]
    edge = np.nonzero(flags & np.concatenate(([True], ~flags[:-1] | (of[1:] != of[:-1]))))[0]
    stop = np.nonzero(flags & np.concatenate((~flags[1:] | (of[1:] != of[:-1]), [True])))[0]
    for a, b in zip(edge.tolist(), stop.tolist()):
        doc, th, lo = place(int(suffixes[a]))
        yield 1, 0, 0, doc, th, lo, b - a + 1
    if across:
        for s in suffixes[~flags].tolist():
            w = raw[s:s + length]
            doc, th, lo = place(s)
            yield 3, _signed(xxhash.xxh64_intdigest(w)), _signed(xxhash.xxh64_intdigest(w, 1)), doc, th, lo, 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _first_of_classes(segments: DataFrame, length: int, held: int = HELD) -> DataFrame:
    """Repeated windows among different segments of one anchor, as ``doc, th, lo, n``; ``segments`` has ``anchor, doc, th, lo, raw``."""
    laid = segments.repartition("anchor").sortWithinPartitions("anchor")

    def rows(given: Iterable[tuple]) -> Iterator[tuple]:
        batch: list[tuple] = []  # whole anchors, then the one being read
        first = 0  # where the anchor being read begins
        split = None  # anchor that is already cut into chunks
        for r in given:
            if batch and r[0] != batch[-1][0]:
                if split is not None:
                    yield from _sort_windows(batch, length, True)
                    batch, split = [], None
                first = len(batch)
            batch.append(r)
            if len(batch) >= held:
                if first:
                    yield from _sort_windows(batch[:first], length, False)
                    batch, first = batch[first:], 0
                if len(batch) >= held:
                    split = r[0]
                    yield from _sort_windows(batch, length, True)
                    batch = []
        if batch:
            if split is not None and batch[0][0] == split:
                yield from _sort_windows(batch, length, True)
            else:
                yield from _sort_windows(batch, length, False)

    found = saved(arrow_rows(laid, rows, _FOUND))
    again = found.where("kind = 3").repartition("w1", "w2").sortWithinPartitions("w1", "w2", "doc", "th", "lo")

    def later(given: Iterable[tuple]) -> Iterator[tuple]:
        key = least = None
        for w1, w2, doc, th, lo in given:
            if (w1, w2) != key:
                key, least = (w1, w2), (doc, th, lo)
            elif (doc, th, lo) != least:
                yield doc, th, lo, 1

    merged = arrow_rows(again.select("w1", "w2", "doc", "th", "lo"), later, f"{_DOC}, lo bigint, n int")
    return found.where("kind = 1").select("doc", "th", "lo", "n").unionByName(merged)


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    raw = text_bytes(text)
    return docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.hash(raw).alias("th"), raw.alias("raw"))


def repeated_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Rows ``doc, th, lo, n``: windows starting at lo .. lo + n - 1 (bytes) also start at an earlier place."""
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    texts = _texts(docs, key, text)
    marks = saved(_meet(_segment_rows(texts, length)))
    edges = marks.where("kind = 2")
    wanted = edges.groupBy("doc", "th").agg(F.collect_list(F.struct("anchor", "lo", "n")).alias("cuts"))  # within one document
    wanted = wanted.select(F.col("doc").alias("_d"), F.col("th").alias("_t"), "cuts")
    cut = texts.join(wanted, (F.col("doc") == F.col("_d")) & (F.col("th") == F.col("_t")))
    part = F.substring(F.col("raw"), (F.col("c.lo") + 1).cast("int"), (F.col("c.n") + length - 1).cast("int"))
    segments = cut.select("doc", "th", "raw", F.explode("cuts").alias("c")).select(F.col("c.anchor").alias("anchor"), "doc", "th", F.col("c.lo").alias("lo"), part.alias("raw"))
    segments = segments.dropDuplicates(["doc", "th", "lo"])
    return marks.where("kind = 1").select("doc", "th", "lo", "n").unionByName(_first_of_classes(segments, length))


def _cut(raw: bytes, spans: list, length: int) -> tuple[int, int, int, bytes]:
    """n_bytes, n_removed, n_spans and what is left of a text without the bytes of its repeated windows."""
    if not spans:
        return len(raw), 0, 0, raw
    edge = np.zeros(len(raw) + 1, np.int64)
    for s in spans:
        edge[s["lo"]] += 1
        edge[s["lo"] + s["n"] + length - 1] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return len(raw), int(gone.sum()), runs, np.frombuffer(raw, np.uint8)[~gone].tobytes()


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Every row as ``row`` (its columns) with ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (bytes) and ``kept_sha256``.

    Places are ordered by (doc_id, start); null ids come last, and rows with one id by a hash
    of their text. Rows with the same id and text are one document and are cut
    alike. Null texts are empty; texts under ``length`` bytes stay whole. What is kept may end
    inside a character, so it is given as bytes.
    """
    ranges = repeated_windows(docs, key, text, length).groupBy("doc", "th").agg(F.collect_list(F.struct("lo", "n")).alias("_spans"))  # within one document
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    named = docs.select(row, F.col(f"`{key}`"), F.col(f"`{text}`"))
    told = named.select("row", *[c.alias(n) for c, n in ((F.coalesce(F.col(f"`{key}`").cast("long"), F.lit((1 << 63) - 1)), "_doc"), (F.hash(text_bytes(text)), "_th"), (text_bytes(text), "_raw"))])
    out = told.join(ranges, (F.col("_doc") == F.col("doc")) & (F.col("_th") == F.col("th")), "left")
    kind = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])

    @F.arrow_udf("n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string")
    def cut(raws: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for raw, s in zip(raws, spans, strict=True):
            n, gone, runs, kept = _cut(raw.as_py(), s.as_py(), length)
            rows.append((n, gone, runs, kept, hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*rows, strict=True)) or [[] for _ in kind]
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], fields=list(kind))

    return out.select("row", cut(F.col("_raw"), F.coalesce("_spans", F.array().cast("array<struct<lo:bigint,n:int>>"))).alias("_c")).select("row", "_c.*")
