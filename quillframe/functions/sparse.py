"""Sparse tf-idf vectors over a whole vocabulary, and exact joins of them by cosine.

Words are numbered from the rarest to the most frequent one. ``cosine_links`` is a prefix
filter: behind a vector's first words, which hold its rare part, the rest is shorter than
the threshold, so two vectors with at least that cosine share one of these words. What
they share of them and what is left behind bound the cosine from above, and only pairs
within the bound are computed in full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions.ordered import narrow_table, reliable_checkpoint

SENT_WORDS, SENT_BYTES, TOKENS = 2_000_000, 32 << 20, 1 << 20  # words sent to all tasks and their bytes at most, tokens counted at a time
MARGIN, SLACK = 1e-12, 1e-6  # a cosine this far below the threshold counts as equal to it, and what bounds in short numbers may lose
BLOCK_ROWS = 4_096  # vectors of a block of the product
ROW_WORDS = 400  # words of a vector, on average, that make a block full before it has all its rows
TILE_ROWS, CHUNK = 256, 1 << 18  # fixed values: rows of a tile of the product, products at a time
FIRST_WORDS, PLACE_PAIRS = 300_000, 100_000  # fixed values: first words of a block of postings, pairs computed at one place
CROWD = 256  # rows that share a first word with a row, on average, from which large groups are cleared first
DOWN, ACROSS = 16, 64  # fixed values: rows and columns of a group in a tile
DENSE, DENSE_WORDS = 0.004, 1_024  # share of the pairs of rows from which a word is cheaper in a dense product, and the most words of one


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value so that ``body`` may use it many times, also inside a lambda, while it is computed once."""
    return F.transform(F.array(value), body)[0]


def unit_length(values: Column) -> Column:
    """The array divided by its Euclidean length; all zeros stay."""
    return once(values, lambda a: once(F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)),
                                       lambda n: F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(0.0))))


def weighted_terms(df: DataFrame, key: str, tokens: Column, vocab: int | None = None) -> DataFrame:
    """Rows ``key, t, term, w``: every word of every row with its tf-idf weight (smoothed, not yet of unit length).

    ``t`` numbers the words by (rows that have it, word), with gaps. ``vocab`` keeps only that many words, the most used ones.
    The words of a row are counted where its text was dealt to by ``key``, and a small table of words is broadcast, so the
    result is still dealt by ``key``: texts are shuffled once, their words are not.
    """
    held = df.select(key, tokens.alias("_t"))
    seen = held.select(F.explode(F.array_distinct("_t")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    if vocab is not None:
        used = held.select(F.explode("_t").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("uses"))
        seen = seen.join(used.orderBy(F.desc("uses"), "term").limit(vocab), "term")
    numbered = seen.repartitionByRange("df", "term").sortWithinPartitions("df", "term").withColumn("t", F.monotonically_increasing_id())
    numbered = narrow_table(numbered.select("term", "df", "t"), F.col("term"))
    idf = F.log(F.lit(1.0 + df.count()) / (F.lit(1.0) + F.col("df"))) + 1
    counted = held.repartition(key).select(key, F.explode("_t").alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    return counted.join(numbered, "term").select(key, "t", "term", (F.col("tf") * idf).alias("w"))


def unit_vectors(weighted: DataFrame, key: str) -> DataFrame:
    """Rows ``key, t, w``: the numbers of a row's words, rarest first, and their weights at unit length."""
    held = weighted.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("t", "w"))).alias("v"))
    return held.select(key, F.col("v.t").alias("t"), unit_length(F.col("v.w")).alias("w"))


class _Block:
    """Some vectors by words: of each word in ``terms`` the rows that have it and their weights. Rows are in the order of ``ids``."""

    PARTS = {"ids": np.int64, "terms": np.int64, "starts": np.int64, "rows": np.int32, "w": np.float64, "floor": np.float64}

    def __init__(self, **parts):
        vars(self).update(parts)

    @classmethod
    def of(cls, ids: np.ndarray, sizes: np.ndarray, t: np.ndarray, w: np.ndarray) -> _Block:
        place = np.empty(len(ids), np.int64)
        place[np.argsort(ids)] = np.arange(len(ids))
        rows = np.repeat(place, sizes)
        order = np.lexsort((rows, t))
        terms, starts = np.unique(t[order], return_index=True)
        return cls(ids=np.sort(ids), terms=terms, starts=np.append(starts, len(order)), rows=rows[order].astype(np.int32), w=w[order], floor=np.zeros(len(ids)))

    @classmethod
    def read(cls, parts: dict[str, pa.Scalar]) -> _Block:
        return cls(**{k: np.frombuffer(parts[k].as_buffer(), kind) for k, kind in cls.PARTS.items()})

    def write(self) -> dict[str, bytes]:
        return {k: getattr(self, k).astype(kind, copy=False).tobytes() for k, kind in self.PARTS.items()}


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of ranges, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def tfidf_vectors(df: DataFrame, key: str, tokens: Column, vocab: int | None = None) -> DataFrame:
    """``unit_vectors`` of the weighted terms of every row; ``key`` is a position.

    Unless the words are too many, those that two rows have are sent to all tasks by (rows that have it, word), and a row's words are
    counted and weighted where it is read: neither texts nor words are shuffled. All words that only this row has are one word of
    their common length then, numbered below zero: no other row meets it.
    """
    held = df.select(F.col(key).cast("long").alias(key), tokens.alias("_t"))

    def parts(batches):
        """Keys, sizes and counted words of some rows at a time: places of rows, places of words in a dictionary, counts, the dictionary."""
        for batch in batches:
            keys, flat, ends = batch.column(0).to_numpy(), batch.column(1).flatten(), np.append(0, np.cumsum(batch.column(1).value_lengths().to_numpy(), dtype=np.int64))
            low = 0
            while low < len(keys):
                high = max(int(np.searchsorted(ends, ends[low] + TOKENS, "right")) - 1, low + 1)
                words = flat.slice(ends[low], ends[high] - ends[low]).dictionary_encode()
                cell = np.repeat(np.arange(high - low), np.diff(ends[low:high + 1])) * max(len(words.dictionary), 1) + words.indices.to_numpy()
                cell, tf = np.unique(cell, return_counts=True)
                yield keys[low:high], *np.divmod(cell, max(len(words.dictionary), 1)), tf, words.dictionary
                low = high
            pa.default_memory_pool().release_unused()  # the worker lives on and has other steps to do

    def count(batches):
        for _, _, word, _, dictionary in parts(batches):
            yield pa.RecordBatch.from_arrays([dictionary, pa.array(np.bincount(word, minlength=len(dictionary)), pa.int64())], ["term", "n"])

    if vocab is not None:
        return unit_vectors(weighted_terms(df, key, tokens, vocab), key)
    shared = reliable_checkpoint(held.mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("df")).where("df > 1"))
    size = shared.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    if size[0] > SENT_WORDS or size[1] > SENT_BYTES:
        return unit_vectors(weighted_terms(df, key, tokens), key)
    table, total = shared.toArrow().sort_by([("df", "ascending"), ("term", "ascending")]), df.count()  # at most SENT_WORDS rows
    weights = np.append(np.log((1.0 + total) / (1.0 + table["df"].to_numpy())) + 1, np.log((1.0 + total) / 2.0) + 1)
    sent = df.sparkSession.sparkContext.broadcast((table["term"].combine_chunks().cast(pa.string()), weights))

    def weigh(batches):
        terms, idf = sent.value
        for keys, row, word, tf, dictionary in parts(batches):
            place = pc.fill_null(pc.index_in(dictionary, value_set=terms), -1).to_numpy()[word]
            raw, lone = tf * idf[place], place < 0
            own = np.sqrt(np.bincount(row[lone], np.square(raw[lone]), len(keys)))
            mine = np.nonzero(own)[0]
            row, t, raw = np.append(row[~lone], mine), np.append(place[~lone], -1 - keys[mine]), np.append(raw[~lone], own[mine])
            by = np.lexsort((t, row))
            row, t, raw = row[by], t[by], raw[by]
            sizes = np.bincount(row, minlength=len(keys))
            some = np.nonzero(sizes)[0]
            ends = np.append(0, np.cumsum(sizes[some]))
            if len(some):
                w = raw / np.repeat(np.sqrt(np.add.reduceat(np.square(raw), ends[:-1])), sizes[some])
                lists = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in (t.astype(np.int64), w))
                yield pa.RecordBatch.from_arrays([pa.array(keys[some]), *lists], [key, "t", "w"])

    return held.mapInArrow(weigh, f"{key} long, t array<bigint>, w array<double>")


def postings(vectors: DataFrame, key: str, threshold: float) -> DataFrame:
    """Rows ``id, t, w, here, tail, stop, rest`` of the first words of every vector, without words that only one vector has.

    They are the fewest first words behind which the vector is shorter than the threshold. ``here`` and ``tail`` are the lengths of the vector
    from the word on and behind it, ``stop`` is its last first word before any was left out, ``rest`` its length behind that one.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")

    def run(batches):
        for batch in batches:
            ids, t, w = (batch.column(i) for i in range(3))
            sizes, t, w = t.value_lengths().to_numpy().astype(np.int64), t.flatten().to_numpy(), w.flatten().to_numpy()
            out, end = [], 0
            for i, n in zip(ids.to_numpy(), sizes):
                first, end = end, end + n
                left = np.append(np.cumsum(np.square(w[first:end])[::-1])[::-1], 0.0)
                cut = int(np.argmax(left < (threshold - 1e-9) ** 2))
                left, lone = np.sqrt(left[:cut + 1]), int(t[first] < 0)  # a word below zero stands first
                rows = slice(first + lone, first + cut)
                out.append((np.full(cut - lone, i), t[rows], w[rows], left[lone:-1], left[1 + lone:], np.full(cut - lone, t[first + cut - 1]), np.full(cut - lone, left[-1])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["id", "t", "w", "here", "tail", "stop", "rest"])

    return vectors.select(F.col(key).cast("long").alias("id"), "t", "w").mapInArrow(run, "id long, t long, w double, here double, tail double, stop long, rest double")


class _First:
    """First words of some vectors: ``ids`` of the vectors, ends and rests of their first words, and the words by (t, row), in short numbers."""

    PARTS = {"ids": np.int64, "stop": np.int64, "rest": np.float64, "t": np.int64, "rows": np.int32, "w": np.float32, "here": np.float32, "tail": np.float32}

    def __init__(self, **parts):
        vars(self).update(parts)

    write, read = _Block.write, classmethod(_Block.read.__func__)

    @classmethod
    def of(cls, id: np.ndarray, t: np.ndarray, w: np.ndarray, here: np.ndarray, tail: np.ndarray, stop: np.ndarray, rest: np.ndarray) -> _First:
        ids, one, rows = np.unique(id, return_index=True, return_inverse=True)
        by = np.lexsort((rows, t))
        return cls(ids=ids, stop=stop[one], rest=rest[one], t=t[by], rows=rows[by].astype(np.int32), w=w[by], here=here[by], tail=tail[by])


def _laid(state: DataFrame, n: int) -> DataFrame:
    """n postings to a row per block of vectors; a vector's postings lie together."""
    count = max(-(-n // FIRST_WORDS), min(n // 2_048, 6), 1)

    def block(held: list[tuple]) -> pa.RecordBatch:
        made = _First.of(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_pydict({"least": [int(made.ids[0])], "most": [int(made.ids[-1])]} | {name: pa.array([data], pa.binary()) for name, data in made.write().items()})

    def run(batches):
        held, some = [], 0
        for batch in batches:
            rows = tuple(batch.column(name).to_numpy() for name in ("id", "t", "w", "here", "tail", "stop", "rest"))
            if some > 2 * FIRST_WORDS and held[-1][0][-1] != rows[0][0]:
                yield block(held)
                held, some = [], 0
            if batch.num_rows:
                held.append(rows)
                some += batch.num_rows
        if held:
            yield block(held)

    kinds = "least long, most long, " + ", ".join(f"{name} binary" for name in _First.PARTS)
    return reliable_checkpoint(state.coalesce(count).sortWithinPartitions("id", "t").mapInArrow(run, kinds))


def _maybe(a: _First, b: _First, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ids, the smaller from a, whose cosine can reach the threshold by what they share of their first words.

    Before the first shared word they share nothing, so the lengths from there on must reach it. Behind the last shared
    word they share at most the rest of the vector whose first words end first times what the other has left there.
    """
    terms, starts, sizes = np.unique(b.t, return_index=True, return_counts=True)
    if not len(terms):
        return
    at = np.minimum(np.searchsorted(terms, a.t), len(terms) - 1)
    some = np.nonzero(terms[at] == a.t)[0]
    some = some[np.argsort(a.rows[some], kind="stable")]  # a row's words stay in the order of t
    starts, sizes = starts[at[some]], sizes[at[some]]
    done, rows = np.cumsum(sizes), a.rows[some]
    low = 0
    while low < len(some):  # whole rows of about a chunk of products
        high = int(np.searchsorted(done, (done[low - 1] if low else 0) + CHUNK, "right"))
        high = int(np.searchsorted(rows, rows[max(min(high, len(some)) - 1, low)], "right")) if high < len(some) else len(some)
        x, y = np.repeat(some[low:high], sizes[low:high]), _ranges(starts[low:high], sizes[low:high])
        low = high
        up = a.ids[a.rows[x]] < b.ids[b.rows[y]]
        x, y = x[up], y[up]
        if not len(x):
            continue
        cell = a.rows[x].astype(np.int64) * len(b.ids) + b.rows[y]
        order = np.argsort(cell, kind="stable")
        x, y, cell = x[order], y[order], cell[order]
        first = np.append(0, np.nonzero(np.diff(cell))[0] + 1)
        last = np.append(first[1:], len(cell)) - 1
        shared = np.add.reduceat(a.w[x] * b.w[y], first)
        ra, rb = a.rows[x[first]], b.rows[y[first]]
        tail_a, tail_b = a.tail[x[last]], b.tail[y[last]]
        beyond = np.minimum(tail_a * tail_b, np.where(a.stop[ra] <= b.stop[rb], a.rest[ra] * tail_b, b.rest[rb] * tail_a))
        keep = (a.here[x[first]] * b.here[y[first]] >= threshold - SLACK) & (shared + beyond >= threshold - SLACK)
        yield a.ids[ra[keep]], b.ids[rb[keep]]


def _checked(maybe: DataFrame, vectors: DataFrame, key: str, threshold: float) -> DataFrame:
    """The pairs with a cosine of at least the threshold.

    Pairs of a group of near vectors are computed at one place, named by the least id that a is paired with, so that a vector is sent there
    once and not for every pair; many pairs of one place are spread by a.
    """
    ends = maybe.select(F.inline(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("o")), F.struct(F.col("b").alias("id"), F.col("a").alias("o")))))
    leads = ends.groupBy("id").agg(F.least(F.col("id"), F.min("o")).alias("lead"))
    leads = narrow_table(leads)
    named = maybe.join(leads.select(F.col("id").alias("a"), "lead"), "a")
    many = narrow_table(named.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / PLACE_PAIRS).alias("parts")))
    placed = reliable_checkpoint(named.join(many, "lead").select("a", "b", "lead", F.pmod(F.xxhash64("a"), F.col("parts")).alias("part")))
    asked = placed.select(F.inline(F.array(F.struct(F.col("a").alias("id"), "lead", "part"), F.struct(F.col("b").alias("id"), "lead", "part")))).distinct()
    used = vectors.select(F.col(key).alias("id"), "t", "w").join(leads.select("id"), "id", "left_semi")
    sent = used.join(asked, "id").select("lead", "part", "id", F.lit(-1).cast("long").alias("b"), "t", "w")
    none = F.array()
    both = sent.unionByName(placed.select("lead", "part", F.col("a").alias("id"), "b", none.cast("array<bigint>").alias("t"), none.cast("array<double>").alias("w")))
    laid = both.repartition("lead", "part").sortWithinPartitions("lead", "part", "b", "id")

    def run(batches):
        here, held = None, {}
        for batch in batches:
            lead, part, ids, others = (batch.column(i).to_numpy() for i in range(4))
            t, w = batch.column(4), batch.column(5)
            ends, t, w = np.append(0, np.cumsum(t.value_lengths().to_numpy(), dtype=np.int64)), t.flatten().to_numpy(), w.flatten().to_numpy()
            near = []
            for n, (place, i, other) in enumerate(zip(zip(lead.tolist(), part.tolist()), ids.tolist(), others.tolist())):
                if place != here:
                    here, held = place, {}
                if other < 0:
                    held[i] = (t[ends[n]:ends[n + 1]], w[ends[n]:ends[n + 1]])
                    continue
                (t1, w1), (t2, w2) = held[i], held[other]
                at = np.minimum(np.searchsorted(t2, t1), len(t2) - 1)
                same = np.nonzero(t2[at] == t1)[0]
                if np.dot(w1[same], w2[at[same]]) >= threshold - MARGIN:
                    near.append((i, other))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in near], pa.int64()) for k in range(2)], ["a", "b"])

    return laid.mapInArrow(run, "a long, b long")


def close_pairs(left: DataFrame, right: DataFrame, vectors: DataFrame, key: str, threshold: float) -> DataFrame:
    """Rows ``a, b`` with a cosine of at least the threshold, a from ``left`` and a smaller than b from ``right`` (both postings, or the same).

    Blocks of postings are read in pairs from the checkpoint, so neither shared words nor pairs are shuffled; only pairs within the bound leave a task.
    """
    x = _laid(left, left.count())
    y = x if right is left else _laid(right, right.count())
    x, y = (d.select(*[F.col(name).alias(f"{side}_{name}") for name in d.columns]) for d, side in ((x, "a"), (y, "b")))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (_First.read({name: batch.column(f"{side}_{name}")[i] for name in _First.PARTS}) for side in "ab")
                for ids, others in _maybe(a, b, threshold):
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(others, pa.int64())], ["a", "b"])

    met = x.join(y.hint("shuffle_replicate_nl"), F.col("a_least") < F.col("b_most")).mapInArrow(run, "a long, b long")
    return _checked(reliable_checkpoint(met), vectors, key, threshold)


def first_kept(vectors: DataFrame, key: str, threshold: float) -> DataFrame:
    """Rows ``id, of``: the vectors that are near an earlier kept one, and the first such one.

    In the order of ``key`` (a number), a vector is kept unless it has a cosine of at least the threshold with a kept
    one before it. Large groups of near copies are cleared first: a vector that is first in the postings of all its
    words is kept whatever the others are, and what it resembles goes, without pairs among them. That is repeated while words
    are crowded and it shortens the postings much; then all links of what is left are found and followed. The outcome does not
    depend on when that switch happens. Each round is checkpointed.
    """
    begun = postings(vectors, key, threshold)
    state, gone, before = begun, begun.select("id").limit(0), None
    while True:
        sizes = state.groupBy("t").agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.sum("n"), F.sum(F.col("n") * F.col("n"))).first()
        if sizes[0] is None or sizes[1] <= CROWD * sizes[0] or (before is not None and sizes[1] > 0.9 * before):
            break
        before = sizes[1]
        least = state.groupBy("t").agg(F.min("id").alias("head"))
        firsts = state.join(least, "t").groupBy("id").agg(F.bool_and(F.col("id") == F.col("head")).alias("first")).where("first").select("id")
        heads = reliable_checkpoint(firsts)
        near = close_pairs(state.join(heads, "id"), state, vectors, key, threshold)
        hit = reliable_checkpoint(near.select(F.col("b").alias("id")).distinct())
        gone = gone.unionByName(hit)
        state = reliable_checkpoint(state.join(heads.unionByName(hit), "id", "left_anti").select(*begun.columns))
    found = links = reliable_checkpoint(close_pairs(state, state, vectors, key, threshold))
    while not links.isEmpty():
        heads = links.select("a").distinct().join(links.select(F.col("b").alias("a")), "a", "left_anti")
        hit = reliable_checkpoint(links.join(heads, "a").select(F.col("b").alias("id")).distinct())
        gone = gone.unionByName(hit)
        for end in "ab":
            links = links.join(hit.withColumnRenamed("id", end), end, "left_anti")
        links = reliable_checkpoint(links.select("a", "b"))
    gone = reliable_checkpoint(gone)
    if before is None:  # all links are known
        pairs = found.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_semi")
    else:
        pairs = close_pairs(begun.join(gone, "id", "left_anti"), begun.join(gone, "id"), vectors, key, threshold)
    return pairs.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("of"))


def _products(a: _Block, b: _Block) -> Iterator[tuple[int, np.ndarray]]:
    """The cosines of a's rows and b's rows, some rows of a at a time; rows and columns are padded with zeros to whole groups.

    Words that many rows of both blocks have go through a dense product, the others by their pairs of rows.
    """
    at = np.minimum(np.searchsorted(b.terms, a.terms), max(len(b.terms) - 1, 0))
    ia = np.nonzero(b.terms[at] == a.terms)[0]
    ib = at[ia]
    na, nb = a.starts[ia + 1] - a.starts[ia], b.starts[ib + 1] - b.starts[ib]
    often = na * nb
    dense = np.nonzero(often > DENSE * len(a.ids) * len(b.ids))[0]
    dense = dense[np.argsort(-often[dense], kind="stable")[:DENSE_WORDS]]
    column = np.full(len(ia), -1)
    column[dense] = np.arange(len(dense))
    wide = -(-len(b.ids) // ACROSS) * ACROSS
    right, cells = np.zeros((len(dense), wide)), _ranges(b.starts[ib[dense]], nb[dense])
    right[np.repeat(np.arange(len(dense)), nb[dense]), b.rows[cells]] = b.w[cells]
    held = _ranges(a.starts[ia], na)
    rows, w, word = a.rows[held], a.w[held], np.repeat(np.arange(len(ia)), na)
    order = np.argsort(rows // TILE_ROWS, kind="stable")
    rows, w, word = rows[order], w[order], word[order]
    cuts = np.searchsorted(rows // TILE_ROWS, np.arange(-(-len(a.ids) // TILE_ROWS) + 1))
    for n, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        first = n * TILE_ROWS
        r, x, k = rows[low:high] - first, w[low:high], word[low:high]
        tall = -(-min(TILE_ROWS, len(a.ids) - first) // DOWN) * DOWN
        left, own = np.zeros((tall, len(dense))), column[k] >= 0
        left[r[own], column[k[own]]] = x[own]
        tile = left @ right
        flat = tile.reshape(-1)
        r, x, k = r[~own], x[~own], k[~own]
        sizes, starts = nb[k], b.starts[ib[k]]
        done = np.cumsum(sizes)
        edges = np.unique(np.append(np.searchsorted(done, np.arange(0, done[-1] if len(done) else 0, CHUNK)), len(k)))
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            cells = _ranges(starts[i:j], sizes[i:j])
            flat += np.bincount(np.repeat(r[i:j].astype(np.int64) * wide, sizes[i:j]) + b.rows[cells], np.repeat(x[i:j], sizes[i:j]) * b.w[cells], len(flat))
        yield first, tile


def _first_k(who: np.ndarray, other: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every ``who`` the k largest scores; ties go to the smaller ``other``."""
    order = np.lexsort((other, -np.round(score, 12), who))
    who, other, score = who[order], other[order], score[order]
    keep = np.arange(len(who)) - np.searchsorted(who, who) < k
    return who[keep], other[keep], score[keep]


def _best_rows(groups: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, place, score`` of what can be among a row's k best, at ``floor`` or above; ``groups`` are rows by groups by places.

    The k-th largest of the groups' maxima is reached by k places, so no place below it counts. ``floor`` is raised to it.
    """
    most = groups.max(2)
    if most.shape[1] >= k:
        np.maximum(floor, np.partition(most, -k, axis=1)[:, -k], out=floor)
    least = np.maximum(floor - 2e-12, 1e-300)
    row, group = np.nonzero(most >= least[:, None])
    some = groups[row, group]
    n, place = np.nonzero(some >= least[row, None])
    return row[n], group[n] * groups.shape[2] + place, some[n, place]


def _neighbours(a: _Block, b: _Block, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``id, other, cosine``: for each of a's rows what can be among its k nearest in b and, if b is another block, the other way round."""
    held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
    up = np.append(b.floor, np.full(-len(b.ids) % ACROSS, np.inf))
    for first, tile in _products(a, b):
        tall, wide = tile.shape
        if a is b:
            here = np.arange(min(tall, len(a.ids) - first))
            tile[here, here + first] = 0
        floor = np.append(a.floor[first:first + tall], np.full(max(first + tall - len(a.ids), 0), np.inf))
        row, place, score = _best_rows(tile.reshape(tall, wide // ACROSS, ACROSS), floor, k)
        row, place, score = _first_k(row, place, score, k)
        yield a.ids[row + first], b.ids[place], score
        if a is not b:
            place, row, score = _best_rows(tile.reshape(tall // DOWN, DOWN, wide).transpose(2, 0, 1), up, k)
            new = (place, row + first, score)
            held = _first_k(*(np.concatenate(x) for x in zip(held, new, strict=True)), k)
            last = np.nonzero(np.bincount(held[0], minlength=wide) == k)[0]
            up[last] = np.maximum(up[last], held[2][np.searchsorted(held[0], last) + k - 1])
    yield b.ids[held[0]], a.ids[held[1]], held[2]


def _packed(rows: int, words: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Vectors to blocks of at most that many rows and words, each with its nearest rows inside the block."""

    def block(held: list[tuple]) -> pa.RecordBatch:
        made = _Block.of(*(np.concatenate(x) for x in zip(*held, strict=True)))
        ids, others, scores = (np.concatenate(x) for x in zip(*_neighbours(made, made, k), strict=True))
        full = np.searchsorted(made.ids, ids)
        full = np.nonzero(np.bincount(full, minlength=len(made.ids)) == k)[0]
        made.floor[full] = scores[np.searchsorted(ids, made.ids[full]) + k - 1]
        own = pa.StructArray.from_arrays([pa.array(ids, pa.int64()), pa.array(others, pa.int64()), pa.array(scores)], ["id", "other", "cosine"])
        return pa.RecordBatch.from_pydict({"block": [int(made.ids[0])], "own": pa.ListArray.from_arrays([0, len(own)], own)} | {
            name: pa.array([data], pa.binary()) for name, data in made.write().items()})

    def run(batches):
        held, some, much = [], 0, 0
        for batch in batches:
            ids, t, w = (batch.column(i) for i in range(3))
            ids, sizes, t, w = ids.to_numpy(), t.value_lengths().to_numpy(), t.flatten().to_numpy(), w.flatten().to_numpy()
            ends, at = np.append(0, np.cumsum(sizes, dtype=np.int64)), 0
            while at < len(ids):
                take = min(len(ids) - at, rows - some, int(np.searchsorted(ends[at + 1:] - ends[at], words - much, "right")))
                take = take if held else max(take, 1)
                if take:
                    part = slice(ends[at], ends[at + take])
                    held.append((ids[at:at + take], sizes[at:at + take], t[part], w[part]))
                    some, much, at = some + take, much + int(ends[at + take] - ends[at]), at + take
                if at < len(ids):
                    yield block(held)
                    held, some, much = [], 0, 0
        if held:
            yield block(held)

    return run


def top_neighbours(vectors: DataFrame, key: str, k: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows ``id, other, cosine``: of each vector the k others with the largest cosine above zero; ties go to the smaller key.

    A product in blocks of about ``rows`` vectors that share their most frequent words. Every two blocks are read together
    once, from the checkpoint and not through a shuffle. A vector's k-th best cosine inside its own block is known before,
    and only rows that reach it leave a task. The work is that of all pairs.
    """
    n, words = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("t")), F.lit(0))).first()
    count = max(-(-4 * n // (3 * rows)), -(-4 * words // (3 * rows * ROW_WORDS)), min(n // 64, 4), 1)
    often = F.reverse("t")
    laid = vectors.select(F.col(key).cast("long").alias("id"), "t", "w").repartitionByRange(count, *[F.get(often, F.lit(i)) for i in range(3)], "id")
    kinds = "block long, own array<struct<id: long, other: long, cosine: double>>, " + ", ".join(f"{name} binary" for name in _Block.PARTS)
    blocks = reliable_checkpoint(laid.sortWithinPartitions(*[F.get(often, F.lit(i)) for i in range(3)], "id").mapInArrow(_packed(rows, rows * ROW_WORDS, k), kinds))
    left, right = (blocks.select(*[F.col(name).alias(f"{side}_{name}") for name in ("block", *_Block.PARTS)]) for side in "ab")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (_Block.read({name: batch.column(f"{side}_{name}")[i] for name in _Block.PARTS}) for side in "ab")
                for ids, others, scores in _neighbours(a, b, k):
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(others, pa.int64()), pa.array(scores, pa.float64())], ["id", "other", "cosine"])

    met = left.join(right.hint("shuffle_replicate_nl"), F.col("a_block") < F.col("b_block"))
    found = met.mapInArrow(run, "id long, other long, cosine double").unionByName(blocks.select(F.inline("own")))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("cosine", 12)), "other"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)
