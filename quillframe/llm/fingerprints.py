"""One-permutation MinHash fingerprints of documents.

Every shingle is hashed once. The high bits choose one of ``BINS`` bins, and a bin keeps
its least hash. Empty bins are filled by optimal densification: each bin tries the others in
an order of its own until one is filled, the same order for every document. Only the
low ``BITS`` bits of each bin are stored. Two fingerprints agree in a bin with
probability J + (1 - J) / 2^BITS, so the share of agreeing bins is corrected for that.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import arrow_rows, shuffle_partitions, text_bytes

WIDTH = 5  # words of a shingle
BINS = 512
BITS = 4
WORDS_HELD = 200_000  # hashes of words that a task remembers
_PAIR = 0x9E3779B97F4A7C15  # fixed value: golden ratio, odd multiplier
_MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)  # fixed values: 64-bit finaliser of MurmurHash3


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_HELD:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    for m in _MIX:
        h = (h ^ (h >> np.uint64(33))) * np.uint64(m)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(raw: bytes, known: dict, width: int = WIDTH) -> np.ndarray:
    """Hashes of the word shingles; fewer words than ``width``: one of the whole sequence; no words: none."""
    words = raw.split()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = len(h) - width + 1
    if n < 1:
        n, width = min(len(h), 1), len(h)
    acc = np.full(n, width, np.uint64)
    for i in range(width):
        acc *= np.uint64(_PAIR)
        acc += h[i:i + n]
    return _mix(acc)


def try_order(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which each bin tries the others, a permutation drawn by hashing: the first tries as rows, and the
    place of bin j in the order of bin i."""
    i = np.arange(bins * bins, dtype=np.uint64).reshape(bins, bins)
    order = np.argsort(_mix(i + np.uint64(1)), axis=1, kind="stable")
    place = np.empty((bins, bins), np.int32)
    np.put_along_axis(place, order, np.arange(bins, dtype=np.int32)[None, :], axis=1)
    return np.ascontiguousarray(order[:, :16].T), place


def signature(hashes: np.ndarray, order: tuple[np.ndarray, np.ndarray], salt: np.ndarray, bins: int = BINS, bits: int = BITS) -> bytes:
    """Packed low-order bits of all bins; no shingles: no bytes."""
    if not len(hashes):
        return b""
    ordered = np.sort(hashes)
    shift = np.uint64(64 - (bins - 1).bit_length())
    where = (ordered >> shift).astype(np.int64)
    first = np.concatenate(([True], where[1:] != where[:-1]))
    values = np.zeros(bins, np.uint64)
    filled = np.zeros(bins, bool)
    values[where[first]] = ordered[first]
    filled[where[first]] = True
    if not filled.all():
        tries, place = order
        hit = filled[tries]
        source = tries[hit.argmax(axis=0), np.arange(bins)]
        late = np.nonzero(~filled & ~hit.any(axis=0))[0]
        if len(late):  # few bins are filled, or few are left
            own = np.nonzero(filled)[0]
            source[late] = own[place[late[:, None], own].argmin(axis=1)]
        values = np.where(filled, values, values[source])
    # the bin takes part, so that two values that agree by chance do so in single bins only
    low = (_mix(values ^ salt) & np.uint64((1 << bits) - 1)).astype(np.uint8).reshape(-1, 8 // bits)
    packed = low[:, 0]
    for k in range(1, 8 // bits):
        packed = (packed << np.uint8(bits)) | low[:, k]
    return packed.tobytes()


def likeness(a: bytes, b: bytes, bins: int = BINS, bits: int = BITS) -> float:
    """Estimated Jaccard similarity, corrected for chance agreement; two empty texts are alike, one empty text is like none."""
    if not a or not b:
        return float(a == b)
    x = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
    mask = (1 << bits) - 1
    differ = sum(np.count_nonzero(x & np.uint8(mask << at)) for at in range(0, 8, bits))
    chance = 2.0 ** -bits
    return float(min(1.0, max(0.0, (1.0 - differ / bins - chance) / (1.0 - chance))))


def bin_salt(bins: int) -> np.ndarray:
    return _mix(np.arange(bins, dtype=np.uint64) + np.uint64(1))


class Fingerprinter:
    """Fingerprints of whole texts, with the state that one task keeps."""

    def __init__(self, width: int = WIDTH, bins: int = BINS, bits: int = BITS):
        if bins & (bins - 1) or bits not in (1, 2, 4, 8) or bins < 8:
            raise ValueError("bins must be a power of two from 8 on, bits 1, 2, 4 or 8")
        self.width, self.bins, self.bits = width, bins, bits
        self.known, self.order, self.salt = _WordHashes(), try_order(bins), bin_salt(bins)

    def __call__(self, raw: bytes) -> bytes:
        return signature(shingle_hashes(raw, self.known, self.width), self.order, self.salt, self.bins, self.bits)

    def likeness(self, a: bytes, b: bytes) -> float:
        return likeness(a, b, self.bins, self.bits)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Rows ``key, fingerprint`` (binary) of every whole text; a null text is empty and has an empty fingerprint."""
    part = docs.select(F.col(f"`{key}`").alias("_key"), text_bytes(text).alias("_raw"))

    def rows(given: Iterable[tuple]) -> Iterator[tuple]:
        take = Fingerprinter(**how)
        for k, raw in given:
            yield k, take(raw)

    return arrow_rows(part, rows, f"_key {dict(part.dtypes)['_key']}, fingerprint binary").withColumnRenamed("_key", key)


def in_order(docs: DataFrame, key: str = "doc_id", text: str = "text", blocks: int | None = None) -> DataFrame:
    """Rows ``_block, _halo, _id, _raw`` laid out so that a task reads whole blocks in ascending id, each followed by a halo row.

    The halo row (``_halo`` true) is the first document of the next block, or of the first
    block after the last: every document's successor is in its task. Null ids come last,
    ties are ordered by text. The cuts between blocks are quantiles of the ids, fixed
    numbers, so a lost task is computed again alike. One text per block comes twice.
    """
    spark = docs.sparkSession
    blocks = blocks or shuffle_partitions(spark)
    d = docs.select(F.col(f"`{key}`").cast("long").alias("_id"), text_bytes(text).alias("_raw"))
    share = [i / blocks for i in range(1, blocks)]
    cuts = sorted(set(d.select(F.percentile_approx(F.col("_id"), share, 1000).alias("q")).first()["q"] or [])) if share else []
    splits = [float("-inf"), *(sorted({float(c) for c in cuts}) or [0.0]), float("inf")]
    # rounding to double keeps the order, and equal ids stay together
    known = Bucketizer(splits=splits, inputCol="_x", outputCol="_b", handleInvalid="keep")
    placed = known.transform(d.withColumn("_x", F.col("_id").cast("double")))
    placed = placed.select(F.coalesce(F.col("_b").cast("int"), F.lit(len(splits))).alias("_block"), "_id", "_raw")
    ids = placed.groupBy("_block").agg(F.min("_id").alias("_first"))
    firsts = sorted((r["_block"], r["_first"]) for r in ids.collect())  # one row per block
    before = {b: firsts[i - 1][0] for i, (b, _) in enumerate(firsts)}
    if not firsts:
        return placed.select("_block", F.lit(False).alias("_halo"), "_id", "_raw")
    heads = spark.createDataFrame([(b, f, before[b]) for b, f in firsts], "_hb int, _first bigint, _to int")
    head = placed.join(F.broadcast(heads), (F.col("_block") == F.col("_hb")) & F.col("_id").eqNullSafe(F.col("_first")))  # one row per block
    halo = head.groupBy("_to", "_id").agg(F.min("_raw").alias("_raw"))
    rows = placed.select("_block", F.lit(False).alias("_halo"), "_id", "_raw").unionByName(
        halo.select(F.col("_to").alias("_block"), F.lit(True).alias("_halo"), "_id", "_raw"))
    return rows.repartition(blocks, "_block").sortWithinPartitions("_block", "_halo", F.col("_id").asc_nulls_last(), "_raw")


def edited(text: str, following: str) -> str:
    """The last half of the text (rounded down) replaced by as many first code points of the next one, or all it has."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def compare_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Every document with its fingerprint, that of its edited text, and their likeness; and the likeness to the next document.

    ``n_chars`` is in code points. One document alone is its own successor. Null and
    empty texts have an empty fingerprint. Repeated ids are neighbours in text order.
    """
    laid = in_order(docs, key, text).select("_block", "_halo", "_id", "_raw")

    def rows(given: Iterable[tuple]) -> Iterator[tuple]:
        take = Fingerprinter(**how)
        last = None
        for _, halo, k, raw in given:
            body = raw.decode("utf-8", "replace")
            fp = None if halo and last is None else take(raw)
            if last is not None:
                lk, lbody, lfp = last
                changed = edited(lbody, body).encode()
                cfp = take(changed)
                yield (lk, len(lbody), _sha256(changed), lfp.hex(), cfp.hex(), take.likeness(lfp, cfp), take.likeness(lfp, fp))
            last = None if halo else (k, body, fp)

    return arrow_rows(laid, rows, f"{key} bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _sha256(raw: bytes) -> str:
    import hashlib

    return hashlib.sha256(raw).hexdigest()
