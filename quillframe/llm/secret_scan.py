"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are long runs of key characters and values that are assigned to a name. The
forest sees their length, how likely their characters follow each other in ordinary text,
how much of them dictionary words cover, the place they come from and the words beside
them. It is trained from labelled findings and from two kinds of drawn assignments: ordinary words
of the corpus, and digests of them in the alphabets of keys. So what tells a secret is the value, not that it
is assigned nor one format. Character transitions and the dictionary are counted over the whole corpus.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha512

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import arrow_rows, saved, text_bytes

MIN_LENGTH = 16  # of a run that stands alone
MIN_VALUE = 8  # of a value that is assigned to a name
DICTIONARY_WORDS = 50_000  # most frequent words that are kept
LABELLED_ROWS = 20_000  # bound of the labelled findings that the forest is fitted on
DRAWN_WORDS = 3_000  # bound, about, of the words behind drawn assignments; each gives an ordinary one and a random one
FLUSH = 100_000  # words that a task counts before it passes them on
#: Names that secrets are assigned to, and parts of paths that hold made-up ones.
NAMES = ("token", "password", "passwd", "pwd", "secret", "apikey", "api_key", "key", "credential", "auth", "access")
SAMPLE_PATHS = ("test", "example", "sample", "fixture", "mock", "doc")
_RUN = re.compile(rb"[A-Za-z0-9+/_\-]{16,}={0,2}")
#: A name, and its value up to the closing quote, or without quotes up to a blank and without a sentence's last mark.
_VALUE = re.compile(rb"[A-Za-z_][A-Za-z0-9_\-]*+[ \t]*[=:][ \t]*(?:\"([^\"\r\n]{8,})\"|'([^'\r\n]{8,})'|[\"']?([^\s\"']{7,}[^\s\"'.,;]))")
FEATURES = ["length", "transition", "coverage", "digits", "upper", "lower", "turns", "distinct", "named", "assigned", "quoted", "alone", "before_long", "after_long", "sample_path", "path_depth"]
_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"), 1):
    _CLASS[list(_chars)] = _i


def find_candidates(raw: bytes) -> list[tuple[int, int]]:
    """Byte spans of candidates, in order: runs with a digit or with both cases, and every assigned value."""
    spans = set()
    for m in _VALUE.finditer(raw):
        spans.add(m.span(m.lastindex))
    for m in _RUN.finditer(raw):
        word = m[0]
        if re.search(rb"[0-9]", word) or (re.search(rb"[a-z][A-Z]", word) and re.search(rb"[A-Z][a-z]*[A-Z]", word)):
            a, b = m.span()
            if not any(x < b and a < y for x, y in spans):
                spans.add((a, b))
    return sorted(spans)


@dataclass
class TextModel:
    """Log probabilities of byte pairs in ordinary text (classes of bytes) and the dictionary."""

    transitions: np.ndarray
    words: frozenset[bytes]
    longest: int

    def transition(self, word: bytes) -> float:
        """Mean log probability of each character after the one before."""
        c = _letters(np.frombuffer(word, np.uint8))
        return float(self.transitions[c[:-1], c[1:]].mean()) if len(c) > 1 else 0.0

    def coverage(self, word: bytes) -> float:
        """Share of the candidate that dictionary words of four letters or more cover, longest first from the left."""
        low, at, covered = word.lower(), 0, 0
        while at < len(low):
            for size in range(min(self.longest, len(low) - at), 3, -1):
                if low[at:at + size] in self.words:
                    covered += size
                    at += size
                    break
            else:
                at += 1
        return covered / len(low)


def _letters(b: np.ndarray) -> np.ndarray:
    """Letters without case 0-25, digits 26, the rest 27."""
    low = b | 0x20
    return np.where((low >= 97) & (low <= 122) & (b >= 65), low.astype(np.int64) - 97, np.where((b >= 48) & (b <= 57), 26, 27))


def fit_text_model(docs: DataFrame, text: str = "text", words: int = DICTIONARY_WORDS) -> TextModel:
    """Counts over all documents: 28 x 28 character transitions, and the ``words`` most frequent words of 4 to 24 letters."""

    def rows(given: Iterable[tuple]) -> Iterator[tuple]:
        counts, pairs = Counter(), np.zeros(28 * 28, np.int64)
        for (raw,) in given:
            c = _letters(np.frombuffer(raw, np.uint8))
            pairs += np.bincount(c[:-1] * 28 + c[1:], minlength=28 * 28)
            counts.update(re.findall(rb"[a-z]{4,24}", raw.lower()))
            if len(counts) > FLUSH:
                yield from ((w.decode(), n) for w, n in counts.items())
                counts.clear()
        yield from ((w.decode(), n) for w, n in counts.items())
        yield from ((f"#{i}", int(n)) for i, n in enumerate(pairs) if n)

    counted = arrow_rows(docs.select(text_bytes(text).alias("raw")), rows, "item string, n bigint").groupBy("item").agg(F.sum("n").alias("n"))
    counted = saved(counted.where("n > 1"))
    table = np.ones(28 * 28)
    for r in counted.where("item like '#%'").collect():  # at most 784 rows
        table[int(r["item"][1:])] += r["n"]
    table = table.reshape(28, 28)
    listed = counted.where("item not like '#%'")
    total = listed.count()
    if total > words:  # a cut a little below the last count that is kept, so that tasks hand in little more than what stays
        cut = listed.agg(F.percentile_approx("n", max(1 - 1.1 * words / total, 0.0), 10_000)).first()[0]
        listed = listed.where(F.col("n") >= cut)
    top = [r["item"].encode() for r in listed.orderBy(F.desc("n"), "item").limit(words).collect()]
    return TextModel(np.log(table / table.sum(axis=1, keepdims=True)), frozenset(top), max(map(len, top), default=0))


def describe(raw: bytes, a: int, b: int, path: str, model: TextModel) -> tuple[float, ...]:
    """Features of the candidate raw[a:b], in the order of ``FEATURES``."""
    word = raw[a:b]
    kinds = _CLASS[np.frombuffer(word, np.uint8)]
    head, tail = raw[max(0, a - 60):a], raw[b:b + 60]
    assigned = re.search(rb"([A-Za-z_][A-Za-z0-9_\-]*)[ \t]*[=:][ \t]*[\"']?$", head)
    before = re.findall(rb"[^\s\"'=:]+", head)
    after = re.findall(rb"[^\s\"'=:]+", tail)
    near = b" ".join([*before[-2:], *after[:1]]).lower()
    place = path.lower()
    return (float(len(word)), model.transition(word), model.coverage(word), float((kinds == 3).mean()), float((kinds == 2).mean()), float((kinds == 1).mean()),
            float((kinds[1:] != kinds[:-1]).mean()), len(set(word)) / len(word), float(any(n.encode() in near for n in NAMES)), float(bool(assigned)),
            float(head[-1:] in b"\"'" and bool(head)), float(not head[-1:].strip() and not tail[:1].strip()),
            float(len(before[-1]) if before else 0), float(len(after[0]) if after else 0),
            float(any(s in place for s in SAMPLE_PATHS)), float(place.count("/")))


CANDIDATES = ", ".join(["start bigint", "length_chars int", "candidate string", *[f"{f} double" for f in FEATURES]])


def candidates(docs: DataFrame, model: TextModel, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Rows ``key, start, length_chars, candidate`` and the features, of every candidate of every whole text.

    ``start`` is in code points. ``path`` names a column with the document's place; without it, or null, the place is empty.
    """
    place = F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("")) if path else F.lit("")
    part = docs.select(F.col(f"`{key}`").alias("_key"), text_bytes(text).alias("_raw"), place.alias("_path"))

    def rows(given: Iterable[tuple]) -> Iterator[tuple]:
        for k, raw, where in given:
            at = chars = 0
            for a, b in find_candidates(raw):
                chars += len(raw[at:a].decode("utf-8", "replace"))
                at = a
                word = raw[a:b].decode("utf-8", "replace")
                yield (k, chars, len(word), word, *describe(raw, a, b, where, model))

    return arrow_rows(part, rows, f"_key {dict(part.dtypes)['_key']}, {CANDIDATES}").withColumnRenamed("_key", key)


#: Alphabets of keys and lengths of keys.
ALPHABETS = (b"0123456789abcdef", b"0123456789ABCDEF", b"0123456789abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
             b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
KEY_LENGTHS = (18, 20, 24, 28, 32, 36, 40, 48, 64)
OTHER_NAMES = ("name", "title", "url", "path", "version", "author", "encoding", "module")


def _ordinary(w: str, h: int) -> str:
    """The word alone, or joined as in names, paths, versions and titles."""
    head = w[:len(w) // 2 + 1]
    return (w, f"{w}.{head}", f"/{head}/{w}", f"https://{w}.org/{head}", f"{w} {head.title()}", f"{head}-{len(w)}.{h % 7}", f"{w}_{head}", f"{w.title()}{head.title()}")[h % 8]


def _random(w: str, h: int) -> str:
    """A digest of the word as a key."""
    letters, n = ALPHABETS[h % len(ALPHABETS)], KEY_LENGTHS[h // 8 % len(KEY_LENGTHS)]
    raw = sha512(w.encode()).digest()
    return bytes(letters[c % len(letters)] for c in raw[:n]).decode()


def drawn_assignments(docs: DataFrame, model: TextModel, text: str = "text", words: int = DRAWN_WORDS, seed: int = 5) -> DataFrame:
    """Labelled findings (``FEATURES``, ``candidate``, ``start``, ``label``) made of about ``words`` words that stand in several places of the
    corpus and have few digits: an ordinary value (label 0) and a random one (1) of each, behind one of ``NAMES`` or ``OTHER_NAMES``."""
    word = F.explode(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), r"[\x20\x09-\x0D]+")).alias("w")
    plain = F.col("w").rlike(r"^[\p{L}\p{N}][\p{L}\p{N}._/:@,;-]*$") & F.char_length("w").between(3, 60) & (F.char_length(F.regexp_replace("w", r"[^0-9]", "")) < 4)
    kept = saved(docs.select(word).where(plain).groupBy("w").count().where("count > 1").select("w"))
    share = F.pmod(F.xxhash64(F.lit(seed), "w"), F.lit(1 << 40)) < int(min(1.0, words / max(kept.count(), 1)) * (1 << 40))
    drawn = kept.where(share).select("w", F.xxhash64(F.lit(seed + 1), "w"))

    def rows(given: Iterable[tuple]) -> Iterator[tuple]:
        for w, h in given:
            names = NAMES + OTHER_NAMES
            for label, value in enumerate((_ordinary(w, h), _random(w, h))):
                at = h // 64 + label
                mark = ('"', "'", "")[at % 3]
                raw = f"{w} {names[at // 3 % len(names)]} {'=:'[at // 64 % 2]} {mark}{value}{mark} {w}".encode()
                for a, b in find_candidates(raw):
                    yield (raw[a:b].decode("utf-8", "replace"), a, label, *describe(raw, a, b, "", model))

    return arrow_rows(drawn, rows, "candidate string, start bigint, label int, " + ", ".join(f"{f} double" for f in FEATURES))


def fit_forest(findings: DataFrame, max_labelled: int = LABELLED_ROWS, trees: int = 30, seed: int = 3) -> RandomForestClassificationModel | None:
    """Fit on labelled findings (``FEATURES`` and ``label`` 0 or 1), at most ``max_labelled`` by a hash of candidate and place;
    none where no finding is labelled 1."""
    rows = findings.where("label is not null").select(*FEATURES, F.col("label").cast("double").alias("label"), "candidate", "start")
    rows = rows.orderBy(F.xxhash64("candidate", "start"), "candidate", "start", *FEATURES).limit(max_labelled)
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(saved(rows))
    if data.where("label = 1").isEmpty():
        return None
    return RandomForestClassifier(numTrees=trees, maxDepth=8, seed=seed, featureSubsetStrategy="sqrt").fit(data)


def judge(found: DataFrame, forest: RandomForestClassificationModel | None, threshold: float = 0.5) -> DataFrame:
    """Add ``probability`` and ``secret`` to candidates; without a forest nothing is known to be a secret (probability 0)."""
    if forest is None:
        return found.withColumns({"probability": F.lit(0.0), "secret": F.lit(False)})
    scored = forest.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found))
    p = F.get(vector_to_array("probability"), 1) if forest.numClasses > 1 else F.lit(0.0)
    return scored.withColumn("_p", p).drop("features", "rawPrediction", "probability", "prediction").withColumnRenamed("_p", "probability").withColumn("secret", F.col("probability") >= threshold)
