"""Quality rules: a learned decision list over document statistics.

Sequential covering (grow on two thirds of the labelled rows, prune on the rest)
finds ordered conjunctions of thresholds that describe bad documents. The list is
emitted as one ordered Spark ``CASE`` expression over the statistics columns, so
applying it is a projection.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import text_bytes, text_udf

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["n_words", "mean_word_chars", "symbols_per_word", "dup_line_share", "repeat_word_share",
            "comma_share", "stop_share", "upper_share", "digit_share", "line_words"]
LABELLED_ROWS = 20_000  # bound of the labelled sample that the rules are fitted on
_SPACE = b" \t\n\r\x0b\x0c"
_TAIL = bytes(range(0x80, 0xC0))  # continuation bytes: not the first byte of a code point
_SYMBOLS = b"#*$%&|<>"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    hit = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift:shift + len(windows)] |= hit
    return int(covered.sum())


def text_stats(raw: bytes) -> tuple:
    """Base statistics and features of one text, in the order of ``BASE`` and then ``FEATURES[1:]``."""
    words = raw.split()
    n = len(words)
    chars = len(raw.translate(None, _SPACE + _TAIL))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    w = max(n, 1)
    short = sum(len(x) <= 3 for x in words)
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    return (n, chars, symbols, dup, repeat, chars / w, symbols / w, dup / max(len(lines), 1), repeat / w,
            raw.count(b",") / w, short / w, upper / w, digits / w, n / max(len(lines), 1))


STATS_SCHEMA = ", ".join([f"{c} bigint" for c in BASE] + [f"{c} double" for c in FEATURES[1:]])


def document_stats(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the statistics of every whole text; a null text has no words. Repeated rows stay."""
    measure = text_udf(text_stats, STATS_SCHEMA)
    return docs.select(*keep, measure(text_bytes(text)).alias("_stats")).select(*keep, "_stats.*")


@dataclass(frozen=True)
class Rule:
    """Conditions ``(feature, above, threshold)`` that must all hold, and the share of bad rows among those covered."""

    conditions: tuple[tuple[str, bool, float], ...]
    precision: float
    covered: int

    def column(self) -> Column:
        parts = [F.col(f) > F.lit(t) if above else F.col(f) <= F.lit(t) for f, above, t in self.conditions]
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out

    def __str__(self) -> str:
        return " and ".join(f"{f} {'>' if above else '<='} {t:.6g}" for f, above, t in self.conditions)


def _mask(x: np.ndarray, conditions, names: list[str]) -> np.ndarray:
    m = np.ones(len(x), bool)
    for f, above, t in conditions:
        c = x[:, names.index(f)]
        m &= c > t if above else c <= t
    return m


def _best_condition(x: np.ndarray, y: np.ndarray, live: np.ndarray, names: list[str], least: int):
    """The threshold with the largest FOIL gain among the rows still covered."""
    p0, n0 = int(y[live].sum()), int(live.sum())
    best, gain = None, 1e-9
    base = np.log2(max(p0, 1e-9) / n0)
    for j, f in enumerate(names):
        values = x[live, j]
        order = np.argsort(values, kind="stable")
        v, good = values[order], np.cumsum(y[live][order])
        cut = np.nonzero(v[1:] > v[:-1])[0]  # a threshold lies between two different values
        if not len(cut):
            continue
        t = (v[cut] + v[cut + 1]) / 2
        for above, pos, size in ((False, good[cut], cut + 1), (True, p0 - good[cut], n0 - cut - 1)):
            with np.errstate(divide="ignore", invalid="ignore"):
                g = np.where((pos > 0) & (size >= least), pos * (np.log2(pos / size) - base), -1.0)
            k = int(np.argmax(g))
            if g[k] > gain:
                best, gain = (f, above, float(t[k])), float(g[k])
    return best


def _worth(m: np.ndarray, y: np.ndarray) -> float:
    """Pruning measure: (bad - good) / covered."""
    p = int(y[m].sum())
    n = int(m.sum()) - p
    return (p - n) / (p + n) if p + n else -1.0


def learn_rules(x: np.ndarray, bad: np.ndarray, names: list[str] = FEATURES, min_precision: float = 0.9,
                least: int = 8, max_conditions: int = 4, seed: int = 7) -> list[Rule]:
    """Sequential covering of the bad rows. No bad rows, or no rule that is precise enough: an empty list (all kept).

    A rule is grown condition by condition on two thirds of the rows, its last
    conditions are pruned while the held-out third does not get worse, and it is kept
    if its precision with add-one smoothing holds on both parts. Rows it covers leave.
    """
    rules: list[Rule] = []
    rng = np.random.default_rng(seed)
    left = np.ones(len(x), bool)
    while bad[left].sum() >= least:
        grow = left & (rng.random(len(x)) < 2 / 3)
        hold = left & ~grow
        conditions: list = []
        live = grow.copy()
        while len(conditions) < max_conditions and bad[live].sum() and bad[live].sum() < live.sum():
            found = _best_condition(x, bad, live, names, least)
            if found is None:
                break
            conditions.append(found)
            live &= _mask(x, [found], names)
        while len(conditions) > 1 and _worth(hold & _mask(x, conditions[:-1], names), bad) >= _worth(hold & _mask(x, conditions, names), bad):
            conditions.pop()
        if not conditions:
            break
        m = left & _mask(x, conditions, names)
        held = m & hold
        share = (bad[m].sum() + 1) / (m.sum() + 2)
        if share < min_precision or (held.sum() and (bad[held].sum() + 1) / (held.sum() + 2) < min_precision - 0.1) or m.sum() < least:
            break
        rules.append(Rule(tuple(conditions), float(share), int(m.sum())))
        left &= ~m
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = LABELLED_ROWS, **how) -> list[Rule]:
    """Fit on at most ``max_labelled`` labelled documents, chosen by a hash of their id (0: bad, other: good; null labels are left out)."""
    sample = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
              .groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    some = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # bounded by max_labelled
    rows = document_stats(some, keep=("quality",)).select(*FEATURES, "quality").toPandas()
    order = rows.sort_values(FEATURES + ["quality"])  # the same rules whatever order the rows come in
    return learn_rules(order[FEATURES].to_numpy(float), (order["quality"] == 0).to_numpy(), **how)


def rule_number(rules: list[Rule]) -> Column:
    """1-based number of the first rule that fits, else null: the decision list as one expression."""
    out = None
    for i, r in enumerate(rules, 1):
        out = F.when(r.column(), F.lit(i)) if out is None else out.when(r.column(), F.lit(i))
    return F.lit(None).cast("int") if out is None else out


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``base_failed``, ``rule`` (number of the rule that rejects, else null) and ``kept`` to statistics."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("rule", rule_number(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def filter_documents(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents that are kept, with all their columns.

    Each row is judged by its own text (a null text has no words and goes), so
    repeated or null ids are no matter; columns of any name pass through.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    stats = document_stats(docs.select(row, F.col("text")), keep=("_row",))
    return judge(stats, rules).where("kept").select("_row.*")
