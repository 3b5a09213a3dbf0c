"""Text operators."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import CountVectorizerModel, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.columns import col, pick, pick_many, resolve, resolve_all, text_cols
from quillframe.functions.levels import oversample, shuffled_position
from quillframe.functions.ordered import index_rows, narrow_table, reliable_checkpoint
from quillframe.functions.profile import fit, r, safe_div
from quillframe.functions.quantile import fit_quantiles
from quillframe.functions.sparse import first_kept, once, tfidf_vectors, top_neighbours, unit_length, weighted_terms
from quillframe.functions.tokens import WORD, rewritten, spaced, without, word_pairs, words
from quillframe.operators.clean import keep_one, row_order, strip, title_case
from quillframe.registry import operator

# English stopwords of the word operators.
STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself "
    "it its itself they them their theirs themselves what which who whom this that these those am is are was were be "
    "been being have has had having do does did doing a an the and but if or because as until while of at by for with "
    "about against between through during before after above below to from up down in out on off over under again "
    "further then once here there when where why how all both each few more most other some such no nor not only own "
    "same so than too very s t can will just don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven "
    "isn ma mightn mustn needn shan shouldn wasn weren won wouldn").split()
# Sentiment words.
POSITIVE = (
    "good great excellent amazing wonderful fantastic awesome outstanding superb brilliant love happy best perfect "
    "beautiful nice positive enjoy pleased satisfied recommend impressive delightful exceptional magnificent terrific "
    "fabulous marvelous like thank thanks helpful useful easy fast reliable efficient comfortable friendly smooth worth "
    "glad fortunate success win top favorite").split()
NEGATIVE = (
    "bad terrible horrible awful poor worst hate ugly disappointing disappointed negative boring slow broken useless "
    "waste annoying frustrating angry sad problem issue error fail failure wrong difficult hard expensive cheap rude "
    "lousy dreadful inferior mediocre weak damage risk danger complaint regret unfortunately never worse painful unhappy "
    "unfair unreliable").split()
# Named patterns.
PATTERNS = {
    "email": r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",
    "url": r"https?://[^\s<>\"']+|www\.[^\s<>\"']+",
    "hashtag": r"#[\p{L}\p{N}_]+",
    "mention": r"@[\p{L}\p{N}_]+",
    "phone": r"\+?\d[\d\-\s()]{7,}\d",
    "number": r"-?\d+\.?\d*",
}
# Personal data patterns and their tags, masked in this order.
PERSONAL = (
    (PATTERNS["email"], "[EMAIL]"),
    (PATTERNS["phone"], "[PHONE]"),
    (r"\b\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b", "[CREDIT_CARD]"),
    (r"\b\d{3}[\s\-]?\d{2}[\s\-]?\d{4}\b", "[SSN]"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "[IP]"),
    (PATTERNS["url"], "[URL]"),
)
# Unicode ranges of the scripts.
SCRIPTS = (("thai", "0E00", "0E7F"), ("chinese", "4E00", "9FFF"), ("japanese", "3040", "30FF"), ("korean", "AC00", "D7AF"),
           ("russian", "0400", "04FF"), ("arabic", "0600", "06FF"), ("hindi", "0900", "097F"), ("latin", "0041", "007A"))
# Emoji ranges and text emoticons.
EMOJI_RANGES = (("1F600", "1F64F"), ("1F300", "1F5FF"), ("1F680", "1F6FF"), ("1F1E0", "1F1FF"), ("2702", "27B0"),
                ("24C2", "1F251"), ("1F900", "1F9FF"), ("1FA00", "1FA6F"), ("1FA70", "1FAFF"))
EMOJI = "[" + "".join(rf"\x{{{a}}}-\x{{{b}}}" for a, b in EMOJI_RANGES) + "]+"
EMOTICON = (r"(?:[:;=][-']?[)(DPp/\\|Oo3><])|(?:[)(DPp><][-']?[:;=])|"
            r"<3|</3|:'\(|:\)|;\)|:D|:P|:O|xD|XD|:-\)|:-\(|:\(|T_T|>_<|\^_\^")
# Suffixes and their replacement, first match wins.
SUFFIXES = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"),
    ("biliti", "ble"), ("ingness", "ing"), ("lessly", "less"), ("ingly", "ing"), ("ness", ""), ("ment", ""),
    ("ing", ""), ("tion", "t"), ("sion", "s"), ("able", ""), ("ible", ""), ("ful", ""), ("less", ""), ("ly", ""),
    ("ed", ""), ("er", ""), ("es", ""), ("s", ""))
U = "(?U)"
EDGE_SPACE = r"(?U)^\s+|\s+$"


def text(c: str) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))


def count(s: Column, pattern: str) -> Column:
    return F.regexp_count(s, F.lit(U + pattern))


def find(s: Column, pattern: str) -> Column:
    return F.regexp_extract_all(s, F.lit(f"{U}({pattern})"), F.lit(0))


def case_words(s: Column) -> Column:
    """Word tokens in their own case."""
    return F.regexp_extract_all(s, F.lit(WORD), F.lit(0))


def over_text(df: DataFrame, column, build) -> DataFrame:
    """Add the columns ``build(name, text)`` for the given or every text column."""
    new: dict[str, Column] = {}
    for c in pick_many(df, column, "text"):
        new |= build(c, text(c))
    return df.withColumns(new)


@operator("nlp.tokenize")
def tokenize(df: DataFrame, column: str | None = None) -> DataFrame:
    return over_text(df, column, lambda c, s: {f"{c}_tokens": case_words(s), f"{c}_token_count": F.size(case_words(s))})


# Cleaning steps in order: strategy name, pattern.
CLEANING = (("no_html", r"<[^>]+>"), ("no_urls", r"https?://\S+|www\.\S+"), ("no_emails", PATTERNS["email"]),
            ("no_numbers", r"\d+"), ("no_punct", r"[^\p{L}\p{N}_\s]"))


@operator("nlp.text_clean")
def text_clean(df: DataFrame, column: str | None = None, strategy: str = "all") -> DataFrame:
    def build(c, s):
        for name, pattern in CLEANING:
            if strategy in ("all", name):
                s = F.regexp_replace(s, U + pattern, " ")
        if strategy in ("all", "lowercase"):
            s = F.lower(s)
        return {c: strip(F.regexp_replace(s, r"(?U)\s+", " "))}

    return over_text(df, column, build)


def stem(w: Column) -> Column:
    """First suffix that leaves at least three letters is replaced; words up to three letters stay."""
    out = F.when(F.length(w) <= 3, w)
    for suffix, repl in SUFFIXES:
        cut = F.length(w) - len(suffix)
        out = out.when(w.endswith(suffix) & (cut + len(repl) >= 3), F.concat(F.substr(w, F.lit(1), cut), F.lit(repl)))
    return out.otherwise(w)


def unaccent(c: Column) -> Column:
    """Compatibility decomposition without combining marks; plain ASCII rows never leave the JVM."""

    def strip_marks(t: str) -> str:
        return "".join(ch for ch in unicodedata.normalize("NFKD", t) if not unicodedata.combining(ch))

    return rewritten(c, c.rlike(r"[^\x00-\x7F]"), strip_marks)


@operator("nlp.text_normalize")
def text_normalize(df: DataFrame, column: str | None = None, stem_words: bool = True, **kw) -> DataFrame:
    """``stem=False`` keeps words whole."""
    stem_words = kw.pop("stem", stem_words)
    cols = pick_many(df, column, "text")
    plain = df.withColumns({c: F.lower(unaccent(text(c))) for c in cols})
    if not stem_words:
        return plain
    return plain.withColumns({c: F.array_join(F.transform(spaced(col(c)), stem), " ") for c in cols})


@operator("nlp.remove_stopwords")
def remove_stopwords(df: DataFrame, column: str | None = None, extra_words: Sequence[str] = ()) -> DataFrame:
    stop = sorted({*STOPWORDS, *extra_words})
    return over_text(df, column, lambda c, s: {c: F.array_join(F.filter(spaced(s), lambda w: ~F.lower(w).isin(stop)), " ")})


def first_text(df: DataFrame, column) -> str:
    return pick(df, column, "text")


@operator("nlp.text_lowercase")
def text_lowercase(df: DataFrame, column: str | None = None) -> DataFrame:
    c = first_text(df, column)
    return df.withColumn(c, F.lower(col(c)))


@operator("nlp.text_uppercase")
def text_uppercase(df: DataFrame, column: str | None = None) -> DataFrame:
    c = first_text(df, column)
    return df.withColumn(c, F.upper(col(c)))


@operator("nlp.text_title_case")
def text_title_case(df: DataFrame, column: str | None = None) -> DataFrame:
    c = first_text(df, column)
    return df.withColumn(c, title_case(col(c)))


@operator("nlp.text_replace")
def text_replace(df: DataFrame, column: str | None = None, pattern: str = "", replacement: str = "",
                 mapping: Mapping[str, str] | None = None, regex: bool = True) -> DataFrame:
    pairs = list(mapping.items()) if mapping else ([(pattern, replacement)] if pattern else [])
    if not pairs:
        raise ValueError("pattern or mapping is required")

    def build(c, s):
        for a, b in pairs:
            s = F.regexp_replace(s, U + a, str(b)) if regex else F.replace(s, F.lit(a), F.lit(str(b)))
        return {c: s}

    return over_text(df, column, build)


@operator("nlp.text_mask_pii")
def text_mask_pii(df: DataFrame, column: str | None = None) -> DataFrame:
    return over_text(df, column, lambda c, s: {c: reduce(lambda x, p: F.regexp_replace(x, U + p[0], p[1]), PERSONAL, s)})


@operator("nlp.text_truncate_pad")
def text_truncate_pad(df: DataFrame, column: str | None = None, max_words: int = 128, pad_token: str = "") -> DataFrame:
    def build(c, s):
        w = F.slice(spaced(s), 1, max_words)
        if pad_token:
            w = F.concat(w, F.array_repeat(F.lit(pad_token), F.lit(max_words) - F.size(w)))
        return {c: F.array_join(w, " ")}

    return over_text(df, column, build)


@operator("nlp.text_concat")
def text_concat(df: DataFrame, columns: Sequence[str] | None = None, separator: str = " ", new_name: str = "text_combined") -> DataFrame:
    cols = resolve_all(df, columns) if columns else text_cols(df)
    if len(cols) < 2:
        raise ValueError("two text columns are needed")
    return df.withColumn(new_name, strip(F.concat_ws(separator, *[text(c) for c in cols])))


@operator("nlp.text_extract_numbers")
def text_extract_numbers(df: DataFrame, column: str | None = None) -> DataFrame:
    return over_text(df, column, lambda c, s: {f"{c}_numbers": F.array_join(find(s, PATTERNS["number"]), ","),
                                               f"{c}_number_count": count(s, PATTERNS["number"])})


def named_patterns(name: str) -> dict[str, str]:
    if name == "all":
        return PATTERNS
    if name not in PATTERNS:
        raise ValueError(f"unknown pattern {name!r}; use all or one of {sorted(PATTERNS)}")
    return {name: PATTERNS[name]}


@operator("nlp.regex_extract")
def regex_extract(df: DataFrame, column: str | None = None, pattern: str = "all", regex: str | None = None) -> DataFrame:
    chosen = {"custom": regex} if regex else named_patterns(pattern)
    return over_text(df, column, lambda c, s: {k: v for n, p in chosen.items() for k, v in (
        (f"{c}_{n}_count", count(s, p)), (f"{c}_{n}_found", F.array_join(F.slice(find(s, p), 1, 5), ",")))})


@operator("nlp.named_entity_extract")
def named_entity_extract(df: DataFrame, column: str | None = None, entity: str = "all") -> DataFrame:
    c = first_text(df, column)
    chosen = PATTERNS if entity == "all" else {entity: PATTERNS.get(entity, entity)}
    return df.withColumns({f"{c}_{n}": F.array_join(find(text(c), p), ", ") for n, p in chosen.items()})


def safe_pattern(pattern: str) -> str:
    try:
        re.compile(re.sub(r"\\p\{\w+\}", "a", pattern))
        return pattern
    except re.error:
        return re.escape(pattern)


@operator("nlp.text_count_pattern")
def text_count_pattern(df: DataFrame, column: str | None = None, pattern: str = "", filter: bool = False) -> DataFrame:
    if not pattern:
        raise ValueError("pattern is required")
    out = f"count_{pattern[:20]}"
    done = df.withColumn(out, count(text(first_text(df, column)), safe_pattern(pattern)))
    return done.where(col(out) > 0) if filter else done


@operator("nlp.text_pattern_match")
def text_pattern_match(df: DataFrame, column: str | None = None, pattern: str = "") -> DataFrame:
    if not pattern:
        raise ValueError("pattern is required")
    return df.where(col(first_text(df, column)).rlike("(?Ui)" + pattern))


@operator("nlp.text_filter")
def text_filter(df: DataFrame, column: str | None = None, min_len: int | None = None, max_len: int | None = None,
                min_words: int | None = None, contains: str | None = None, not_contains: str | None = None) -> DataFrame:
    s = text(first_text(df, column))
    tests = []
    if min_len is not None:
        tests.append(F.length(s) >= min_len)
    if max_len is not None:
        tests.append(F.length(s) <= max_len)
    if min_words is not None:
        tests.append(F.size(spaced(s)) >= min_words)
    if contains is not None:
        tests.append(s.rlike("(?Ui)" + contains))
    if not_contains is not None:
        tests.append(~s.rlike("(?Ui)" + not_contains))
    return df.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


@operator("nlp.text_label_rules")
def text_label_rules(df: DataFrame, column: str | None = None, mapping: Mapping[str, Sequence[str]] | None = None,
                     default: str = "other") -> DataFrame:
    if not mapping:
        raise ValueError("mapping is required")
    c = first_text(df, column)
    low = F.lower(text(c))
    out = F.when(F.lit(False), "")
    for label, keys in mapping.items():
        for k in keys:
            out = out.when(low.contains(k.lower()), str(label))
    return df.withColumn(f"{c}_label", out.otherwise(default))


@operator("nlp.char_features")
def char_features(df: DataFrame, column: str | None = None) -> DataFrame:
    def build(c, s):
        n = F.greatest(F.length(s), F.lit(1))
        w = case_words(s)
        letters = F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x))
        punct = count(s, r"[^\p{L}\p{N}_\s]")
        return {f"{c}_char_count": F.length(s), f"{c}_punct_count": punct, f"{c}_punct_ratio": r(punct / n),
                f"{c}_digit_ratio": r(count(s, r"\d") / n), f"{c}_upper_ratio": r(count(s, "[A-Z]") / n),
                f"{c}_lower_ratio": r(count(s, "[a-z]") / n), f"{c}_space_ratio": r(count(s, r"\s") / n),
                f"{c}_special_ratio": r(count(s, r"[^a-zA-Z0-9\s]") / n),
                f"{c}_avg_word_len": F.coalesce(r(safe_div(letters, F.size(w)), 2), F.lit(0.0))}

    return over_text(df, column, build)


def sentences(s: Column) -> Column:
    return F.filter(F.split(s, "[.!?]+"), lambda x: strip(x) != "")


@operator("nlp.sentence_features")
def sentence_features(df: DataFrame, column: str | None = None) -> DataFrame:
    def build(c, s):
        n = F.transform(sentences(s), lambda x: F.size(spaced(x)))
        total = F.aggregate(n, F.lit(0), lambda a, x: a + x)
        return {f"{c}_sent_count": F.size(n), f"{c}_sent_avg_len": F.coalesce(r(safe_div(total, F.size(n)), 2), F.lit(0.0)),
                f"{c}_sent_max_len": F.coalesce(F.array_max(n), F.lit(0)), f"{c}_sent_min_len": F.coalesce(F.array_min(n), F.lit(0)),
                f"{c}_question_count": count(s, r"\?"), f"{c}_exclamation_count": count(s, "!")}

    return over_text(df, column, build)


@operator("nlp.text_pos_patterns")
def text_pos_patterns(df: DataFrame, column: str | None = None) -> DataFrame:
    def build(c, s):
        w = case_words(s)
        n = F.greatest(F.size(w), F.lit(1))
        up = lambda x: x.rlike(r"\p{Lu}") & (F.upper(x) == x)
        return {f"{c}_all_caps_ratio": r(F.size(F.filter(w, lambda x: up(x) & (F.length(x) > 1))) / n),
                f"{c}_capitalized_ratio": r(F.size(F.filter(w, lambda x: x.rlike(r"^\p{Lu}") & ~up(x))) / n),
                f"{c}_numeric_word_ratio": r(F.size(F.filter(w, lambda x: x.rlike(r"(?U)^\d+$"))) / n)}

    return over_text(df, column, build)


@operator("nlp.emoji_features")
def emoji_features(df: DataFrame, column: str | None = None) -> DataFrame:
    def build(c, s):
        found = F.regexp_extract_all(s, F.lit(f"({EMOJI})"), F.lit(0))
        face = F.regexp_count(s, F.lit(EMOTICON))
        total = F.size(found) + face
        return {f"{c}_emoji_count": F.size(found), f"{c}_emoticon_count": face, f"{c}_emoji_total": total,
                f"{c}_emoji_ratio": r(total / F.greatest(F.length(s), F.lit(1))),
                f"{c}_emojis_found": F.array_join(F.slice(found, 1, 10), ",")}

    return over_text(df, column, build)


@operator("nlp.readability_score")
def readability_score(df: DataFrame, column: str | None = None) -> DataFrame:
    out = df
    for c in pick_many(df, column, "text"):
        # words and counts are columns of their own, so that each is computed once
        t = out.withColumns({"_w": case_words(text(c)), "_ns": F.greatest(F.size(sentences(text(c))), F.lit(1)).cast("double")})
        t = t.withColumns({
            "_nw": F.greatest(F.size("_w"), F.lit(1)).cast("double"), "_chars": F.length(F.array_join("_w", "")),
            "_syllables": F.aggregate(F.split(F.regexp_replace(F.lower(F.array_join("_w", " ")), "e+( |$)", "$1"), " "), F.lit(0),
                                      lambda a, x: a + F.greatest(F.lit(1), F.regexp_count(x, F.lit("[aeiouy]+"))))})
        t = t.withColumn("_syllables", F.when(F.size("_w") > 0, F.col("_syllables")).otherwise(F.lit(0)))
        per_sentence, per_word, size = F.col("_nw") / F.col("_ns"), F.col("_syllables") / F.col("_nw"), F.col("_chars") / F.col("_nw")
        flesch = 206.835 - 1.015 * per_sentence - 84.6 * per_word
        out = t.withColumns({f"{c}_flesch_score": r(F.greatest(F.lit(0.0), F.least(flesch, F.lit(120.0))), 1),
                             f"{c}_coleman_liau": r(0.0588 * (size * 100) - 0.296 * (F.col("_ns") / F.col("_nw") * 100) - 15.8, 1),
                             f"{c}_ari_score": r(4.71 * size + 0.5 * per_sentence - 21.43, 1)}).drop("_w", "_ns", "_nw", "_chars", "_syllables")
    return out


@operator("nlp.sentiment_score")
def sentiment_score(df: DataFrame, column: str | None = None) -> DataFrame:
    def build(c, s):
        w = words(s)
        n = F.greatest(F.size(w), F.lit(1))
        pos = F.size(F.filter(w, lambda x: x.isin(POSITIVE)))
        neg = F.size(F.filter(w, lambda x: x.isin(NEGATIVE)))
        mix = r((pos - neg) / n)
        return {f"{c}_sentiment_pos": r(pos / n), f"{c}_sentiment_neg": r(neg / n), f"{c}_sentiment_compound": mix,
                f"{c}_sentiment_label": F.when(mix > 0.05, "positive").when(mix < -0.05, "negative").otherwise("neutral")}

    return over_text(df, column, build)


@operator("nlp.language_detect")
def language_detect(df: DataFrame, column: str | None = None) -> DataFrame:
    """Script with most characters; equal counts go to the script listed first."""
    def build(c, s):
        counts = [F.struct(F.regexp_count(s, F.lit(rf"[\x{{{a}}}-\x{{{b}}}]")).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("s"))
                  for i, (name, a, b) in enumerate(SCRIPTS)]
        best = F.array_max(F.array(*counts))
        return {f"{c}_language": F.when(strip(s) == "", "empty").when(best["n"] == 0, "unknown").otherwise(best["s"])}

    return over_text(df, column, build)


@operator("nlp.text_diversity_index")
def text_diversity_index(df: DataFrame, column: str | None = None) -> DataFrame:
    """Simpson diversity, from the word counts of each text."""
    def build(c, s):
        k = word_pairs(F.array_join(words(s), " "))
        n = k["n"].cast("double")
        return {f"{c}_diversity": F.when(n <= 1, 0.0).otherwise(r(1 - k["same"] / (n * (n - 1))))}

    return over_text(df, column, build)


def jaccard(a: Column, b: Column) -> Column:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.coalesce(r(safe_div(both, either)), F.lit(0.0))


@operator("nlp.word_overlap")
def word_overlap(df: DataFrame, columns: Sequence[str] | None = None, column: str | None = None,
                 order_by: Sequence[str] = ()) -> DataFrame:
    """Jaccard of the words of two columns, or of each row with the row before it."""
    if columns and len(columns) >= 2:
        a, b = resolve_all(df, columns[:2])
        return df.withColumn(f"{a}_{b}_jaccard", jaccard(words(text(a)), words(text(b))))
    c = first_text(df, column)
    ix = index_rows(df, order_by).windowed(lambda w: {"_prev": F.lag(text(c)).over(w)}, before=1)
    return ix.result().withColumn(f"{c}_row_overlap", F.when(F.col("_prev").isNull(), 0.0).otherwise(
        jaccard(words(F.col("_prev")), words(text(c))))).drop("_prev")


@operator("nlp.text_window")
def text_window(df: DataFrame, column: str | None = None, keyword: str = "", window: int = 5,
                key: Sequence[str] = ()) -> DataFrame:
    """One row per hit: key columns, keyword, position and the words around it."""
    if not keyword:
        raise ValueError("keyword is required")
    c = first_text(df, column)
    w = F.col("_w")
    at = F.filter(F.transform(w, lambda x, i: F.when(F.lower(x).contains(keyword.lower()), i)), lambda i: i.isNotNull())
    hits = df.select(*[col(k) for k in resolve_all(df, key)], spaced(text(c)).alias("_w")).withColumn("position", F.explode(at))
    start = F.greatest(F.col("position") - window, F.lit(0))
    stop = F.least(F.col("position") + window + 1, F.size(w))
    return hits.select(*[col(k) for k in key], F.lit(keyword).alias("keyword"), "position",
                       F.array_join(F.slice(w, start + 1, stop - start), " ").alias("context"))


@operator("nlp.text_chunk")
def text_chunk(df: DataFrame, column: str | None = None, chunk_size: int = 200, overlap: int = 20) -> DataFrame:
    c = first_text(df, column)
    step = max(chunk_size - overlap, 1)
    w = F.col("_w")
    n = F.size(w)
    long = n > chunk_size
    starts = F.when(long, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array(F.lit(0)))
    total = F.when(long, F.greatest(F.lit(1), F.ceil((n - overlap) / F.lit(step))).cast("int")).otherwise(1)
    out = df.withColumn("_w", spaced(text(c))).withColumn("_chunk_total", total)
    out = out.select("*", F.posexplode(starts).alias("_chunk_id", "_start"))
    return out.withColumn(c, F.when(long, F.array_join(F.slice(w, F.col("_start") + 1, F.lit(chunk_size)), " ")).otherwise(col(c))).drop("_w", "_start")


def split_rows(df: DataFrame, column, pattern: str, id_name: str, total_name: str) -> DataFrame:
    c = first_text(df, column)
    parts = F.filter(F.transform(F.split(text(c), pattern), strip), lambda x: x != "")
    parts = F.when(F.size(parts) > 0, parts).otherwise(F.array(text(c)))
    out = df.withColumn("_parts", parts).withColumn(total_name, F.size("_parts"))
    return out.select("*", F.posexplode("_parts").alias(id_name, "_part")).withColumn(c, F.col("_part")).drop("_parts", "_part")


@operator("nlp.text_split_sentences")
def text_split_sentences(df: DataFrame, column: str | None = None) -> DataFrame:
    return split_rows(df, column, r"(?U)(?<=[.!?])\s+", "_sentence_id", "_sentence_total")


@operator("nlp.text_to_paragraphs")
def text_to_paragraphs(df: DataFrame, column: str | None = None) -> DataFrame:
    return split_rows(df, column, r"(?U)\n\s*\n", "_para_id", "_para_total")


@operator("nlp.text_augment")
def text_augment(df: DataFrame, column: str | None = None, n: int = 1, strategy: str = "mixed", seed: int = 42) -> DataFrame:
    """Append n copies with one word deleted or two neighbours swapped, chosen by a seeded hash of the text."""
    if strategy not in ("delete", "swap", "mixed"):
        raise ValueError(f"unknown strategy {strategy!r}")
    c = first_text(df, column)
    parts = [df]
    for i in range(n):
        w, size = F.col("_w"), F.size("_w")
        pick_at = F.pmod(F.xxhash64(F.lit(seed + i), text(c)), size.cast("long")).cast("int")
        swap_at = F.pmod(F.xxhash64(F.lit(seed + i), text(c)), F.greatest(size - 1, F.lit(1)).cast("long")).cast("int")
        deleted = F.concat(F.slice(w, F.lit(1), F.col("_d")), F.slice(w, F.col("_d") + 2, size))
        swapped = F.concat(F.slice(w, F.lit(1), F.col("_s")), F.slice(w, F.col("_s") + 2, F.lit(1)),
                           F.slice(w, F.col("_s") + 1, F.lit(1)), F.slice(w, F.col("_s") + 3, size))
        coin = {"delete": F.lit(True), "swap": F.lit(False),
                "mixed": F.pmod(F.xxhash64(F.lit(seed + 7919 + i), text(c)), F.lit(2)) == 0}[strategy]
        t = df.withColumn("_w", spaced(text(c))).withColumns({"_d": pick_at, "_s": swap_at, "_coin": coin})
        parts.append(t.withColumn(c, F.when(size < 3, text(c)).otherwise(
            F.array_join(F.when(F.col("_coin"), deleted).otherwise(swapped), " "))).drop("_w", "_d", "_s", "_coin"))
    return reduce(DataFrame.unionByName, parts)


def label_text(df: DataFrame, name: str | None, most: int) -> str:
    """The given column, else the first text column with at most ``most`` values."""
    if name is not None:
        return resolve(df, name)
    cats = text_cols(df)
    few = fit(df, **{f"c{i}": F.count_distinct(col(c)) for i, c in enumerate(cats)}) if cats else {}
    found = [c for i, c in enumerate(cats) if few[f"c{i}"] <= most]
    if not found:
        raise ValueError(f"no text column with at most {most} values")
    return found[0]


@operator("nlp.text_oversample")
def text_oversample(df: DataFrame, column: str | None = None, seed: int = 42) -> DataFrame:
    return oversample(df, label_text(df, column, 20), seed)


@operator("nlp.text_stratified_sample")
def text_stratified_sample(df: DataFrame, column: str | None = None, n: int = 100, seed: int = 42) -> DataFrame:
    c = label_text(df, column, 30)
    k = fit(df, k=F.count_distinct(col(c)))["k"]
    return shuffled_position(df, c, seed).where(F.col("_pos") < max(1, n // max(k, 1))).drop("_pos")


@operator("nlp.class_balance_text")
def class_balance_text(df: DataFrame, column: str | None = None, text_column: str | None = None) -> DataFrame:
    c = label_text(df, column, 50)
    aggs = [F.count(F.lit(1)).alias("count")]
    if text_column:
        s = text(resolve(df, text_column))
        aggs += [F.round(F.avg(F.length(s)), 1).alias("avg_text_length"), F.round(F.avg(F.size(spaced(s))), 1).alias("avg_word_count")]
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    g = df.where(col(c).isNotNull()).groupBy(col(c).cast("string").alias("label")).agg(*aggs)
    return (g.crossJoin(F.broadcast(total)).withColumn("percentage", r(F.col("count") / F.col("_n") * 100, 2)).drop("_n")
            .orderBy(F.desc("count"), "label"))


@operator("nlp.text_length_dist")
def text_length_dist(df: DataFrame, column: str | None = None) -> DataFrame:
    s = text(first_text(df, column))
    sizes = df.select(F.length(s).alias("c"), F.size(spaced(s)).alias("w"))
    q = fit_quantiles(sizes, ["c", "w"], [0.5])
    med = {k: F.lit(float(int(q[k][0]))) if k in q else F.lit(None).cast("double") for k in "cw"}
    stats = {"count": F.count("c"), "mean_chars": F.round(F.avg("c"), 1), "median_chars": F.max(med["c"]),
             "std_chars": F.round(F.stddev_samp("c"), 1), "min_chars": F.min("c"), "max_chars": F.max("c"),
             "mean_words": F.round(F.avg("w"), 1), "median_words": F.max(med["w"]), "min_words": F.min("w"),
             "max_words": F.max("w"), "empty_rows": F.count_if(F.col("c") == 0), "single_word_rows": F.count_if(F.col("w") <= 1)}
    one = sizes.agg(*[v.cast("double").alias(k) for k, v in stats.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in stats])))


def exploded(df: DataFrame, c: str, tokens=words) -> DataFrame:
    return df.select(F.explode(tokens(text(c))).alias("word"))


def word_counts(df: DataFrame, c: str, tokens=words) -> DataFrame:
    return exploded(df, c, tokens).groupBy("word").agg(F.count(F.lit(1)).alias("count"))


@operator("nlp.word_frequency")
def word_frequency(df: DataFrame, column: str | None = None, n: int = 20, remove_stopwords: bool = True) -> DataFrame:
    c = first_text(df, column)
    counts = word_counts(df, c)
    if remove_stopwords:
        counts = counts.where(~F.col("word").isin(STOPWORDS))
    total = counts.agg(F.sum("count").alias("_t"))
    return counts.orderBy(F.desc("count"), "word").limit(n).crossJoin(F.broadcast(total)).select(
        "word", "count", r(F.col("count") / F.col("_t") * 100, 2).alias("percentage")).orderBy(F.desc("count"), "word")


@operator("nlp.word_cloud")
def word_cloud(df: DataFrame, column: str | None = None, n: int = 40) -> DataFrame:
    """Weights of the n most frequent words; percentages are of the shown words."""
    c = first_text(df, column)
    top = (word_counts(df, c).where(~F.col("word").isin(STOPWORDS) & (F.length("word") > 2))
           .orderBy(F.desc("count"), "word").limit(n))
    w = Window.partitionBy(F.lit(1))  # at most n rows
    return top.select("word", F.col("count").alias("weight"), r(F.col("count") / F.sum("count").over(w) * 100, 2).alias("percentage"))


def grams(tokens: Column, n: int) -> Column:
    """n-grams of an array of tokens without spaces, as text: at every word of the joined tokens the next n words."""
    ahead = rf"(?<![^ ])(?=([^ ]++(?: [^ ]++){{{n - 1}}}))"
    return F.regexp_extract_all(F.array_join(tokens, " "), F.lit(ahead), F.lit(1))


@operator("nlp.text_ngram_frequency")
def text_ngram_frequency(df: DataFrame, column: str | None = None, n: int = 2, top: int = 20) -> DataFrame:
    c = first_text(df, column)
    rows = df.select(without(words(text(c)), STOPWORDS).alias("_t")).select(F.explode(grams(F.col("_t"), n)).alias("ngram"))
    return rows.groupBy("ngram").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "ngram").limit(top)


@operator("nlp.collocations")
def collocations(df: DataFrame, column: str | None = None, n: int = 20) -> DataFrame:
    """PMI of the 3n most frequent word pairs seen at least twice; the n best."""
    c = first_text(df, column)
    base = df.select(F.filter(without(words(text(c)), STOPWORDS), lambda w: F.length(w) > 1).alias("_t"))
    bi = base.select(F.explode(grams(F.col("_t"), 2)).alias("collocation")).groupBy("collocation").agg(F.count(F.lit(1)).alias("frequency"))
    top = [(x["collocation"], x["frequency"]) for x in bi.orderBy(F.desc("frequency"), "collocation").limit(3 * n).collect() if x["frequency"] >= 2]
    named = sorted({w for pair, _ in top for w in pair.split(" ")})  # at most 6n words
    uni = base.select(F.posexplode("_t").alias("_i", "word")).groupBy(F.when(F.col("word").isin(named), F.col("word")).alias("word")).agg(
        F.count(F.lit(1)).alias("k"), F.count_if(F.col("_i") == 0).alias("texts")).collect()
    k = {x["word"]: x["k"] for x in uni}
    nu, nb = sum(x["k"] for x in uni), sum(x["k"] - x["texts"] for x in uni)
    rows = [(pair, seen, *[k[w] for w in pair.split(" ")]) for pair, seen in top]
    t = df.sparkSession.createDataFrame(rows, "collocation string, frequency long, ka long, kb long")
    expected = F.col("ka") / F.lit(nu) * (F.col("kb") / F.lit(nu))
    pmi = F.log2(F.col("frequency") / F.lit(nb) / F.greatest(expected, F.lit(1e-10)))
    return t.select("collocation", "frequency", r(pmi, 3).alias("pmi")).orderBy(F.desc("pmi"), "collocation").limit(n)


@operator("nlp.vocab_stats")
def vocab_stats(df: DataFrame, column: str | None = None) -> DataFrame:
    parts = []
    for c in pick_many(df, column, "text"):
        counts = word_counts(df, c)
        one = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("u"),
                         F.coalesce(F.sum(F.col("count") * F.length("word")), F.lit(0)).alias("l"), F.count_if(F.col("count") == 1).alias("h"))
        top = counts.orderBy(F.desc("count"), "word").limit(5).agg(F.array_join(F.transform(F.array_sort(F.collect_list(
            F.struct((-F.col("count")).alias("k"), "word"))), lambda x: x["word"]), ", ").alias("top"))
        docs = df.agg(F.count_if(F.length(text(c)) > 0).alias("d"), F.count_if(F.length(text(c)) == 0).alias("e"))
        parts.append(one.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(docs)).select(
            F.lit(c).alias("column"), F.col("t").alias("total_tokens"), F.col("u").alias("unique_tokens"),
            r(F.col("u") / F.greatest("t", F.lit(1))).alias("type_token_ratio"),
            r(F.col("l") / F.greatest("t", F.lit(1)), 2).alias("avg_word_length"), F.col("h").alias("hapax_legomena"),
            r(F.col("h") / F.greatest("u", F.lit(1))).alias("hapax_ratio"), F.col("top").alias("top_5_words"),
            F.col("d").alias("docs_with_text"), F.col("e").alias("empty_docs")))
    return reduce(DataFrame.unionByName, parts)


def text_key(c: str) -> Column:
    """Identity of a text: 128 bits of hash. Equal texts get equal corpus features, so they may share a key."""
    return F.struct(F.xxhash64(F.lit(1), text(c)).alias("a"), F.xxhash64(F.lit(2), text(c)).alias("b"))


def keyed_words(df: DataFrame, c: str, tokens: Column) -> DataFrame:
    """Rows ``_key, word``. The key is made before the words: beside ``explode`` it would be made anew for every word."""
    return df.select(text_key(c).alias("_key"), tokens.alias("_t")).select("_key", F.explode("_t").alias("word"))


def lone_words(df: DataFrame, c: str, tokens: Column) -> DataFrame:
    """Rows ``_key, word`` of the words that the corpus holds once; the halves of the key are smallest ones of one row."""
    held = keyed_words(df, c, tokens).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min("_key.a").alias("a"), F.min("_key.b").alias("b"))
    return held.where(F.col("n") == 1).select(F.struct("a", "b").alias("_key"), "word")


def by_text(df: DataFrame, table: DataFrame, c: str) -> DataFrame:
    """Join a per-text table (``_key``) back to the rows."""
    return df.withColumn("_k", text_key(c)).join(table, F.col("_k") == F.col("_key"), "left").drop("_k", "_key")


@operator("nlp.spelling_features")
def spelling_features(df: DataFrame, column: str | None = None) -> DataFrame:
    """Words of more than two letters that the whole corpus holds once: such a word names its only text."""
    out = df
    for c in pick_many(df, column, "text"):
        tokens = F.filter(F.regexp_extract_all(F.lower(text(c)), F.lit(r"(?U)\b[a-zA-Z]+\b"), F.lit(0)), lambda w: F.length(w) > 2)
        table = lone_words(df, c, tokens).groupBy("_key").agg(F.count(F.lit(1)).alias("_oov"))
        out = by_text(out, table, c).withColumn("_total", F.size(tokens))
        oov = F.coalesce("_oov", F.lit(0))
        out = out.withColumns({f"{c}_oov_count": oov, f"{c}_oov_ratio": F.coalesce(r(safe_div(oov, F.col("_total"))), F.lit(0.0))}).drop("_oov", "_total")
    return out


@operator("nlp.text_unique_words")
def text_unique_words(df: DataFrame, column: str | None = None, shown: int = 10) -> DataFrame:
    """Words found in one document only: the first ``shown`` of a document and how many are shown."""
    c = first_text(df, column)
    tokens = F.array_distinct(without(words(text(c)), STOPWORDS))
    table = lone_words(df, c, tokens).groupBy("_key").agg(F.slice(F.array_sort(F.collect_list("word")), 1, shown).alias("_u"))  # words of one text
    u = F.coalesce(F.col("_u"), F.array().cast("array<string>"))
    return by_text(df, table, c).withColumns({f"{c}_unique_words": F.array_join(u, ", "), f"{c}_unique_count": F.size(u)}).drop("_u")


@operator("nlp.text_remove_rare")
def text_remove_rare(df: DataFrame, column: str | None = None, min_freq: int = 2) -> DataFrame:
    out = df
    for c in pick_many(df, column, "text"):
        rare = word_counts(df, c).where(F.col("count") < min_freq).select("word")
        held = keyed_words(df, c, F.array_distinct(words(text(c)))).join(rare, "word")
        table = held.groupBy("_key").agg(F.collect_set("word").alias("_rare"))  # words of one text, each in few texts
        kept = F.filter(spaced(text(c)), lambda w: ~F.array_contains(F.col("_rare"), F.lower(w)))
        out = by_text(out, table, c).withColumn(c, F.array_join(
            F.when(F.col("_rare").isNull(), spaced(text(c))).otherwise(kept), " ")).drop("_rare")
    return out


def top_words(df: DataFrame, c: str, n: int, tokens=words) -> list[str]:
    """The n most frequent words, ties by word: at most n rows reach the driver."""
    return [x["word"] for x in word_counts(df, c, tokens).orderBy(F.desc("count"), "word").limit(n).collect()]


@operator("nlp.text_encode")
def text_encode(df: DataFrame, column: str | None = None, max_vocab: int = 5000, max_len: int = 100) -> DataFrame:
    """Word numbers by corpus frequency from 2 on; 0 pads, 1 is an unknown word."""
    out = df
    for c in pick_many(df, column, "text"):
        vocab = {w: str(i + 2) for i, w in enumerate(top_words(df, c, max_vocab))}

        @F.pandas_udf("string")
        def encode(tokens: pd.Series) -> pd.Series:
            return tokens.map(lambda ws: ",".join([vocab.get(w, "1") for w in ws] + ["0"] * (max_len - len(ws))))

        out = out.withColumns({f"{c}_encoded": encode(F.slice(words(text(c)), 1, max_len)), f"{c}_vocab_size": F.lit(len(vocab) + 2)})
    return out


def vector_stopwords(stop_words: Sequence[str] | None) -> list[str]:
    """Given words, or Spark's own English list."""
    return list(stop_words) if stop_words is not None else StopWordsRemover.loadDefaultStopWords("english")


def terms(stop: Sequence[str], n: int = 1):
    """Words of at least two characters without stopwords, or their n-grams."""
    def tokens(s: Column) -> Column:
        t = without(F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)), stop)
        return t if n == 1 else grams(t, n)

    return tokens


def count_array(df: DataFrame, c: str, vocab: Sequence[str], tokens, out: str) -> DataFrame:
    """Counts of the vocabulary words of each row, as an array in vocabulary order."""
    if not vocab:
        raise ValueError("the vocabulary is empty")
    model = CountVectorizerModel.from_vocabulary(list(vocab), inputCol="_t", outputCol="_v", minTF=1.0)
    return model.transform(df.withColumn("_t", tokens(text(c)))).withColumn(out, vector_to_array("_v")).drop("_t", "_v")


def spread(df: DataFrame, array: str, names: Sequence[str], whole: bool = False) -> DataFrame:
    return df.withColumns({n: F.col(array)[i].cast("int") if whole else F.col(array)[i] for i, n in enumerate(names)}).drop(array)


@operator("nlp.bow")
def bow(df: DataFrame, column: str | None = None, n: int = 50, stop_words: Sequence[str] | None = None) -> DataFrame:
    out, tokens = df, terms(vector_stopwords(stop_words))
    for c in pick_many(df, column, "text"):
        vocab = sorted(top_words(df, c, n, tokens))
        out = spread(count_array(out, c, vocab, tokens, "_a"), "_a", [f"{c}_bow_{w}" for w in vocab], True)
    return out


@operator("nlp.doc_term_matrix")
def doc_term_matrix(df: DataFrame, column: str | None = None, n: int = 100, stop_words: Sequence[str] | None = None) -> DataFrame:
    c, tokens = first_text(df, column), terms(vector_stopwords(stop_words))
    vocab = sorted(top_words(df, c, n, tokens))
    out = spread(count_array(df, c, vocab, tokens, "_a"), "_a", [f"_term_{i}" for i in range(len(vocab))], True)
    return out.select(*[F.col(f"_term_{i}").alias(w) for i, w in enumerate(vocab)])


def idf_weights(df: DataFrame, c: str, n: int, tokens) -> dict[str, float]:
    """Smoothed inverse document frequency of the n most frequent terms."""
    seen = df.select(tokens(text(c)).alias("_t"))
    vocab = (seen.select(F.explode("_t").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("count"))
             .orderBy(F.desc("count"), "word").limit(n))
    found = [x["word"] for x in vocab.collect()]  # at most n rows
    if not found:
        raise ValueError("the vocabulary is empty")
    df_rows = (seen.select(F.explode(F.array_distinct(F.filter("_t", lambda w: w.isin(found)))).alias("word"))
               .groupBy("word").count().collect())  # at most n rows
    total = df.count()
    return {x["word"]: float(np.log((1 + total) / (1 + x["count"])) + 1) for x in sorted(df_rows, key=lambda x: x["word"])}


def tfidf_array(df: DataFrame, c: str, idf: Mapping[str, float], tokens, out: str) -> DataFrame:
    """Unit-length tf-idf weights of each row, as an array in vocabulary order."""
    counted = count_array(df, c, list(idf), tokens, "_raw")
    raw = F.zip_with("_raw", F.lit(list(idf.values())), lambda a, b: a * b)
    return counted.withColumn(out, unit_length(raw)).drop("_raw")


@operator("nlp.tfidf")
def tfidf(df: DataFrame, column: str | None = None, n: int = 50, stop_words: Sequence[str] | None = None) -> DataFrame:
    out, tokens = df, terms(vector_stopwords(stop_words))
    for c in pick_many(df, column, "text"):
        idf = idf_weights(df, c, n, tokens)
        out = spread(tfidf_array(out, c, idf, tokens, "_a"), "_a", [f"{c}_tfidf_{w}" for w in idf])
    return out


@operator("nlp.ngrams")
def ngrams(df: DataFrame, column: str | None = None, n: int = 2, max_features: int = 30,
           stop_words: Sequence[str] | None = None) -> DataFrame:
    out, tokens = df, terms(vector_stopwords(stop_words), n)
    for c in pick_many(df, column, "text"):
        idf = idf_weights(df, c, max_features, tokens)
        out = spread(tfidf_array(out, c, idf, tokens, "_a"), "_a", [f"{c}_{n}gram_{w.replace(' ', '_')}" for w in idf])
    return out


def numbered_rows(df: DataFrame) -> DataFrame:
    """The rows, written once, with a number ``_row`` that stays theirs."""
    return reliable_checkpoint(df.withColumn("_row", F.monotonically_increasing_id()))


@operator("nlp.keyword_extract")
def keyword_extract(df: DataFrame, column: str | None = None, n: int = 5, vocab: int | None = None,
                    stop_words: Sequence[str] | None = None) -> DataFrame:
    """Best tf-idf words of each text, out of all words of the corpus (``vocab``: of the most frequent ones only);
    equal weights go to the later word in the alphabet. A text without words has none.

    Words meet their corpus counts by a join; of a text's words only its best ``n`` of each task reach the shuffle.
    """
    cols, tokens = pick_many(df, column, "text"), terms(vector_stopwords(stop_words))
    out = numbered_rows(df)
    for c in cols:
        weighted = weighted_terms(out, "_row", tokens(text(c)), vocab)
        best = weighted.withColumn("_n", F.row_number().over(Window.partitionBy("_row").orderBy(F.desc("w"), F.desc("term")))).where(F.col("_n") <= n)
        words_of = best.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_n", "term"))).alias("_k"))
        out = out.join(words_of, "_row", "left").withColumn(f"{c}_keywords", F.coalesce(F.array_join(F.col("_k.term"), ", "), F.lit(""))).drop("_k")
    return out.drop("_row")


@operator("nlp.hash_vectorize")
def hash_vectorize(df: DataFrame, column: str | None = None, n: int = 32) -> DataFrame:
    """Unit-length counts of words hashed into n slots (xxhash64)."""
    out = df
    for c in pick_many(df, column, "text"):
        slots = F.transform(F.regexp_extract_all(F.lower(text(c)), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)),
                            lambda w: F.pmod(F.xxhash64(w), F.lit(n)).cast("int"))
        counts = once(slots, lambda t: F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                                                   lambda i: F.size(F.filter(t, lambda s: s == i)).cast("double")))
        out = spread(out.withColumn("_a", unit_length(counts)), "_a", [f"{c}_hash_{i}" for i in range(n)])
    return out


@operator("nlp.text_similarity")
def text_similarity(df: DataFrame, column: str | None = None, order_by: Sequence[str] = (), k: int = 5, n: int | None = None,
                    vocab: int | None = None, stop_words: Sequence[str] | None = None) -> DataFrame:
    """Rows ``document, rank, neighbour, similarity``: of every text the ``k`` others with the largest tf-idf cosine.

    Texts are named by their place in ``order_by``. With ``n``, instead the cosine matrix of the first n texts.
    """
    c, tokens = first_text(df, column), terms(vector_stopwords(stop_words))
    ix = index_rows(df, order_by).df
    rows = ix.where(F.col("_idx") < n) if n is not None else ix
    vectors = reliable_checkpoint(tfidf_vectors(rows, "_idx", tokens(text(c)), vocab))
    if n is None:
        near = top_neighbours(vectors, "_idx", k)
        return near.select(F.col("id").alias("document"), "rank", F.col("other").alias("neighbour"), r("cosine", 3).alias("similarity"))
    flat = vectors.select(F.col("_idx").alias("i"), F.inline(F.arrays_zip("t", "w")))
    other = flat.select(F.col("i").alias("j"), "t", F.col("w").alias("v"))
    dots = flat.join(other, "t").groupBy("i", "j").agg(F.sum(F.col("w") * F.col("v")).alias("s"))
    places = F.sequence(F.lit(0).cast("long"), F.lit(rows.count() - 1).cast("long"))
    whole = rows.select(F.col("_idx").alias("i"), F.explode(places).alias("j")).join(dots, ["i", "j"], "left")  # n * n rows, as asked for
    return whole.groupBy(F.concat(F.lit("doc_"), F.col("i")).alias("document")).pivot("j", list(range(rows.count()))).agg(
        F.first(F.round(F.coalesce("s", F.lit(0.0)), 3))).select("document", *[F.col(str(j)).alias(f"doc_{j}") for j in range(rows.count())])


@operator("nlp.text_dedup")
def text_dedup(df: DataFrame, column: str | None = None, threshold: float = 0.9, action: str = "flag", order_by: Sequence[str] = (),
               vocab: int | None = None, stop_words: Sequence[str] | None = None) -> DataFrame:
    """Near duplicates by tf-idf cosine over all words: a text is a duplicate of the first kept text that it resembles.

    Exact: no pair at the threshold is missed (see ``functions.sparse.first_kept``). Texts with
    the same words as often are merged before. Texts without words are never duplicates.
    """
    if action not in ("flag", "remove"):
        raise ValueError("action must be flag or remove")
    c, tokens = first_text(df, column), terms(vector_stopwords(stop_words))
    ix = index_rows(df, order_by)
    vectors = reliable_checkpoint(tfidf_vectors(ix.df, "_idx", tokens(text(c)), vocab))
    prints = vectors.select("_idx", F.xxhash64("t", "w").alias("_a"), F.xxhash64(F.lit(1), "w", "t").alias("_b"))
    first = reliable_checkpoint(prints.groupBy("_a", "_b").agg(F.min("_idx").alias("_first")))  # 128 bits name a vector
    same = prints.join(first, ["_a", "_b"]).select("_idx", "_first")
    copies = narrow_table(same.where(F.col("_idx") != F.col("_first")))
    near = narrow_table(first_kept(vectors.join(copies.select("_idx"), "_idx", "left_anti"), "_idx", threshold))
    again = copies.join(near.withColumnRenamed("id", "_first"), "_first", "left").select("_idx", F.coalesce("of", "_first").alias("_of"))
    flagged = narrow_table(again.unionByName(near.select(F.col("id").alias("_idx"), F.col("of").alias("_of"))))
    out = ix.df.join(flagged, "_idx", "left").withColumns({
        "_text_is_duplicate": F.col("_of").isNotNull(), "_text_duplicate_of": F.coalesce("_of", F.lit(-1).cast("long"))}).drop("_idx", "_of")
    return out.where(~F.col("_text_is_duplicate")).drop("_text_is_duplicate", "_text_duplicate_of") if action == "remove" else out


@operator("nlp.text_dedup_exact")
def text_dedup_exact(df: DataFrame, column: str | None = None, keep: str = "first", order_by: Sequence[str] = ()) -> DataFrame:
    c = first_text(df, column)
    t = df.withColumn("_norm", F.sha2(strip(F.lower(text(c))), 256))
    return keep_one(t, ["_norm"], row_order(t, order_by), keep == "last").drop("_norm")


@operator("nlp.text_summary_report")
def text_summary_report(df: DataFrame, column: str | None = None) -> DataFrame:
    """Typed rows (metric, value) about one text column; every number comes from all rows."""
    c = first_text(df, column)
    s = text(c)
    n_words = F.size(spaced(s))
    scripts = {"thai": r"[\x{0E00}-\x{0E7F}]", "han": r"[\x{4E00}-\x{9FFF}]", "kana": r"[\x{3040}-\x{30FF}]"}
    shape = df.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(n_words), F.lit(0)).alias("words"), F.avg(n_words).alias("words_mean"),
                   F.min(n_words).alias("words_min"), F.max(n_words).alias("words_max"), F.count_if(strip(s) == "").alias("empty"),
                   F.count_if(n_words < 5).alias("under_five_words"), *[F.count_if(s.rlike(p)).alias(f"with_{k}") for k, p in scripts.items()])
    vocabulary = word_counts(df, c).agg(F.count(F.lit(1)).alias("distinct_tokens"), F.coalesce(F.sum("count"), F.lit(0)).alias("tokens"))
    kept = df.select(F.sha2(strip(F.lower(s)), 256).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("duplicates"))
    wide = shape.crossJoin(vocabulary).crossJoin(kept)  # one row each
    return wide.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.round(F.col(k).cast("double"), 4).alias("value")) for k in wide.columns])))
