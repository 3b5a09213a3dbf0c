"""Licence scans: a trained paragraph classifier with an unknown class, confirmed by templates. DataFrame operations and JVM models only.

A paragraph is a run of lines between blank lines, so a notice may be wrapped over lines.
It is read in windows of words that overlap by half; the longest template fits into half a
window, so every notice lies whole in one of them, however long the paragraph is. Word
n-grams are hashed to a sparse vector, a multinomial logistic regression names the family
or ``unknown``, and its probabilities are calibrated on rows it was not fitted on. A
prediction above the cut is a finding where the window holds most word pairs of one of the
predicted family's templates. That last test needs certain words, so windows without any
of them are passed over unseen by the model; the result is the same.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import saved

#: The usual notices of each family.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004"],
    "MIT": ["Released under the MIT License", "Licensed under the MIT License",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "Proprietary": ["All rights reserved"],
}
UNKNOWN = "unknown"
FEATURES = 1 << 13
SURROUNDINGS = 12  # corpus lines that notices are put beside
UNKNOWN_ROWS = 4_000  # bound of the sample of other paragraphs that the model is fitted on
CONFIRM = 0.75  # share of a template's word pairs that a finding holds
MIN_WINDOW = 64  # words; longer templates make longer windows
TRAINING_CHARS = 2_000  # windows of longer text (of very long words) are scanned but not trained on


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def word_pairs(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def gate_words(templates: dict[str, list[str]], confirm: float) -> list[str]:
    """Words of which a paragraph must contain one to hold the share ``confirm`` of any template's word pairs."""
    chosen: set[str] = set()
    for text in (t for family in templates.values() for t in family):
        pairs = [tuple(p.split()) for p in word_pairs(words_of(text))]

        def untouched() -> list[tuple]:
            return [p for p in pairs if not any(any(g in w for g in chosen) for w in p)]

        while len(left := untouched()) >= confirm * len(pairs):
            chosen.add(max((w for p in left for w in p), key=lambda w: (len(w), w)))
    return sorted(chosen)


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``key, _text, paragraph, body``: runs of lines that are not blank, by the 0-based number of their first line.

    ``_text`` is a hash of the text. A null text and one of blank lines have none.
    """
    lines = docs.select(F.col(f"`{key}`"), F.xxhash64(F.col(f"`{text}`")).alias("_text"), F.split(F.col(f"`{text}`"), "\n").alias("_l"))
    lines = lines.withColumn("_full", F.transform("_l", lambda x: x.rlike(r"\S")))
    numbers = F.sequence(F.lit(0), F.size("_l") - 1)

    def edge(step: int) -> Column:
        """Full lines whose neighbour on one side is blank or missing."""
        return F.filter(numbers, lambda i: F.get("_full", i) & ~F.coalesce(F.get("_full", i + step), F.lit(False)))

    lines = lines.where(F.col("_l").isNotNull()).withColumn("_runs", F.arrays_zip(edge(-1).alias("a"), edge(1).alias("b")))
    return lines.select(F.col(f"`{key}`"), "_text", F.inline(F.transform("_runs", lambda z: F.struct(
        z["a"].alias("paragraph"), F.array_join(F.slice("_l", z["a"] + 1, z["b"] - z["a"] + 1), "\n").alias("body")))))


def window_words(templates: dict[str, list[str]]) -> int:
    """Words of a window: twice the longest template, at least ``MIN_WINDOW``."""
    return max(MIN_WINDOW, 2 * max(len(words_of(t)) for family in templates.values() for t in family))


def windows(parts: DataFrame, size: int) -> DataFrame:
    """Split ``body`` of paragraphs into windows of ``size`` words, half a window apart: ``word`` is the first one's
    0-based number in the paragraph, ``body`` the words joined by spaces. Paragraphs without a word have none."""
    step = size // 2
    rest = [c for c in parts.columns if c != "body"]
    split = parts.select(*[F.col(f"`{c}`") for c in rest], _words(F.col("body")).alias("_w")).where(F.size("_w") > 0)
    last = F.ceil(F.greatest(F.size("_w") - size, F.lit(0)) / step).cast("int") * step
    return split.select(*[F.col(f"`{c}`") for c in rest], F.inline(F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i: F.struct(
        i.alias("word"), F.array_join(F.slice("_w", i + 1, size), " ").alias("body")))))


def _words(body: Column) -> Column:
    return F.regexp_extract_all(F.lower(body), F.lit("[a-z0-9]+"), F.lit(0))


def _pairs(words: Column) -> Column:
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def _triples(words: Column) -> Column:
    n = F.greatest(F.size(words) - 2, F.lit(0))
    return F.zip_with(_pairs(F.slice(words, 1, n + 1)), F.slice(words, 3, n), lambda a, b: F.concat_ws(" ", a, b))


def gated(rows: DataFrame, words: list[str], text: str = "body") -> DataFrame:
    low = F.lower(F.col(f"`{text}`"))
    test = F.lit(False)
    for w in words:
        test = test | F.contains(low, F.lit(w))
    return rows.where(test)


def _grams(rows: DataFrame) -> DataFrame:
    """Add ``_w`` (words), ``_p`` (pairs) and ``_g`` (all n-grams up to three words)."""
    rows = rows.withColumn("_w", _words(F.col("body"))).withColumn("_p", _pairs(F.col("_w")))
    return rows.withColumn("_g", F.concat("_w", "_p", _triples(F.col("_w"))))


def template_share(pairs: Column, texts: list[str]) -> Column:
    """Largest share of one template's word pairs that are among ``pairs``."""
    shares = []
    for t in texts:
        own = word_pairs(words_of(t))
        shares.append(F.size(F.array_intersect(F.array(*[F.lit(p) for p in own]), pairs)) / F.lit(len(own)))
    return F.greatest(*shares) if len(shares) > 1 else shares[0]


@dataclass
class LicenceModel:
    """The fitted classifier with its calibration: probabilities are sharpened or flattened by ``temperature``, and
    the best family counts from ``cut`` on."""

    model: LogisticRegressionModel
    families: list[str]
    temperature: float
    cut: float
    templates: dict[str, list[str]]
    confirm: float

    def probabilities(self, rows: DataFrame) -> DataFrame:
        """Add ``_q``, an array of calibrated probabilities in the order of ``families``."""
        scored = self.model.transform(HashingTF(numFeatures=FEATURES, binary=True, inputCol="_g", outputCol="features").transform(rows))
        return scored.withColumn("_q", _tempered(self.temperature))


def _tempered(t: float) -> Column:
    p = vector_to_array(F.col("probability"))
    powers = F.transform(p, lambda x: F.pow(F.greatest(x, F.lit(1e-12)), F.lit(1 / t)))
    return F.transform(F.array(powers), lambda q: F.transform(q, lambda x: x / F.aggregate(q, F.lit(0.0), lambda a, b: a + b)))[0]


def gated_windows(docs: DataFrame, templates: dict[str, list[str]], confirm: float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All windows that can hold the share ``confirm`` of a template; texts, then paragraphs, then windows without gate words go."""
    gate = gate_words(templates, confirm)
    parts = gated(paragraphs(gated(docs, gate, text), key, text), gate)
    return gated(windows(parts, window_words(templates)), gate)


def training_rows(docs: DataFrame, templates: dict[str, list[str]], unknown_rows: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Labelled windows ``body, label``: notices in several surroundings, and other windows of the corpus.

    The others are at most ``unknown_rows``, by a hash of their text, half of them with words of the
    notices; those that hold a quarter of any template's word pairs are left out. A notice
    stands alone, after a line's words, before them, between them, and with a name and year, and
    unknown rows also come from notices cut to their first quarter.
    """
    spark = docs.sparkSession
    families = sorted(templates)
    all_texts = [t for f in families for t in templates[f]]
    eighth = docs.where(F.pmod(F.xxhash64(F.col(f"`{text}`")), F.lit(8)) == 0)

    def some(rows: DataFrame) -> DataFrame:
        rows = rows.select("body").where(F.char_length("body") <= TRAINING_CHARS)
        return rows.distinct().orderBy(F.xxhash64("body"), "body").limit(unknown_rows // 2)

    plain = some(windows(paragraphs(eighth, key, text), window_words(templates)))
    paired = saved(plain.unionByName(some(gated_windows(docs, templates, CONFIRM, key, text))).distinct().withColumn("_p", _pairs(_words(F.col("body")))))
    unknown = saved(paired.where(template_share(F.col("_p"), all_texts) < 0.25).select("body"))
    around = [r["body"] for r in unknown.orderBy(F.xxhash64(F.lit(5), "body")).limit(SURROUNDINGS).select(F.substring("body", 1, 180).alias("body")).collect()]
    rows = []
    for family in families:
        for t in templates[family]:
            cut = " ".join(t.split()[:max(1, len(t.split()) // 4)])
            rows += [(family, x) for x in (t, t.upper(), f"{t}.", f"Copyright (c) 2020 {t}")]
            rows += [(family, x) for b in around for x in (f"{b}. {t}", f"{t}. {b}")]
            rows += [(family, f"{a} {t} {b}") for a, b in zip(around, around[1:] + around[:1])]
            rows += [(UNKNOWN, f"{cut} {b}") for b in around]
    known = spark.createDataFrame(rows, "label string, body string")
    return known.unionByName(unknown.select(F.lit(UNKNOWN).alias("label"), "body")).distinct()


def fit_licences(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, unknown_rows: int = UNKNOWN_ROWS, confirm: float = CONFIRM,
                 false_rate: float = 0.01, text: str = "text", key: str = "doc_id") -> LicenceModel:
    """Fit on three quarters of the training rows; choose temperature (least log loss) and cut (at most ``false_rate`` of unknown rows above it) on the rest."""
    families = [UNKNOWN, *sorted(templates)]
    index = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("label")) - 1
    rows = _grams(training_rows(docs, templates, unknown_rows, text, key)).withColumn("y", index.cast("double"))
    rows = saved(rows.select("body", "label", "y", "_g", (F.pmod(F.xxhash64("body"), F.lit(4)) == 0).alias("_held")))
    vectors = HashingTF(numFeatures=FEATURES, binary=True, inputCol="_g", outputCol="features")
    model = LogisticRegression(labelCol="y", family="multinomial", regParam=1e-3, elasticNetParam=0.0, maxIter=30).fit(vectors.transform(rows.where("not _held or y > 0")).repartition(4))
    held = saved(LicenceModel(model, families, 1.0, 0.5, templates, confirm).probabilities(rows.where("_held")).select("y", vector_to_array("probability").alias("p")))
    grid = [0.5, 0.7, 1.0, 1.4, 2.0, 2.8]

    def tempered(t: float) -> Column:
        return F.transform("p", lambda x: F.pow(F.greatest(x, F.lit(1e-12)), F.lit(1 / t)))

    losses = held.agg(*[F.avg(-F.log(F.get(tempered(t), F.col("y").cast("int")) / F.aggregate(tempered(t), F.lit(0.0), lambda a, b: a + b))).alias(f"t{i}") for i, t in enumerate(grid)]).first()
    found = [losses[f"t{i}"] for i in range(len(grid))]
    temperature = grid[min(range(len(grid)), key=lambda i: found[i] if found[i] is not None else float("inf"))]
    best = F.array_max(F.slice(tempered(temperature), 2, len(families) - 1)) / F.aggregate(tempered(temperature), F.lit(0.0), lambda a, b: a + b)
    cut = held.where("y = 0").agg(F.percentile(best, 1 - false_rate).alias("c")).first()["c"]
    return LicenceModel(model, families, temperature, min(max(cut or 0.5, 0.5), 0.95), templates, confirm)


def scan_licences(docs: DataFrame, model: LicenceModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``key, paragraph, word, family, probability, share`` of every licence that a paragraph names, whole texts.

    ``paragraph`` is the 0-based line the paragraph starts at, ``word`` the first word of the window
    with the highest probability (ties: most pairs, then the first), ``share`` the part of the best template's
    word pairs it holds; one row per paragraph and family. Windows whose best family is unknown, is
    below the cut or is not confirmed give no row; null and empty texts and empty tables give
    none. Repeated rows (same key and text) count once; rows of one key with different texts, and null keys, count each.
    """
    rows = _grams(gated_windows(docs, model.templates, model.confirm, key, text))
    top = F.array_max("_q")
    scored = model.probabilities(rows).select(F.col(f"`{key}`"), "_text", "paragraph", "word", "_p", (F.array_position("_q", top) - 1).cast("int").alias("_b"), top.alias("probability"))
    said = saved(scored).where((F.col("_b") > 0) & (F.col("probability") >= model.cut))
    share = F.lit(0.0)
    for i, family in enumerate(model.families[1:], 1):
        share = F.when(F.col("_b") == i, template_share(F.col("_p"), model.templates[family])).otherwise(share)
    sure = said.withColumn("share", share).where(F.col("share") >= model.confirm)
    best = sure.groupBy(F.col(f"`{key}`"), "_text", "paragraph", "_b").agg(F.max(F.struct("probability", "share", (-F.col("word")).alias("w"))).alias("_m"))
    return best.select(F.col(f"`{key}`"), F.col("paragraph").cast("long").alias("paragraph"), (-F.col("_m.w")).cast("long").alias("word"),
                       F.element_at(F.array(*[F.lit(f) for f in model.families]), F.col("_b") + 1).alias("family"), "_m.probability", "_m.share")
