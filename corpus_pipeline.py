"""From raw documents to packed training sequences.

Quality rules drop documents, line dedup cuts repeated lines, near-dedup keeps one document
of each group of similar texts, the sources are mixed to target weights, and the result is
tokenised and packed. Every stage reads what the one before has kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillframe.llm import lines, mixing, packing, quality, simhash
from quillframe.llm.common import saved
from quillframe.llm.queries import word_tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base limits and the rules learned from the labelled ones among them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.filter_documents(docs, quality.fit_rules(docs, labels))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand, up to two edits, at an earlier place; a document may be left with an empty text."""
    return lines.without_repeats(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group: SimHash links, and bands behind them, propose pairs, and those with a
    Jaccard similarity of 0.8 of their five-word shingle sets link."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: a row for every whole copy taken, and one for the words of a part."""
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every text in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, word_tokenizer())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = saved(docs)
    return docs


#: Rules are learned and links are followed until nothing changes, so SQL cannot say it; tests/llm compares the stages with plain Python.
ORACLE_SQL = None
