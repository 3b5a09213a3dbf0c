from collections import Counter

import corpus_pipeline
from quillframe.llm import packing
from quillframe.llm.queries import QUERIES, word_tokenizer

from .test_lines import brute
from .test_near import plain_kept


def test_stages_do_their_work(spark, folder):
    """Every stage on what the one before kept, against plain Python."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "simhash_near_dedup", "mix_sources", "best_fit_packing"]
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    good = corpus_pipeline.saved(stages["quality_rules"](spark, docs, folder))
    kept = texts(good)
    verdict = {r["doc_id"]: r["kept"] for r in QUERIES["op8_quality_rules"](spark, folder).collect()}
    assert good.columns == names and set(kept) == {d for d, k in verdict.items() if k}

    lines = corpus_pipeline.saved(stages["line_dedup"](spark, good, folder))
    cut = texts(lines)
    assert lines.columns == names and cut == {d: r[4] for d, r in brute(sorted(kept.items())).items()}

    single = corpus_pipeline.saved(stages["simhash_near_dedup"](spark, lines, folder))
    first = plain_kept(cut)
    assert single.columns == names and set(texts(single)) == first

    mixed = corpus_pipeline.saved(stages["mix_sources"](spark, single, folder))
    assert mixed.columns == names and set(texts(mixed)) <= first

    packed = stages["best_fit_packing"](spark, mixed, folder).collect()
    ids = packing.WordIds(word_tokenizer())
    want = Counter((r["doc_id"], len(ids.document(r["text"])) // 4) for r in mixed.collect())
    assert sum(r["length"] for r in packed) == sum(n * k for (_, n), k in want.items())


def test_extra_columns_nulls_and_no_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = docs.selectExpr("*", "'x' AS kept", "1 AS size", "array(1) AS row").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, folder)
        assert out.columns == odd.columns and out.collect() == [], name
    assert corpus_pipeline.best_fit_packing(spark, odd, folder).collect() == []
