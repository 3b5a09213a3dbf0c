import random
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quillframe.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["İstanbul ΣΑΣ Ⅷ ½ x² don't 'LL 日本語 é ẛ̣ \x1c a\x85b", "<|startoftext|> <|endoftext|>q", "", " \n ", "à́ _x_ 12 ٣ ǅ ß ﬁ 한글 👍🏽 ﻿ ​ z", "𝐀 𐐀 ꟲ 𐐨", "ΟΔΟΣ Σ"]


def true_ids(texts):
    t = Tokenizer.from_file(PATH)
    return [np.array([*e.ids, 0], "<u4") for e in t.encode_batch(texts, add_special_tokens=False)]


def test_ids_are_the_tokenizers(spark, folder):
    texts = [r[0] for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect()] + ODD
    words = packing.WordIds(PATH)
    assert [words.document(t) for t in texts] == [x.tobytes() for x in true_ids(texts)]


def best(items, capacity):
    @lru_cache(None)
    def need(left):
        if not left:
            return 0
        rest, least = left[1:], len(left)
        for m in range(1 << len(rest)):
            if left[0] + sum(x for i, x in enumerate(rest) if m >> i & 1) <= capacity:
                least = min(least, 1 + need(tuple(x for i, x in enumerate(rest) if not m >> i & 1)))
        return least

    return need(tuple(sorted(items, reverse=True)))


def test_reduction_keeps_an_optimal_packing():
    rnd = random.Random(2)
    for _ in range(250):
        capacity = rnd.randint(8, 40)
        items = [rnd.randint(1, capacity) for _ in range(rnd.randint(1, 8))]
        c = packing._Counts(dict(Counter(items)), capacity)
        fixed = packing.reduce_dominated(c, capacity)
        rest = [x for x in range(capacity + 1) for _ in range(int(c.n[x]))]
        assert sum(n for _, n in fixed) + best(rest, capacity) == best(items, capacity)


def test_plans_are_whole():
    rnd = random.Random(3)
    for _ in range(200):
        capacity = rnd.randint(5, 60)
        items = Counter(rnd.randint(1, capacity) for _ in range(rnd.randint(0, 60)))
        found = Counter()
        for lengths, n in packing.plan_bins(dict(items), capacity):
            assert sum(lengths) <= capacity and n > 0
            for x in lengths:
                found[x] += n
        assert found == items


def check(rows, packed, capacity):
    ids = dict(zip((d for d, _ in rows), true_ids([t or "" for _, t in rows])))
    seen, sequences = Counter(), {}
    for r in packed:
        cut = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert r["start"] == r["piece"] * capacity and len(cut) == r["length"] and zlib.crc32(cut.tobytes()) == r["ids_crc32"]
        seen[r["doc_id"]] += r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert seen == {d: len(x) for d, x in ids.items()}
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(map(len, ids.values()))


def test_given_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    n, tokens = check(rows, packing.pack_documents(docs, PATH).collect(), 2048)
    assert n <= -(-tokens // 2048) * 1.02 + 1


def test_nulls_long_texts_and_empty_tables(spark):
    rows = [(1, None), (2, ""), (3, "word " * 9000), (4, "x"), (5, "x"), (None, "hello")]
    df = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, piece string")
    check(rows, packing.pack_documents(df, PATH).collect(), 2048)
    assert packing.pack_documents(df.limit(0), PATH).collect() == []
    check(rows, packing.pack_documents(df.repartition(4), PATH, capacity=7).collect(), 7)
