import hashlib
import random

import numpy as np

from quillframe.llm import substrings


def brute(rows, length=100):
    """doc_id -> (n_bytes, n_removed, n_spans, sha) by remembering every window."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            w = raw[s:s + length]
            if w in seen:
                gone[s:s + length] = True
            seen.add(w)
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        runs = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(raw) else 0
        out[doc] = (len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def result(spark, rows, partitions=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    found = substrings.remove_repeats(df).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    return {r[0]: tuple(r)[1:] for r in found}


def made_up(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abé") for _ in range(rnd.randint(1, 6)))
    passages = [" ".join(word() for _ in range(60)) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 40)))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randint(0, len(p) // 2)
            parts += [p[a:rnd.randint(a, len(p))], " ".join(word() for _ in range(rnd.randint(0, 9)))]
        rows.append((i * 7 - 50, "".join(parts)))
    rows += [(1000, "a" * 1500), (1001, "ab" * 700), (1002, "a" * 130), (1003, ""), (1004, None), (1005, rows[3][1]), (1006, rows[3][1]), (1007, "x" * 99)]
    rnd.shuffle(rows)
    return rows


def test_matches_brute_force(spark):
    rows = made_up(1)
    assert result(spark, rows) == brute(rows)


def test_small_buffers_and_chunks(spark, monkeypatch):
    """Documents cut at buffer ends, and anchors with more segments than one sort takes."""
    rows = made_up(2)
    segments = substrings._first_of_classes
    monkeypatch.setattr(substrings, "BUFFER", 700)
    monkeypatch.setattr(substrings, "_first_of_classes", lambda s, n: segments(s, n, held=3))
    assert result(spark, rows) == brute(rows)


def test_given_documents(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert result(spark, rows, 5) == brute(rows)


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.remove_repeats(empty).collect() == []
    odd = spark.createDataFrame([(1, "q" * 300, "x", 5), (1, "q" * 300, "x", 5), (None, "z", "y", 6)], "doc_id long, text string, doc string, n_bytes int")
    out = substrings.remove_repeats(odd).select("row.doc", "row.n_bytes", "n_removed").collect()
    assert sorted((r[0], r[1], r[2]) for r in out) == [("x", 5, 299), ("x", 5, 299), ("y", 6, 0)]


def test_deep_shallow_sort_finds_all_classes():
    rnd = random.Random(3)
    raw = bytes(rnd.choice(b"ab") for _ in range(3000)) + b"ab" * 200
    raw += raw[500:900] + b"c" + raw[480:700]
    suffixes = np.arange(len(raw) - 100 + 1)
    found = sorted(sorted(c) for c in substrings.equal_windows(raw, suffixes, shallow=16))
    by = {}
    for s in suffixes.tolist():
        by.setdefault(raw[s:s + 100], []).append(s)
    assert found == sorted(v for v in by.values() if len(v) > 1)
