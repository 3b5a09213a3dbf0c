import numpy as np

from quillframe.llm import quality


def plain(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


TEXTS = [None, "", " \n\t", "a b c a b c", "x\nx\n\n\nx y\nx y", "é#ü|*  $%&<>\x1c \x85 ", "one\r\none\r\n one", "a a a a", "😀 b 😀 b 😀 b"]


def test_base_statistics(spark, folder):
    texts = TEXTS + [r[0] for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").limit(60).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r[c] for c in quality.BASE) for r in quality.document_stats(df).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_rules_hold_on_unseen_documents(spark):
    """Fitted on every second labelled document, the rules find the bad ones among the rest and leave the good ones."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rules = quality.fit_rules(docs, labels.where("doc_id % 2 = 0"))
    rest = quality.judge(quality.document_stats(docs), rules).join(labels.where("doc_id % 2 = 1"), "doc_id")
    good = rest.where("quality = 1 and not base_failed")
    bad = rest.where("quality = 0 and not base_failed")
    assert good.where("kept").count() >= 0.98 * good.count() and bad.where("not kept").count() >= 0.9 * bad.count()


def test_covering_finds_planted_conjunctions():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    bad = ((x[:, 0] > 0.7) & (x[:, 1] <= 0.3)) | (x[:, 2] > 0.9)
    rules = quality.learn_rules(x, bad, ["a", "b", "c"], min_precision=0.85)
    hit = np.zeros(len(x), bool)
    for r in rules:
        hit |= quality._mask(x, r.conditions, ["a", "b", "c"])
    assert (hit == bad).mean() > 0.97 and 2 <= len(rules) <= 6


def test_no_labels_no_rules_and_whole_rows_pass(spark):
    docs = spark.createDataFrame([(1, "w " * 60, "x"), (1, "w " * 60, "x"), (None, " ".join(f"u{i}" for i in range(60)), "y"), (2, None, "z")], "doc_id long, text string, rule string")
    none = spark.createDataFrame([(5, 1), (None, 0), (6, None)], "doc_id long, quality int")
    assert quality.fit_rules(docs, none) == []
    kept = quality.filter_documents(docs, [])
    assert kept.columns == docs.columns and [r["rule"] for r in kept.collect()] == ["y"]
    assert quality.filter_documents(docs.limit(0), []).collect() == []
