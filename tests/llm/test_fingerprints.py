import hashlib

from quillframe.llm import fingerprints


def shingles(text):
    words = text.encode().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check(rows, got, tolerance):
    errors = []
    for i, (doc, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        edited = text[:len(text) - len(text) // 2] + following[:len(text) // 2]
        r = got[doc]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors += [abs(r["near_edited"] - jaccard(text, edited)), abs(r["near_next"] - jaccard(text, following))]
    assert max(errors) < tolerance and sum(errors) / len(errors) < tolerance / 5


def test_given_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    got = {r["doc_id"]: r for r in fingerprints.compare_neighbours(docs.repartition(5)).collect()}
    assert len(got) == len(rows)
    check(rows, got, 0.12)
    by_text = {}
    for doc, text in rows:
        assert by_text.setdefault(text, got[doc]["fingerprint"]) == got[doc]["fingerprint"]


def test_edges(spark):
    long = " ".join(f"w{i % 977}é" for i in range(60_000))
    rows = [(-5, None), (0, ""), (1, "a"), (2, "a b c d"), (3, "a b c d"), (4, long), (5, long + " more"), (9, "😀😀 x")]
    df = spark.createDataFrame([(t, d, 1) for d, t in rows], "text string, doc_id long, _block int")
    got = {r["doc_id"]: r for r in fingerprints.compare_neighbours(df).collect()}
    check(rows, got, 0.12)
    assert got[2]["fingerprint"] == got[3]["fingerprint"] and got[2]["near_next"] == 1.0 and got[0]["fingerprint"] == ""


def test_one_document_no_document_and_repeated_ids(spark):
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert fingerprints.compare_neighbours(one).collect()[0]["near_next"] == 1.0
    assert fingerprints.compare_neighbours(one.limit(0)).collect() == []
    many = spark.createDataFrame([(1, "a b"), (1, "c d"), (1, "a b"), (None, "n"), (None, None)], "doc_id long, text string")
    got = fingerprints.compare_neighbours(many).collect()
    assert len(got) == 5 and sorted(r["n_chars"] for r in got) == [0, 1, 3, 3, 3]
    assert len(fingerprints.fingerprints(many).collect()) == 5
