import random

from quillframe.llm import near, simhash


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(texts):
    """The smallest id of each group that all pairs at 0.8 or more give."""
    sets, root = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {find(d) for d in texts}


def test_given_documents_keep_one_of_each_group(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = plain_kept({r["doc_id"]: r["text"] for r in docs.collect()})
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == want


def test_changed_words_and_chains(spark):
    """Copies with one word in thirty changed, chains of such copies, and texts just below the similarity."""
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    texts, at = {}, 0
    for _ in range(12):
        base = [rnd.choice(words) for _ in range(rnd.choice([40, 150, 900]))]
        for _ in range(12):
            texts[at], at = " ".join(base), at + 1
            base = list(base)
            for i in range(rnd.randrange(30), len(base), rnd.choice([25, 60])):
                base[i] = rnd.choice(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    want = plain_kept(texts)
    assert len(want) < len(texts) and {r["doc_id"] for r in simhash.keep_one(df).collect()} == want


def test_band_holds_what_three_bits_lose():
    rnd = random.Random(3)
    a = [f"w{rnd.randrange(2000)}" for _ in range(200)]
    b = [f"x{i}" if i % 60 == 30 else w for i, w in enumerate(a)]
    x, y = (" ".join(t).encode() for t in (a, b))
    assert len(shingles(x.decode()) & shingles(y.decode())) >= 0.8 * len(shingles(x.decode()) | shingles(y.decode()))
    p, q = (int.from_bytes(simhash.fingerprint(t), "big") for t in (x, y))
    assert (p ^ q).bit_count() > 3 and set(near.signature(x)[2]) & set(near.signature(y)[2])


def test_dense_group_between_the_similarities(spark, monkeypatch):
    """Hundreds of copies of one text at mutual similarities around the threshold, in one piece and in many."""
    rnd = random.Random(11)
    base = [f"w{rnd.randrange(5000)}" for _ in range(120)]
    texts = {}
    for d in range(500):
        words = list(base)
        for i in rnd.sample(range(120), rnd.choice([1, 2, 3, 4])):
            words[i] = f"x{rnd.randrange(9)}"
        texts[d] = " ".join(words)
    want = plain_kept(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert {r["doc_id"] for r in simhash.keep_one(df).collect()} == want and len(want) > 1
    monkeypatch.setattr(near, "PIECE_ROWS", 64)
    assert {r["doc_id"] for r in simhash.keep_one(df).collect()} == want


def test_simhash_proposes_the_links(spark, monkeypatch):
    """Without bands, copies within three bits are found; texts within three bits that are not similar stay."""
    rnd = random.Random(21)
    texts, at = {}, 0
    for _ in range(30):
        base = [f"w{rnd.randrange(4000)}" for _ in range(400)]
        for _ in range(2):
            texts[at], at = " ".join(base), at + 1
            base = [*base[:-1], f"x{rnd.randrange(4000)}"]
    for _ in range(3):
        texts[at], at = "same three words " * 200 + " ".join(f"y{rnd.randrange(4000)}" for _ in range(150)), at + 1
    fps = {d: int.from_bytes(simhash.fingerprint(t.encode()), "big") for d, t in texts.items()}
    close = [d for d in range(0, 60, 2) if (fps[d] ^ fps[d + 1]).bit_count() <= 3]
    assert len(close) > 15 and (fps[60] ^ fps[61]).bit_count() <= 3
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert {r["doc_id"] for r in simhash.keep_one(df).collect()} == plain_kept(texts) == {*range(0, 60, 2), 60, 61, 62}
    members = near.cell_members
    monkeypatch.setattr(near, "cell_members", lambda nodes: members(nodes).limit(0))
    assert {r["doc_id"] for r in simhash.keep_one(df).collect()} == set(texts) - {d + 1 for d in close}
