import random

import numpy as np
import xxhash

from quillframe.llm import simhash
from quillframe.llm.common import components


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """doc ids and fingerprints -> smallest reachable id, by comparing all pairs."""
    ids = sorted(prints)
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_given_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    prints = {d: plain_print(t) for d, t in texts.items()}
    want = plain_components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {d: (f"{prints[d]:016x}", want[d]) for d in texts}


def test_dense_groups_and_chains(spark):
    """Links of planted clusters and chains agree with brute force, also where a cell is cut into chunks."""
    rnd = random.Random(5)
    fps = set()
    for _ in range(6):
        x = rnd.getrandbits(64)
        for _ in range(40):
            fps.add(x)
            for b in rnd.sample(range(64), rnd.randint(0, 3)):
                x ^= 1 << b
    centre = rnd.getrandbits(64)
    fps |= {centre ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(1, 64, 7)}
    rows = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    df = spark.createDataFrame(rows, "fp long")
    links = simhash.grid_links(df, chunk=8).collect()
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in links)
    signed = {r[0] for r in rows}
    got = {f: f for f in signed} | {r["node"]: r["root"] for r in components(simhash.grid_links(df, chunk=8)).collect()}
    want = plain_components({f: f & (2**64 - 1) for f in signed})
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups(got) == groups(want)


def test_lower_bound():
    rng = np.random.default_rng(1)
    x, y = (rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2) for _ in range(2))
    counts = lambda v: np.array([[(int(a) >> 2 * s & 3).bit_count() for s in range(32)] for a in v])
    manhattan = np.abs(counts(x) - counts(y)).sum(axis=1)
    assert (np.bitwise_count(simhash._unary(x) ^ simhash._unary(y)) == manhattan).all()
    assert (manhattan <= np.bitwise_count(x ^ y)).all()


def test_nulls_ties_empty_tables_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).collect() == [] and simhash.keep_one(empty).collect() == []
    rows = [(4, None, 1), (2, "", 1), (None, "a b", 1), (7, "a b", 2), (7, "a b", 2), (9, "A  B", 3), (None, "only me here", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r[0] is None, r[0] or 0), r[1], r[2]) for r in simhash.near_duplicates(df).collect())
    assert [g[2] for g in got] == [2, 2, 7, 7, 7, 7, None] or {g[2] for g in got} == {2, 7, None}
    kept = sorted((r["doc_id"] or -1, r["fp"]) for r in simhash.keep_one(df).collect())
    assert kept == [(-1, 4), (2, 1), (7, 2)]


def test_components_of_a_long_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1001)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components(path).collect()}
    assert set(roots.values()) == {0, 1000} and len(roots) == 303
    assert components(path.limit(0)).collect() == []
