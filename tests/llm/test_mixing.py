import random
from collections import defaultdict

from quillframe.llm import mixing


def brute_targets(sizes):
    """source -> target: shares by weight, the excess over three times a source given to the others until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in capped]
        room = total - sum(capped.values())
        shares = {s: room * weight[s] / sum(weight[r] for r in rest) for s in rest} if rest else {}
        above = {s: 3 * sizes[s] for s in rest if shares[s] > 3 * sizes[s]}
        if not above:
            return capped | shares
        capped |= above


def sainte_lague(votes, seats, most):
    got = [0] * len(votes)
    for _ in range(seats):
        open_ = [i for i in range(len(votes)) if got[i] < most[i] and votes[i] > 0]
        if not open_:
            break
        got[max(open_, key=lambda i: (votes[i] / (2 * got[i] + 1), -i))] += 1
    return got


def test_quotients_agree_with_one_by_one_allocation(spark):
    rnd = random.Random(1)
    rows, want = [], {}
    for g in range(40):
        votes = [float(rnd.choice([0, 1, 5, 40, 1000]) * rnd.random()) for _ in range(rnd.randint(1, 9))]
        seats, most = rnd.randint(0, 60), [rnd.choice([0, 3, 100]) for _ in votes]
        if sum(m for m, v in zip(most, votes) if v > 0) < seats or rnd.random() < 0.5:
            most = [1000] * len(votes)
        for i, (v, n) in enumerate(zip(votes, sainte_lague(votes, seats, most))):
            rows.append((g, i, v, seats, most[i]))
            want[g, i] = n
    df = spark.createDataFrame(rows, "g int, i int, votes double, seats long, most long")
    got = {(r["g"], r["i"]): r["quota"] for r in mixing.sainte_lague(df, "votes", "seats", "most", ["g"], ["i"]).collect()}
    free = {g for g, _, _, _, m in rows if m == 1000}
    assert {k: v for k, v in got.items() if k[0] in free} == {k: v for k, v in want.items() if k[0] in free}
    assert all(got[g, i] <= m for g, i, _, _, m in rows)


def check(rows, got, slack=70):
    size = {d: len((t or "").encode().split()) for d, _, t in rows}
    by = defaultdict(int)
    for d, s, _ in rows:
        by[s] += size[d]
    want, taken = brute_targets(dict(by)), defaultdict(int)
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == by[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in by:
        assert abs(taken[s] - want[s]) <= slack


def test_given_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["source"], r["text"]) for r in docs.collect()]
    run = lambda d: mixing.mix(d, carry=["doc_id", "source"]).select("row.*", "size", "source_size", "target", "taken").collect()
    got = run(docs)
    assert len(got) == len(rows)
    check(rows, got)
    assert {r["doc_id"]: r["taken"] for r in got} == {r["doc_id"]: r["taken"] for r in run(docs.repartition(7))}


def test_many_shards_and_capped_sources(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["a", "a", "a", "a", "a", "b", "tiny"] if i > 3 else ["tiny", None]), "w " * rnd.randint(0, 300)) for i in range(900)]
    rows += [(1000, "z", None), (1001, "z", ""), (1002, "long", "w " * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(df, shard_words=2000, block_words=4).select("row.doc_id", "row.source", "size", "source_size", "target", "taken").collect()
    check(rows, got, slack=200)
    assert len(got) == len(rows)


def test_mixed_text_is_what_was_taken(spark):
    rows = [(i, f"s{i % 5}", " ".join(f"w{i}_{k}" for k in range(i % 13)), i % 13) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars long")
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(df).select("row.doc_id", "taken").collect()}
    words, out = defaultdict(int), mixing.mixed_documents(df)
    assert out.columns == df.columns
    for r in out.collect():
        assert r["n_chars"] == len(r["text"])
        words[r["doc_id"]] += len(r["text"].split())
    assert {d: n for d, n in taken.items() if n} == dict(words)


def test_empty_table_and_part_of_a_text(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string, size int")
    assert mixing.mix(empty).collect() == [] and mixing.mixed_documents(empty).collect() == []
    assert mixing.some_words(" a\tb  c d ", 2, 3) == "c d\na" and mixing.some_words("a b", 0, 1) == "a"
    clash = spark.createDataFrame([(1, "a", "x y", 7), (1, "a", "x y", 7), (None, None, "z", 7)], "doc_id long, source string, text string, size int")
    assert sum(r["taken"] for r in mixing.mix(clash, block_words=1).collect()) >= 4


def test_small_sources_come_near_their_targets(spark):
    rows = [(i, f"s{i:02}", "w " * 5) for i in range(30)] + [(100 + i, "big", "w " * 200) for i in range(100)] + [(300, "one", "w")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(df).select("row.doc_id", "row.source", "size", "source_size", "target", "taken").collect()
    check(rows, got, slack=2)
    assert all(r["taken"] >= 1 for r in got if r["source"] != "big")
