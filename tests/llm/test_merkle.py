import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillframe.llm import merkle

SCHEMA = "doc_id bigint, lang string, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def proof(all_levels, at, fanout):
    steps = []
    for level in all_levels[:-1]:
        start = at // fanout * fanout
        steps.append(("".join(level[start:at]), "".join(level[at + 1:start + fanout])))
        at //= fanout
    return steps


def brute(rows, fanout=2):
    """(doc_id, leaf, subroot, root, proof) of every row, sorted."""
    groups = {}
    for doc_id, lang, text in rows:
        groups.setdefault(lang, []).append((doc_id is None, doc_id or 0, h(field(doc_id), field(lang), field(text)), doc_id))
    trees = {lang: levels([r[2] for r in sorted(found)], fanout) for lang, found in groups.items()}
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    top = levels([trees[n][-1][0] for n in names], fanout)
    return sorted(((r[3], r[2], trees[n][-1][0], top[-1][0], proof(trees[n], i, fanout) + proof(top, g, fanout))
                   for g, n in enumerate(names) for i, r in enumerate(sorted(groups[n]))), key=repr)


def made_up(n=90, seed=3):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(["en", "en", "en", "de", "", None]), rnd.choice(["a", "é b", "", None, "x" * 3000])) for i in range(n)]
    return [*rows, (None, "en", "t"), (None, "en", None), (5, "en", "again"), (7, "de", "x"), (7, "de", "x"), (200, "zz", "alone")]


@pytest.mark.parametrize(("fanout", "height"), [(2, 8), (2, 2), (3, 2)])
def test_equals_plain_trees(spark, fanout, height):
    rows = made_up()
    out = merkle.manifest(spark.createDataFrame(rows, SCHEMA), ["doc_id", "lang", "text"], fanout=fanout, levels=height)
    got = sorted(((r.key, r.leaf, r.subroot, r.root, [(s.left, s.right) for s in r.proof]) for r in out.collect()), key=repr)
    assert got == brute(rows, fanout)


def test_proof_tells_changed_rows(spark):
    rows = made_up(30)
    out = merkle.manifest(spark.createDataFrame(rows, SCHEMA).withColumn("tree", F.lit("clash")), ["doc_id", "lang", "text"],
                          altered=[F.col("doc_id"), F.col("lang"), F.when(F.col("doc_id") % 3 == 0, F.lit("!")).otherwise(F.col("text"))])
    got = out.select("key", (merkle.fold(F.col("altered"), F.col("proof")) == F.col("root")).alias("fine")).collect()
    assert all(r.fine == (r.key is None or r.key % 3 != 0) for r in got) and len(got) == len(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "a", "x"), (2, "b", "y")]])
def test_few_rows(spark, rows):
    out = merkle.manifest(spark.createDataFrame(rows, SCHEMA), ["doc_id", "lang", "text"]).collect()
    assert sorted((r.key, r.root, len(r.proof)) for r in out) == [(r[0], r[3], len(r[4])) for r in brute(rows)]
