import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quillframe.llm import lines

BASE = ["the quick brown fox jumps", "lorem ipsum dolor sit amet é", "aaaaaaaaaaaaaaaaaaaaaaaaa", "abababababababababababab"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rnd, text, edits):
    out = list(text)
    for _ in range(edits):
        i, kind = rnd.randrange(len(out)), rnd.random()
        if kind < 0.3:
            out.insert(i, rnd.choice("abé z"))
        elif kind < 0.6:
            out.pop(i)
        else:
            out[i] = rnd.choice("abé z")
    return "".join(out)


def made_up(seed=4):
    rnd = random.Random(seed)
    rows = [(i, "\n".join(changed(rnd, rnd.choice(BASE), rnd.randint(0, 4)) for _ in range(rnd.randint(0, 6)))) for i in range(60)]
    return [*rows, (100, None), (101, ""), (102, BASE[0] + "\nshort\nshort"), (103, BASE[0])]


def brute(rows, threshold=2, least=20):
    """doc -> (n_lines, repeats, nears, links, kept)."""
    first, places = {}, {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        for n, line in enumerate((text or "").split("\n") if text is not None else []):
            places[doc, n] = line
            if line.strip(" \t\n\v\f\r"):
                first.setdefault(line, (doc, n))
    letters = {a: Counter(a) for a in first}  # an edit changes at most one letter of a for another

    def close(a, b):
        return abs(len(a) - len(b)) <= threshold and (letters[a] - letters[b]).total() <= threshold and distance(a, b) <= threshold

    near = {a: [b for b in first if b != a and min(len(a), len(b)) >= least and close(a, b)] for a in first}
    out = {}
    for doc, text in rows:
        kept, repeats, nears, links = [], 0, 0, 0
        for n, line in enumerate(text.split("\n") if text is not None else []):
            again = line in first and first[line] != (doc, n)
            close = line in first and any(first[b] < first[line] for b in near[line])
            repeats, nears = repeats + again, nears + (close and not again)
            links += len(near.get(line, ()))
            if not again and not close:
                kept.append(line)
        out[doc] = (0 if text is None else len(text.split("\n")), repeats, nears, links, None if text is None else "\n".join(kept))
    return out


def test_matches_brute_force(spark):
    rows = made_up()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in lines.dedup_lines(df).select("row.doc_id", "n_lines", "repeats", "nears", "links", "kept").collect()}
    assert got == brute(rows)


def test_given_documents_have_all_links(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = lines.distinct_lines(docs)
    got = {frozenset((r[0], r[1])) for r in lines.edit_links(found).select("line_a", "line_b").collect()}
    a = found.select(F.col("line").alias("a"), F.col("n").alias("na"))
    b = found.select(F.col("line").alias("b"), F.col("n").alias("nb"))
    every = a.join(b, (F.abs(F.col("na") - F.col("nb")) <= 2) & (F.col("a") < F.col("b")) & (F.levenshtein("a", "b", 2) >= 0))
    assert got == {frozenset((r["a"], r["b"])) for r in every.collect()}


def test_banded_distance_for_other_thresholds(spark):
    rnd = random.Random(8)
    pairs = []
    for _ in range(150):
        a = "".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 14)))
        b = changed(rnd, a, rnd.randint(0, 4)) if len(a) > 5 else "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 6)))
        pairs.append((max(a, b, key=len), min(b, a, key=len)) if len(a) != len(b) else (a, b))
    df = spark.createDataFrame(pairs, "a string, b string")
    for k in (1, 2, 3):
        rows = df.select("a", "b", lines.within_edits(F.col("a"), F.col("b"), k).alias("w")).collect()
        assert all(r["w"] == (distance(r["a"], r["b"]) <= k) for r in rows)


def test_empty_table_repeated_rows_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    assert lines.without_repeats(empty).collect() == []
    rows = [(1, BASE[0], 25, "k"), (1, BASE[0], 25, "k"), (None, BASE[0] + "\nx", 27, "n"), (None, None, None, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, kept string")
    out = lines.without_repeats(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, BASE[0], 25, "k"), (1, BASE[0], 25, "k"), (None, "x", 1, "n"), (None, None, None, "n")], key=repr)


def test_methods_of_the_probes_are_short_enough_for_the_compiler(spark, folder, capsys):
    """The JVM only interprets methods above 8000 bytes."""
    found = lines.distinct_lines(spark.read.parquet(f"{folder}/documents.parquet"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines.probe_rows(found, lines.THRESHOLD).explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


def test_lines_beyond_ascii(spark):
    """Characters of one to four bytes, changed for one another, are one edit each."""
    rnd = random.Random(12)
    letters = "aé漢😀 ?"
    base = ["".join(rnd.choice(letters) for _ in range(n)) for n in (20, 21, 33, 60)]
    rows = []
    for i in range(80):
        line = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randrange(len(line))
            line[at:at + rnd.randint(0, 1)] = rnd.choice(["", *letters])
        rows.append((i, "".join(line)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in lines.dedup_lines(df).select("row.doc_id", "n_lines", "repeats", "nears", "links", "kept").collect()}
    assert got == brute(rows) and sum(r[2] for r in got.values()) > 5
