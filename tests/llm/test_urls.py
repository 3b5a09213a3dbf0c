import re

from pyspark.sql import functions as F

from quillframe.llm import urls
from quillframe.llm.queries import RULES

URLS = [None, "", "no scheme", "http://Example.ORG/es/x", "https://a.example.org/en/123?q", "https://a.example.org/en/2", "http://x.com/fr/", "http://x.com/fr",
        "http://x.com/de/1#y", "https://org/", "https://org", "http://notexample.org/es/", "a://b://c.com/de/", "http://ÄX.com/fr/ü", "http://x.net/", "http://u@x.com:80/de/", "http://com?/fr/", "x://www.spam.net/a/index.html", "x://spam.net/a"]


def plain(url, listed):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fits = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith("/" + r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, f"{best[0]}/{best[1]}" if best else None, best[2] if best else "block" if url in listed else "allow"


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    listed = pages.where(F.col("url").contains("spam")).select(urls.canonical(F.col("url")).alias("canonical"))
    got = {r["row"]["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(pages, listed, RULES).collect()}
    assert got == {i: plain(u, URLS[-2:]) for i, u in enumerate(URLS)}


def test_filter_has_no_false_negatives_and_the_join_no_false_positives(spark):
    listed = spark.range(3000).select(F.concat(F.lit("h"), F.col("id"), F.lit(".net/p")).alias("canonical"))
    pages = spark.range(9000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id"), F.lit(".net/p")).alias("url"))
    out = urls.judge_urls(pages, listed, [])
    assert out.where((F.col("row.page_id") < 3000) != F.col("listed")).count() == 0
    assert out.where("possible and not listed").count() < 60
    bloom, blocks = urls.bloom_filter(listed, bits_per_url=1)
    some = pages.select(urls.canonical(F.col("url")).alias("canonical"))
    assert urls.possible_hits(some, bloom, blocks).join(listed, "canonical", "left_semi").count() == 3000


def test_empty_tables_repeated_rows_and_clashing_names(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", "h"), (1, "http://a.net/x", "h"), (None, None, "h")], "page_id long, url string, host string")
    none = spark.createDataFrame([], "canonical string")
    assert [r["verdict"] for r in urls.judge_urls(pages, none, RULES).collect()] == ["allow"] * 3
    assert urls.judge_urls(pages.limit(0), none, RULES).collect() == []
    twice = spark.createDataFrame([("a.net/x",), ("a.net/x",), (None,)], "canonical string")
    assert sorted(r["verdict"] for r in urls.judge_urls(pages, twice, RULES).collect()) == ["allow", "block", "block"]
