"""URL filters: a blocked Bloom filter in front of an exact join.

The listed canonical URLs set bits in blocks of 512 bits: one hash names the block,
eight more bits are set inside it. The filter is a table (block, eight 64-bit words),
so it may be larger than a task's memory: rows meet their block by a join on the block
number, and only possible hits go on to the exact join with the listed URLs. Spark
broadcasts either table where its measured size allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_URL = 16
BLOCK_BITS = 512
PROBES = 8
#: Host part (a suffix of whole labels), path prefix, verdict.
Rule = tuple[str, str, str]


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without a leading ``www.`` or ``m.``, and the path without ``index.html``, ``.html`` and a last slash; null stays null."""
    h = F.regexp_replace(host(url), r"^(www|m)\.", "")
    p = F.regexp_replace(path(url), r"(/index)?(\.html)?/?$", "")
    return F.when(url.isNotNull(), F.concat(h, p))


def rule_of(h: Column, p: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits as a struct (rule, verdict), else null. The list is fixed and short, so it is one expression.

    A rule fits its host and all subdomains if the path starts with the rule's path (after
    the slash that ends its host, so an empty path fits none). Longest is by characters; of equal ones the first listed.
    """
    out = None
    for name, prefix, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((h == name) | h.endswith("." + name)) & p.startswith("/" + prefix)
        value = F.struct(F.lit(f"{name}/{prefix}").alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def _hashes(c: Column, blocks: Column | int) -> tuple[Column, list[Column]]:
    h = F.xxhash64(c)
    block = F.pmod(F.xxhash64(F.lit(1), c), blocks if isinstance(blocks, Column) else F.lit(blocks))
    return block, [F.shiftrightunsigned(h, 9 * i).bitwiseAND(F.lit(511)) for i in range(7)] + [F.pmod(F.xxhash64(F.lit(2), c), F.lit(BLOCK_BITS))]


def _words(bits: list[Column]) -> list[Column]:
    """The eight 64-bit words in which the probe bits are set."""
    out = []
    for w in range(BLOCK_BITS // 64):
        parts = [F.when(F.shiftright(b, 6) == w, F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("long")) for b in bits]
        word = parts[0]
        for p in parts[1:]:
            word = word.bitwiseOR(p)
        out.append(word)
    return out


def bloom_filter(listed: DataFrame, url: str = "canonical", bits_per_url: int = BITS_PER_URL) -> tuple[DataFrame, int]:
    """The filter as a table ``block, w0 .. w7`` and its number of blocks. ``listed`` holds distinct, non-null URLs."""
    n = listed.count()
    blocks = max(1, -(-n * bits_per_url // BLOCK_BITS))
    block, bits = _hashes(F.col(url), blocks)
    rows = listed.select(block.alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(_words(bits))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(BLOCK_BITS // 64)]), blocks


def possible_hits(urls: DataFrame, bloom: DataFrame, blocks: int, url: str = "canonical") -> DataFrame:
    """The rows whose probe bits are all set in their block."""
    block, bits = _hashes(F.col(url), blocks)
    b = bloom.withColumnRenamed("block", "_block")
    joined = urls.withColumn("_at", block).join(b, F.col("_at") == F.col("_block"))
    fits = None
    for i, m in enumerate(_words(bits)):
        one = F.col(f"w{i}").bitwiseAND(m) == m
        fits = one if fits is None else fits & one
    return joined.where(fits).select(*urls.columns)


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url") -> DataFrame:
    """Every row with ``host``, ``path``, ``rule``, ``verdict``, ``canonical``, ``possible`` and ``listed``.

    ``listed`` has a column ``canonical``; null entries are left out and repeated ones
    count once. The verdict is the rule's, else block if the canonical URL is listed, else
    allow. Null urls have empty host and path, fit no rule and are allowed. Rows are told
    by their distinct canonical URL, so repeated rows and repeated keys stay as they are,
    and one hot URL is looked up once.
    """
    names = pages.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    p = pages.select(row, F.col(f"`{url}`").alias("_url"))
    p = p.select("row", host(F.col("_url")).alias("host"), path(F.col("_url")).alias("path"), canonical(F.col("_url")).alias("canonical"))
    exact = listed.select("canonical").where(F.col("canonical").isNotNull()).distinct()
    bloom, blocks = bloom_filter(exact)
    asked = p.select("canonical").where(F.col("canonical").isNotNull()).distinct()
    maybe = possible_hits(asked, bloom, blocks)
    hits = maybe.join(exact.withColumn("_in", F.lit(True)), "canonical", "left").select(F.col("canonical").alias("_c"), F.coalesce("_in", F.lit(False)).alias("_in"))
    out = p.join(hits, F.col("canonical") == F.col("_c"), "left").withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    is_listed = F.coalesce("_in", F.lit(False))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(is_listed, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("row", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "canonical",
                      F.col("_c").isNotNull().alias("possible"), is_listed.alias("listed"))
