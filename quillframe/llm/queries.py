"""The registered queries ``opN_<name>`` and ``pipeline``, each over its whole table, and their SQL.

A query without SQL is tested against a brute-force version in ``tests/llm``.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm import (
    centroids, fingerprints, licences, lines, merkle, mixing, neighbours, packing, quality, secret_scan, simhash, substrings, urls,
)
from quillframe.llm.common import saved


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_tokenizer() -> str:
    """Path of the tokenizer file that op4 and the pipeline count tokens with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compare_neighbours(_read(spark, folder, "documents"))


RULES: list[urls.Rule] = [
    ("org", "", "allow"), ("example.org", "es/", "block"), ("example.org", "en/1", "block"), ("com", "fr/", "allow"), ("com", "de/", "block"),
]
SPAM_HOSTS = "casino|pills|bets|ads-track"


def listed_urls(pages: DataFrame) -> DataFrame:
    """The block list of the test tables: canonical URLs of all pages on hosts with a spam word."""
    return pages.where(urls.host(F.col("url")).rlike(SPAM_HOSTS)).select(urls.canonical(F.col("url")).alias("canonical"))


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = _read(spark, folder, "pages").select("page_id", "url")
    out = urls.judge_urls(pages, listed_urls(pages), RULES)
    return out.select("row.page_id", "host", "path", "rule", "verdict", "listed")


OP2_SQL = rf"""
WITH p AS (SELECT page_id,
  coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
c AS (SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(/index)?(\.html)?/?$', '') AS canonical FROM p),
l AS (SELECT DISTINCT canonical, true AS hit FROM c WHERE regexp_matches(host, '{SPAM_HOSTS}')),
r AS (SELECT c.page_id, c.host, c.path, l.hit IS NOT NULL AS listed, CASE
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM c LEFT JOIN l ON c.canonical = l.canonical)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM r
"""


def op3_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").select("doc_id", "source", "text")
    out = mixing.mix(docs, carry=["doc_id", "source"])
    return out.select("row.doc_id", "size", "source_size", "target", "taken", "row.source")


def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_read(spark, folder, "documents"), word_tokenizer())


def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = substrings.remove_repeats(_read(spark, folder, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def labelled_findings(found: DataFrame) -> DataFrame:
    """Labels of the test tables' findings by the formats that issuers publish: fixed-length hex tokens and passwords of either
    case, issuers' prefixes and web tokens are secrets. Other assigned values have no label; other findings, as runs of digits
    and mixed words, are not secrets."""
    hex40, hex18 = F.col("candidate").rlike("^(?i)[0-9a-f]{40}$"), F.col("candidate").rlike("^(?i)[0-9a-f]{18}$")
    issued = F.col("candidate").rlike(r"^(AKIA[0-9A-Z]{16}$|gh[pousr]_[0-9A-Za-z]{36}$|xox[abprs]-[0-9A-Za-z-]{10,}$|eyJ[0-9A-Za-z_-]{10,}(\.|$))")
    assigned = F.col("assigned") > 0
    return found.withColumn("label", F.when(((hex40 | hex18) & assigned) | issued, 1).when(~assigned, 0))


def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").select("doc_id", "text", "source")
    model = secret_scan.fit_text_model(docs)
    found = saved(secret_scan.candidates(docs, model, path="source"))
    labelled = labelled_findings(found).select("candidate", "start", "label", *secret_scan.FEATURES)
    out = secret_scan.judge(found, secret_scan.fit_forest(labelled.unionByName(secret_scan.drawn_assignments(docs, model))))
    return out.select("doc_id", "start", F.col("length_chars").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "probability", "secret")


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = lines.dedup_lines(_read(spark, folder, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "repeats", "nears", "links", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _read(spark, folder, "documents"), _read(spark, folder, "labels")
    rules = quality.fit_rules(docs, labels)
    out = quality.judge(quality.document_stats(docs), rules)
    return out.select("doc_id", *quality.BASE, "base_failed", "kept", "rule")


def op9_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").select("doc_id", "text")
    return licences.scan_licences(docs, licences.fit_licences(docs))


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, folder, "documents"))


MANIFEST = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    one_more = F.col("n_chars").cast("decimal(38,0)") + F.when(hit, 1).otherwise(0)
    out = merkle.manifest(docs, MANIFEST, altered=[one_more if c == "n_chars" else F.col(c) for c in MANIFEST])
    folded = merkle.fold(F.col("altered"), F.col("proof"))
    return out.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")).cast("binary"), 256).alias("proof_sha256"),
                      folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "coalesce(strlen({0}) || ':' || {0}, '-')"


def _leaf_sql(n_chars: str) -> str:
    fields = [f"({n_chars})::VARCHAR" if c == "n_chars" else f"{c}::VARCHAR" for c in MANIFEST]
    return "sha256(" + " || ".join(_FIELD.format(f) for f in fields) + ")"


def _tree_sql(name: str, leaves: str) -> str:
    """All nodes ``name(tree, level, pos, n, h)`` over ``leaves(tree, pos, n, h)``."""
    return f"""{name} AS (SELECT tree, 0 AS level, pos, n, h FROM {leaves} UNION ALL
  SELECT tree, max(level) + 1, pos // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY tree, pos // 2)"""


def _proof_sql(name: str, leaves: str, nodes: str) -> str:
    """``name(tree, pos, proof)``: the siblings of every leaf, left or right of its own digest."""
    return f"""{name} AS (SELECT l.tree, l.pos, coalesce(list({{'left': coalesce(a.h, ''), 'right': coalesce(b.h, '')}} ORDER BY o.level) FILTER (o.level IS NOT NULL), []) AS proof
  FROM {leaves} l LEFT JOIN {nodes} o ON o.tree = l.tree AND o.pos = l.pos >> o.level AND o.n > 1
  LEFT JOIN {nodes} a ON a.tree = o.tree AND a.level = o.level AND o.pos % 2 = 1 AND a.pos = o.pos - 1
  LEFT JOIN {nodes} b ON b.tree = o.tree AND b.level = o.level AND o.pos % 2 = 0 AND b.pos = o.pos + 1 GROUP BY l.tree, l.pos)"""


# 0xEDB88320 (3988292384) is the reversed polynomial of CRC-32; a byte is taken in, then shifted out by eight steps (-1)
OP11_SQL = f"""
WITH RECURSIVE d AS (SELECT *, (xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
    lambda b: [ord(b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, b: CASE WHEN b >= 0 THEN xor(c, b)
    WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END), 4294967295::BIGINT)) % 7 = 0 AS hit FROM documents),
k AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf_sql("n_chars")} AS h, {_leaf_sql("n_chars::HUGEINT + CASE WHEN hit THEN 1 ELSE 0 END")} AS altered FROM d),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, h) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM k),
{_tree_sql("nodes", "leaves")},
tops AS (SELECT '' AS tree, tree AS name, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, h FROM nodes WHERE n = 1),
{_tree_sql("upper", "tops")},
{_proof_sql("low", "leaves", "nodes")}, {_proof_sql("high", "tops", "upper")},
r AS (SELECT l.doc_id, l.h AS leaf, l.altered, t.h AS subroot, (SELECT h FROM upper WHERE n = 1) AS root, low.proof || high.proof AS proof
  FROM leaves l JOIN low ON low.tree = l.tree AND low.pos = l.pos JOIN tops t ON t.name = l.tree JOIN high ON high.pos = t.pos),
f AS (SELECT *, list_reduce(list_prepend({{'left': altered, 'right': ''}}, proof), lambda x, s: {{'left': sha256(s['left'] || x['left'] || s['right']), 'right': ''}})['left'] AS folded_root FROM r)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(proof, lambda s: s['left'] || s['right']), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified FROM f
"""


def op12_projection_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.search(_read(spark, folder, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


CLUSTERS, COMPONENTS, SCALE, ROUNDS = 16, 64, 64, 3


def op13_va_clusters(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _read(spark, folder, "embeddings").select("vec_id", "embedding")
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = vectors.where(centroids.usable(F.col("embedding"), COMPONENTS, SCALE)).orderBy(order.asc_nulls_last(), "embedding").limit(CLUSTERS)
    found, centres = centroids.cluster(vectors, "vec_id", "embedding", first.select(F.col("embedding").alias("v")), COMPONENTS, SCALE, ROUNDS)
    found = saved(found)
    own = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row per centroid
    facts = [(c, s, sum(own.values()), sha256(",".join(map(str, centres[c].tolist())).encode()).hexdigest()) for c, s in own.items()]
    told = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select(F.col("key").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _assign_sql(r: int) -> str:
    """``a<r>(vec_id, v, c, d)``: the nearest centroid of ``c<r>(c, v)``."""
    return f"""a{r} AS (SELECT vec_id, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT e.vec_id, e.v, k.c,
  list_sum(list_transform(list_zip(e.v, k.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM e, c{r} k) GROUP BY vec_id, v)"""


def _centroids_sql(r: int) -> str:
    """``c<r + 1>``: floored means of the clusters in ``a<r>``; a centroid without vectors stays."""
    return f"""m{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n
  FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i) GROUP BY c),
c{r + 1} AS (SELECT c{r}.c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} ON m{r}.c = c{r}.c)"""


OP13_SQL = f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT v, sha256('1:' || vec_id) AS h FROM e ORDER BY h LIMIT {CLUSTERS})),
{", ".join(f"{_assign_sql(r)}, {_centroids_sql(r)}" for r in range(ROUNDS))}, {_assign_sql(ROUNDS)}
SELECT a.vec_id, a.c::INTEGER AS "cluster", a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(k.v, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} k ON k.c = a.c
"""


QUERIES = {
    "op1_fingerprints": op1_fingerprints, "op2_url_filter": op2_url_filter, "op3_mix_sources": op3_mix_sources,
    "op4_best_fit_packing": op4_best_fit_packing, "op5_suffix_dedup": op5_suffix_dedup, "op6_secret_scan": op6_secret_scan,
    "op7_line_dedup": op7_line_dedup, "op8_quality_rules": op8_quality_rules,
    "op9_licence_scan": op9_licence_scan, "op10_simhash": op10_simhash, "op11_merkle_manifest": op11_merkle_manifest,
    "op12_projection_neighbours": op12_projection_neighbours, "op13_va_clusters": op13_va_clusters,
}
ORACLE_SQL = {"op2_url_filter": OP2_SQL, "op11_merkle_manifest": OP11_SQL, "op13_va_clusters": OP13_SQL}
