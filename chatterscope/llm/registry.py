"""The queries opN_<name> and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterscope.llm import alignment, inner_products, line_templates, merkle, mixing, near_dup, ordinal_quality, packing, posting_lists, quality_rules, secret_scan, sharding, suffix_tree
from chatterscope.llm.common import table


def op1_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), size=5, percent=75)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.digest(secret_scan.secret_scan(docs, repo=F.concat_ws("/", "source", "lang"), owner=F.col("source")))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=1024, end_id=2)


#: The mixture's targets: domains, and languages inside every domain; sources of a language weigh the same.
DOMAINS = {"web": 0.5, "reference": 0.3, "forum": 0.2}
LANGUAGES = {"en": 0.55, "fr": 0.15, "de": 0.15, "es": 0.15}
WEIGHTS = {(d,): w for d, w in DOMAINS.items()} | {(d, x): w for d in DOMAINS for x, w in LANGUAGES.items()}


def domain() -> Column:
    """The tables name no domain; a source's is fixed by its CRC."""
    return F.get(F.array(*map(F.lit, DOMAINS)), (F.crc32(F.coalesce("source", F.lit(""))) % 3).cast("int"))


LEVELS = {"domain": domain, "lang": lambda: F.col("lang"), "source": lambda: F.col("source")}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = mixing.mix(docs, {k: f() for k, f in LEVELS.items()}, WEIGHTS, total_tokens=1.0, max_epochs=2)
    return out.select("doc_id", "epoch", "n_tokens", "take_tokens")


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.drop_recurring_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op10_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ordinal_quality.train(docs, table(spark, sf_dir, "labels"))
    return ordinal_quality.classify(docs, model).select("doc_id", "expected_grade", "tail_prob", F.col("accepted").alias("kept"))


def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"))


def op6_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_lists.search(table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 100 == 0)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), n_shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 0
    n = F.when(hit, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)"))
    return merkle.manifest(table(spark, sf_dir, "documents"), group="lang", tampered={"n_chars": n}, arity=2)


def op12_top_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inner_products.search(table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 100 == 0, scale=1024, k=10)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(alignment.align(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_near_dup, op2_secret_scan, op3_best_fit_packing, op4_mixing, op5_suffix_tree, op6_posting_lists, op7_quality_rules, op8_sharding, op9_line_templates, op10_ordinal_quality, op11_merkle_manifest, op12_top_inner_products, op13_token_alignment)}
#: SQL has no fits, byte-pair encoding or hashes of other engines; tests compare every other query with brute force.
ORACLES: dict[str, str] = {
    "op11_merkle_manifest": """
WITH RECURSIVE crc AS (
  SELECT *, CAST(doc_id AS VARCHAR) AS d, n_chars IS NOT NULL AND doc_id IS NOT NULL AND xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
      range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda j: [CAST(ascii(substr(CAST(doc_id AS VARCHAR), j, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) % 7 = 0 AS hit
  FROM documents
), said AS (
  SELECT doc_id, lang, hit, n_chars, coalesce(strlen(d) || ':' || d, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM crc
), hashed AS (
  SELECT doc_id, lang, sha256(head || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN hit THEN sha256(head || length(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) || tail) END AS other
  FROM said
), leaves AS (
  SELECT doc_id, leaf, other, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM hashed
), up AS (
  SELECT g, 0 AS level, i, leaf AS h, n FROM leaves
  UNION ALL SELECT g, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM up WHERE n > 1 GROUP BY g, level, i // 2, n
), above AS (
  SELECT 0 AS level, g AS i, h, (SELECT count(DISTINCT g) FROM leaves) AS n FROM up WHERE n = 1
  UNION ALL SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM above WHERE n > 1 GROUP BY level, i // 2, n
), nodes AS (SELECT g, level, i, h FROM up UNION ALL SELECT -1, level, i, h FROM above),
sizes AS (SELECT DISTINCT g, level, n FROM up UNION ALL SELECT DISTINCT -1, level, n FROM above),
climb AS (
  SELECT row_number() OVER () AS k, doc_id, leaf, g, g AS tree, 0 AS level, i, coalesce(other, leaf) AS h, '' AS siblings FROM leaves
  UNION ALL
  SELECT k, doc_id, leaf, c.g, CASE WHEN n > 1 THEN tree ELSE -1 END, CASE WHEN n > 1 THEN c.level + 1 ELSE 0 END, CASE WHEN n > 1 THEN c.i // 2 ELSE c.g END,
    CASE WHEN n = 1 THEN c.h WHEN c.i % 2 = 0 THEN sha256(c.h || coalesce(s.h, '')) ELSE sha256(s.h || c.h) END, siblings || CASE WHEN n > 1 THEN coalesce(s.h, '') ELSE '' END
  FROM climb c JOIN sizes z ON z.g = tree AND z.level = c.level LEFT JOIN nodes s ON s.g = tree AND s.level = c.level AND s.i = xor(c.i, 1)
  WHERE tree <> -1 OR n > 1
)
SELECT doc_id, leaf, r.h AS subroot, t.h AS root, sha256(siblings) AS proof_sha256, c.h AS folded_root, c.h = t.h AS verified
FROM climb c JOIN sizes z ON tree = -1 AND z.g = -1 AND z.level = c.level AND z.n = 1 JOIN (SELECT g, h FROM up WHERE n = 1) r ON r.g = c.g CROSS JOIN (SELECT h FROM above WHERE n = 1) t
""",
    "op12_top_inner_products": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, p.vec_id, CAST(list_inner_product(q.v, p.v) AS BIGINT) AS score FROM v q JOIN v p ON q.vec_id % 100 = 0 AND p.vec_id <> q.vec_id
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
""",
}
