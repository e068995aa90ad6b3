"""The queries of the training-data operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import lines, minhash, mixing, outliers, packing, passages, sharding, topk, toxicity, warc
from .common import table

SHARDS = [f"shard-{i:03d}" for i in range(32)]


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).drop("ids")


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses_of(table(spark, sf_dir, "pages")), with_record=False)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.quality_verdicts(table(spark, sf_dir, "documents").drop("n_chars"))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("h", "n")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


QUERIES = (op1_topk_search, op2_packing, op3_warc_derivatives, op4_minhash_near_dedup, op5_sharding, op6_line_dedup, op7_quality_outliers, op8_passages, op9_mixing, op10_toxicity)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_topk_search": TOPK_SQL, "op4_minhash_near_dedup": NEAR_SQL, "op5_sharding": SHARDING_SQL}


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""

#: The table is filled turn by turn: each turn's shard takes the first free slot of its order.
SHARDING_SQL = """
WITH RECURSIVE shards AS (
  SELECT i, 'shard-' || lpad(CAST(i AS VARCHAR), 3, '0') AS name FROM range(32) t(i)
), orders AS (
  SELECT i, name, CAST('0x' || substr(md5(name || '/offset'), 1, 8) AS BIGINT) % 4099 AS o,
         CAST('0x' || substr(md5(name || '/skip'), 1, 8) AS BIGINT) % 4098 + 1 AS k FROM shards
), fill AS (
  SELECT CAST(-1 AS BIGINT) AS turn, CAST(-1 AS BIGINT) AS slot, CAST(repeat('0', 4099) AS BIT) AS taken
  UNION ALL
  SELECT turn + 1, claim, set_bit(taken, CAST(claim AS INTEGER), 1) FROM (
    SELECT turn, taken, (
      SELECT min_by((o + j * k) % 4099, j) FROM range(4099) r(j)
      WHERE get_bit(taken, CAST((o + j * k) % 4099 AS INTEGER)) = 0) AS claim
    FROM fill JOIN orders ON i = (turn + 1) % 32 WHERE turn < 4098)
)
SELECT doc_id, slot, name AS shard
FROM (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % 4099 AS slot FROM documents) d
JOIN fill USING (slot) JOIN shards ON i = turn % 32
"""

#: All pairs of sets that share a shingle, copies first made one; then the least id reachable, link by link.
NEAR_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN list_distinct([w[1]])
    ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s FROM words
), classes AS (
  SELECT s, min(doc_id) AS id, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), grams AS (
  SELECT id, n, unnest(s) AS g FROM classes
), common AS (
  SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM grams a JOIN grams b
    ON a.g = b.g AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL
), links AS (
  SELECT a, b FROM common WHERE 100 * c >= 80 * (na + nb - c) UNION SELECT b, a FROM common WHERE 100 * c >= 80 * (na + nb - c)
), reached AS (
  SELECT id, id AS least FROM classes UNION SELECT l.b, r.least FROM reached r JOIN links l ON l.a = r.id WHERE r.least < l.b
), parts AS (
  SELECT id, min(least) AS component_id FROM reached GROUP BY id
)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(p.component_id, d.doc_id) AS component_id,
  d.doc_id = coalesce(p.component_id, d.doc_id) AS kept
FROM sets d LEFT JOIN classes c ON c.s = d.s LEFT JOIN parts p ON p.id = c.id
"""
