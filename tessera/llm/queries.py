"""The registered queries of this subpackage: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitsliced, boosting, crf, ftrl, fuzzylines, langid, licenses, mixing, neardup, packing, projections, spelling
from .common import crc_mod, table


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return crf.label(docs, crf.train(docs, table(spark, sf_dir, "labels")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ftrl.train(docs, table(spark, sf_dir, "labels"))
    held = (crc_mod("doc_id", 4) == 2).alias("held_out")
    return ftrl.score(docs, model).select("doc_id", held, "score", "predicted")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs).drop("text")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = boosting.train(docs, table(spark, sf_dir, "labels"))
    held = (crc_mod("doc_id", 5) == 0).alias("held_out")
    return boosting.score(docs, model).select("doc_id", held, "score", "predicted")


def op8_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fuzzylines.dedupe(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_cut", F.length("text").cast("long").alias("chars_left"), F.md5("text").alias("text_md5"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = (crc_mod("doc_id", 4) == 2).alias("held_out")
    return langid.predict(docs.drop("lang"), langid.train(docs)).select("doc_id", held, "lang_pred", "score")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op11_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.near_duplicates(table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (
    op1_topk_search, op2_quality_rules, op3_toxicity, op4_license_scan, op5_minhash_near_dedup,
    op6_packing, op7_quality_classifier, op8_fuzzy_line_dedup, op9_language_id, op10_source_mixing,
    op11_vector_near_dedup, op12_spelling_variants,
)}

ORACLES = {
    "op1_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score
FROM s QUALIFY "rank" <= 5
""",
    "op4_license_scan": licenses.scan_sql(),
    "op10_source_mixing": r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS tm, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), o AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY k, tm, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS at FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), n AS (
  SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, row_number() OVER (ORDER BY source NULLS LAST) AS num FROM s
), r AS (
  SELECT *, 2 * source_size AS cap, CAST(2 * source_size AS DOUBLE) / w AS ratio, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) AS total FROM n
), l AS (
  SELECT *, (total - CAST(coalesce(sum(cap) OVER (ORDER BY ratio, num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
            / CAST(sum(w) OVER (ORDER BY ratio, num ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM r
), t AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), w * (SELECT max(level) FROM l WHERE ratio >= level)) AS target FROM l
), p AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS take FROM t
)
SELECT o.doc_id, o.size, p.source_size, p.target,
       CAST(CASE WHEN p.source_size = 0 THEN 0 ELSE o.size * (p.take // p.source_size)
            + greatest(0, least(o.at + o.size, p.take % p.source_size) - o.at) END AS BIGINT) AS taken
FROM o JOIN p ON o.source IS NOT DISTINCT FROM p.source
""",
    "op11_vector_near_dedup": """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.k AS a, b.k AS b, b.vec_id AS id FROM v a JOIN v b ON a.k <> b.k AND len(a.e) = len(b.e)
  AND list_inner_product(a.e, b.e) >= 0.95::DOUBLE * sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e))
), reach AS (
  SELECT a, b, id FROM l UNION SELECT r.a, l.b, l.id FROM reach r JOIN l ON r.b = l.a
), n AS (SELECT a AS k, count(*) AS n FROM l GROUP BY 1), c AS (SELECT a AS k, min(id) AS c FROM reach GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c, vec_id)) AS kept
FROM v LEFT JOIN n USING (k) LEFT JOIN c USING (k)
UNION ALL SELECT vec_id, 0, vec_id, vec_id IS NOT NULL FROM embeddings e
WHERE vec_id IS NULL OR embedding IS NULL OR len(embedding) = 0 OR len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0 OR len(list_filter(embedding, lambda x: x <> 0)) = 0
""",
}
