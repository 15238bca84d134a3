"""The registered queries of this subpackage: each applies its operator to the whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.mixing import plan

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return plan(docs).select(
        "doc_id", F.col("__mix_size").alias("size"), F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"), (F.col("__mix_size") * F.col("__mix_copies")).alias("taken")
    )


#: The same computation for DuckDB: the draw is a prefix of an MD5 digest, which both engines have.
OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3)::DOUBLE AS weight FROM s),
r AS (SELECT *, source_size * 3.0::DOUBLE / weight AS r FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size) OVER b, 0) * 3)::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      , row_number() OVER (ORDER BY r, encode(source) NULLS LAST) AS nth
      FROM r WINDOW b AS (ORDER BY r, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT r AS first_r, level AS first_level FROM l WHERE level <= r ORDER BY nth LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN r < first_r THEN source_size * 3.0::DOUBLE ELSE first_level * weight END AS target FROM l, m),
q AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
      ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || ':17'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM q
"""


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.sharding import shard_records

    return shard_records(table(spark, sf_dir, "documents").select("doc_id", "text"), [1.0] * 16)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.ppm import score_texts

    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.quality import verdicts

    return verdicts(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.embeddings import links

    return links(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


#: All pairs of a label, and what links reach; vectors that can't be compared stay alone.
OP3_SQL = r"""
WITH RECURSIVE u AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.98),
r AS (SELECT DISTINCT a AS node, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node WHERE r.root < l.b),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.root, e.vec_id) AS component_id, e.vec_id = coalesce(c.root, e.vec_id) AS kept
FROM embeddings e LEFT JOIN c ON c.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.simhash import classes

    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.toxicity import score_texts

    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.packing import pack

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.langid import predict

    return predict(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: What the archives have to hold; base32 takes five bits of two hexadecimal digits at a time.
OP10_SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((1 + ((('0x' || substr(h, (1 + (5 * i) // 4)::INT, 2))::INT >> (3 - (5 * i) % 4)::INT) & 31)))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (op1_lm_scoring, op2_quality_rules, op3_embedding_dedup, op4_simhash, op5_toxicity, op6_mixing, op7_packing, op8_sharding, op9_language_id, op10_warc)
}
ORACLE_SQL: dict[str, str] = {"op3_embedding_dedup": OP3_SQL, "op6_mixing": OP6_SQL, "op10_warc": OP10_SQL}
