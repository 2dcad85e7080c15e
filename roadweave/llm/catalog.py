"""One query for each operator, with production parameters over its whole table, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.llm import mixing, neighbours, packing, quality, similarity_join, token_files, toxicity, urls, warc, winnowing
from roadweave.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), threshold=0.7)
    return found.select("doc_id", "held_out", "score", "predicted")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1, capacity=4096)
    digests = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    packed = packing.pack(digests, capacity=4096)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), threshold=0.5)
    return found.select("doc_id", "held_out", "score", "predicted")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.warc_round_trip(table(spark, sf_dir, "pages"), least=0)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS h FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS top FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(list_sum(list_transform(range(0, 5), lambda j: ((CAST(('0x' || substr(h, CAST((i * 5 + j) // 4 + 1 AS INTEGER), 1)) AS INTEGER)
      >> CAST(3 - (i * 5 + j) % 4 AS INTEGER)) & 1) << CAST(4 - j AS INTEGER))) AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM m
"""


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join.near_duplicates(table(spark, sf_dir, "documents"), n_words=4, percent=85)


OP6_SQL = """
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM w),
e AS (SELECT r, len(sh) AS n, unnest(sh) AS g FROM s),
i AS (SELECT a.r AS x, b.r AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.r < b.r
    AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM i WHERE 100 * c >= 85 * (n + m - c) UNION SELECT y, x FROM i WHERE 100 * c >= 85 * (n + m - c)),
t AS (SELECT r, r AS z FROM s UNION SELECT t.r, l.y FROM t JOIN l ON t.z = l.x)
SELECT any_value(s.doc_id) AS doc_id, CAST(any_value(len(s.sh)) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM t JOIN s ON s.r = t.r JOIN s o ON o.r = t.z GROUP BY t.r
"""


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edited_fingerprints(table(spark, sf_dir, "documents"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op9_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_id_output(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, repeat=2.0).select("doc_id", "source", "weight", F.col("mix_tokens").alias("tokens"), "epoch", "block", "block_key", "row_key")


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_best_fit_packing,
        op3_url_filters,
        op4_quality_classifier,
        op5_warc,
        op6_ngram_jaccard_join,
        op7_document_fingerprints,
        op8_nearest_neighbours,
        op9_token_id_output,
        op10_source_mixing,
    )
}
ORACLES: dict[str, str] = {"op5_warc": OP5_SQL, "op6_ngram_jaccard_join": OP6_SQL}
