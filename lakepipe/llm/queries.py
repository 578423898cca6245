"""The registered queries of these operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


ORACLE["op2_warc_segments"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     q AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
     g AS (SELECT payload_digest, min(page_id) AS least FROM q WHERE payload_bytes >= 100 GROUP BY 1)
SELECT q.page_id, q.payload_bytes, q.payload_digest,
       CASE WHEN least IS NULL OR least = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN least = page_id THEN NULL ELSE least END AS refers_to
FROM q LEFT JOIN g ON q.payload_digest = g.payload_digest
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakepipe.llm import ann

    index = ann.build(table(spark, sf_dir, "embeddings"))
    queries = index.rows.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "vector")
    return index.search(queries, k=20)


@query
def op2_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakepipe.llm import warc
    from lakepipe.llm.common import new_folder

    folder = new_folder(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakepipe.llm import line_dedup

    return line_dedup.report(table(spark, sf_dir, "documents"))


#: (verdict, host and path) of the lists that come before the learned rules.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


@query
def op4_url_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakepipe.llm import url_rules

    return url_rules.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query
def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakepipe.llm import order_minhash

    return order_minhash.compare_with_next(table(spark, sf_dir, "documents"))


@query
def op6_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lakepipe.llm import tokens

    files = tokens.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return tokens.read(spark, files)


@query
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakepipe.llm import simhash

    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakepipe.llm import packing
    from lakepipe.llm.common import word_count

    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", word_count("text").alias("size")))


@query
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakepipe.llm import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.classify(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", "predicted")


@query
def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakepipe.llm import mixing

    return mixing.mix(table(spark, sf_dir, "documents")).report()
