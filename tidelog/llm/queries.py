"""The queries of the operators in this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, jaccard, langid, packing, pii, substring_dedup, token_files, topk, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the text without sentences that repeat earlier ones, and how many sentences and words went."""
    return substring_dedup.dedup(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = langid.predict(docs.select("doc_id", "text"), langid.train(docs))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), langid.is_held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds."""
    return decontam.leaks(_read(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "benchmark", "item_id", "text"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encoded(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels", "doc_id", "toxic"))
    scored = toxicity.score(docs, model)
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), langid.is_held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive(_read(spark, sf_dir, "pages", "page_id", "url", "html"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict:
    found = [op1_substring_dedup, op2_pii, op3_language_id, op4_decontamination, op5_token_files, op6_jaccard_join, op7_packing, op8_top_k, op9_toxicity, op10_warc]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op8_top_k": OP8}


OP8 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
