"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs; all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import decontam, jaccard, langid, packing, pii
from tidelog.llm.shared import new_folder, private

#: A posterior below this is a text without one language.
LEAST_LANGUAGE_SCORE = 0.5
#: The posterior is near 1 for any text of some words. A text of less mean score for each character isn't in a learned language:
#: documents of sf0.001 to sf0.1 have -3.7 at least, sentences in other languages with Latin letters -5.0 at most.
LEAST_MEAN_SCORE = -4.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose words and characters are not like a learned language's, or of no one language for sure, go; null, empty and
    letterless ones too, and all if no text has a language to learn."""
    lang, score, mean = private(docs.columns, "lang_pred", "score", "mean_score")
    found = langid.predict(docs, langid.train(docs), result=(lang, score, mean))
    sure = (F.col(lang) != "und") & (F.col(score) >= LEAST_LANGUAGE_SCORE) & (F.col(mean) >= LEAST_MEAN_SCORE)
    return found.where(sure).drop(lang, score, mean)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies stays: that with the least identifier (rows without one last; then by the words'
    hash, then by all columns). Rows may share an identifier; rows without words all stay."""
    return jaccard.distinct(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each row decided on its own; null and empty texts stay, and all if the benchmark
    is empty."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the texts; n_chars follows (null for a null text). All rows stay."""
    return pii.masked(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 token ids and their places in sequences, for every row; a null text is an empty one."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("personal_data", personal_data), ("packing", packed)]

#: Language models, tokenizers and packing can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
