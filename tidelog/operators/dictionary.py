"""Dictionary encoding: codes by order of first appearance, from 0; and the deterministic bulk-load generator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import RUN_FILE_HEADER, seeded_text, varint_hex, varint_len
from .prefix_sum import ordered_sums, running_sum


def dictionary(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, code). `order` is a whole-numbered column; keys first seen in one row rank by key."""
    first = rows.groupBy(key).agg(F.min(order).alias("first_seen"))
    return running_sum(first, "first_seen", F.lit(1), "code").select(key, "code")


def encode(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with the key's code."""
    return rows.join(dictionary(rows, key, order), key)


def compressed_run(runs: DataFrame, codes: DataFrame) -> DataFrame:
    """(run_id, code, size_bytes, record_hex, offset) of the records of runs that aren't deleted, in order of keys: the
    varints of the key's code and of the value's size, then the value."""
    of = codes.select(F.col("key").alias("of_key"), "code")
    kept = runs.where(~F.col("tombstone")).join(of, F.col("key") == F.col("of_key"))
    value = F.coalesce("value", F.lit(""))
    size = F.octet_length(value).cast("long")
    record = F.lower(F.concat(varint_hex(F.col("code")), varint_hex(size), F.hex(F.encode(value, "UTF-8"))))
    rows = kept.withColumn("size_bytes", varint_len(size)).withColumn("record_hex", record).withColumn("width", F.length("record_hex") / 2)
    placed = ordered_sums(rows, ["run_id"], "key", offset=F.col("width").cast("long"))
    return placed.select("run_id", "code", "size_bytes", "record_hex", (F.col("offset") + RUN_FILE_HEADER).alias("offset"))


def shuffled(keys: DataFrame, seed: int) -> DataFrame:
    """(key, place): the distinct keys in an order that the seed alone decides."""
    drawn = keys.select("key").distinct().withColumn("drawn", F.md5(F.concat_ws(":", F.lit(str(seed)), "key")))
    return ordered_sums(drawn, [], "drawn", place=F.lit(1)).select("key", "place")


def bulk_load(spark: SparkSession, n: int = 100_000, keys: int = 100) -> DataFrame:
    """(i, key, value): n puts over a list of keys, the value's length is i % 100."""
    i = F.col("id")
    return spark.range(n).select(i.alias("i"), F.concat(F.lit("key"), (i % keys).cast("string")).alias("key"), seeded_text(i % 100, i).alias("value"))


def bulk_load_encoded(spark: SparkSession, n: int = 100_000, keys: int = 100) -> DataFrame:
    """(i, code, value_bytes, size_bytes): the load with keys by code and the varint width of the value's size."""
    rows = encode(bulk_load(spark, n, keys), "key", "i")
    size = F.octet_length("value").cast("bigint")
    return rows.select("i", "code", size.alias("value_bytes"), varint_len(size).alias("size_bytes"))
