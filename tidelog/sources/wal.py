"""The write-ahead log: records with offsets, segments, recovery after a skipped prefix, truncation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import LOG_HEADER, decode_log_record, encode_log_record, log_crc, record_size
from ..operators.log import latest
from ..operators.prefix_sum import running_sum


def seconds(log: DataFrame) -> DataFrame:
    """The log with ts as whole Unix seconds."""
    return log.withColumn("ts", F.unix_timestamp(F.col("ts").cast("timestamp")))


def offsets(log: DataFrame) -> DataFrame:
    """(seq, size, start, stop): each record's byte range in the log."""
    size = record_size(F.col("key"), F.col("value"), LOG_HEADER)
    return running_sum(log.withColumn("size", size), "seq", size, "start").select("seq", "key", "size", "start", (F.col("start") + F.col("size")).alias("stop"))


def segments(log: DataFrame, segment_bytes: int) -> DataFrame:
    """(segment, n_records, first_seq, last_seq, bytes): segments by running size; a record belongs to the segment where it
    begins and may reach into the next."""
    return offsets(log).groupBy(F.floor(F.col("start") / segment_bytes).alias("segment")).agg(F.count(F.lit(1)).alias("n_records"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.sum("size").alias("bytes"))


def truncate(log: DataFrame, flushed_bytes: int, segment_bytes: int) -> DataFrame:
    """(segment, removed, skip): segments wholly covered by the flushed bytes go; the first kept one skips the rest."""
    kept_from = flushed_bytes // segment_bytes
    return segments(log, segment_bytes).select("segment", (F.col("segment") < kept_from).alias("removed"), F.when(F.col("segment") == kept_from, F.lit(flushed_bytes % segment_bytes)).otherwise(0).cast("bigint").alias("skip"))


def low_water(log: DataFrame, segment_bytes: int, keep: int) -> DataFrame:
    """The newest `keep` segments."""
    return segments(log, segment_bytes).orderBy(F.desc("segment")).limit(keep)


def recover(log: DataFrame, skip_bytes: int) -> DataFrame:
    """Replay of the records that begin at or after the skipped bytes: the newest of every key."""
    rest = offsets(log).where(F.col("start") >= skip_bytes).select("seq")
    return latest(log.join(rest, "seq", "left_semi"))


def encode(log: DataFrame) -> DataFrame:
    """(seq, record binary) of a log whose ts is in seconds."""
    return log.select("seq", encode_log_record(F.col("ts"), F.col("tombstone"), F.col("key"), F.col("value")).alias("record"))


def decode(records: DataFrame) -> DataFrame:
    """Records whose checksum holds."""
    got = records.select("seq", decode_log_record(F.col("record")).alias("r")).where("r.valid")
    return got.select("r.key", "r.value", "r.tombstone", "r.ts", "seq")


def checksums(log: DataFrame) -> DataFrame:
    return log.select("seq", log_crc(F.col("ts"), F.col("tombstone"), F.col("key"), F.col("value")).alias("crc"))
