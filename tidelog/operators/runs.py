"""Sorted runs: flush, manifest, sparse index, summary, offsets, zone lookup and the lookup chain. A run may be of any size:
places and offsets come from sums over ranges of its keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codecs import RUN_FILE_HEADER, record_size
from ..sources.folders import written
from . import sketches
from .log import latest
from .prefix_sum import ordered_sums


def daily(log: DataFrame) -> DataFrame:
    """The log with run_id, the day of its time as yyyymmdd; level 1."""
    return log.withColumn("run_id", F.date_format("ts", "yyyyMMdd").cast("int")).withColumn("level", F.lit(1))


def flush(log_by_run: DataFrame) -> DataFrame:
    """Each run's newest record of every key."""
    return latest(log_by_run, "level", "run_id")


def numbered(runs: DataFrame) -> DataFrame:
    """Records by key within their run, from 0."""
    return ordered_sums(runs, ["run_id"], "key", pos=F.lit(1))


def manifest(runs: DataFrame) -> DataFrame:
    """(level, run_id, n_rows, bytes, min_key, max_key), a row for each run."""
    return runs.groupBy("level", "run_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(record_size(F.col("key"), F.col("value"))).alias("bytes"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))


def level_bytes(runs: DataFrame) -> DataFrame:
    return runs.groupBy("level").agg(F.countDistinct("run_id").alias("n_runs"), F.sum(record_size(F.col("key"), F.col("value"))).alias("bytes"))


def listing(runs: DataFrame) -> DataFrame:
    """Runs newest first."""
    return manifest(runs).select("run_id", "level", "n_rows").orderBy(F.desc("run_id"))


def with_offsets(runs: DataFrame) -> DataFrame:
    """Records with their place and byte offset within the run's file."""
    size = record_size(F.col("key"), F.col("value"))
    return ordered_sums(runs.withColumn("size", size), ["run_id"], "key", pos=F.lit(1), offset=F.col("size")).withColumn("offset", F.col("offset") + RUN_FILE_HEADER)


def sparse_index(runs: DataFrame, stride: int = 2) -> DataFrame:
    """First records of blocks of `stride` records."""
    return with_offsets(runs).where(F.col("pos") % stride == 0).select("run_id", "pos", "key", "offset")


def sample_summary(runs: DataFrame, percent: int = 49) -> DataFrame:
    """First and last key of each run and a hashed sample of the others."""
    placed = with_offsets(runs)
    ends = placed.groupBy(F.col("run_id").alias("of")).agg(F.max("pos").alias("last"))
    edge = (F.col("pos") == 0) | (F.col("pos") == F.col("last"))
    drawn = F.conv(F.substring(F.md5("key"), 1, 8), 16, 10).cast("bigint") % 100 < percent
    return placed.join(ends, F.col("run_id") == F.col("of")).where(edge | drawn).select("run_id", "key", "offset")


def stride_summary(runs: DataFrame, step: int, percent: int = 49) -> DataFrame:
    """Every step-th key, from the first, of each run's sample."""
    return ordered_sums(sample_summary(runs, percent), ["run_id"], "key", ord=F.lit(1)).where(F.col("ord") % step == 0).drop("ord")


def _leaders(placed: DataFrame, probes: DataFrame, stride: int) -> DataFrame:
    """(run_id, key, leader, offset, pos) of each probe: the last of every stride-th key that isn't after it, and its place;
    none before a run's first key or after its last. Leaders and probes are cut into ranges of keys together; a range
    without a leader takes the last one before it."""
    last = placed.groupBy(F.col("run_id").alias("of")).agg(F.max("key").alias("last_key"))
    leaders = placed.where(F.col("pos") % stride == 0).select("run_id", "key", F.lit(0).alias("probe"), F.struct("key", "offset", "pos").alias("leader"))
    asked = probes.select("run_id", "key", F.lit(1).alias("probe"), F.lit(None).cast(leaders.schema["leader"].dataType).alias("leader"))
    dealt = written(leaders.unionByName(asked).repartitionByRange("run_id", "key").withColumn("range", F.spark_partition_id()), "zones")
    tops = dealt.groupBy("run_id", "range").agg(F.max("leader").alias("top"))
    above = Window.partitionBy("run_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(F.col("run_id").alias("in_run"), F.col("range").alias("in_range"), F.max("top").over(above).alias("carried"))
    inner = Window.partitionBy("run_id", "range").orderBy("key", "probe")
    found = dealt.join(tops, (F.col("run_id") == F.col("in_run")) & (F.col("range") == F.col("in_range"))).withColumn("zone", F.coalesce(F.last("leader", ignorenulls=True).over(inner), F.col("carried")))
    hit = found.where("probe = 1").join(last, F.col("run_id") == F.col("of"), "left").withColumn("zone", F.when(F.col("key") <= F.col("last_key"), F.col("zone")))
    return hit.select("run_id", "key", F.col("zone.key").alias("leader"), F.col("zone.offset").alias("offset"), F.col("zone.pos").alias("pos"))


def zone_lookup(runs: DataFrame, probes: DataFrame, stride: int = 4) -> DataFrame:
    """For every probe (run_id, key): the greatest leader not after it and the leader's offset; probes before a run's first
    key or after its last have none."""
    return _leaders(with_offsets(runs), probes, stride).select("run_id", "key", "leader", "offset")


def filters(runs: DataFrame, m: int, k: int) -> DataFrame:
    """(run_id, pos): the set bits of each run's filter, m rows at most for a run."""
    return sketches.md5_positions(runs.select("run_id", "key"), m, k).select("run_id", F.col("pos").alias("bit")).distinct()


def lookup_chain(runs: DataFrame, probes: DataFrame, m: int, k: int, stride: int = 2, blocks: int = 2) -> DataFrame:
    """(run_id, key, summary_offset, index_offset, offset, value) of the probes (key) in every run that holds them: through
    the run's filter, its summary (every `blocks`-th block), its index (first records of blocks) to the record, whose value
    must fit the checksum that the run keeps of it (column crc; made here if there is none). Deleted records have no value and aren't found."""
    check = F.crc32(F.encode(F.coalesce("value", F.lit("")), "UTF-8"))
    placed = written(with_offsets(runs if "crc" in runs.columns else runs.withColumn("crc", check)), "placed")
    asked = sketches.md5_positions(probes.select("key").distinct(), m, k).select("key", F.col("pos").alias("at"))
    maybe = asked.join(filters(runs, m, k), F.col("at") == F.col("bit")).groupBy("run_id", "key").agg(F.countDistinct("at").alias("hits"))
    bits = asked.groupBy(F.col("key").alias("of_key")).agg(F.countDistinct("at").alias("bits"))
    passed = written(maybe.join(bits, F.col("key") == F.col("of_key")).where("hits = bits").select("run_id", "key"), "passed")
    summary = _leaders(placed, passed, stride * blocks).where("leader IS NOT NULL").select("run_id", "key", F.col("offset").alias("summary_offset"), F.col("pos").alias("from_pos"))
    # within the summary's zone: the index entry before the key, then the block's records
    index = placed.where(F.col("pos") % stride == 0).select(F.col("run_id").alias("i_run"), F.col("key").alias("i_key"), F.col("offset").alias("i_offset"), F.col("pos").alias("i_pos"), (F.col("pos") - F.col("pos") % (stride * blocks)).alias("i_from"))
    zone = summary.join(index, (F.col("run_id") == F.col("i_run")) & (F.col("from_pos") == F.col("i_from")) & (F.col("i_key") <= F.col("key")))
    block = zone.groupBy("run_id", "key", "summary_offset").agg(F.max(F.struct("i_pos", "i_offset")).alias("i"))
    data = placed.select(F.col("run_id").alias("d_run"), F.col("key").alias("d_key"), (F.col("pos") - F.col("pos") % stride).alias("d_block"), F.col("offset").alias("offset"), "value", "tombstone", "crc")
    found = block.join(data, (F.col("run_id") == F.col("d_run")) & (F.col("i.i_pos") == F.col("d_block")) & (F.col("key") == F.col("d_key")))
    whole = ~F.col("tombstone") & (check == F.col("crc"))
    return found.where(whole).select("run_id", "key", "summary_offset", F.col("i.i_offset").alias("index_offset"), "offset", "value")
