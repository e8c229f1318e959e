"""Membership, frequency and distinct-count sketches as state tables. States combine by set union, + and max, so Spark's
partial aggregation merges them; a table of counters has a fixed bound."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import fnv1a32, fnv1a64, md5_u64, trailing_zeros

SEED_BASE = 1234


def bloom_params(n: int, p: float) -> tuple[int, int]:
    m = math.ceil(n * abs(math.log(p)) / math.log(2) ** 2)
    return m, math.ceil(m / n * math.log(2))


def cms_params(epsilon: float, delta: float) -> tuple[int, int]:
    return math.ceil(math.log(math.e / delta)), math.ceil(math.e / epsilon)


def md5_positions(keys: DataFrame, m: int, k: int) -> DataFrame:
    """keys (with a column key) with i and pos for each of k seeded hashes."""
    return keys.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i")).withColumn("pos", (md5_u64(F.col("key"), F.lit(SEED_BASE) + F.col("i")) % F.lit(m).cast("decimal(20,0)")).cast("bigint"))


def bloom_bits(keys: DataFrame, m: int, k: int) -> DataFrame:
    """Positions of the set bits: m rows at most."""
    return md5_positions(keys.select("key").distinct(), m, k).select("pos").distinct()


def _contains(positions: DataFrame, bits: DataFrame, k: int) -> DataFrame:
    hit = positions.join(F.broadcast(bits.withColumn("hit", F.lit(1))), "pos", "left")  # bits: at most m rows
    return hit.groupBy("key").agg((F.sum(F.coalesce("hit", F.lit(0))) == k).alias("maybe"))


def bloom_contains(probes: DataFrame, bits: DataFrame, m: int, k: int) -> DataFrame:
    return _contains(md5_positions(probes.select("key").distinct(), m, k), bits, k)


def fnv_positions(keys: DataFrame, size: int, k: int) -> DataFrame:
    hashed = keys.select("key").distinct().withColumn("h", fnv1a32(F.col("key")))
    return hashed.select("key", F.explode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda s: F.col("h").bitwiseXOR(s.cast("bigint")) % size)).alias("pos"))


def bloom_fnv_bits(keys: DataFrame, size: int, k: int) -> DataFrame:
    return fnv_positions(keys, size, k).select("pos").distinct()


def bloom_fnv_contains(probes: DataFrame, bits: DataFrame, size: int, k: int) -> DataFrame:
    return _contains(fnv_positions(probes, size, k), bits, k)


def cms_cells(keys: DataFrame, m: int, k: int) -> DataFrame:
    return keys.select("key", "n", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("row")).withColumn("bucket", (md5_u64(F.col("key"), F.lit(SEED_BASE) + F.col("row")) % F.lit(m).cast("decimal(20,0)")).cast("bigint"))


def cms_build(keys: DataFrame, m: int, k: int) -> DataFrame:
    """(row, bucket, cnt): k * m rows at most. Keys are counted first, so each is hashed once."""
    counted = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return cms_cells(counted, m, k).groupBy("row", "bucket").agg(F.sum("n").alias("cnt"))


def cms_reset(cells: DataFrame) -> DataFrame:
    """The sketch emptied: its counters at zero."""
    return cells.withColumn("cnt", F.lit(0).cast("long"))


def cms_frequency(probes: DataFrame, cells: DataFrame, m: int, k: int) -> DataFrame:
    """(key, estimate): the least counter; never below the truth."""
    asked = cms_cells(probes.select("key").distinct().withColumn("n", F.lit(0)), m, k).drop("n")
    got = asked.join(F.broadcast(cells), ["row", "bucket"], "left")  # cells: at most k * m rows
    return got.groupBy("key").agg(F.min(F.coalesce("cnt", F.lit(0))).alias("estimate"))


def hll_registers(keys: DataFrame, p: int, wide: bool = False) -> DataFrame:
    """(bucket, rank): 2^p rows at most."""
    if not 4 <= p <= 16:
        p = 8
    if wide:
        h = keys.select(fnv1a64(F.col("key")).alias("h"))
        zeros = F.when(F.col("h.lo") != 0, trailing_zeros(F.col("h.lo"), 32)).otherwise(trailing_zeros(F.col("h.hi"), 32) + 32)
        bucket, width = F.shiftrightunsigned(F.col("h.hi"), 32 - p), 64
    else:
        h = keys.select(fnv1a32(F.col("key")).alias("h"))
        zeros, bucket, width = trailing_zeros(F.col("h"), 32), F.shiftrightunsigned(F.col("h"), 32 - p), 32
    rank = F.least(F.lit(width - p), zeros + 1).cast("int")
    return h.select(bucket.cast("bigint").alias("bucket"), rank.alias("rank")).groupBy("bucket").agg(F.max("rank").alias("rank"))


def hll_estimate(registers: DataFrame, p: int) -> DataFrame:
    m = float(1 << p)
    top = 2.0**32
    alpha = 0.7213 / (1.0 + 1.079 / m)
    sums = registers.agg(F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("s"), F.count(F.lit(1)).alias("n"))
    empty = F.lit(m) - F.col("n")
    raw = alpha * m * m / (F.coalesce("s", F.lit(0.0)) + empty)
    small: Column = F.when(empty > 0, m * F.log(m / empty)).otherwise(raw)
    fixed = F.when(raw <= 2.5 * m, small).when(raw > top / 30, -top * F.log(1.0 - raw / top)).otherwise(raw)
    return sums.select(F.round(fixed, 6).alias("estimate"))
