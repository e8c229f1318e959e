"""SHA-1 trees over runs: leaf SHA-1(key, value), parent SHA-1(left, right) over raw bytes, an odd node is its own partner, a
run of one record has its leaf as root. A shuffle raises 8 levels at once: blocks of 256 nodes are folded in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runs import numbered

STEP = 8
WIDTH = 1 << STEP


def leaves(runs: DataFrame) -> DataFrame:
    """(run_id, pos, hash), in order of keys."""
    leaf = F.sha1(F.concat(F.encode("key", "UTF-8"), F.encode(F.coalesce("value", F.lit("")), "UTF-8")))
    return numbered(runs).select("run_id", "pos", leaf.alias("hash"))


def _raise(nodes: Column) -> Column:
    """One level: pairs of neighbours."""
    at = lambda i: F.unhex(F.element_at(nodes, i))
    n = F.size(nodes)
    return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 2).cast("int")), lambda i: F.sha1(F.concat(at(2 * i + 1), at(F.least(2 * i + 2, n)))))


def roots(runs: DataFrame) -> DataFrame:
    """(run_id, root)."""
    level = leaves(runs)
    sizes = level.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    level, most = level.join(sizes, "run_id"), sizes.agg(F.max("n")).first()[0] or 0
    while True:
        blocks = level.groupBy("run_id", "n", F.floor(F.col("pos") / WIDTH).alias("pos")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"]).alias("nodes"))
        # a run of one block stops at one node; blocks of a longer run rise all 8 levels
        up = lambda stop: F.aggregate(F.sequence(F.lit(1), F.lit(STEP)), F.col("nodes"), lambda a, _: F.when(F.size(a) == 1, a).otherwise(_raise(a)) if stop else _raise(a))[0]
        folded = F.when(F.col("n") <= WIDTH, up(True)).otherwise(up(False))
        level = blocks.select("run_id", F.greatest(F.lit(1), F.ceil(F.col("n") / WIDTH)).cast("bigint").alias("n"), "pos", folded.alias("hash"))
        if most <= WIDTH:
            return level.select("run_id", F.col("hash").alias("root"))
        most = -(-most // WIDTH)


def verify(runs: DataFrame, recorded: DataFrame) -> DataFrame:
    """(run_id, ok): whether each run still has its recorded root."""
    return recorded.join(roots(runs).withColumnRenamed("root", "now"), "run_id", "left").select("run_id", (F.coalesce("now", F.lit("")) == F.col("root")).alias("ok"))
