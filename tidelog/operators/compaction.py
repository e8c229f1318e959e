"""Compaction. The driver reads the manifest (a row for each run) and decides; one aggregate merges all groups of a step."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.codecs import record_size
from .log import latest
from .prefix_sum import ordered_sums


def merge(runs: DataFrame, *by: str, order: tuple[str, ...] = ("ts", "seq", "run_id")) -> DataFrame:
    """Newest record of every key within each group; ties go to the later run. Tombstones stay."""
    return latest(runs, *by, order=order)


def purge(runs: DataFrame) -> DataFrame:
    """Drops tombstones, which is right only at the last level."""
    return runs.where(~F.col("tombstone"))


def triggers(by_level: DataFrame, config: EngineConfig) -> DataFrame:
    """(level, n_runs, bytes, by_tables, by_bytes): whether each level is due."""
    scale = F.pow(F.lit(float(config.scaling_factor)), F.col("level") - 1)
    return by_level.select("level", "n_runs", "bytes", (F.col("n_runs") >= config.max_tables * scale).alias("by_tables"), (F.col("bytes") >= config.max_bytes * scale).alias("by_bytes")).where(F.col("level") < config.max_levels)


def size_tiered_plan(runs: list[tuple[int, int, int]], config: EngineConfig, measured=None) -> dict[int, tuple[int, int]]:
    """From (level, run_id, bytes) to run_id -> (final level, final run): pairs of neighbours move up a level, level by level
    while one is due; an odd run stays. A merged run has the smaller id. `measured` gives the bytes of merged runs, from lists
    of the runs that go into each; without it they are taken as the sums."""
    groups = {level: [] for level in range(1, config.max_levels + 1)}
    for level, run, size in sorted(runs):
        groups[level].append(([run], size))
    for level in range(1, config.max_levels):
        here, scale = groups[level], config.scaling_factor ** (level - 1)
        due = len(here) >= config.max_tables * scale if config.compaction_condition == "tables" else sum(s for _, s in here) >= config.max_bytes * scale
        if due:
            pairs = [(here[i][0] + here[i + 1][0], here[i][1] + here[i + 1][1]) for i in range(0, len(here) - 1, 2)]
            if measured and config.compaction_condition == "bytes" and pairs:
                pairs = list(zip([members for members, _ in pairs], measured([members for members, _ in pairs]), strict=True))
            groups[level + 1] += pairs
            groups[level] = here[2 * len(pairs) :]
    return {run: (level, min(members)) for level, found in groups.items() for members, _ in found for run in members}


def size_tiered(runs: DataFrame, config: EngineConfig) -> DataFrame:
    """All rounds at once: every record goes straight to the run it ends in. Where bytes decide, merged runs are measured, by
    one aggregate for each level; else the manifest alone is read."""
    spark, size = runs.sparkSession, record_size(F.col("key"), F.col("value"))

    def into(targets: dict[int, tuple]) -> DataFrame:
        table = spark.createDataFrame([(k, *v) for k, v in targets.items()], "of_run int, to_level int, to_run int")
        moved = runs.join(table, F.col("run_id") == F.col("of_run")).withColumn("old_run", F.col("run_id")).drop("level", "run_id", "of_run")
        return merge(moved, "to_level", "to_run", order=("ts", "seq", "old_run"))

    def measured(groups: list[list[int]]) -> list[int]:
        merged = into({run: (0, k) for k, members in enumerate(groups) for run in members})
        got = {r[0]: r[1] for r in merged.groupBy("to_run").agg(F.sum(size)).collect()}  # a row for each merged run
        return [got[k] for k in range(len(groups))]

    sizes = runs.groupBy("level", "run_id").agg(F.sum(size).alias("bytes"))
    plan = size_tiered_plan([(r["level"], r["run_id"], r["bytes"]) for r in sizes.collect()], config, measured)  # the manifest
    return into(plan).select("key", "value", "tombstone", "ts", "seq", F.col("to_run").alias("run_id"), F.col("to_level").alias("level"))


def one_round(runs: DataFrame, level: int) -> DataFrame:
    """Merges a level's neighbouring runs two by two; an odd last run stays where it is."""
    listed = runs.where(F.col("level") == level).select("run_id").distinct()
    order = Window.orderBy("run_id")  # over the manifest: a row for each run
    pairs = listed.withColumn("ord", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    odd = (F.col("n") % 2 == 1) & (F.col("ord") == F.col("n") - 1)
    pairs = pairs.select("run_id", F.floor(F.col("ord") / 2).cast("int").alias("pair"), F.when(odd, level).otherwise(level + 1).cast("int").alias("to_level"))
    moved = runs.where(F.col("level") == level).join(pairs, "run_id").drop("level")
    return merge(moved, "to_level", "pair")


def split(runs: DataFrame, most: int, *by: str) -> DataFrame:
    """Cuts sorted records into parts of about `most` bytes by running size."""
    placed = ordered_sums(runs, list(by), "key", before=record_size(F.col("key"), F.col("value")))
    return placed.withColumn("part", F.floor(F.col("before") / most).cast("int")).drop("before")


def leveled(runs: DataFrame, config: EngineConfig) -> DataFrame:
    """Leveled compaction as designed: a record of a later run replaces any earlier one of its key whatever its time; the
    result is cut into parts by running size, and parts fill level 1 up to its budget from the end of the key range, then
    level 2 with twice the budget, and so on; the first keys are pushed down furthest."""
    merged = merge(runs, order=("run_id", "ts", "seq")).drop("level")
    placed = ordered_sums(merged, [], "key", before=record_size(F.col("key"), F.col("value")))
    whole = placed.agg(F.max(F.col("before") + record_size(F.col("key"), F.col("value")))).first()[0] or 0
    part = F.floor(F.col("before") / config.leveled_run_bytes)
    after = F.lit(whole) - part * config.leveled_run_bytes
    level, budgets = F.lit(config.max_levels), []
    for k in range(1, config.max_levels):
        budgets.append((budgets[-1] if budgets else 0) + config.leveled_base_bytes * config.scaling_factor ** (k - 1))
    for k, most in reversed(list(enumerate(budgets, 1))):
        level = F.when(after <= most, k).otherwise(level)
    return placed.select("key", "value", "tombstone", "ts", "seq", part.cast("int").alias("part"), level.cast("int").alias("level"))


def pushed_down(levels: DataFrame, run: DataFrame, config: EngineConfig) -> DataFrame:
    """One arrival at the levels: `run` joins level 1, where it replaces records of its keys; level 1 is cut into parts by
    running size, and while a level holds more than its budget its first parts go to the next level, which they join in the
    same way. Rows have key, value, tombstone, ts, seq, part, level; a key can stand once in each level. A level above its
    budget gives up whole parts; the last level takes all."""
    columns = ["key", "value", "tombstone", "ts", "seq"]
    size = record_size(F.col("key"), F.col("value"))
    arriving, done = run.select(*columns), None
    for level in range(1, config.max_levels + 1):
        here = levels.where(F.col("level") == level).select(*columns)
        joined = here.withColumn("new", F.lit(0)).union(arriving.withColumn("new", F.lit(1)))
        merged = latest(joined, order=("new", "ts", "seq")).drop("new")
        placed = ordered_sums(merged, [], "key", before=size).withColumn("part", F.floor(F.col("before") / config.leveled_run_bytes).cast("int")).withColumn("level", F.lit(level))
        whole = placed.agg(F.max(F.col("before") + size)).first()[0] or 0
        budget = config.leveled_base_bytes * config.scaling_factor ** (level - 1)
        keep = F.lit(True) if level == config.max_levels else F.lit(whole) - F.col("part") * config.leveled_run_bytes <= budget
        stays = placed.where(keep).select(*columns, "part", "level")
        done = stays if done is None else done.union(stays)
        arriving = placed.where(~keep).select(*columns)
        if level < config.max_levels and whole <= budget:
            return done.union(levels.where(F.col("level") > level).select(*done.columns))
    return done
