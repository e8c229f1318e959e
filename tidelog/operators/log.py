"""The change log and its last-write-wins views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORD = ["key", "value", "tombstone", "ts", "seq"]


def from_events(events: DataFrame) -> DataFrame:
    """The canonical log over events: a put for each event, a delete for each error."""
    return events.select(
        F.concat(F.lit("user"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"),
        F.concat_ws(":", "event_type", F.col("event_id").cast("string")).alias("value"),
        (F.col("event_type") == "error").alias("tombstone"),
        "ts",
        F.col("event_id").alias("seq"),
    )


def latest(log: DataFrame, *by: str, order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """The newest record of every key (and of every value of `by`), by `order`. Combined map-side before the shuffle; key
    predicates above it reach the scan, as they hold for whole groups."""
    keys = [*by, "key"]
    rest = [c for c in log.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    return log.groupBy(*keys).agg(newest.alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest)).select(*log.columns)


def live(log: DataFrame) -> DataFrame:
    """Latest records without deleted keys. The tombstone filter stays above the aggregate: below, it would bring back what
    was deleted."""
    return latest(log).where(~F.col("tombstone"))


def get(log: DataFrame, key: str) -> DataFrame:
    return live(log.where(F.col("key") == key)).select("key", "value")


def multi_get(log: DataFrame, keys: DataFrame, most_broadcast: int = 1_000_000) -> DataFrame:
    """Live records of the keys in a frame with a column key; the keys are broadcast only if they are few."""
    few = keys.select("key").distinct()
    if few.limit(most_broadcast + 1).count() <= most_broadcast:
        few = F.broadcast(few)
    return live(log.join(few, "key", "left_semi")).select("key", "value")


def put(log: DataFrame, records: DataFrame) -> DataFrame:
    return log.unionByName(records.select(*log.columns))


def delete(log: DataFrame, keys: DataFrame, ts: Column, seq: Column) -> DataFrame:
    """The log with a tombstone appended for each key."""
    gone = keys.select("key", F.lit(None).cast("string").alias("value"), F.lit(True).alias("tombstone"), ts.cast(log.schema["ts"].dataType).alias("ts"), seq.cast("bigint").alias("seq"))
    return log.unionByName(gone.select(*log.columns))


def delete_present(log: DataFrame, keys: DataFrame) -> DataFrame:
    """The latest records, those of the keys marked deleted; keys that the log doesn't hold leave no tombstone."""
    gone = keys.select(F.col("key").alias("gone_key")).distinct()
    marked = latest(log).join(gone, F.col("key") == F.col("gone_key"), "left")
    return marked.withColumn("tombstone", F.col("tombstone") | F.col("gone_key").isNotNull()).select(*log.columns)
