"""Structured Streaming forms: log ingest, the last-write-wins view and the token bucket. State grows with the number of
keys; ttl_seconds, where given, drops keys not seen for so long by a watermark on their time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.log import from_events, latest
from ..operators.stateful import allow
from ..sources.folders import new_folder


def event_stream(spark, path: str, schema, files_per_batch: int = 16) -> DataFrame:
    """The log over a growing folder of event files; admission by files for each batch."""
    return from_events(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path))


def latest_stream(log: DataFrame) -> DataFrame:
    """Newest record of every key, as an update stream."""
    newest = F.max_by(F.struct("value", "tombstone", "ts", "seq"), F.struct("ts", "seq"))
    return log.groupBy("key").agg(newest.alias("r")).select("key", "r.value", "r.tombstone", "r.ts", "r.seq")


def token_bucket_stream(requests: DataFrame, rate: int, most: int, ttl_seconds: int | None = None) -> DataFrame:
    """(key, second, seq, allowed) of a stream of (key, second, seq); a caller's state is (last, tokens)."""

    def run(key, batches, state: GroupState):
        last, tokens = state.get if state.exists else (None, most)
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values(["second", "seq"])
        out = []
        for s in pdf["second"]:
            ok, last, tokens = allow(int(s), last, tokens, rate, most)
            out.append(ok)
        state.update((last, tokens))
        if ttl_seconds:
            state.setTimeoutDuration(ttl_seconds * 1000)
        yield pd.DataFrame({"key": key[0], "second": pdf["second"].to_numpy(), "seq": pdf["seq"].to_numpy(), "allowed": out})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_seconds else GroupStateTimeout.NoTimeout
    return requests.groupBy("key").applyInPandasWithState(run, "key string, second long, seq long, allowed boolean", "last long, tokens long", "append", timeout)


def run_to_end(stream: DataFrame, mode: str, folder: str | None = None) -> DataFrame:
    """Runs a stream over what is there and returns what it wrote: each micro-batch is a folder of Parquet files, written again
    whole if its batch is repeated; progress is kept beside them. With mode "update" a row stands for each change."""
    spark = stream.sparkSession
    folder = folder or new_folder(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/rows")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows").select(*stream.columns)


def settled(updates: DataFrame, order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """The last state of every key in the changes that a stream wrote."""
    return latest(updates, order=order)
