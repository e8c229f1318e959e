"""Saving and loading of engine state: sketches, dictionaries, tree metadata. A state is a small table; it is saved as Parquet
beside its kind and parameters, and loaded only as the kind it was saved as."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(state: DataFrame, path: str, kind: str, **parameters) -> None:
    """Replaces what was saved there. `parameters` are those that a user of the state must repeat (widths, seeds)."""
    told = json.dumps({"kind": kind, **parameters}, sort_keys=True)
    state.withColumn("__state", F.lit(told)).write.mode("overwrite").option("compression", "zstd").parquet(path)


def load(spark: SparkSession, path: str, kind: str, **parameters) -> DataFrame:
    """The state; an error if it is of another kind or made with other parameters."""
    told = json.dumps({"kind": kind, **parameters}, sort_keys=True)
    got = spark.read.parquet(path)
    other = got.where(F.col("__state") != told).select("__state").limit(1).collect()
    if other:
        raise ValueError(f"{path} holds {other[0][0]}, not {told}")
    return got.drop("__state")
