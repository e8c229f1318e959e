"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder: spark.checkpoint.dir. A session on one machine that has none gets a temporary folder; on a
    cluster that is an error, as a folder of one machine can't be shared."""
    got = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tidelog.shared.dir", None)
    if not got:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        got = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("tidelog.shared.dir", got)
        spark.sparkContext.setCheckpointDir(got)
    return got.rstrip("/") if "://" in got else "file://" + got.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a fresh folder in the shared one; removed when the driver's Python ends."""
    uri = f"{shared_dir(spark)}/tidelog-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, uri)
    return uri


def _remove(spark: SparkSession, uri: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended before; the cluster's own cleaning takes it
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, which cuts its lineage."""
    uri = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)
