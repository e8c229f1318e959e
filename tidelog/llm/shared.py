"""What several operators need: the shared folder, written intermediate tables and files that any executor can open."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share: spark.checkpoint.dir. Only a session on one machine that has none
    (tests) gets a temporary folder, kept in the session; on a cluster that is an error."""
    got = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tidelog.shared.dir", None)
    if not got:
        if spark.sparkContext.master.split("[")[0] != "local":
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
    """df as a Parquet table in the shared folder: cuts the lineage, so that a lost executor costs no recomputation of
    what came before."""
    uri = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def file_system(uri: str):
    """(pyarrow file system, path) of a URI; local, HDFS and object stores alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put_file(folder: str, name: str, data: bytes, ending: str = "") -> str:
    """Writes a file under a name of its own for every attempt of a task; only names that reach the manifest count, so
    failed and speculative attempts leave nothing that is read."""
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    final = f"{name}-{uuid.uuid4().hex[:12]}{ending}"
    with system.open_output_stream(f"{path}/{final}") as out:
        out.write(data)
    return f"{folder}/{final}"


def quoted(name: str) -> Column:
    """The column of exactly that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def private(names: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of names has, in any case of letters."""
    taken, out = {x.lower() for x in names}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
        taken.add(name.lower())
    return out


def without(names: list[str], own: list[str], needed: list[str] = ()) -> list[str]:
    """names without those that a result has columns of its own for; these are replaced. Needed ones can't be."""
    taken = {x.lower() for x in own}
    for name in needed:
        if name.lower() in taken:
            raise ValueError(f"the result has a column {name} of its own; rename the input's")
    return [x for x in names if x.lower() not in taken]


def ddl(schema, names: list[str]) -> str:
    """The columns of a schema that have these names, as text."""
    return ", ".join("`" + n.replace("`", "``") + "` " + schema[n].dataType.simpleString() for n in names)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lean(run):
    """run for mapInArrow, in a worker that has given back what tasks of other stages left: workers outlive a stage, and what
    they keep counts against their executor. The tokenizer's memory goes first, freed memory of this task at its end."""

    def task(batches):
        from .tokens import encoder

        encoder.cache_clear()
        _trim()
        yield from run(batches)
        _trim()

    return task


def trimmed(run):
    """run for mapInArrow; freed memory goes back at the task's end."""

    def task(batches):
        yield from run(batches)
        _trim()

    return task


def _trim() -> None:
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass
