"""A store on shared files: flushes and compactions write sorted runs partitioned by level and run, and a manifest names the
runs that count. A version of the manifest is a table; it counts once the file of its number names it, and that file is created
only if there is none, so of two writers one fails. Readers see all of a compaction or nothing. Runs that no recent version
names are removed apart, so that running readers keep theirs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators import compaction, log as views, scan

SCHEMA = "key string, value string, tombstone boolean, ts timestamp_ntz, seq bigint, run_id int, level int"
MANIFEST = "level int, run_id int, path string, bytes bigint"


class Store:
    def __init__(self, spark: SparkSession, root: str, config: EngineConfig | None = None):
        self.spark, self.root, self.config = spark, root.rstrip("/"), (config or EngineConfig()).valid()
        self.jvm_path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.jvm_path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # manifest versions
    def _versions(self) -> list[int]:
        path = self.jvm_path(f"{self.root}/manifest")
        if not self.fs.exists(path):
            return []
        return sorted(int(x.getPath().getName()) for x in self.fs.listStatus(path) if x.getPath().getName().isdigit())

    def _table(self, version: int) -> str | None:
        """Where a version's table is; None while its writer hasn't named it to the end."""
        at = self.jvm_path(f"{self.root}/manifest/{version}")
        if not self.fs.exists(at):
            return None
        size = self.fs.getFileStatus(at).getLen()
        stream = self.fs.open(at)
        told = "".join(chr(stream.read()) for _ in range(size))
        stream.close()
        return f"{self.root}/{told.strip()}" if told.endswith("\n") else None

    def manifest(self, version: int | None = None) -> list:
        for v in [version] if version else reversed(self._versions()):
            table = self._table(v)
            if table:
                return self.spark.read.schema(MANIFEST).parquet(table).collect()
        return []

    def _swap(self, rows: list[tuple], after: int) -> None:
        """Makes rows the version that follows `after`; an error if another writer has made one since."""
        name = f"tables/{uuid.uuid4().hex}"
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{self.root}/{name}")
        try:
            out = self.fs.create(self.jvm_path(f"{self.root}/manifest/{after + 1}"), False)
        except Exception as e:
            raise RuntimeError("another writer has swapped the manifest") from e
        out.write(bytearray(f"{name}\n".encode()))
        out.close()

    def _last(self) -> int:
        return (self._versions() or [0])[-1]

    def _write(self, runs: DataFrame) -> list[tuple]:
        """Writes sorted runs and returns their manifest rows."""
        path = f"{self.root}/runs/{uuid.uuid4().hex}"
        stored = runs.withColumn("run", F.col("run_id")).withColumn("lvl", F.col("level"))
        stored.repartitionByRange("run_id", "key").sortWithinPartitions("run_id", "key").write.option("parquet.bloom.filter.enabled#key", "true").partitionBy("lvl", "run").parquet(path)
        sizes = self.spark.read.parquet(path).groupBy("level", "run_id").agg(F.sum(F.lit(25) + F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))).alias("b")).collect()
        return [(r["level"], r["run_id"], f"{path}/lvl={r['level']}/run={r['run_id']}", r["b"]) for r in sizes]

    def runs(self) -> DataFrame:
        paths = [r["path"] for r in self.manifest()]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    # operations
    def flush(self, records: DataFrame) -> None:
        """Puts records as a new run of level 1: newest of every key, sorted."""
        version = self._last()
        now = [tuple(r) for r in self.manifest()]
        run = 1 + max((r[1] for r in now), default=0)
        rows = views.latest(records.select(*views.RECORD)).withColumn("run_id", F.lit(run)).withColumn("level", F.lit(1))
        self._swap(now + self._write(rows), version)

    def compact(self) -> None:
        """Size-tiered or leveled, as configured. Runs that stay as they are keep their files."""
        version, old = self._last(), self.manifest()
        if self.config.compaction_algorithm == "leveled":
            rows, kept = compaction.leveled(self.runs(), self.config).withColumnRenamed("part", "run_id"), []
        else:
            plan = compaction.size_tiered_plan([(r["level"], r["run_id"], r["bytes"]) for r in old], self.config)
            alone = {run for run, to in plan.items() if to == (next(r["level"] for r in old if r["run_id"] == run), run) and list(plan.values()).count(to) == 1}
            kept = [tuple(r) for r in old if r["run_id"] in alone]
            moved = self.runs().where(~F.col("run_id").isin(*alone)) if alone else self.runs()
            rows = compaction.size_tiered(moved, self.config)
        self._swap(kept + self._write(rows.select("key", "value", "tombstone", "ts", "seq", "run_id", "level")), version)

    def expire(self, keep: int = 2) -> list[str]:
        """Removes the files of runs that none of the newest `keep` versions names; their folders. Readers of older versions
        must have ended."""
        versions = self._versions()
        new, gone = {r["path"] for v in versions[-keep:] for r in self.manifest(v)}, []
        for v in versions[:-keep]:
            for r in self.manifest(v):
                if r["path"] not in new and self.fs.delete(self.jvm_path(r["path"]), True):
                    gone.append(r["path"])
        return gone

    def log(self) -> DataFrame:
        return self.runs().select(*views.RECORD)

    def get(self, key: str) -> str | None:
        found = views.get(self.log(), key).collect()
        return found[0]["value"] if found else None

    def prefix_scan(self, prefix: str, page: int = 1, size: int = 20) -> DataFrame:
        return scan.prefix_scan(self.log(), prefix, page, size)

    def range_scan(self, low: str, high: str, page: int = 1, size: int = 20) -> DataFrame:
        return scan.range_scan(self.log(), low, high, page, size)
