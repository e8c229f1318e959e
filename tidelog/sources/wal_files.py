"""The write-ahead log on shared files: append with rotation, opening at the last segment, recovery, truncation.

A segment is a folder `segment=<number>` of Parquet rows (seq, start, record): the record's bytes and its offset in the whole
log. Segments are written whole and never changed, so a new append begins a new segment. Their numbers only grow; removed
ones leave a gap. How many bytes of the log count as flushed stands in a file that is replaced by one rename, so recovery
skips them even if the removal of covered segments was cut short.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.codecs import LOG_HEADER, record_size
from ..operators.log import latest
from ..operators.prefix_sum import running_sum
from . import wal
from .folders import written

ROWS = "seq long, start long, record binary, segment long"


class LogFiles:
    def __init__(self, spark: SparkSession, root: str, config: EngineConfig | None = None):
        self.spark, self.root, self.config = spark, root.rstrip("/"), (config or EngineConfig()).valid()
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def segments(self) -> list[int]:
        """Numbers of the segments there are, oldest first."""
        folder = self._path(f"{self.root}/segments")
        if not self.fs.exists(folder):
            return []
        names = (x.getPath().getName() for x in self.fs.listStatus(folder))
        return sorted(int(n.removeprefix("segment=")) for n in names if n.startswith("segment="))

    def rows(self) -> DataFrame:
        """(seq, start, record, segment) of all segments."""
        if not self.segments():
            return self.spark.createDataFrame([], ROWS)
        return self.spark.read.schema(ROWS).parquet(f"{self.root}/segments")

    def end(self) -> int:
        """Bytes of the log so far, removed ones too."""
        last = self.rows().agg(F.max(F.col("start") + F.octet_length("record"))).first()[0]
        return max(last or 0, self.flushed())

    def append(self, records: DataFrame) -> None:
        """Appends records (key, value, tombstone, ts in seconds, seq) in order of seq. A segment ends after wal_segment_records
        records of an append, and where the append's bytes pass a multiple of wal_segment_bytes."""
        size = record_size(F.col("key"), F.col("value"), LOG_HEADER)
        placed = running_sum(running_sum(records, "seq", F.lit(1), "number"), "seq", size, "at")
        cut = placed.withColumn("a", F.floor(F.col("number") / self.config.wal_segment_records)).withColumn("b", F.floor(F.col("at") / self.config.wal_segment_bytes))
        cuts = written(cut.groupBy("a", "b").agg(F.min("number").alias("first")), "cuts")  # a row for each segment
        base = (self.segments() or [0])[-1] + 1
        numbered = running_sum(cuts, "first", F.lit(1), "k").select(F.col("a").alias("of_a"), F.col("b").alias("of_b"), (F.col("k") + base).alias("segment"))
        from_byte = self.end()
        rows = cut.join(numbered, (F.col("a") == F.col("of_a")) & (F.col("b") == F.col("of_b")))
        encoded = wal.encode(rows.select("key", "value", "tombstone", "ts", "seq"))
        out = encoded.join(rows.select(F.col("seq").alias("of_seq"), (F.col("at") + from_byte).cast("long").alias("start"), "segment"), F.col("seq") == F.col("of_seq")).select("seq", "start", "record", "segment")
        draft = f"{self.root}/draft-{uuid.uuid4().hex}"
        out.repartitionByRange("segment").sortWithinPartitions("segment", "seq").write.partitionBy("segment").parquet(draft)
        self.fs.mkdirs(self._path(f"{self.root}/segments"))
        for x in sorted(self.fs.listStatus(self._path(draft)), key=lambda x: x.getPath().getName().rpartition("=")[2].zfill(20)):
            name = x.getPath().getName()  # oldest first: a writer that fails leaves a whole prefix
            if name.startswith("segment=") and not self.fs.rename(x.getPath(), self._path(f"{self.root}/segments/{name}")):
                raise RuntimeError(f"{name} exists")
        self.fs.delete(self._path(draft), True)

    def flushed(self) -> int:
        """Bytes from the log's start that recovery skips."""
        at = self._path(f"{self.root}/flushed")
        if not self.fs.exists(at):
            return 0
        return int(self.spark.read.text(f"{self.root}/flushed").first()[0])

    def truncate(self, flushed_bytes: int) -> list[int]:
        """Marks so many further bytes as flushed, then removes the segments that they cover whole; their numbers."""
        flushed = self.flushed() + flushed_bytes
        draft = self._path(f"{self.root}/flushed-{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(bytearray(str(flushed).encode()))
        out.close()
        self.fs.delete(self._path(f"{self.root}/flushed"), False)
        self.fs.rename(draft, self._path(f"{self.root}/flushed"))
        stops = self.rows().groupBy("segment").agg(F.max(F.col("start") + F.octet_length("record")).alias("stop"))
        return self._remove([r[0] for r in stops.where(F.col("stop") <= flushed).select("segment").collect()])  # a row for each segment

    def keep_newest(self) -> list[int]:
        """Removes all but the newest wal_low_water segments; their numbers."""
        return self._remove(self.segments()[: -self.config.wal_low_water])

    def _remove(self, numbers: list[int]) -> list[int]:
        for n in sorted(numbers):
            self.fs.delete(self._path(f"{self.root}/segments/segment={n}"), True)
        return sorted(numbers)

    def replay(self) -> DataFrame:
        """The records that begin at or after the flushed bytes and whose checksum holds."""
        return wal.decode(self.rows().where(F.col("start") >= self.flushed()))

    def recover(self) -> DataFrame:
        """The newest record of every key among those to replay."""
        return latest(self.replay())


def listing(rows: DataFrame) -> DataFrame:
    """(segment, n_records, first_seq, bytes), in order of segments."""
    by = rows.groupBy("segment").agg(F.count(F.lit(1)).alias("n_records"), F.min("seq").alias("first_seq"), F.sum(F.octet_length("record").cast("long")).alias("bytes"))
    return by.withColumn("segment", (F.row_number().over(Window.orderBy("segment")) - 1).cast("long"))  # over a row for each segment
