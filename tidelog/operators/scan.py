"""Prefix and range scans in pages, and resumable cursors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .log import live


def _page(rows: DataFrame, page: int, size: int) -> DataFrame:
    """The 1-based page by key; a top-k with an offset, not a full sort."""
    return rows.select("key", "value").orderBy("key").offset((page - 1) * size).limit(size)


def prefix_scan(log: DataFrame, prefix: str, page: int, size: int) -> DataFrame:
    return _page(live(log.where(F.col("key").startswith(prefix))), page, size)


def range_scan(log: DataFrame, low: str, high: str, page: int, size: int) -> DataFrame:
    """Keys from low to high, both included."""
    return _page(live(log.where(F.col("key").between(low, high))), page, size)


class Cursor:
    """Iterates live keys in order. A step asks for the keys after the last one seen, so a cursor holds one key only and
    can be resumed anywhere."""

    def __init__(self, log: DataFrame, prefix: str | None = None, low: str | None = None, high: str | None = None, after: str | None = None):
        if prefix is not None:
            log = log.where(F.col("key").startswith(prefix))
        if low is not None:
            log = log.where(F.col("key") >= low)
        if high is not None:
            log = log.where(F.col("key") <= high)
        self.log, self.after, self.stopped = log, after, False

    def batch(self, n: int) -> DataFrame:
        """The next n records, without moving."""
        rest = self.log if self.after is None else self.log.where(F.col("key") > self.after)
        return _page(live(rest), 1, n)

    def next(self) -> tuple[str, str] | None:
        if self.stopped:
            return None
        got = self.batch(1).collect()
        if not got:
            self.stop()
            return None
        self.after = got[0]["key"]
        return got[0]["key"], got[0]["value"]

    def stop(self) -> None:
        self.stopped = True
