"""Sequential operators: cache trace, token bucket and the memtable ring. Each runs in order within its own instance (a cache,
a caller, a store); instances run side by side. They are arbitrary state machines: the rows of a task are sorted by instance
and order and pass through as Arrow batches, so a task holds one batch and one instance's bounded state."""

from __future__ import annotations

from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Cache:
    """The `capacity` last used keys. A deletion drops its key and is no hit."""

    def __init__(self, capacity: int):
        self.capacity, self.held = capacity, OrderedDict()

    def feed(self, key, dead=False) -> bool:
        if dead:
            self.held.pop(key, None)
            return False
        hit = key in self.held
        self.held[key] = True
        self.held.move_to_end(key)
        if len(self.held) > self.capacity:
            self.held.popitem(last=False)
        return hit


def allow(second: int, last: int | None, tokens: int, rate: int, most: int) -> tuple[bool, int, int]:
    """(allowed, last, tokens) of one request: refilled to the most once more than `rate` whole seconds have passed."""
    if last is None:
        last, tokens = second, most
    if second - last > rate:
        last, tokens = second, most
    return tokens > 0, last, max(0, tokens - 1)


class Bucket:
    """A token bucket, full at its caller's first request."""

    def __init__(self, rate: int, most: int):
        self.rate, self.most, self.last, self.tokens = rate, most, None, most

    def feed(self, second: int) -> bool:
        ok, self.last, self.tokens = allow(second, self.last, self.tokens, self.rate, self.most)
        return ok


class Ring:
    """Memtables that take keys in turn: a table that reaches `size` distinct keys passes to the next slot; a slot that is
    still full is flushed and emptied first."""

    def __init__(self, size: int, instances: int):
        self.size, self.tables, self.active, self.seen, self.flushes = size, [set() for _ in range(instances)], 0, 0, 0

    def feed(self, key) -> tuple[int, int, int] | None:
        """(flush number, record, distinct keys) if the record leads to a flush."""
        out, at = None, self.seen
        self.seen += 1
        self.tables[self.active].add(key)
        if len(self.tables[self.active]) == self.size:
            self.active = (self.active + 1) % len(self.tables)
            if len(self.tables[self.active]) == self.size:
                out = (self.flushes, at, self.size)
                self.flushes += 1
                self.tables[self.active] = set()
        return out


def ring_flushes(keys: list[str], size: int, instances: int) -> list[tuple[int, int, int]]:
    ring = Ring(size, instances)
    return [x for x in map(ring.feed, keys) if x]


def _fed(batches, instance: str, columns: list[str], machine):
    """(batch, what the instance's machine says to each row)."""
    now, last = None, None
    for batch in batches:
        out = []
        for name, *values in zip(batch.column(instance).to_pylist(), *(batch.column(c).to_pylist() for c in columns), strict=True):
            if now is None or name != last:
                now, last = machine(), name
            out.append(now.feed(*values))
        yield batch, out


def _in_order(rows: DataFrame, instance: str, *order: str) -> DataFrame:
    return rows.repartition(F.col(instance)).sortWithinPartitions(instance, *order)


def _flagged(rows: DataFrame, instance: str, columns: list[str], order: list[str], name: str, machine) -> DataFrame:
    def run(batches):
        for batch, out in _fed(batches, instance, columns, machine):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], names=[*batch.schema.names, name])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"{name} boolean"])
    return _in_order(rows, instance, *order).mapInArrow(run, schema)


def lru_trace(accesses: DataFrame, instance: str, key: str, order: str, capacity: int, deleted: str | None = None) -> DataFrame:
    """accesses with hit: whether the key was among the `capacity` last used of its cache. A row with `deleted` set
    invalidates its key and is no hit."""
    return _flagged(accesses, instance, [key, deleted] if deleted else [key], [order], "hit", lambda: Cache(capacity))


def cached(accesses: DataFrame, instance: str, key: str, order: str, capacity: int) -> DataFrame:
    """The keys that each cache holds after all accesses: the `capacity` last used, with their rank from the newest, and the
    latest row of each. An aggregate and a top-k; no state machine."""
    rest = [c for c in accesses.columns if c not in (instance, key)]
    newest = accesses.groupBy(instance, key).agg(F.max(F.struct(order, *(c for c in rest if c != order))).alias("r"))
    ranked = newest.withColumn("rank", F.row_number().over(Window.partitionBy(instance).orderBy(F.desc(f"r.{order}"))))
    return ranked.where(F.col("rank") <= capacity).select(instance, key, *(F.col(f"r.{c}").alias(c) for c in rest), "rank")


def token_bucket(requests: DataFrame, caller: str, second: str, order: str, rate: int, most: int) -> DataFrame:
    """requests with allowed; a bucket starts full at its caller's first request."""
    return _flagged(requests, caller, [second], [second, order], "allowed", lambda: Bucket(rate, most))


def flush_trace(log: DataFrame, instance: str, key: str, order: str, size: int, instances: int) -> DataFrame:
    """(instance, flush, at_record, n_keys) of every store's ring."""

    def run(batches):
        for batch, out in _fed(batches, instance, [key], lambda: Ring(size, instances)):
            at = [i for i, x in enumerate(out) if x]
            found = [out[i] for i in at]
            yield pa.RecordBatch.from_arrays([batch.column(instance).take(pa.array(at, pa.int64())), *(pa.array([x[k] for x in found], pa.int64()) for k in range(3))], names=[instance, "flush", "at_record", "n_keys"])

    kind = dict(log.dtypes)[instance]
    return _in_order(log, instance, order).mapInArrow(run, f"`{instance}` {kind}, flush long, at_record long, n_keys long")
