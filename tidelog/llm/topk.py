"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are cut into buckets of similar length (range partitions on the squared norm, ties split by identifier). For a
query and a bucket, the score to beat and the bucket's greatest norm give a local cosine threshold: above 1 the bucket is
skipped; where it is high, coordinate pruning keeps candidates whose normalised focus coordinates lie in the feasible
intervals; else length pruning keeps candidates long enough to reach the score. What is left is verified by whole products.

Queries are taken in blocks of bounded size, each broadcast and run over all buckets. Rows whose vector is null, empty, or
holds null or non-finite components take no part; products are defined between vectors of equal dimension only. Repeated
vectors tie and come in order of identifier. Rows without an identifier take no part. Rows that share an identifier are
queries of their own (equal rows are one query) and candidates of their own for other identifiers' queries, never for each
other's. Components are taken as floor(256 * x); results are exact while products stay below 2^53 in magnitude. Extra columns
are ignored. An empty table, or one without queries, gives no row.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import quoted, shuffle_partitions, written

SCALE = 256
RESULT = "query_id long, query long, vec_id long, score long"
BLOCKS = "dim int, n int, least double, most double, ids binary, matrix binary"


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v array<double> of whole numbers, norm2), of the rows that take part."""
    usable = quoted(id_col).isNotNull() & quoted(vec_col).isNotNull() & (F.size(quoted(vec_col)) > 0) & F.forall(quoted(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.coalesce(usable, F.lit(False))).select(quoted(id_col).cast("long").alias("vec_id"), F.transform(quoted(vec_col), lambda x: F.rint(F.floor(x.cast("double") * SCALE).cast("double"))).alias("v"))
    return rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))


def _matrix(batch: pa.RecordBatch):
    """(dimension, ids, matrix) for each dimension in a batch of (vec_id, v, ...)."""
    ids, lists = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("v")
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield int(dim), ids[at], flat[(offsets[at][:, None] + np.arange(dim)).ravel()].reshape(-1, dim)


def norm_buckets(rows: DataFrame, bucket_rows: int) -> DataFrame:
    """Buckets of at most bucket_rows candidates, by falling norm within a partition."""

    def pack(batches):
        held: dict[int, list] = {}

        def out(dim, ids, m):
            norm = np.sqrt((m * m).sum(1))
            order = np.lexsort((ids, -norm))
            ids, m, norm = ids[order], m[order], norm[order]
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "least": [float(norm[-1])], "most": [float(norm[0])], "ids": pa.array([ids.tobytes()], pa.binary()), "matrix": pa.array([np.ascontiguousarray(m).tobytes()], pa.binary())})

        for batch in batches:
            for dim, ids, m in _matrix(batch):
                parts = held.setdefault(dim, [])
                parts.append((ids, m))
                while sum(len(x) for x, _ in parts) >= bucket_rows:
                    ids, m = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
                    yield out(dim, ids[:bucket_rows], m[:bucket_rows])
                    parts[:] = [(ids[bucket_rows:], m[bucket_rows:])] if len(ids) > bucket_rows else []
        for dim, parts in held.items():
            if parts:
                yield out(dim, np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts]))

    spark = rows.sparkSession
    dealt = rows.repartitionByRange(shuffle_partitions(spark), F.desc("norm2"), F.col("vec_id")).sortWithinPartitions(F.desc("norm2"), "vec_id")
    return dealt.select("vec_id", "v").mapInArrow(pack, BLOCKS)


def survivors(q: np.ndarray, m: np.ndarray, norm: np.ndarray, beat: float, coordinate_from: float = 0.5) -> np.ndarray:
    """Rows of a bucket (by falling norm) that can reach a score of `beat` with the query; never leaves out one that does."""
    length = float(np.sqrt(q @ q))
    if beat <= 0 or not length or not norm[0]:
        return np.arange(len(norm)) if beat <= 0 else np.zeros(0, np.int64)
    local = beat / (length * norm[0])
    if local > 1 + 1e-9:
        return np.zeros(0, np.int64)
    keep = np.arange(int(np.searchsorted(-norm, -(beat / length) * (1 - 1e-9), "right")))
    if local < coordinate_from:
        return keep
    for f in np.argsort(-np.abs(q))[:3]:  # focus coordinates
        unit = q[f] / length
        near, slack = unit * local, np.sqrt(max(0.0, 1 - local * local) * max(0.0, 1 - unit * unit)) + 1e-9
        low = near - slack if -unit < local else -1.0  # outside of the cap the bound is that of the sphere
        high = near + slack if unit < local else 1.0
        x = m[keep, f] / norm[keep]
        keep = keep[(x >= low) & (x <= high)]
    return keep


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: by falling score, then by identifier."""
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
        return at[np.lexsort((ids[at], -scores[at]))][:k]
    return np.lexsort((ids, -scores))[:k]


def _search(queries: dict, floor: dict, k: int):
    """mapInArrow function over buckets. queries: dimension -> (identifiers, numbers, matrix); floor: a query's number -> a
    score that k candidates reach for sure."""

    def search(batches):
        top: dict = {}  # a query's number -> (identifier, ids, scores), the best so far of this task
        for batch in batches:
            for dim, n, _, most, ids, matrix in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if dim not in queries:
                    continue
                ids, m = np.frombuffer(ids, np.int64), np.frombuffer(matrix, np.float64).reshape(n, dim)
                norm = np.sqrt((m * m).sum(1))
                for q_id, number, q in zip(*queries[dim], strict=True):
                    have = top.get(number)
                    beat = floor.get(number, -np.inf)
                    if have is not None and len(have[1]) >= k:
                        beat = max(beat, float(have[2][-1]))
                    keep = survivors(q, m, norm, beat)
                    if not len(keep):
                        continue
                    scores = m[keep] @ q if len(keep) < n else m @ q
                    found = (scores >= beat) & (ids[keep] != q_id)
                    if found.any():
                        a, b = ids[keep][found], scores[found].astype(np.int64)
                        if have is not None:
                            a, b = np.concatenate([have[1], a]), np.concatenate([have[2], b])
                        at = best(a, b, k)
                        top[number] = (q_id, a[at], b[at])
        if top:
            sizes = [len(a) for _, a, _ in top.values()]
            yield pa.RecordBatch.from_pydict({"query_id": np.repeat(np.array([q for q, _, _ in top.values()], np.int64), sizes), "query": np.repeat(np.array(list(top), np.int64), sizes), "vec_id": np.concatenate([a for _, a, _ in top.values()]), "score": np.concatenate([b for _, _, b in top.values()])})

    return search


def top_k(vectors: DataFrame, query_every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", block_queries: int = 4096, bucket_rows: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows for each row whose identifier is divisible by query_every."""
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, id_col, vec_col)
    buckets = written(norm_buckets(rows, bucket_rows), "buckets")
    asked = rows.where(F.col("vec_id") % query_every == 0).select("vec_id", "v").distinct()
    queries = written(asked.repartitionByRange(max(1, shuffle_partitions(spark)), "vec_id"), "queries")
    starts = _block_starts(queries, block_queries)
    parts, numbered = [], 0
    for low, high in zip(starts, [*starts[1:], None], strict=False):
        part = queries.where(F.col("vec_id") >= low)
        block = (part if high is None else part.where(F.col("vec_id") < high)).toArrow()
        of: dict = {}
        for dim, found in _by_dim(block).items():
            ids, m = np.concatenate([i for i, _ in found]), np.concatenate([m for _, m in found])
            of[dim] = ids, np.arange(numbered, numbered + len(ids)), m
            numbered += len(ids)
        # a first pass over the longest vectors gives every query a score that is reached for sure
        head = buckets.orderBy(F.desc("most")).limit(2).mapInArrow(_search(of, {}, k), RESULT)
        floor = {r[0]: float(r[1]) for r in head.groupBy("query").agg(F.collect_list("score").alias("s")).select("query", F.when(F.size("s") >= k, F.sort_array("s", False)[k - 1])).collect() if r[1] is not None}
        parts.append(buckets.mapInArrow(_search(of, floor, k), RESULT))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = reduce(DataFrame.union, parts)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_dim(table: pa.Table) -> dict:
    out: dict = {}
    for batch in table.combine_chunks().to_batches():
        for dim, ids, m in _matrix(batch):
            out.setdefault(dim, []).append((ids, m))
    return out


def _block_starts(queries: DataFrame, size: int) -> list[int]:
    """First identifiers of blocks of about `size` queries."""
    n = queries.count()
    if not n:
        return []
    low = queries.agg(F.min("vec_id")).first()[0]
    cuts = max(1, -(-n // size))
    if cuts == 1:
        return [low]
    at = queries.agg(F.percentile_approx("vec_id", [i / cuts for i in range(1, cuts)], 100_000)).first()[0]
    return [low, *sorted(set(at) - {low})]
