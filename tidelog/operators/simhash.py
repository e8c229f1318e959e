"""Document fingerprints of 256 bits: for each distinct word, the 8-bit codes of the 32 hexadecimal digits of its MD5 vote
with the word's count. Words are split on single spaces; stop words are left out, case-sensitively. Each row is a document.

Fingerprints come from one Arrow pass over the texts, without a shuffle: words' digests are unpacked to bits and summed by
numpy, some words at a time."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The stop words.
STOP_WORDS = (
    "I me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its "
    "itself they them their theirs themselves what which who whom this that these those am is are was were be been being have "
    "has had having do does did doing a an the and but if or because as until while of at by for with about against between "
    "into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such only own same so than too very s t can will just don "
    "should now"
).split()

WORDS = 4


def terms(docs: DataFrame, id_col: str) -> DataFrame:
    """(id, word, n)."""
    words = docs.select(id_col, F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("word"))
    return words.where(~F.col("word").isin(*STOP_WORDS)).groupBy(id_col, "word").agg(F.count(F.lit(1)).alias("n"))


BITS = 64 * WORDS
#: Words whose bits are unpacked at once.
AT_ONCE = 1 << 14


def vote(texts: list[str | None]) -> np.ndarray:
    """(texts, BITS) booleans: the fingerprint of each text."""
    stop, known = set(STOP_WORDS), {}
    digests, owners, out = [], [], np.zeros((len(texts), BITS), np.int64)

    def settle():
        if digests:
            bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, BITS // 8), axis=1).astype(np.int8) * 2 - 1
            own = np.array(owners)
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            out[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
            digests.clear()
            owners.clear()

    for i, text in enumerate(texts):
        for word in (text or "").split(" "):
            if word not in stop:
                digest = known.get(word)
                if digest is None:
                    if len(known) >= 1 << 20:
                        known.clear()
                    digest = known[word] = hashlib.md5(word.encode()).hexdigest().encode()
                digests.append(digest)
                owners.append(i)
                if len(digests) >= AT_ONCE:
                    settle()
    settle()
    return out > 0


def _voted(id_col: str):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                packed = np.packbits(vote(some.column("text").to_pylist()), axis=1)
                yield pa.RecordBatch.from_arrays([some.column(id_col), pa.array([x.tobytes() for x in packed], pa.binary())], names=[id_col, "raw"])

    return run


def packed(docs: DataFrame, id_col: str) -> DataFrame:
    """(id, raw binary of 32 bytes)."""
    rows = docs.select(id_col, "text")
    return rows.mapInArrow(_voted(id_col), f"`{id_col}` {dict(rows.dtypes)[id_col]}, raw binary")


def fingerprint(docs: DataFrame, id_col: str) -> DataFrame:
    """(id, fingerprint string of 256 digits). A document without words has zeros."""
    parts = [F.lpad(F.conv(F.hex(F.substring("raw", 4 * i + 1, 4)), 16, 2), 32, "0") for i in range(BITS // 32)]
    return packed(docs, id_col).select(id_col, F.concat(*parts).alias("fingerprint"))


def words64(fingerprint: Column) -> Column:
    """array of four 64-bit words."""
    return F.array(*(F.conv(F.substring(fingerprint, 64 * i + 1, 64), 2, -10).cast("bigint") for i in range(WORDS)))


def hamming(a: Column, b: Column) -> Column:
    """Distance of two arrays of words."""
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(WORDS)), F.lit(0))


def _nearest(sent, id_col: str, item_col: str):
    def run(batches):
        ids, words = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                own = np.packbits(vote(some.column("text").to_pylist()), axis=1).view(np.uint64)
                best = np.full(len(own), BITS + 1)
                item = np.zeros(len(own), np.int64)
                for k in range(0, len(ids), 1024):  # items by rising identifier: the first of a distance stays
                    apart = np.bitwise_count(own[:, None, :] ^ words[None, k : k + 1024, :]).sum(2, dtype=np.int64)
                    near = apart.argmin(1)
                    closer = apart[np.arange(len(own)), near] < best
                    best = np.where(closer, apart[np.arange(len(own)), near], best)
                    item = np.where(closer, ids[k + near], item)
                yield pa.RecordBatch.from_arrays([some.column(id_col), pa.array(item), pa.array(best.astype(np.int32))], names=[id_col, item_col, "distance"])

    return run


def nearest(docs: DataFrame, items: DataFrame, id_col: str, item_col: str, block: int = 1 << 16) -> DataFrame:
    """For each document the item at least distance (ties: least identifier). Items are a query set against all documents,
    taken in blocks of `block` items (32 bytes each); each block is a pass over the documents, whose results meet by document."""
    listed = packed(items, item_col).where(F.col(item_col).isNotNull()).orderBy(item_col).select(F.col(item_col).cast("long").alias("i"), "raw")
    rows, parts, held = docs.select(id_col, "text"), [], []
    schema = f"`{id_col}` {dict(rows.dtypes)[id_col]}, `{item_col}` long, distance int"

    def against(held):
        ids, words = np.array([i for i, _ in held], np.int64), np.frombuffer(b"".join(r for _, r in held), np.uint64).reshape(-1, WORDS)
        return rows.mapInArrow(_nearest(docs.sparkSession.sparkContext.broadcast((ids, words)), id_col, item_col), schema)

    for i, raw in listed.toLocalIterator():
        held.append((i, bytes(raw)))
        if len(held) == block:
            parts.append(against(held))
            held = []
    if held or not parts:
        parts.append(against(held) if held else rows.sparkSession.createDataFrame([], schema))
    if len(parts) == 1:
        return parts[0]
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    best = found.groupBy(id_col).agg(F.min(F.struct("distance", item_col)).alias("b"))
    return best.select(id_col, F.col(f"b.{item_col}").alias(item_col), F.col("b.distance").alias("distance"))
