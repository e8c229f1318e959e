"""Token-id files: ids of whole texts, coded by the adaptive range coder, in ascending document order.

A file holds whole documents of one range of identifiers: a magic word, then the coded blocks (each with its length, size and
checksum), then the document table (identifier, token count), then a footer with the table's place. A file ends with the
document that brings it to FILE_IDS ids or FILE_DOCS documents. Files are listed in a manifest in order, which gives every
document its place in the stream of all ids. Tasks write and read group by group and hold no file whole.

Null texts are empty documents of one end id. Rows that share an identifier follow each other in order of their text's hash,
then text; rows without one come first. Extra columns are ignored. An empty table gives no file. Ids must be below 65536.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import coder
from .shared import file_system, new_folder, shuffle_partitions, trimmed, written
from .tokens import encoder
from .words import slices

MAGIC = b"TDTK0002"
HEAD = "<III"  # of a block: ids, bytes, crc32 of the ids
FOOT = "<QQQQ"  # place and size of the table, documents, ids
HEAD_BYTES, FOOT_BYTES = struct.calcsize(HEAD), struct.calcsize(FOOT)
#: Ids that a row between Python and the coder holds.
GROUP = 16 * coder.BLOCK
FILE_IDS, FILE_DOCS = 1 << 25, 1 << 20
DOC = np.dtype([("known", "u1"), ("id", "<i8"), ("n", "<i8")])
GROUPS = "part long, file int, last boolean, ids binary, docs binary"
MANIFEST = "part long, file int, path string, n_docs long, n_tokens long"
BLOCKS = "base long, blocks binary, docs binary"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _batch(schema: str, *values) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[k]) for v, (_, k) in zip(values, fields, strict=True)], names=[n for n, _ in fields])


def _groups(tokenizer: str | None, file_ids: int, file_docs: int):
    """Ids of the documents in groups, of each file after another. A group's docs are those that end in it."""

    def run(batches):
        from pyspark import TaskContext

        part, e, file = TaskContext.get().partitionId(), encoder(tokenizer), 0
        held, size, docs, file_size, file_rows = [], 0, [], 0, 0

        def out(n: int, last: bool):
            ids = np.concatenate(held) if held else np.zeros(0, np.uint32)
            row = _batch(GROUPS, part, file, last, coder.packed(ids[:n]), np.concatenate(docs).tobytes() if docs else b"")
            held[:], docs[:] = [ids[n:]], []
            return row

        for batch in batches:
            for some in slices(batch, "text"):
                ids, offsets = e.encode(some.column("text"))
                table = np.zeros(len(some), DOC)
                table["known"] = ~some.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                table["id"] = some.column("doc_id").fill_null(0).to_numpy()
                table["n"] = np.diff(offsets)
                at = 0
                while at < len(table):
                    # as many documents as the file still takes, one at least
                    end = int(np.searchsorted(offsets, offsets[at] + file_ids - file_size))
                    end = min(max(end, at + 1), at + file_docs - file_rows, len(table))
                    held.append(ids[offsets[at] : offsets[end]])
                    docs.append(table[at:end])
                    n = int(offsets[end] - offsets[at])
                    size, file_size, file_rows, at = size + n, file_size + n, file_rows + end - at, end
                    while size >= GROUP:
                        yield out(GROUP, False)
                        size -= GROUP
                    if file_size >= file_ids or file_rows >= file_docs:
                        yield out(size, True)
                        size, file_size, file_rows, file = 0, 0, 0, file + 1
        if file_rows:
            yield out(size, True)

    return run


def _write(folder: str):
    """Coded groups into files, under a name of its own for every attempt of a task."""

    def run(batches):
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        stream = None
        for batch in batches:
            for part, file, last, blocks, docs in zip(*(batch.column(c).to_pylist() for c in ("part", "file", "last", "ids", "docs")), strict=True):
                if stream is None:
                    name = f"ids-{part:06d}-{file:05d}-{uuid.uuid4().hex[:12]}"
                    stream, table = system.open_output_stream(f"{path}/{name}"), []
                    stream.write(MAGIC)
                stream.write(blocks)
                table.append(docs)
                if last:
                    rows = np.frombuffer(b"".join(table), DOC)
                    packed, at, total = zlib.compress(rows.tobytes()), stream.tell(), int(rows["n"].sum())
                    stream.write(packed + struct.pack(FOOT, at, len(packed), len(rows), total))
                    stream.close()
                    stream = None
                    yield _batch(MANIFEST, part, file, f"{folder}/{name}", len(rows), total)

    return run


def write_files(docs: DataFrame, folder: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS, file_docs: int = FILE_DOCS) -> DataFrame:
    """Encodes all texts and writes files in order of identifiers; returns the manifest, a written table."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    ranged = rows.repartitionByRange(max(shuffle_partitions(spark), 1), *order).sortWithinPartitions(*order, "text")
    groups = ranged.mapInArrow(trimmed(_groups(tokenizer, file_ids, file_docs)), GROUPS)
    coded = groups.withColumn("ids", coder.encoded(spark, F.col("ids")))
    return written(coded.mapInArrow(_write(folder), MANIFEST), "token-manifest")


def read_blocks(path: str):
    """Yields (coded blocks of about a group, document table or None); the table comes with the first."""
    system, name = file_system(path)
    with system.open_input_file(name) as f:
        size = f.size()
        if size < len(MAGIC) + FOOT_BYTES or f.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("not a token file")
        end, length, n, _ = struct.unpack(FOOT, f.read_at(FOOT_BYTES, size - FOOT_BYTES))
        table = zlib.decompress(f.read_at(length, end))
        if len(table) != n * DOC.itemsize:
            raise ValueError("the document table is damaged")
        f.seek(len(MAGIC))
        held, ids = [], 0
        while f.tell() < end:
            head = f.read(HEAD_BYTES)
            count, size, _ = struct.unpack(HEAD, head)
            held += [head, f.read(size)]
            ids += count
            if ids >= GROUP or f.tell() >= end:
                yield b"".join(held), table
                held, ids, table = [], 0, None


def _open(batches):
    for batch in batches:
        for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
            for blocks, table in read_blocks(path):
                yield _batch(BLOCKS, base, blocks, table)


def _documents(batches):
    """A row for each document, from the ids of its files' groups in their order."""
    docs = np.zeros(0, DOC)
    done = at = left = crc = 0
    for batch in batches:
        for base, raw, table in zip(*(batch.column(c).to_pylist() for c in ("base", "blocks", "docs")), strict=True):
            if table is not None:
                if done < len(docs):
                    raise ValueError("a file ends within a document")
                docs, done, at, crc = np.frombuffer(table, DOC), 0, base, 0
                left = int(docs["n"][0])
            ids = memoryview(np.frombuffer(raw, "<u2").astype("<u4").tobytes())
            n, place, first, crcs = len(ids) // 4, 0, done, []
            ends = np.cumsum(docs["n"][done : done + n + 1])
            counts = docs["n"][done : done + int(np.searchsorted(ends, ends[0] - left + n, "right")) if len(ends) else done].tolist()
            for k, size in enumerate(counts):
                stop = place + (left if k == 0 else size)
                crcs.append(zlib.crc32(ids[4 * place : 4 * stop], crc))
                crc, place = 0, stop
            if counts:
                done += len(counts)
                left = int(docs["n"][done]) if done < len(docs) else 0
                rows = docs[first:done]
                sizes = np.ascontiguousarray(rows["n"])
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows["id"]), mask=rows["known"] == 0), pa.array(at + np.cumsum(sizes) - sizes), pa.array(sizes), pa.array(crcs, pa.int64())], names=[x.split()[0] for x in RESULT.split(", ")])
                at += int(sizes.sum())
            if place < n:
                crc, left = zlib.crc32(ids[4 * place :], crc), left - (n - place)
    if done < len(docs):
        raise ValueError("a file ends within a document")


def read_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)  # over the manifest: a row for each file
    placed = written(manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base")), "token-bases")
    files = placed.repartition(max(1, min(placed.count(), 1 << 14)))
    blocks = files.mapInArrow(_open, BLOCKS).withColumn("blocks", coder.decoded(manifest.sparkSession, F.col("blocks")))
    return blocks.mapInArrow(trimmed(_documents), RESULT)


def encoded(docs: DataFrame, **options) -> DataFrame:
    """Writes docs as token files in the shared folder and reads them back."""
    return read_files(write_files(docs, new_folder(docs.sparkSession, "tokens"), **options))
