"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle ends with the seek table of the seekable format (a skippable
frame that has each frame's compressed and decompressed size), so any frame is found without reading those before it. An
index maps a record's identifier to (bundle, frame, offset within the frame's content).

Payloads of equal digest and size are stored once: the record with the smallest identifier is the response, the others are
revisits that refer to it. Nulls count as empty payloads. Identifiers that repeat are kept as records of their own; rows
whose identifier is null are written as responses and never referred to by rows with an identifier, as they come last in
order. A record's own identifier is a UUID made from the page's identifier and the payload's digest, so only equal rows
share one. Extra columns of the input are ignored. An empty table gives no bundle.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import file_system, new_folder, put_file, written

#: Fixed values of the Zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEK_TABLE_MAGIC = 0x8F92EAB1

MANIFEST = "bundle string, n_frames long, n_records long"
INDEX = "page_id long, bundle string, frame int, frame_start long, frame_size long, record_start long, record_size long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def with_origin(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int) -> DataFrame:
    """(page_id, url, payload, digest, refers_to). Digests are counted with map-side combining and only those that repeat
    are joined back, from a written table, so that a digest of a third of all rows is split by the skew join."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.encode("payload", "UTF-8")))
    large = F.when(F.octet_length("payload") >= least, F.col("digest"))
    firsts = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & F.col("first_id").isNotNull())
    firsts = written(firsts.select(F.col("digest").alias("of"), "first_id"), "firsts")
    joined = rows.withColumn("key", large).join(firsts, F.col("key") == F.col("of"), "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(F.col("page_id") > F.col("first_id"), F.col("first_id")).alias("refers_to"))


def record_id(page_id: int | None, digest: str) -> str:
    """The identifier of a page's record."""
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}').urn}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A WARC/1.1 record; a revisit has no payload, but its length and digest among the headers."""
    kind = "response" if refers_to is None else "revisit"
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if refers_to is None else b"")
    target = "".join(c for c in url or "" if c >= " ")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head[4:4] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


class Bundle:
    """Collects records into frames of about frame_bytes and gives the file's bytes."""

    def __init__(self, frame_bytes: int = 1 << 18, level: int = 6):
        import zstandard

        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frame_bytes, self.frames, self.sizes, self.open, self.held, self.records = frame_bytes, [], [], [], 0, 0

    def add(self, record: bytes) -> None:
        self.open.append(record)
        self.held += len(record)
        self.records += 1
        if self.held >= self.frame_bytes:
            self._close()

    def _close(self) -> None:
        if self.open:
            content = b"".join(self.open)
            self.frames.append(self.pack.compress(content))
            self.sizes.append((len(self.frames[-1]), len(content)))
            self.open, self.held = [], 0

    @property
    def size(self) -> int:
        return sum(x for x, _ in self.sizes) + self.held

    def finish(self) -> bytes:
        self._close()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEK_TABLE_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table


def write_bundles(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, bundle_bytes: int = 32 << 20, date: str | None = None) -> DataFrame:
    """Writes the archives and returns the manifest, a written table with a row for each finished bundle. Payloads of at
    least `least` bytes are de-duplicated. `date` is when the pages were got (the present time if not given)."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches):
        bundle, done = Bundle(), []

        def finish():
            done.append((put_file(folder, "bundle", bundle.finish()), len(bundle.frames), bundle.records))

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bundle.add(record_bytes(page_id, url, payload.encode(), base64.b32encode(bytes.fromhex(digest)).decode(), refers_to, date))
                if bundle.size >= bundle_bytes:
                    finish()
                    bundle = Bundle()
        if bundle.records:
            finish()
        for x in done:
            yield pa.RecordBatch.from_pylist([dict(zip(("bundle", "n_frames", "n_records"), x, strict=True))])

    return written(with_origin(pages, id_col, url_col, payload_col, least).mapInArrow(write, MANIFEST), "manifest")


def seek_table(uri: str) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of each frame, from the footer."""
    system, path = file_system(uri)
    with system.open_input_file(path) as f:
        end = f.size()
        f.seek(end - 9)
        n, _, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEK_TABLE_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        f.seek(end - 9 - 8 * n)
        sizes = struct.unpack(f"<{2 * n}I", f.read(8 * n))
    out, at = [], 0
    for packed, content in zip(sizes[::2], sizes[1::2], strict=True):
        out.append((at, packed, content))
        at += packed
    return out


def read_frame(uri: str, start: int, size: int) -> bytes:
    import zstandard

    system, path = file_system(uri)
    with system.open_input_file(path) as f:
        return zstandard.ZstdDecompressor().decompress(f.read_at(size, start))


def parse(content: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, place after) of the record at a place of a frame's content."""
    end = content.index(b"\r\n\r\n", at)
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in content[at:end].decode().split("\r\n")[1:])
    block = content[end + 4 : end + 4 + int(headers["Content-Length"])]
    return headers, block, end + 4 + len(block) + 4


def described(headers: dict[str, str], block: bytes) -> dict:
    """What op10 tells of a record; a response's payload is measured and its digest checked against the header."""
    kind, digest, size = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"])
    if kind == "response":
        payload = block.split(b"\r\n\r\n", 1)[1]
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"payload of {headers['WARC-Record-ID']} is damaged")
    page, refers_to = (int(x) if x else None for x in (headers["X-Page-ID"], headers.get("X-Refers-To-Page")))
    if headers["WARC-Record-ID"] != record_id(page, digest) or kind == "revisit" and headers["WARC-Refers-To"] != record_id(refers_to, digest):
        raise ValueError(f"headers of {headers['WARC-Record-ID']} are damaged")
    return {"page_id": page, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": refers_to}


def read_index(manifest: DataFrame) -> DataFrame:
    """Reads every bundle, frame by frame through its seek table, and returns the index with what each record says."""

    def read(batches):
        for batch in batches:
            for uri in batch.column("bundle").to_pylist():
                for k, (start, size, _) in enumerate(seek_table(uri)):
                    content, at, rows = read_frame(uri, start, size), 0, []
                    while at < len(content):
                        headers, block, after = parse(content, at)
                        rows.append(described(headers, block) | {"bundle": uri, "frame": k, "frame_start": start, "frame_size": size, "record_start": at, "record_size": after - at})
                        at = after
                    yield pa.RecordBatch.from_pylist(rows, schema=_index_schema())

    return manifest.select("bundle").repartition(max(1, min(manifest.count(), 1 << 14))).mapInArrow(read, INDEX)


def _index_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    return pa.schema([(a, kinds[b]) for a, b in (x.split() for x in INDEX.split(", "))])


def read_record(index_row) -> tuple[dict[str, str], bytes]:
    """One record by its index row: opens one frame only."""
    content = read_frame(index_row["bundle"], index_row["frame_start"], index_row["frame_size"])
    headers, block, _ = parse(content, index_row["record_start"])
    return headers, block


def archive(pages: DataFrame, **options) -> DataFrame:
    """Writes pages as bundles in the shared folder and reads them back."""
    return read_index(write_bundles(pages, new_folder(pages.sparkSession, "warc"), **options))
