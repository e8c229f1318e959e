"""Substring de-duplication by sliding sentence spans.

Sentences end at . ! ? or a line feed; one of more than LONG words, as in text without such marks, is cut further after words
whose hash is the least among the two words on each side, so it is cut alike wherever it stands. A span is a run of `run`
consecutive sentences, made longer until it has min_words words. The hashes of all spans meet globally; a sentence is removed
if a span covers it that an earlier document holds too, in order of (identifier, text hash). What repeats within one document
only stays, unless `within` is set: then every occurrence but the first goes.

Each task of the scan keeps one row for a span hash it sees, its first, and knows those of other documents to be repeats: so a
span of a third of all texts has one open row for each task, not for each text; known repeats go straight on, by text. Spans
go to their bucket as packed arrays, and from there, packed again, to their texts. Buckets are as many as the text's bytes
need, so that one is held by a worker at a time.

A copy of fewer than `run` sentences or min_words words has no span and stays, a whole text too.

Words are runs of bytes other than white space, A-Z as a-z. Null and empty texts have no spans and stay as they are. Equal
rows (same identifier and text) are one document and don't remove each other's text. Rows without an identifier come first and
are told apart by 64-bit hashes of their texts. Extra columns stay; those named like the result's own are replaced. An
empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ddl, private, quoted, shuffle_partitions, without, written
from .words import _mix, range_hashes, slices, words_of

LONG = 30
#: Bytes of text whose spans one bucket may hold.
BUCKET_BYTES = 32 << 20
_ENDS = np.zeros(256, bool)
_ENDS[[ord("."), ord("!"), ord("?"), 10]] = True
#: One span: hash, identifier, text hash, number of its first sentence. A number below 0 is -1 - s of a known repeat.
ROW = np.dtype([("h", "<u8"), ("d", "<i8"), ("t", "<i8"), ("s", "<i4")])


def sentences_of(column: pa.Array, long: int = LONG):
    """(words, first word of each sentence and one more at the end, first sentence of each text and one more)."""
    w = words_of(column)
    n = len(w.hash)
    if not n:
        return w, np.zeros(1, np.int64), np.zeros(len(w.first), np.int64)
    ends = np.concatenate([[0], np.cumsum(_ENDS[w.data])])
    # a sentence begins with a text's first word and after a word that holds or is followed by an end mark
    begin = np.zeros(n + 1, bool)
    begin[w.first[:-1][np.diff(w.first) > 0]] = True
    begin[1:n] |= ends[w.start[1:]] > ends[w.start[:-1]]
    begin[n] = True
    starts = np.flatnonzero(begin)
    size = np.diff(starts)
    begin[1:] |= _least_nearby(w.hash, np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))) & np.repeat(size > long, size)
    starts = np.flatnonzero(begin)
    return w, starts, np.searchsorted(starts, w.first)


def _least_nearby(h: np.ndarray, owner: np.ndarray, reach: int = 2) -> np.ndarray:
    """Words whose hash none of the words at most `reach` before or after, in the same text, undercuts."""
    ok = np.ones(len(h), bool)
    for k in range(1, reach + 1):
        apart = owner[k:] != owner[:-k]
        ok[k:] &= apart | (h[k:] <= h[:-k])
        ok[:-k] &= apart | (h[:-k] <= h[k:])
    return ok


def spans_of(column: pa.Array, run: int, min_words: int):
    """(owner text, hash, first sentence, sentence after the last), sentences numbered within their text."""
    w, starts, first = sentences_of(column)
    n = len(starts) - 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 4
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = np.maximum(np.arange(n) + run, np.searchsorted(starts, starts[:-1] + min_words))
    ok = end <= first[1:][owner]
    i, j, owner = np.flatnonzero(ok), end[ok], owner[ok]
    return owner, range_hashes(w.hash, starts[i], starts[j]), i - first[owner], j - first[owner]


def _ordered(rows: np.ndarray) -> np.ndarray:
    return rows[np.lexsort((rows["s"], rows["t"], rows["d"], rows["h"]))]


def _split(rows: np.ndarray, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """(the first row of each hash, known repeats) of ordered rows. Of a hash in a document only the first row counts, but
    with `within` the later ones are repeats of their own."""
    if not len(rows):
        return rows, rows
    new = np.concatenate([[True], rows["h"][1:] != rows["h"][:-1]])
    of = rows[np.flatnonzero(new)][np.cumsum(new) - 1]
    other = (rows["d"] != of["d"]) | (rows["t"] != of["t"])
    if within:
        other |= rows["s"] != of["s"]
    else:  # one row of each document
        again = np.concatenate([[False], (rows["h"][1:] == rows["h"][:-1]) & (rows["d"][1:] == rows["d"][:-1]) & (rows["t"][1:] == rows["t"][:-1])])
        other &= ~again
    return rows[new], rows[other]


def _by_place(rows: np.ndarray, buckets: int) -> np.ndarray:
    return _mix(rows["d"].astype(np.uint64) * np.uint64(31) + rows["t"].astype(np.uint64)) % np.uint64(buckets)


def _scan(run: int, min_words: int, within: bool, buckets: int):
    """Rows (bucket, blob): the firsts of this task, by hash, and marked, by document, the repeats that are known here already."""

    def scan(batches):
        kept = np.zeros(0, ROW)
        held, size = [], 0

        def settle(kept, held):
            first, again = _split(_ordered(np.concatenate([kept, *held])), within)
            again["s"] = -1 - again["s"]
            return first, again

        for batch in batches:
            for part in slices(batch, "text"):
                owner, h, s, _ = spans_of(part.column("text"), run, min_words)
                rows = np.zeros(len(h), ROW)
                rows["h"], rows["s"] = h, s
                rows["d"], rows["t"] = (part.column(c).to_numpy(zero_copy_only=False)[owner] for c in ("id", "key"))
                held.append(rows)
                size += len(rows)
                if size > 1 << 18:
                    kept, again = settle(kept, held)
                    held, size = [], 0
                    yield from _blobs(_by_place(again, buckets), again)
        kept, again = settle(kept, held)
        yield from _blobs(_by_place(again, buckets), again)
        yield from _blobs(kept["h"] % np.uint64(buckets), kept)

    return scan


def _blobs(bucket: np.ndarray, rows: np.ndarray):
    if len(rows):
        order = np.argsort(bucket, kind="stable")
        bucket, rows = bucket[order].astype(np.int64), rows[order]
        at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        yield pa.RecordBatch.from_pydict({"bucket": bucket[at], "blob": pa.array([rows[a:b].tobytes() for a, b in zip(at, [*at[1:], len(rows)], strict=True)], pa.binary())})


def _rows(table: pa.Table) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_py(), ROW) for x in table.column("blob")])


def _meet(buckets: int, within: bool):
    """All first spans of a bucket: those after the first of their hash repeat it. Packed again, by text."""

    def run(table: pa.Table) -> pa.Table:
        rows = _rows(table)
        known = rows[rows["s"] < 0]
        known["s"] = -1 - known["s"]
        again = np.concatenate([known, _split(_ordered(rows[rows["s"] >= 0]), within)[1]])
        found = list(_blobs(_by_place(again, buckets), again))
        return pa.Table.from_batches(found) if found else pa.table({"bucket": pa.array([], pa.int64()), "blob": pa.array([], pa.binary())})

    return run


def _by_text(table: pa.Table) -> pa.Table:
    """A row for each text: the first sentences of its repeated spans."""
    rows = _rows(table)
    rows = rows[np.lexsort((rows["s"], rows["t"], rows["d"]))]
    new = np.flatnonzero(np.concatenate([[True], (rows["d"][1:] != rows["d"][:-1]) | (rows["t"][1:] != rows["t"][:-1])]))
    at = [np.unique(rows["s"][a:b]).astype("<i4").tobytes() for a, b in zip(new, [*new[1:], len(rows)], strict=True)]
    return pa.table({"of_id": np.ascontiguousarray(rows["d"][new]), "of_key": np.ascontiguousarray(rows["t"][new]), "at": pa.array(at, pa.binary())})


def _place(id_col: str, text_col: str):
    """Columns that stand for a row's document: its identifier (none: the least) and its text's hash."""
    return F.coalesce(quoted(id_col).cast("long"), F.lit(-(1 << 63))), F.xxhash64(quoted(text_col))


def covered(docs: DataFrame, run: int = 3, min_words: int = 30, within: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(of_id, of_key, at): the first sentences of the repeated spans of each text that has any."""
    own_id, key = _place(id_col, text_col)
    rows = docs.where(quoted(text_col).isNotNull()).select(own_id.alias("id"), key.alias("key"), quoted(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(2 * shuffle_partitions(docs.sparkSession), size // BUCKET_BYTES)
    packed = "bucket long, blob binary"
    met = rows.mapInArrow(_scan(run, min_words, within, buckets), packed).groupBy("bucket").applyInArrow(_meet(buckets, within), packed)
    return met.groupBy("bucket").applyInArrow(_by_text, "of_id long, of_key long, at binary")


def cut_text(column: pa.Array, repeats: list[bytes | None], run: int, min_words: int) -> tuple[list[str], list[int], list[int]]:
    """(kept text, removed sentences, removed words) of each text, from the first sentences of its repeated spans."""
    w, starts, first = sentences_of(column)
    owner, h, begins_at, ends_at = spans_of(column, run, min_words)
    of = np.searchsorted(owner, np.arange(len(repeats) + 1))
    texts, sentences, words = [], [], []
    for i, blob in enumerate(repeats):
        a, b = int(w.text_start[i]), int(w.text_start[i + 1])
        lo, hi = int(first[i]), int(first[i + 1])
        gone = np.zeros(hi - lo, bool)
        if blob:  # with each marked span those of its hash after it
            here = slice(of[i], of[i + 1])
            own, marked = h[here], np.frombuffer(blob, "<i4")
            known, at = np.unique(own[np.searchsorted(begins_at[here], marked)], return_index=True)
            place = np.minimum(np.searchsorted(known, own), len(known) - 1)
            hit = (known[place] == own) & (begins_at[here] >= marked[at][place])
            change = np.zeros(hi - lo + 1, np.int64)
            np.add.at(change, begins_at[here][hit], 1)
            np.add.at(change, ends_at[here][hit], -1)
            gone = change.cumsum()[:-1] > 0
        raw = w.data[a:b].tobytes()
        if gone.any():
            begins = [a, *w.start[starts[lo + 1 : hi]].tolist(), b]  # what stands between sentences goes with that before
            raw = b"".join(raw[x - a : y - a] for x, y, g in zip(begins[:-1], begins[1:], gone.tolist(), strict=True) if not g)
        texts.append(raw.decode())
        sentences.append(int(gone.sum()))
        words.append(int(np.diff(starts[lo : hi + 1])[gone].sum()))
    return texts, sentences, words


def dedup(docs: DataFrame, run: int = 3, min_words: int = 30, within: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text cut, and removed_sentences and removed_words (0: nothing repeats)."""
    repeats = written(covered(docs, run, min_words, within, id_col, text_col), "repeats")
    own = ["removed_sentences", "removed_words"]
    names = without(docs.columns, own, [id_col, text_col])
    of_id, of_key, at, mine, key = private(names, "of_id", "of_key", "at", "mine", "key")
    own_id, own_key = _place(id_col, text_col)
    keyed = docs.select(*map(quoted, names), own_id.alias(mine), own_key.alias(key))
    found = repeats.select(F.col("of_id").alias(of_id), F.col("of_key").alias(of_key), F.col("at").alias(at)).hint("merge")  # grows with the input: never broadcast
    joined = keyed.join(found, (F.col(mine) == F.col(of_id)) & (F.col(key) == F.col(of_key)), "left").select(*map(quoted, names), at)

    def cut(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                column = part.column(text_col)
                texts, sentences, words = cut_text(column, part.column(at).to_pylist(), run, min_words)
                texts = [None if m else t for t, m in zip(texts, column.is_null().to_pylist(), strict=True)]
                cols = [pa.array(texts, pa.string()) if c == text_col else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(sentences, pa.int32()), pa.array(words, pa.int32())], names=[*names, *own])

    return joined.mapInArrow(cut, ddl(docs.schema, names) + ", removed_sentences int, removed_words int")
