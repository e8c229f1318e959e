"""Benchmark decontamination by greedy string tiling.

Texts are lower-cased runs of letters and digits. Seeds are all runs of min_match tokens of a benchmark item; the corpus is
joined with them on their hashes, item by item candidates follow. For a candidate, running Karp-Rabin greedy string tiling
repeatedly marks the longest non-overlapping common runs, down to min_match tokens, in any order of the passages; the item
counts as leaked if the tiles cover at least `coverage` of its tokens (a shorter item: its whole sequence).

The benchmark is read in blocks of at most block_tokens tokens, one after the other: what the driver holds and the workers
get has a fixed bound, and a block's results are written before the next is read. Each further block is another pass over the
corpus. Null and empty texts match nothing and stay; items without tokens are never leaked; repeated items and rows are
reported each, and each row is decided on its own. Extra columns are ignored, or stay where rows do. Empty tables give no
leak.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import quoted, written
from .words import ALNUM, range_hashes, slices, words_of

RESULT = "doc_id long, item_id long, tokens int, covered int, coverage double, tiles int"


def tile(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two token sequences by running Karp-Rabin: (start in a, start in b, length). The longest
    matches go first, ties to the smallest starts. Negative tokens of b are barriers."""
    free_a, free_b, tiles = np.ones(len(a), bool), b >= 0, []
    length = min(len(a), len(b))
    while length >= least:
        found = _matches(a, b, free_a, free_b, least)
        if not found:
            break
        longest = max(n for _, _, n in found)
        for at_a, at_b, n in sorted(found, key=lambda x: (-x[2], x[0], x[1])):
            if n < longest:
                break
            if free_a[at_a : at_a + n].all() and free_b[at_b : at_b + n].all():
                free_a[at_a : at_a + n] = free_b[at_b : at_b + n] = False
                tiles.append((at_a, at_b, n))
        length = longest
    return tiles


def _matches(a, b, free_a, free_b, size) -> list[tuple[int, int, int]]:
    """Maximal common runs, of size tokens at least, of what is unmarked; windows meet by their rolling hashes and are
    checked token by token."""
    if len(a) < size or len(b) < size:
        return []
    by_hash: dict[int, list[int]] = defaultdict(list)
    windows = lambda x: range_hashes(x.astype(np.uint64), np.arange(len(x) - size + 1), np.arange(size, len(x) + 1))
    whole = lambda free: np.convolve(free, np.ones(size, int), "valid") == size
    for i, (h, ok) in enumerate(zip(windows(a).tolist(), whole(free_a), strict=True)):
        if ok:
            by_hash[h].append(i)
    out, done = [], {}
    for j, (h, ok) in enumerate(zip(windows(b).tolist(), whole(free_b), strict=True)):
        for i in by_hash.get(h, ()) if ok else ():
            if done.get(i - j, -1) >= j:  # inside a run that has been extended
                continue
            n = 0
            while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                n += 1
            if n >= size:
                out.append((i, j, n))
                done[i - j] = j + n - size
    return out


class Block:
    """A block of the benchmark: tokens of its items and their seeds."""

    def __init__(self, items: list[tuple[int, str]], min_match: int, coverage: float):
        self.ids, self.min_match, self.coverage = [i for i, _ in items], min_match, coverage
        w = words_of(pa.array([t or "" for _, t in items], pa.string()), ALNUM)
        self.vocabulary = np.unique(w.hash)
        tokens = np.searchsorted(self.vocabulary, w.hash)
        self.items = [tokens[x:y] for x, y in zip(w.first[:-1], w.first[1:], strict=True)]
        self.sizes = sorted({min(min_match, len(x)) for x in self.items if len(x)})
        seeds: dict[int, list[int]] = defaultdict(list)
        for k, x in enumerate(self.items):
            size = min(min_match, len(x))
            if size:
                at = np.arange(len(x) - size + 1)
                for h in set(range_hashes(x.astype(np.uint64), at, at + size).tolist()):
                    seeds[h].append(k)
        self.seeds = np.array(sorted(seeds), np.uint64)
        self.owners = [seeds[int(h)] for h in self.seeds]

    def search(self, column: pa.Array):
        """(place of the text, place of the item, covered tokens, tiles) of all leaks."""
        w = words_of(column, ALNUM)
        at = np.minimum(np.searchsorted(self.vocabulary, w.hash), max(0, len(self.vocabulary) - 1))
        tokens = np.where(self.vocabulary[at] == w.hash, at, -1) if len(self.vocabulary) else np.full(len(w.hash), -1)
        ends, hits = w.first[1:], defaultdict(list)
        owner = np.repeat(np.arange(len(ends)), np.diff(w.first))
        for size in self.sizes:
            if len(tokens) < size:
                continue
            start = np.arange(len(tokens) - size + 1)
            known = np.concatenate([[0], np.cumsum(tokens >= 0)])
            start = start[(known[size:] - known[:-size] == size) & (start + size <= ends[owner[: len(start)]])]
            if not len(start):
                continue
            h = range_hashes(np.maximum(tokens, 0).astype(np.uint64), start, start + size)
            got = np.minimum(np.searchsorted(self.seeds, h), len(self.seeds) - 1)
            for s, g in zip(*(x[self.seeds[got] == h].tolist() for x in (start, got)), strict=True):
                for item in self.owners[g]:
                    hits[int(owner[s]), item].append((s, size))
        for (text, item), found in sorted(hits.items()):
            a, size = self.items[item], min(self.min_match, len(self.items[item]))
            spans = [s for s, n in found if n == size]
            if not spans:
                continue
            pieces, last = [], -1
            for s in spans:  # only tokens under a seed can be in a tile
                if s > last and pieces:
                    pieces.append(np.array([-1]))
                pieces.append(tokens[max(s, last) : s + size])
                last = max(last, s + size)
            b = np.concatenate(pieces)
            if len(set(b.tolist()) - {-1}) < self.coverage * len(set(a.tolist())) * 0.5 and len(b) < self.coverage * len(a):
                continue
            tiles = tile(a, b, size)
            covered = sum(n for _, _, n in tiles)
            if covered >= self.coverage * len(a):
                yield text, item, covered, len(tiles)


def leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, coverage: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_tokens: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, tokens, covered, coverage, tiles) of each leaked item and the text that holds it."""
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    parts = []
    for block, last in _with_last(_blocks(benchmark, item_col, item_text_col, block_tokens, min_match, coverage)):
        sent = rows.sparkSession.sparkContext.broadcast(block)
        part = rows.mapInArrow(_tiler(sent), RESULT)
        if not last:
            part = written(part, "leaks")
            sent.destroy()
        parts.append(part)
    return reduce(DataFrame.union, parts) if parts else rows.sparkSession.createDataFrame([], RESULT)


def _with_last(items):
    """(item, whether it is the last) of an iterator."""
    held = None
    for x in items:
        if held is not None:
            yield held, False
        held = x
    if held is not None:
        yield held, True


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_tokens: int, min_match: int, coverage: float):
    items = benchmark.select(quoted(item_col).cast("long").alias("i"), F.coalesce(quoted(text_col), F.lit("")).alias("t")).orderBy("i", "t")
    held, size = [], 0
    for i, t in items.toLocalIterator():
        n = len(t) // 2 + 1
        if held and size + n > block_tokens:
            yield Block(held, min_match, coverage)
            held, size = [], 0
        held.append((i, t))
        size += n
    if held:
        yield Block(held, min_match, coverage)


def _tiler(sent):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                block, ids = sent.value, part.column("doc_id").to_pylist()
                out = [{"doc_id": ids[t], "item_id": block.ids[k], "tokens": len(block.items[k]), "covered": n, "coverage": n / len(block.items[k]), "tiles": c} for t, k, n, c in block.search(part.column("text"))]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("tokens", pa.int32()), ("covered", pa.int32()), ("coverage", pa.float64()), ("tiles", pa.int32())]))

    return run


def clean(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, coverage: float = 0.5, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_tokens: int = 1_000_000) -> DataFrame:
    """docs without the rows whose text holds a leaked item; decided in the scan itself, with no join."""

    def run(sent):
        def keep(batches):
            for batch in batches:
                for part in slices(batch, text_col):
                    bad = {t for t, *_ in sent.value.search(part.column(text_col))}
                    yield part.take(pa.array([i for i in range(part.num_rows) if i not in bad], pa.int64()))

        return keep

    for block, last in _with_last(_blocks(benchmark, item_col, item_text_col, block_tokens, min_match, coverage)):
        sent = docs.sparkSession.sparkContext.broadcast(block)
        docs = docs.mapInArrow(run(sent), docs.schema)
        if not last:
            docs = written(docs, "clean")
            sent.destroy()
    return docs
