"""Words of Arrow text columns by numpy, without a Python step for each word.

A batch's UTF-8 bytes are one array. Words are maximal runs of bytes of a class; each has a 64-bit hash made from prefix
sums of a polynomial (random value of each byte, odd base), then mixed. Hashes depend on the lower-cased bytes alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE, _WORD_BASE = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NON_SPACE = ~SPACE
#: Letters of ASCII and every byte of a longer UTF-8 sequence.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
ALNUM = LETTERS.copy()
ALNUM[48:58] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


#: A value for each byte, A to Z as a to z.
_VALUE = _mix(np.arange(1, 257, dtype=_U) * _U(0xBF58476D1CE4E5B9))
_VALUE[65:91] = _VALUE[97:123]


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


class _Powers:
    """Powers of a base and of its inverse modulo 2^64, grown as needed."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse, self.up, self.down = base, _U(_inverse(int(base))), np.ones(1, _U), np.ones(1, _U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            for name, by in (("up", self.base), ("down", self.inverse)):
                row = np.full(size, by, _U)
                row[0] = _U(1)
                setattr(self, name, np.multiply.accumulate(row))
        return self.up[:n], self.down[:n]


_bytes, _items = _Powers(_BASE), _Powers(_WORD_BASE)


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for every pair; equal sequences have equal hashes wherever they stand."""
    up, down = _items.to(len(values) + 1)
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return _mix((total[end] - total[start]) * down[start] + (end - start).astype(_U) * _U(0x2545F4914F6CDD1D))


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts
    text_start: np.ndarray  # by text, one more at the end: offsets into data
    start: np.ndarray  # by word
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # by text, one more at the end: index of the first word


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(column: pa.Array | pa.ChunkedArray, inside: np.ndarray = NON_SPACE) -> Words:
    """The words of each text: maximal runs of bytes of the class, never across texts."""
    data, offsets = text_bytes(column)
    n = len(data)
    mask = np.zeros(n + 2, np.int8)
    mask[1:-1] = inside[data]
    step = np.diff(mask)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    cut = np.unique(cut[(mask[cut] == 1) & (mask[cut + 1] == 1)]) if len(cut) else cut
    if len(cut):  # a word that runs over the end of a text is two
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    up, down = _bytes.to(n + 1)
    total = np.zeros(n + 1, _U)
    np.cumsum(_VALUE[data] * up[:n], out=total[1:])
    hashes = _mix((total[end] - total[start]) * down[start] + (end - start).astype(_U))
    return Words(data, offsets, start, end, hashes, np.searchsorted(start, offsets))


def word_hash(word: str) -> int:
    """The hash that words_of gives to one word."""
    return int(words_of(pa.array([word]), np.ones(256, bool)).hash[0])


def shingles_of(w: Words, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of the word shingles of every text; a text of fewer words has its whole sequence as one, a
    text without words none."""
    count = np.diff(w.first)
    runs = np.maximum(np.minimum(count, 1), count - size + 1)
    owner = np.repeat(np.arange(len(count)), runs)
    at = np.concatenate([[0], np.cumsum(runs)])
    start = w.first[:-1][owner] + np.arange(at[-1]) - at[:-1][owner]
    hashes = range_hashes(w.hash, start, np.minimum(start + size, w.first[1:][owner]))
    out = []
    for i in range(len(count)):
        row = np.sort(hashes[at[i] : at[i + 1]])
        out.append(row[np.concatenate([[True], row[1:] != row[:-1]])] if len(row) > 1 else row)
    return out


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 19):
    """The batch in runs of rows whose texts hold about so many bytes, to bound the memory of what is made from them."""
    sizes = np.diff(text_bytes(batch.column(column))[1])
    at = np.concatenate([[0], np.cumsum(sizes)])
    i = 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j
