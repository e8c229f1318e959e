"""Token ids of whole texts by the tokenizers library, fast on text of recurring words.

The byte-level pre-tokenizer never joins a visible character with white space after it, an ASCII letter with an ASCII
character after it that is no letter, nor a single line feed with a visible character after it. A text is cut at these places
by numpy; each distinct unit is encoded once by the library and kept, under a 64-bit hash of its bytes, in a worker's memory
of bounded size; a text's ids are its units' ids in a row. Units of letters alone are one pre-token each and go straight to
the library's BPE model, others through the whole tokenizer. Long units aren't kept. Texts that hold an added token's name
(which becomes that token) or white space beyond ASCII are encoded whole. All ways give the ids of
encode(text, add_special_tokens=False).
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import _bytes, _mix, text_bytes

END = 0
_U = np.uint64
#: Slots of a worker's table of units; it starts anew when half of them are taken.
SLOTS = 1 << 21
#: Units of more bytes aren't kept.
LONGEST = 256

_KIND_LETTER, _KIND_VISIBLE, _KIND_CUT_SPACE, _KIND_OTHER, _KIND_HIGH = 0, 1, 2, 3, 4
#: By byte: ASCII letter, other visible ASCII, space or line feed, control, part of a longer UTF-8 sequence.
_KIND = np.full(256, _KIND_OTHER, np.uint8)
_KIND[0x21:0x7F] = _KIND_VISIBLE
_KIND[[*range(65, 91), *range(97, 123)]] = _KIND_LETTER
_KIND[[0x20, 0x0A]] = _KIND_CUT_SPACE
_KIND[128:] = _KIND_HIGH
_VALUE = _mix(np.arange(301, 557, dtype=_U) * _U(0xBF58476D1CE4E5B9))
#: Letters up to U+024F, after a space or none: one pre-token.
_PLAIN = re.compile("[ ]?[A-Za-zÀ-ÖØ-öø-ɏ]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b if b in shown else spare))
        spare += b not in shown
    return out


def units_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the units of all texts; every text that isn't empty begins a unit."""
    n = len(data)
    kind = _KIND[data]
    before, now = kind[:-1], kind[1:]
    cut = np.zeros(n, bool)
    at_space = (now == _KIND_CUT_SPACE) & ((before <= _KIND_VISIBLE) | (before == _KIND_HIGH))
    cut[1:] = at_space | ((before == _KIND_LETTER) & (now != _KIND_LETTER) & (now != _KIND_HIGH))
    cut[offsets[:-1][offsets[:-1] < n]] = True
    # after a line feed that is a unit's first byte and stands before a visible ASCII character
    feed = np.flatnonzero((data[:-1] == 0x0A) & cut[:-1] & (now <= _KIND_VISIBLE))
    cut[feed + 1] = True
    return np.flatnonzero(cut)


class Encoder:
    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path or default_path())
        #: Texts of added tokens, which the library cuts out before it merges.
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.batch = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        self.merge = self.library.model.tokenize
        self.shown = _byte_characters()
        self._forget()

    def _forget(self) -> None:
        self.keys, self.slots = np.zeros(SLOTS, _U), np.zeros(SLOTS, np.int32)
        #: Place 0 is the end of a document.
        self.ids, self.n_ids = np.array([END], np.uint32), 1
        self.starts, self.sizes, self.n = np.zeros(1, np.int64), np.ones(1, np.int32), 1

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Places of units, 0 where unknown."""
        slot = (keys & _U(SLOTS - 1)).astype(np.int64)
        found = self.slots[slot]
        todo = np.flatnonzero((found != 0) & (self.keys[slot] != keys))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (SLOTS - 1)
            found[todo] = self.slots[slot[todo]]
            todo = todo[(found[todo] != 0) & (self.keys[slot[todo]] != keys[todo])]
        return found

    def _insert(self, keys: np.ndarray, places: np.ndarray) -> None:
        """Enters distinct unknown units."""
        slot = (keys & _U(SLOTS - 1)).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.slots[slot[todo]] == 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.slots[slot[put]], self.keys[slot[put]] = places[put], keys[put]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & (SLOTS - 1)

    def _encoded(self, units: list[str]) -> list[list[int]]:
        """Ids of each unit. An empty list marks one that can't stand alone."""
        shown, merge, plain = self.shown, self.merge, _PLAIN.fullmatch
        out: list = []
        rest = []
        for i, u in enumerate(units):
            if plain(u):
                out.append([t.id for t in merge("".join([shown[b] for b in u.encode()]) if not u.isascii() else "Ġ" + u[1:] if u[0] == " " else u)])
            else:
                out.append([])
                if u.isascii() or not any(c.isspace() for c in u if c > "\x7f"):
                    rest.append(i)
        for k in range(0, len(rest), 4096):
            some = rest[k : k + 4096]
            for i, x in zip(some, self.batch([units[i] for i in some], add_special_tokens=False), strict=True):
                out[i] = x.ids
        return out

    def _add(self, units: list[str]) -> np.ndarray:
        """Keeps the ids of units; their places."""
        found = self._encoded(units)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum()))
        ends = sizes.cumsum() + self.n_ids
        self.ids, self.n_ids = _room(self.ids, self.n_ids, flat), self.n_ids + len(flat)
        self.starts = _room(self.starts, self.n, ends - sizes)
        self.sizes = _room(self.sizes, self.n, sizes)
        places = np.arange(self.n, self.n + len(units))
        self.n += len(units)
        return places

    def _places(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        up, down = _bytes.to(len(data) + 1)
        total = np.zeros(len(data) + 1, _U)
        np.cumsum(_VALUE[data] * up[: len(data)], out=total[1:])
        keys = _mix((total[end] - total[start]) * down[start] + (end - start).astype(_U))
        short = end - start <= LONGEST
        places = np.where(short, self._find(keys), 0)
        new = np.flatnonzero(places == 0)
        if len(new):
            raw = data.tobytes()
            cut = lambda some: [raw[a:b].decode() for a, b in zip(start[some].tolist(), end[some].tolist(), strict=True)]
            kept, long = new[short[new]], new[~short[new]]
            own, first, back = np.unique(keys[kept], return_index=True, return_inverse=True)
            got = self._add(cut(kept[first]))
            self._insert(own, got)
            places[kept] = got[back]
            if len(long):
                places[long] = self._add(cut(long))
        return places

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets by text); every text is followed by END. Null as empty."""
        column = texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.string())
        if self.n > SLOTS // 2 or self.n_ids > 4 * SLOTS:
            self._forget()
        data, offsets = text_bytes(column)
        n = len(offsets) - 1
        if not n:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        start = units_of(data, offsets) if len(data) else np.zeros(0, np.int64)
        places = self._places(data, start, np.append(start[1:], len(data))) if len(data) else start
        first = np.searchsorted(start, offsets)
        owner = np.repeat(np.arange(n), np.diff(first))
        row = np.zeros(len(places) + n, np.int64)  # an end after the units of each text
        row[np.arange(len(places)) + owner] = places
        size = self.sizes[row].astype(np.int64)
        ends = np.cumsum(size)
        out = self.ids[np.repeat(self.starts[row] - ends + size, size) + np.arange(ends[-1])]
        offsets = np.concatenate([[0], ends[first[1:] + np.arange(n)]])
        whole = set(owner[self.sizes[places] == 0].tolist())
        for name in self.added:
            whole.update(np.flatnonzero(pc.match_substring(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, name).fill_null(False).to_numpy(zero_copy_only=False)).tolist())
        if whole:
            order = sorted(whole)
            slow = dict(zip(order, self.batch([column[i].as_py() for i in order], add_special_tokens=False), strict=True))
            rows = [np.array([*slow[i].ids, END], np.uint32) if i in whole else out[offsets[i] : offsets[i + 1]] for i in range(n)]
            out, offsets = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])])
        return out, offsets


def _room(held: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """held with more from place used on, grown by half or more when full."""
    if used + len(more) > len(held):
        grown = np.zeros(max(used + len(more), len(held) * 3 // 2, 1 << 16), held.dtype)
        grown[:used] = held[:used]
        held = grown
    held[used : used + len(more)] = more
    return held


@lru_cache(1)
def encoder(path: str | None = None) -> Encoder:
    """One for each worker process."""
    return Encoder(path)
