"""Language identification by word-first backoff.

A known word scores its log frequency in each language. An unseen word scores by a character model: for every character the
longest known n-gram that ends there, from 4 characters down to 1, each step down at a penalty. A text's scores are summed
over all its words and turned into a posterior.

Training counts come from a bounded sample of labelled rows, chosen by a hash of the identifier: `max_documents` in
expectation (a documented bound; prediction covers every whole text). Every distinct word of the sample teaches its n-grams,
however rare; a word is itself known from min_count occurrences on. Both are counted by Spark; n-grams and known words reach
the driver. Texts that are null or hold no letter are `und` with score 0. Ties go to the language whose name comes first. With
no labelled row, every text is `und`. Extra columns stay; those named like the result's own are replaced. Equal rows get
equal results.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ddl, lean, private, quoted, without, written
from .words import LETTERS, _mix, slices, word_hash, words_of

ORDER = 4
PENALTY = log(0.4)
UNSEEN = log(0.05)
BEGIN, END = "\x02", "\x03"


@dataclass
class Model:
    langs: list[str]
    words: np.ndarray  # sorted hashes of known words
    word_scores: np.ndarray  # by word and language
    grams: list[np.ndarray]  # by length - 1: sorted keys
    gram_scores: list[np.ndarray]


def is_held_out(id_col: str, modulus: int, rest: int) -> Column:
    return F.coalesce(F.crc32(quoted(id_col).cast("string")) % modulus == rest, F.lit(False))


def word_counts(labelled: DataFrame) -> DataFrame:
    """(lang, word, n) of a frame with lang and text."""

    def count(batches):
        found: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = text.encode()
                found[lang].update(raw.translate(_KEEP).split())
        for lang, c in found.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(c), "word": pa.array([w.decode("utf-8", "replace") for w in c], pa.string()), "n": pa.array(list(c.values()), pa.int64())})

    return labelled.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


#: Bytes that aren't part of a word become spaces.
_KEEP = bytes(b if LETTERS[b] else 32 for b in range(256))


def gram_key(codes: np.ndarray) -> np.ndarray:
    """Keys of n-grams; codes has a column for each character."""
    key = np.zeros(len(codes), np.uint64)
    for i in range(codes.shape[1]):
        key = key * np.uint64(0x100000001B3) + codes[:, i].astype(np.uint64) + np.uint64(1)
    return _mix(key)


def gram_counts(words) -> Counter:
    """(lang, n-gram) -> how often the (lang, word) hold it; n-grams of 1 to ORDER characters of the word between its marks."""
    found: Counter = Counter()
    for lang, word in words:
        marked = BEGIN + word + END
        found.update((lang, marked[at - size + 1 : at + 1]) for size in range(1, ORDER + 1) for at in range(max(1, size - 1), len(marked)))
    return found


def _grams(batches):
    found: Counter = Counter()
    for batch in batches:
        found.update(gram_counts(zip(batch.column("lang").to_pylist(), batch.column("word").to_pylist(), strict=True)))
    langs, grams = zip(*found, strict=True) if found else ((), ())
    for k in range(0, len(langs), 1 << 17):
        some = slice(k, k + (1 << 17))
        yield pa.RecordBatch.from_pydict({"lang": pa.array(langs[some], pa.string()), "gram": pa.array(grams[some], pa.string()), "n": pa.array(list(found.values())[some], pa.int64())})


def fit(counts: list[tuple[str, str, int]], min_count: int = 3) -> Model:
    """A model of (lang, word, n). Words of fewer than min_count occurrences teach n-grams only."""
    total: Counter = Counter()
    for lang, _, n in counts:
        total[lang] += n
    grams = gram_counts((lang, word) for lang, word, _ in counts)
    return model_of([x for x in counts if x[2] >= min_count], [(*k, n) for k, n in grams.items()], total)


def model_of(known_words: list[tuple[str, str, int]], gram_rows: list[tuple[str, str, int]], totals: dict[str, int]) -> Model:
    """A model of the known words (lang, word, n), the n-grams (lang, n-gram, n) and the words of each language. Longer n-grams
    that occur only once are told by the shorter ones."""
    langs = sorted(totals)
    place = {lang: i for i, lang in enumerate(langs)}
    total = np.ones(len(langs)) + [totals[lang] for lang in langs]
    words: dict[str, np.ndarray] = {}
    grams: list[dict[str, np.ndarray]] = [{} for _ in range(ORDER + 1)]
    for lang, word, n in known_words:
        words.setdefault(word, np.zeros(len(langs)))[place[lang]] += n
    for lang, gram, n in gram_rows:
        grams[len(gram)].setdefault(gram, np.zeros(len(langs)))[place[lang]] += n
    known = sorted(words)
    hashes = np.array([word_hash(w) for w in known], np.uint64) if len(known) < 1000 else words_of(pa.array(known), np.ones(256, bool)).hash
    scores = np.array([np.log(np.maximum(words[w], 0.5) / total) for w in known]).reshape(-1, len(langs))
    order = np.argsort(hashes)
    context: list[dict] = [defaultdict(lambda: np.zeros(len(langs))) for _ in range(ORDER + 1)]
    for size in range(1, ORDER + 1):
        for gram, c in grams[size].items():
            context[size][gram[:-1]] += c
    value: dict[str, np.ndarray] = {"": np.full(len(langs), log(1e-4))}
    keys, rows = [], []
    for size in range(1, ORDER + 1):
        own, out = [], []
        for gram, c in grams[size].items():
            if size > 1 and c.sum() < 2:
                continue
            back = value.get(gram[1:])
            shorter = gram[1:]
            while back is None:
                shorter = shorter[1:]
                back = value.get(shorter)
            with np.errstate(divide="ignore"):
                value[gram] = np.where(c > 0, np.log(c / np.maximum(context[size][gram[:-1]], 1)), back + PENALTY * (size - len(shorter)))
            own.append([ord(x) for x in gram])
            out.append(value[gram])
        k = gram_key(np.array(own, np.uint32).reshape(-1, size))
        at = np.argsort(k)
        keys.append(k[at])
        rows.append(np.array(out).reshape(-1, len(langs))[at])
    return Model(langs, hashes[order], scores[order], keys, rows)


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted table, -1 where absent."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def unseen_scores(model: Model, words: list[bytes] | None, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Scores of words, given as ranges of data, by their characters."""
    length = end - start
    first = np.concatenate([[0], np.cumsum(length + 2)])
    flat = np.empty(first[-1], np.uint8)
    flat[first[:-1]], flat[first[1:] - 1] = ord(BEGIN), ord(END)
    inner = np.repeat(start - np.concatenate([[0], np.cumsum(length)])[:-1], length) + np.arange(length.sum())
    flat[np.repeat(first[:-1] + 1 - np.concatenate([[0], np.cumsum(length)])[:-1], length) + np.arange(length.sum())] = data[inner]
    codes = np.frombuffer(flat.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begins = np.flatnonzero(codes == ord(BEGIN))
    owner = np.cumsum(codes == ord(BEGIN)) - 1
    depth = np.arange(len(codes)) - begins[owner]
    out = np.full((len(codes), len(model.langs)), log(1e-4) + ORDER * PENALTY)
    open_ = depth > 0
    for size in range(ORDER, 0, -1):
        at = np.flatnonzero(open_ & (depth >= size - 1))
        got = _find(model.grams[size - 1], gram_key(np.stack([codes[at - size + 1 + i] for i in range(size)], 1)))
        hit = got >= 0
        out[at[hit]] = model.gram_scores[size - 1][got[hit]] + PENALTY * (ORDER - size)
        open_[at[hit]] = False
    out[depth == 0] = 0
    return np.add.reduceat(out, begins) + UNSEEN


def score_batch(model: Model, column: pa.Array) -> np.ndarray:
    """Sum of word scores by text and language."""
    return scores_and_lengths(model, column)[0]


def scores_and_lengths(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sum of word scores by text and language; each text's characters within words, and one more for each word's end."""
    w = words_of(column, LETTERS)
    got = _find(model.words, w.hash)
    chars = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
    ends = np.concatenate([[0], np.cumsum(chars[w.end] - chars[w.start] + 1)])
    rows = np.zeros((len(w.hash) + 1, len(model.langs)))
    known = np.flatnonzero(got >= 0)
    rows[known] = model.word_scores[got[known]]
    new = np.flatnonzero(got < 0)
    if len(new):
        _, at, back = np.unique(w.hash[new], return_index=True, return_inverse=True)
        rows[new] = unseen_scores(model, None, w.data, w.start[new][at], w.end[new][at])[back]
    total = np.zeros((len(w.hash) + 1, len(model.langs)))
    np.cumsum(rows[:-1], axis=0, out=total[1:])
    return total[w.first[1:]] - total[w.first[:-1]], ends[w.first[1:]] - ends[w.first[:-1]]


def train(docs: DataFrame, max_documents: int = 20_000, min_count: int = 3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    able = docs.where(~is_held_out(id_col, 3, 1) & quoted(id_col).isNotNull() & quoted(lang_col).isNotNull() & quoted(text_col).isNotNull())
    n = able.select(F.lit(1)).count()
    if not n:
        return None
    share = min(1 << 20, int((1 << 20) * max_documents / n))
    sample = able.where(F.pmod(F.xxhash64(quoted(id_col).cast("string")), F.lit(1 << 20)) < share)
    counts = written(word_counts(sample.select(quoted(lang_col).alias("lang"), F.lower(quoted(text_col)).alias("text"))), "word-counts")
    rows = lambda df, *by: list(df.toPandas().sort_values(list(by)).itertuples(index=False, name=None))
    totals = dict(rows(counts.groupBy("lang").agg(F.sum("n").alias("n")), "lang"))
    if not totals:
        return None
    grams = counts.select("lang", "word").mapInArrow(_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return model_of(rows(counts.where(F.col("n") >= min_count), "lang", "word"), rows(grams, "lang", "gram"), totals)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", result: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """docs with the language and its posterior under the names of `result`; a third name, if given, is that of the best
    language's score for each character."""
    own, mean = list(result), len(result) > 2
    names = without(docs.columns, own, [text_col])
    columns = [quoted(x) for x in names]
    if model is None:
        return docs.select(*columns, F.lit("und").alias(own[0]), *(F.lit(0.0).alias(x) for x in own[1:]))
    low, letter = private(names, "lowered", "letter")
    sent = spark_model(docs, model)

    def run(batches):
        m = sent.value
        for batch in batches:
            for part in slices(batch, low):
                scores, length = scores_and_lengths(m, part.column(low))
                best = scores.argmax(1)
                share = 1 / np.exp(np.minimum(scores - scores[np.arange(len(best)), best][:, None], 0)).sum(1)
                has = part.column(letter).to_numpy(zero_copy_only=False).astype(bool)
                cols = [part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.where(has, np.array(m.langs, object)[best], "und"), pa.string()), pa.array(np.where(has, share, 0.0)), *[pa.array(scores.max(1) / np.maximum(length, 1))] * mean], names=[*names, *own])

    schema = ", ".join([ddl(docs.schema, names), *(f"`{x}` {kind}" for x, kind in zip(own, ("string", "double", "double"), strict=False))])
    text = quoted(text_col)
    has_letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    return docs.select(*columns, F.coalesce(F.lower(text), F.lit("")).alias(low), has_letter.alias(letter)).mapInArrow(lean(run), schema)


def spark_model(docs: DataFrame, model):
    """The model, of bounded size, as a broadcast variable."""
    return docs.sparkSession.sparkContext.broadcast(model)
