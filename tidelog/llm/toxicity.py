"""Toxicity by non-negative positive-unlabelled learning.

A logistic classifier over word presence is trained in numpy from confirmed toxic texts and unlabelled ones. The risk is
corrected by the class prior: prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)]); where the second
term falls below zero, its gradient is reversed.

The training sample is bounded (documented parameters): about max_positives confirmed rows and max_unlabelled texts, chosen
by a hash of the identifier. The prior is the share of toxic rows among all labelled training rows. Every whole text is
scored. Null and empty texts score as texts without words. Without confirmed rows every score is 0. Rows with a null
identifier teach nothing. Repeated labels of an identifier: toxic if any says so. Extra columns stay; those named like the
result's own are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import is_held_out
from .shared import ddl, private, quoted, without
from .words import LETTERS, slices, words_of

BITS = 20


@dataclass
class Classifier:
    slot: np.ndarray  # by hashed word: place of its weight, -1 for none
    weights: np.ndarray
    bias: float


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashed words, offsets by text)."""
    w = words_of(column, LETTERS)
    return (w.hash >> np.uint64(64 - BITS)).astype(np.int32), w.first


def _present(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            ids, first = hashed_words(part.column("text"))
            rows = [np.unique(ids[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("kind"), pa.array([x.tobytes() for x in rows], pa.binary())], names=["kind", "words"])


def _csr(rows: list[np.ndarray], slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each entry, slot of each entry) of the words that have a slot."""
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    at = slot[np.concatenate(rows)] if rows else np.zeros(0, np.int64)
    return owner[at >= 0], at[at >= 0]


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, features: int = 4096, confidence: float = 3.0, steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> Classifier:
    """Trains from sets of hashed words. The features are words over-represented among the positives by more
    than `confidence` standard errors of their log ratio."""
    size = 1 << BITS
    slot = np.full(size, -1, np.int64)
    if not positive or not unlabelled:
        return Classifier(slot, np.zeros(0), -50.0)
    seen_p, seen_u = (np.bincount(np.concatenate(x), minlength=size) for x in (positive, unlabelled))
    lift = np.log((seen_p + 0.5) / (len(positive) + 1)) - np.log((seen_u + 0.5) / (len(unlabelled) + 1))
    sure = lift - confidence * np.sqrt(1 / (seen_p + 0.5) + 1 / (seen_u + 0.5))
    able = np.flatnonzero((seen_p >= 3) & (sure > 0))
    chosen = able[np.argsort(-lift[able], kind="stable")][:features]
    slot[chosen] = np.arange(len(chosen))
    n_p, n_u = len(positive), len(unlabelled)
    row_p, col_p = _csr(positive, slot)
    row_u, col_u = _csr(unlabelled, slot)
    weights, bias = np.zeros(len(chosen) + 1), np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    weights[-1] = bias
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, steps + 1):
        _, grad = risk_and_step(weights, (row_p, col_p, n_p), (row_u, col_u, n_u), prior)
        grad[:-1] += decay * weights[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        weights = weights - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Classifier(slot, weights[:-1], float(weights[-1]))


def risk_and_step(weights: np.ndarray, positive: tuple, unlabelled: tuple, prior: float) -> tuple[tuple[float, float], np.ndarray]:
    """((risk of positives as positive, risk of negatives), direction to step against) of logistic loss; texts are (row of each
    entry, feature of each entry, number of texts), the last weight is the bias. Where the risk of negatives is below zero,
    the step undoes it."""
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
    soft = lambda x: np.logaddexp(0, x)
    margin = lambda row, col, n: np.bincount(row, weights[col], n) + weights[-1]
    pull = lambda row, col, g: np.append(np.bincount(col, g[row], len(weights) - 1), g.sum())
    (row_p, col_p, n_p), (row_u, col_u, n_u) = positive, unlabelled
    g_p, g_u = margin(row_p, col_p, n_p), margin(row_u, col_u, n_u)
    negative = soft(g_u).mean() - prior * soft(g_p).mean()
    toward = pull(row_u, col_u, sigmoid(g_u) / n_u) - pull(row_p, col_p, prior * sigmoid(g_p) / n_p)
    step = -toward if negative < 0 else pull(row_p, col_p, -prior * sigmoid(-g_p) / n_p) + toward
    return (prior * soft(-g_p).mean(), negative), step


def score_batch(model: Classifier, column: pa.Array) -> np.ndarray:
    ids, first = hashed_words(column)
    at = model.slot[ids]
    hit = np.flatnonzero(at >= 0)
    owner = np.searchsorted(first, hit, "right") - 1
    pairs = np.unique(owner * np.int64(1 << 32) + at[hit])  # a word counts once for a text
    total = np.bincount(pairs >> 32, model.weights[pairs & 0xFFFFFFFF], len(first) - 1) if len(pairs) else np.zeros(len(first) - 1)
    return 1 / (1 + np.exp(-np.clip(total + model.bias, -50, 50)))


def train(docs: DataFrame, labels: DataFrame, max_positives: int = 5_000, max_unlabelled: int = 10_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Classifier:
    spark = docs.sparkSession
    able = ~is_held_out(id_col, 4, 2) & F.col(id_col).isNotNull()
    known = labels.where(able & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("labelled_id")).agg(F.max(label_col).alias("is_toxic"))
    counts = known.agg(F.sum(F.when(F.col("is_toxic") == 1, 1).otherwise(0)), F.count(F.lit(1))).first()
    texts = docs.where(able).select(F.col(id_col).alias("text_id"), F.coalesce(F.lower(F.col(text_col)), F.lit("")).alias("text"))
    n_text = docs.where(able).select(F.lit(1)).count()
    if not counts[1] or not counts[0] or not n_text:
        return fit([], [], 0.0)
    drawn = F.pmod(F.xxhash64(F.col("text_id").cast("string")), F.lit(1 << 24))
    take = lambda most, n: min(1 << 24, int((1 << 24) * most / n))
    chosen = known.where(F.col("is_toxic") == 1).withColumnRenamed("labelled_id", "text_id").where(drawn < take(max_positives, counts[0])).select("text_id")
    ids = [r[0] for r in chosen.collect()]  # about max_positives at most
    positives = texts.where(F.col("text_id").isin(ids)).select(F.lit(1).alias("kind"), "text")
    unlabelled = texts.where(drawn < take(max_unlabelled, n_text)).select(F.lit(0).alias("kind"), "text")
    got = positives.union(unlabelled).mapInArrow(_present, "kind int, words binary").toArrow()
    kinds, rows = got.column("kind").to_pylist(), [np.frombuffer(x, np.int32) for x in got.column("words").to_pylist()]
    return fit([x for k, x in zip(kinds, rows, strict=True) if k == 1], [x for k, x in zip(kinds, rows, strict=True) if k == 0], counts[0] / counts[1])


def score(docs: DataFrame, model: Classifier, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with score and predicted."""
    own = ["score", "predicted"]
    names = without(docs.columns, own, [text_col])
    (low,) = private(names, "lowered")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch, low):
                p = score_batch(sent.value, part.column(low))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*names, *own])

    return docs.select(*map(quoted, names), F.coalesce(F.lower(quoted(text_col)), F.lit("")).alias(low)).mapInArrow(run, ddl(docs.schema, names) + ", score double, predicted int")
