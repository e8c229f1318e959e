"""Best-fit packing of token sequences by a configuration linear program.

A configuration is a multiset of lengths that fits a sequence. The linear program over the histogram of lengths (how often
to use each configuration so that every length is covered as often as it occurs) is solved by multiplicative weights. Prices
of lengths start in proportion to the lengths. In a round a knapsack dynamic program finds the configuration worth most, and
through the same table the best that holds each given length; each is used for a share of what its scarcest length still
needs, and the prices of what it covers fall by a factor for the share covered. Prices are used for the whole round. By
duality every round's prices give a lower bound on the number of sequences: what all pieces are worth, by what one
configuration is worth at most. The mix is rounded to whole configurations, the fullest first, and what is left is packed
best-fit by falling length. Only the histogram (one count for each possible length) and the plan (bounded by configurations,
not by documents) reach the driver.

Documents of up to `capacity` ids are never cut; longer ones are cut from the end into full pieces, the first may be shorter.
Places are dealt by each piece's rank among those of its length, counted by partition and summed, so no length's pieces meet
in one task. Null texts are one end id. Rows sharing an identifier are packed each, those without one too. Extra columns are
ignored. An empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import trimmed, written
from .tokens import encoder
from .words import slices

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, local long"


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    first = n % capacity or capacity
    return [(0, min(n, first))] + [(s, capacity) for s in range(first, n, capacity)]


def tokenized(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents, a written table; part and local number the pieces of a length within a partition."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        from pyspark import TaskContext

        e, number, seen = encoder(tokenizer), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                ids, offsets = e.encode(part.column("text"))
                raw, out = memoryview(ids.astype("<u4").tobytes()), []
                for doc_id, a, b in zip(part.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    for k, (start, length) in enumerate(pieces_of(b - a, capacity)):
                        out.append((doc_id, k, start, length, zlib.crc32(raw[4 * (a + start) : 4 * (a + start + length)]), number, seen[length]))
                        seen[length] += 1
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return written(rows.mapInArrow(trimmed(run), PIECES), "pieces")


def price_table(price: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(worth, last): by room, the most that lengths in it are worth, and one of these lengths; 0 where the room's last id
    stays free. Unbounded knapsack by dynamic programming."""
    worth, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        n = fits[c]
        if n:
            value = worth[c - lengths[:n]] + price[:n]
            k = int(value.argmax())
            worth[c], last[c] = value[k], lengths[k]
        if worth[c - 1] >= worth[c]:
            worth[c], last[c] = worth[c - 1], 0
    return worth, last


def traced(last: list[int], room: int) -> Counter:
    """The configuration that a table holds for a room."""
    out: Counter = Counter()
    while room > 0:
        x = last[room]
        if x:
            out[x] += 1
        room -= x or 1
    return out


def best_configuration(price: np.ndarray, lengths: np.ndarray, capacity: int) -> dict[int, int]:
    return dict(traced(price_table(price, lengths, capacity)[1].tolist(), capacity))


def lower_bound(lengths: np.ndarray, need: np.ndarray, capacity: int) -> float:
    """The best lower bound by dual feasible functions: prices at which no configuration is worth more than 1."""
    best = float(need @ lengths) / capacity
    for k in range(1, 50):  # whole multiples of 1/(k+1), rounded down to multiples of 1/k
        parts, over = np.divmod((k + 1) * lengths, capacity)
        best = max(best, float(need @ np.where(over == 0, lengths / capacity, parts / k)))
    for small in lengths[2 * lengths <= capacity].tolist():  # below `small` nothing, above its rest a whole sequence
        best = max(best, float(need @ np.where(lengths > capacity - small, 1.0, np.where(lengths < small, 0.0, lengths / capacity))))
    return best


def relaxed(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = 40, share: float = 0.5, step: float = 0.1) -> tuple[list[tuple[dict[int, int], float]], float]:
    """(configurations and how often each is used, lower bound of any packing's sequences). No length is covered more often
    than it occurs; what `rounds` rounds leave uncovered is for the caller."""
    lengths = np.array(sorted(histogram))
    need = np.array([histogram[int(x)] for x in lengths], float)
    price, left = lengths / capacity, need.copy()
    place = {x: k for k, x in enumerate(lengths.tolist())}
    mix, bound = [], lower_bound(lengths, need, capacity)
    for _ in range(rounds):
        bound = max(bound, float(need @ price / price_table(price, lengths, capacity)[0][capacity]))
        open_ = np.flatnonzero(left > 0)
        table = price_table(price[open_], lengths[open_], capacity)[1].tolist()
        for k in open_[::-1].tolist():
            if left[k] <= 0:
                continue
            column = traced(table, capacity - int(lengths[k]))
            column[int(lengths[k])] += 1
            at, each = [place[x] for x in column], np.array(list(column.values()))
            most = float((left[at] / each).min())
            if most <= 0:
                continue
            amount = most if most <= 1 else max(1.0, most * share)
            mix.append((dict(column), amount))
            left[at] -= each * amount
            left[np.array(at)[left[at] < 1e-9]] = 0
            price[at] *= np.exp(-step * each * amount / need[at])
        price /= price.max()  # only their proportions count
        if not left.any():
            break
    return mix, bound


def solve(histogram: dict[int, int], capacity: int = CAPACITY, **options) -> tuple[list[tuple[dict[int, int], int]], float]:
    """(whole configurations and how often each is used, lower bound of the number of sequences). They hold every length as
    often as it occurs. Where best-fit alone needs fewer sequences than the rounded mix and its rest, its plan is taken."""
    alone = best_fit(Counter(histogram), capacity)
    left = Counter({k: int(v) for k, v in histogram.items() if v > 0})
    plan: list[tuple[dict[int, int], int]] = []
    if not left:
        return plan, 0.0
    mix, bound = relaxed(left, capacity, **options)
    total: Counter = Counter()
    for column, amount in mix:
        total[tuple(sorted(column.items(), reverse=True))] += amount
    for column, amount in sorted(total.items(), key=lambda x: (-sum(a * b for a, b in x[0]), -x[1], x[0])):
        times = min(int(np.ceil(amount - 1e-9)), min(left[x] // n for x, n in column))
        if times > 0:
            plan.append((dict(column), times))
            for x, n in column:
                left[x] -= times * n
    plan += best_fit(left, capacity)
    return min(plan, alone, key=lambda x: sum(times for _, times in x)), bound


def best_fit(left: Counter, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit by falling length: every piece goes where the least room is that holds it. Pieces of a length and sequences
    alike are dealt with together, so work doesn't grow with the counts."""
    rooms: dict[int, Counter] = {}  # room -> contents -> sequences
    open_ = 0  # a bit for each room that there is
    for x in sorted((x for x, n in left.items() if n > 0), reverse=True):
        n = left[x]
        while n:
            above = open_ >> x
            room = x + (above & -above).bit_length() - 1 if above else capacity
            if above:
                contents, alike = rooms[room].popitem()
            else:
                contents, alike = (), n
            each = min(room // x, n)  # one that took a piece is now the tightest
            taken = min(alike, n // each)
            if above:
                if taken < alike:
                    rooms[room][contents] += alike - taken
                if not rooms[room]:
                    open_ &= ~(1 << room)
            rest = room - each * x
            rooms.setdefault(rest, Counter())[(*contents, (x, each))] += taken
            open_ |= 1 << rest
            n -= each * taken
    return [(dict(contents), times) for found in rooms.values() for contents, times in found.items()]


def slots(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, copies in a sequence, first sequence, first offset): where the pieces of a length go."""
    rank: Counter = Counter()
    out, base = [], 0
    for column, times in plan:
        offset = 0
        for x, n in sorted(column.items(), reverse=True):
            out.append((x, rank[x], rank[x] + n * times, n, base, offset))
            rank[x] += n * times
            offset += n * x
        base += times
    return out


def _placed(sent):
    """(sequence_id, offset) of each piece, from its rank among those of its length."""

    def run(batches):
        low, copies, sequence, offset = sent.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(low, length * RANKS + rank, "right") - 1
            within = length * RANKS + rank - low[at]
            out = {"sequence_id": sequence[at] + within // copies[at], "offset": offset[at] + within % copies[at] * length}
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in PLACED), *map(pa.array, out.values())], names=[*PLACED, *out])

    return run


PLACED = ["doc_id", "piece", "start", "length", "ids_crc32"]
#: More than the pieces of one length.
RANKS = 1 << 50


def pack(docs: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    rows = tokenized(docs, capacity, **options)
    counts = written(rows.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    plan = sorted(slots(solve(histogram, capacity)[0]))
    length, low, _, *rest = (np.array(c, np.int64) for c in zip(*plan, strict=True)) if plan else [np.zeros(0, np.int64)] * 6
    sent = docs.sparkSession.sparkContext.broadcast((length * RANKS + low, *rest))  # bounded by the number of configurations
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("part").alias("of_part"), F.col("length").alias("of_length"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # a row for each length of each partition: grows with the input, so it is never broadcast
    placed = rows.join(written(bases, "bases").hint("merge"), (F.col("part") == F.col("of_part")) & (F.col("length") == F.col("of_length")))
    ranked = placed.select(*PLACED, (F.col("base") + F.col("local")).alias("rank"))
    return ranked.mapInArrow(trimmed(_placed(sent)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
