"""N-gram Jaccard join by prefixes under several global orders.

A text's set is that of its word shingles. Two sets of similarity t or more share a token among their prefixes (the first
n - ceil(t n) + 1 tokens) under every global order. The first order is by frequency class, then hash: tokens that many texts
hold come last, so lists of texts by prefix token stay short. Frequencies come from a count sketch over all texts. Two more
orders are by hash. Candidates meet under the first order; before sets are compared, they must pass the sizes, a bitmap
bound on the symmetric difference, and share prefix tokens under the other orders too.

Classes without all pairs: equal sequences are one representative. Of each list only pairs with one member, its
leader, are compared at first and their components found; then, for each two components that a list holds, the pair of
nearest bitmaps; then all pairs of a list that still lie in different components. A pair left out lies in one
component already, so components are exact. A list of more than LIST texts is dealt into pairs of blocks, a task's work each.

Lower-cases A-Z; words are runs of bytes other than space and \\t \\n \\v \\f \\r. Texts without words (null, empty) have size
0 and stand alone. Texts are compared by 64-bit hashes of shingles. Rows that share an identifier are rows of their own and
get the same class only if their texts link; rows without one don't lend a class their identifier. A class of rows without
identifiers has none. Extra columns are ignored. An empty table gives no row.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import ddl, lean, private, quoted, shuffle_partitions, written
from .words import _mix, range_hashes, shingles_of, slices, words_of

SIZE = 5
POSTING = np.dtype([("h", "<u8"), ("g", "<i8"), ("n", "<i4")])
MEMBER = np.dtype([("g", "<i8"), ("n", "<i4")])
MAP_WORDS = 16
#: Postings that a task packs at once; bounds a worker's memory.
POSTINGS = 1 << 19
#: Set members that stand for one bucket of lists, about a quarter of which are posted.
BUCKET = 1 << 22
#: Texts of a list that meet in one task.
LIST = 4096
SKETCH_BLOCK = 1 << 16
_U = np.uint64
_maps = [f"m{i}" for i in range(MAP_WORDS)]


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def signatures(w) -> np.ndarray:
    """A hash of each text's word sequence."""
    return range_hashes(w.hash, w.first[:-1], w.first[1:]).astype(np.int64)


def sketch_width(n_docs: int) -> int:
    """Counters of the sketch: by the number of texts, 2^24 at most (one byte each once merged)."""
    return min(1 << 24, max(1 << 18, 1 << int(np.ceil(np.log2(64 * max(1, n_docs))))))


def _profile(width: int):
    """A row for each text: size, signature and bitmap; and this task's part of the sketch (block >= 0)."""

    def run(batches):
        counts, seen = np.zeros(width, np.uint32), set()
        for batch in batches:
            for part in slices(batch, "text"):
                w = words_of(part.column("text"))
                sig, sets = signatures(w), shingles_of(w, SIZE)
                maps = np.zeros((len(sets), MAP_WORDS), np.int64)
                for i, s in enumerate(sets):
                    bits = np.bincount((s & _U(64 * MAP_WORDS - 1)).astype(np.int64), minlength=64 * MAP_WORDS) & 1
                    maps[i] = np.packbits(bits.astype(np.uint8)).view(np.int64)
                    if len(s) and int(sig[i]) not in seen:
                        seen.add(int(sig[i]))
                        np.add.at(counts, (s >> _U(20)).astype(np.int64) & (width - 1), 1)
                sizes = np.array([len(s) for s in sets], np.int32)
                n = len(sets)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(sig), pa.array(sizes), *(pa.array(maps[:, k]) for k in range(MAP_WORDS)), pa.array(np.full(n, -1, np.int32)), pa.nulls(n, pa.binary())], names=["doc_id", "key", "sig", "n", *_maps, "block", "blob"])
        blocks = [(k, counts[k * SKETCH_BLOCK : (k + 1) * SKETCH_BLOCK]) for k in range(width // SKETCH_BLOCK)]
        blocks = [(k, zlib.compress(np.minimum(b, 65535).astype("<u2").tobytes(), 1)) for k, b in blocks if b.any()]
        if blocks:
            none = [pa.nulls(len(blocks), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * MAP_WORDS)]
            yield pa.RecordBatch.from_arrays([*none, pa.array([k for k, _ in blocks], pa.int32()), pa.array([b for _, b in blocks], pa.binary())], names=["doc_id", "key", "sig", "n", *_maps, "block", "blob"])

    return run


def _merge_sketch(table: pa.Table) -> pa.Table:
    total = np.zeros(SKETCH_BLOCK, np.int64)
    for x in table.column("blob"):
        total += np.frombuffer(zlib.decompress(x.as_py()), "<u2")
    level = np.floor(np.log2(total + 1)).astype(np.uint8)
    return pa.table({"block": table.column("block").slice(0, 1), "level": pa.array([zlib.compress(level.tobytes(), 1)], pa.binary())})


def prefix(s: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """The first tokens under the first order: by level, then hash."""
    k = len(s) - least_overlap(len(s), percent) + 1
    level = levels[(s >> _U(20)).astype(np.int64) & (len(levels) - 1)].astype(_U)
    order = np.argpartition((level << _U(58)) | (s >> _U(6)), min(k, len(s)) - 1)[:k] if k < len(s) else np.arange(len(s))
    return s[order]


def hash_prefix(s: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The first tokens under a further order, sorted."""
    key = np.sort(_mix(s ^ _U(0x9E3779B97F4A7C15 * (2 * order + 1) % (1 << 64))))
    return key[: len(s) - least_overlap(len(s), percent) + 1]


def _post(sent, buckets: int, percent: int):
    """(bucket, packed postings) of the prefix tokens; a sequence is posted once by a task."""

    def run(batches):
        levels, seen, held, size = sent.value, set(), [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                w = words_of(part.column("text"))
                for g, s in zip(signatures(w).tolist(), shingles_of(w, SIZE), strict=True):
                    if len(s) and g not in seen:
                        seen.add(g)
                        h = prefix(s, levels, percent)
                        row = np.empty(len(h), POSTING)
                        row["h"], row["g"], row["n"] = h, g, len(s)
                        held.append(row)
                        size += len(h)
                if size > POSTINGS:
                    yield from _packed(np.concatenate(held), buckets)
                    held, size = [], 0
        if held:
            yield from _packed(np.concatenate(held), buckets)

    return run


def _packed(rows: np.ndarray, buckets: int):
    bucket = (_mix(rows["h"]) % _U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    yield pa.RecordBatch.from_pydict({"bucket": bucket[at], "blob": pa.array([rows[a:b].tobytes() for a, b in zip(at, [*at[1:], len(rows)], strict=True)], pa.binary())})


def _lists(percent: int):
    """Lists of representatives that share a prefix token, cut where sizes are too far apart; each list once. A list's
    leader is the member that the bucket's lists hold most often: near copies of one text have most in common with it."""

    def run(table: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(x.as_py(), POSTING) for x in table.column("blob")])
        order = np.argsort(rows["h"], kind="stable")
        same = rows["h"][order]
        twice = np.zeros(len(rows), bool)
        if len(rows) > 1:
            eq = same[1:] == same[:-1]
            twice[1:] |= eq
            twice[:-1] |= eq
        rows = rows[order[twice]]
        rows = rows[np.lexsort((rows["g"], rows["n"], rows["h"]))]
        if len(rows):
            new = np.concatenate([[True], (rows["h"][1:] != rows["h"][:-1]) | (rows["g"][1:] != rows["g"][:-1])])
            rows = rows[new]  # copies posted by several tasks
            cut = np.concatenate([[True], (rows["h"][1:] != rows["h"][:-1]) | (100 * rows["n"][:-1].astype(np.int64) < percent * rows["n"][1:].astype(np.int64))])
            start = np.flatnonzero(cut)
            end = np.append(start[1:], len(rows))
            many = end - start > 1
            start, end = start[many], end[many]
            key = range_hashes(_mix(rows["g"].astype(_U)), start, end)
            _, at = np.unique(key, return_index=True)
            known, place, often = np.unique(rows["g"], return_inverse=True, return_counts=True)
            often = often[place]
            leaders = [int(rows["g"][start[i] + often[start[i] : end[i]].argmax()]) for i in at]
            members = np.empty(len(rows), MEMBER)
            members["g"], members["n"] = rows["g"], rows["n"]
            blobs = [members[start[i] : end[i]].tobytes() for i in at]
            return pa.table({"list": pa.array(key[at].astype(np.int64)), "m": pa.array((end - start)[at].astype(np.int32)), "leader": pa.array(leaders, pa.int64()), "members": pa.array(blobs, pa.binary())})
        return pa.table({"list": pa.array([], pa.int64()), "m": pa.array([], pa.int32()), "leader": pa.array([], pa.int64()), "members": pa.array([], pa.binary())})

    return run


def _stars(percent: int):
    def run(batches):
        for batch in batches:
            out = []
            for x, leader in zip(batch.column("members").to_pylist(), batch.column("leader").to_pylist(), strict=True):
                m = np.frombuffer(x, MEMBER)
                own = m["g"] == leader
                n, rest = int(m["n"][own][0]), m[~own]
                rest = rest["g"][100 * np.minimum(rest["n"], n).astype(np.int64) >= percent * np.maximum(rest["n"], n).astype(np.int64)]
                out.append(np.stack([np.minimum(rest, leader), np.maximum(rest, leader)], 1))
            if out:
                pairs = np.unique(np.concatenate(out), axis=0)
                yield pa.RecordBatch.from_pydict({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def _members(batches):
    for batch in batches:
        rows = [np.frombuffer(x, MEMBER) for x in batch.column("members").to_pylist()]
        if rows:
            names = np.repeat(batch.column("list").to_numpy(), [len(x) for x in rows])
            leaders = np.repeat(batch.column("leader").to_numpy(), [len(x) for x in rows])
            flat = np.concatenate(rows)
            yield pa.RecordBatch.from_pydict({"list": names, "g": np.ascontiguousarray(flat["g"]), "n": np.ascontiguousarray(flat["n"]), "lead": flat["g"] == leaders})


def _nearest(found: np.ndarray) -> np.ndarray:
    """Of the rows (component, other component, distance, text, text), that of the least distance for each two components."""
    found = found[np.lexsort((found[:, 4], found[:, 3], found[:, 2], found[:, 1], found[:, 0]))]
    return found[np.concatenate([[True], (np.diff(found[:, :2], axis=0) != 0).any(1)])]


def _across(percent: int, best: bool):
    """Pairs of two blocks of a list (or of one) that lie in different components, haven't been compared with the leader, and
    pass the bitmaps. With `best`, for each two components only the pair of the nearest bitmaps."""

    def run(table: pa.Table) -> pa.Table:
        g, n, c, lead, own = (table.column(x).to_numpy() for x in ("g", "n", "c", "lead", "own"))
        alone = own.min() == own.max() == table.column("low")[0].as_py() == table.column("high")[0].as_py()
        maps = np.stack([table.column(m).to_numpy() for m in _maps], 1).view(_U)  # of signed values numpy counts the bits of the absolute one
        order = np.argsort(n, kind="stable")
        g, n, c, lead, own, maps = g[order], n[order].astype(np.int64), c[order], lead[order], own[order], maps[order]
        out, size = [], 0
        top = np.searchsorted(percent * n, 100 * n, "right")  # sizes up to n * 100 / percent
        for i in np.flatnonzero(~lead):
            j = np.arange(i + 1, top[i])
            j = j[(c[j] != c[i]) & ~lead[j] & (alone | (own[j] != own[i]))]
            if not len(j):
                continue
            apart, total = np.bitwise_count(maps[j] ^ maps[i]).sum(1, dtype=np.int64), n[j] + n[i]
            ok = (100 + percent) * (total - apart) >= 2 * percent * total
            j, apart = j[ok], apart[ok]
            if len(j):
                pair = [np.minimum(g[i], g[j]), np.maximum(g[i], g[j])]
                out.append(np.stack([np.minimum(c[i], c[j]), np.maximum(c[i], c[j]), apart, *pair] if best else pair, 1))
                size += len(j)
            if best and size > 1 << 18:
                out = [_nearest(np.concatenate(out))]
                size = 0
        if not out:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        found = np.concatenate(out)
        pairs = _nearest(found)[:, 3:] if best else found
        return pa.table({"a": np.ascontiguousarray(pairs[:, 0]), "b": np.ascontiguousarray(pairs[:, 1])})

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text_a", 1 << 18):
                sets = [shingles_of(words_of(part.column(c)), SIZE) for c in ("text_a", "text_b")]
                good = [linked(x, y, percent) for x, y in zip(*sets, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets are similar: the further orders' prefixes first, then the whole sets."""
    for order in (1, 2):
        if not len(np.intersect1d(hash_prefix(x, order, percent), hash_prefix(y, order, percent), assume_unique=True)):
            return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


class Join:
    def __init__(self, docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text"):
        self.spark, self.percent = docs.sparkSession, percent
        text = F.coalesce(quoted(text_col), F.lit(""))
        self.docs = docs.select(quoted(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))
        width = sketch_width(self.docs.select(F.lit(1)).count())
        kinds = "doc_id long, key long, sig long, n int, " + ", ".join(f"{m} long" for m in _maps) + ", block int, blob binary"
        found = written(self.docs.mapInArrow(lean(_profile(width)), kinds), "profile")
        self.rows = found.where("block < 0").select("doc_id", "key", "sig", "n", *_maps)
        merged = found.where("block >= 0").select("block", "blob").groupBy("block").applyInArrow(_merge_sketch, "block int, level binary")
        levels = np.zeros(width, np.uint8)
        for k, x in merged.collect():  # `width` bytes at most
            levels[k * SKETCH_BLOCK : (k + 1) * SKETCH_BLOCK] = np.frombuffer(zlib.decompress(x), np.uint8)
        self.levels = self.spark.sparkContext.broadcast(levels)
        self.reps = written(self.rows.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "key")).alias("of"), F.first("n").alias("n"), *(F.first(m).alias(m) for m in _maps)), "reps")

    def lists(self) -> DataFrame:
        size = self.rows.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
        buckets = max(4 * shuffle_partitions(self.spark), size // BUCKET)
        posted = self.docs.mapInArrow(lean(_post(self.levels, buckets, self.percent)), "bucket long, blob binary")
        lists = posted.groupBy("bucket").applyInArrow(_lists(self.percent), "list long, m int, leader long, members binary")
        return written(lists.dropDuplicates(["list"]), "lists")

    def plausible(self, pairs: DataFrame) -> DataFrame:
        """Pairs that the bitmaps don't rule out. The Hamming distance of parity bitmaps is at most the size of the sets'
        symmetric difference."""
        side = lambda x: self.reps.select(F.col("sig").alias(x), F.col("n").alias(f"n_{x}"), *(F.col(m).alias(f"{m}_{x}") for m in _maps))
        apart = sum((F.bit_count(F.col(f"{m}_a").bitwiseXOR(F.col(f"{m}_b"))) for m in _maps), F.lit(0))
        total = F.col("n_a").cast("long") + F.col("n_b")
        joined = pairs.join(side("a"), "a").join(side("b"), "b")
        return joined.where((100 + self.percent) * (total - apart) >= 2 * self.percent * total).select("a", "b")

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """Links among pairs, a written table."""
        need = pairs.select(F.col("a").alias("need")).union(pairs.select("b")).distinct()
        of = written(need.join(self.reps, F.col("need") == F.col("sig")).select("sig", F.col("of.doc_id").alias("of_id"), F.col("of.key").alias("of_key")), f"{name}-need")

        def same(batches):  # several rows may share the identifier and the text's hash
            for batch in batches:
                for part in slices(batch, "text"):
                    keep = signatures(words_of(part.column("text"))) == part.column("sig").to_numpy()
                    yield part.filter(pa.array(keep, pa.bool_()))

        # tables that grow with the input are never broadcast, however small they are now
        texts = self.docs.join(of.hint("merge"), F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key"))).select("sig", "text").mapInArrow(lean(same), "sig long, text string")
        texts = written(texts.dropDuplicates(["sig"]), f"{name}-texts")
        side = lambda x: texts.select(F.col("sig").alias(x), F.col("text").alias(f"text_{x}"))
        both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")
        return written(both.mapInArrow(lean(_verify(self.percent)), "a long, b long"), f"{name}-links")

    def links(self) -> tuple[DataFrame, DataFrame]:
        """(links between representatives that join all classes, (node, component) over representatives)."""
        lists = self.lists()
        stars = written(self.plausible(lists.select("leader", "members").mapInArrow(_stars(self.percent), "a long, b long").distinct()), "star-pairs")
        links = self.verified(stars, "star")
        known = written(components(links), "components")
        members = written(lists.where("m > 2").select("list", "leader", "members").mapInArrow(_members, "list long, g long, n int, lead boolean"), "members")
        maps = self.reps.select(F.col("sig").alias("of_sig"), *_maps)
        tested = None
        # first the likeliest pair of two components of a list, then all that are still open
        for best in (True, False):
            marked = written(members.join(known, members["g"] == known["node"], "left").select("list", "g", "n", "lead", F.coalesce("component", "g").alias("c")), "marked")
            open_ = written(marked.groupBy("list").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("m")).where("low < high").select(F.col("list").alias("of"), "m"), "open")
            rest = marked.join(open_, marked["list"] == open_["of"]).join(maps, F.col("g") == F.col("of_sig")).select("list", "m", "g", "n", "lead", "c", *_maps)
            # a member of a long list goes to its own block with each block
            blocks = F.ceil(F.col("m") / LIST).cast("int")
            dealt = rest.withColumn("own", F.pmod(F.col("g"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            dealt = dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
            pairs = dealt.groupBy("list", "low", "high").applyInArrow(_across(self.percent, best), "a long, b long").distinct()
            pairs = written(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "rest-pairs")
            tested = pairs
            more = self.verified(pairs, "rest")
            if not more.isEmpty():
                links = links.union(more)
                known = written(components(links), "components")
        return links, known

    def labels(self) -> DataFrame:
        """(sig, least doc_id, component) over representatives."""
        _, known = self.links()
        return written(self.reps.join(known, self.reps["sig"] == known["node"], "left").select("sig", "doc_id", F.coalesce("component", "sig").alias("c")), "label")

    def classes(self) -> DataFrame:
        """(doc_id, n_shingles, component_id), a row for each row of the input."""
        label = self.labels()
        least = written(label.groupBy(F.col("c").alias("of")).agg(F.min("doc_id").alias("component_id")), "least-id")
        by_sig = written(label.join(least, label["c"] == least["of"]).select(F.col("sig").alias("of_sig"), "component_id"), "by-sig")
        rows = self.rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("sig")).alias("sig"))
        return rows.join(by_sig, rows["sig"] == by_sig["of_sig"], "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def classes(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return Join(docs, percent, id_col, text_col).classes()


def distinct(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class: that of the least identifier (rows without one last), then of the least word-sequence
    signature, then of the least columns. Rows are told apart by identifier and signature. Rows without words all stay."""
    join, names = Join(docs, percent, id_col, text_col), docs.columns
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sig")).alias("k")
    keep = written(join.labels().groupBy("c").agg(first).select(F.col("k.doc_id").alias("keep_id"), F.col("k.sig").alias("keep_sig")), "keep")
    many = written(join.rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("doc_id IS NULL OR rows > 1").select("doc_id"), "many")
    gone = join.rows.where("n > 0").join(keep, (F.col("doc_id") == F.col("keep_id")) & (F.col("sig") == F.col("keep_sig")), "left_anti").select("doc_id")
    out, sig, words, keep_id, keep_sig, row = private(names, "gone", "sig", "words", "keep_id", "keep_sig", "row")
    own = quoted(id_col).cast("long")
    once = docs.join(written(gone.union(many).distinct(), "gone").select(F.col("doc_id").alias(out)).hint("merge"), own.eqNullSafe(F.col(out)), "left_anti")
    if many.isEmpty():
        return once
    shared = docs.join(many.select(F.col("doc_id").alias(out)).hint("merge"), own.eqNullSafe(F.col(out)), "left_semi")

    def signed(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                w = words_of(part.column(text_col))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(signatures(w)), pa.array(np.diff(w.first) > 0)], names=[*names, sig, words])

    marked = written(shared.mapInArrow(lean(signed), ddl(docs.schema, names) + f", {sig} long, {words} boolean"), "shared")
    kept = keep.select(F.col("keep_id").alias(keep_id), F.col("keep_sig").alias(keep_sig))
    kept = marked.where(words).join(kept, own.eqNullSafe(F.col(keep_id)) & (F.col(sig) == F.col(keep_sig)))
    kept = kept.groupBy(keep_id, keep_sig).agg(F.min(F.struct(*map(quoted, names))).alias(row)).select(f"{row}.*")
    return once.union(kept).union(marked.where(~F.col(words)).select(*map(quoted, names)))
