"""Operators against plain Python models on small frames, and invariants of the sketches and trees."""

import hashlib
import random
import zlib
from collections import OrderedDict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidelog import config
from tidelog.functions import codecs, hashing
from tidelog.operators import compaction, dictionary, log, merkle, prefix_sum, runs, scan, simhash, sketches, stateful
from tidelog.sources import folders, states, wal, wal_files
from tidelog.sources.store import Store

SCHEMA = "key string, value string, tombstone boolean, ts timestamp_ntz, seq bigint"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, d, datetime(2024, 1, 1 + s % 28, 0, 0, s % 60), s) for k, v, d, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    return [(f"k{rng.randrange(20):02d}", f"v{i}", rng.random() < 0.2, i) for i in range(300)]


def model(rows):
    newest = {}
    for k, v, d, s in rows:
        at = (1 + s % 28, s % 60, s)
        if k not in newest or at > newest[k][0]:
            newest[k] = (at, v, d)
    return {k: v for k, (_, v, d) in newest.items() if not d}


def test_live_is_last_write_wins(spark, rows):
    assert {r["key"]: r["value"] for r in log.live(frame(spark, rows)).collect()} == model(rows)


def test_pages_make_the_scan_and_cursors_resume(spark, rows):
    df, want = frame(spark, rows), sorted(model(rows).items())
    got = [tuple(r) for p in range(1, 6) for r in scan.prefix_scan(df, "k", p, 5).collect()]
    assert got == want[:25]
    c, seen = scan.Cursor(df, low="k05", high="k12"), []
    while (x := c.next()) and len(seen) < 3:
        seen.append(x)
    inside = [x for x in want if "k05" <= x[0] <= "k12"]
    assert seen == inside[:3]
    c.stop()
    assert c.next() is None


def test_delete_hides_a_key(spark, rows):
    keys = spark.createDataFrame([(k,) for k in list(model(rows))[:2]], "key string")
    gone = log.delete(frame(spark, rows), keys, F.lit("2100-01-01").cast("timestamp_ntz"), F.lit(10**9))
    assert {r["key"] for r in log.live(gone).collect()} == set(model(rows)) - {r[0] for r in keys.collect()}


def test_hashes(spark):
    got = spark.createDataFrame([("key1",), ("a",), ("",)], "s string").select(hashing.fnv1a32(F.col("s")), hashing.md5_u64(F.col("s"), F.lit(1234)).cast("string"), F.crc32("s")).collect()
    assert got[0][0] == 927623783 and got[1][0] == 3826002220 and got[2][0] == 2166136261
    assert got[0][1] == "14902404010660480104" and got[1][2] == 3904355907


def test_fnv64_and_bits(spark):
    def fnv(x):
        h = 14695981039346656037
        for b in x.encode():
            h = (h ^ b) * 1099511628211 % 2**64
        return h

    words = ["", "a", "čaj", "longer text here"]
    got = spark.createDataFrame([(w,) for w in words], "s string").select(hashing.fnv1a64(F.col("s")).alias("h")).collect()
    assert [r["h"]["hi"] * 2**32 + r["h"]["lo"] for r in got] == [fnv(w) for w in words]
    zeros = spark.createDataFrame([(0,), (1,), (8,), (2**40,)], "x long").select(hashing.trailing_zeros(F.col("x"), 64)).collect()
    assert [r[0] for r in zeros] == [64, 0, 3, 40]


def test_varint_and_log_codec(spark):
    xs = [0, 1, 127, 128, 300, 16383, 16384, 2**40]
    x = F.col("x")
    got = spark.createDataFrame([(i,) for i in xs], "x long").select(codecs.varint_hex(x), codecs.varint_len(x), codecs.varint_value(codecs.varint_hex(x))).collect()

    def leb(n):
        out = b""
        while True:
            n, b = n >> 7, n & 127
            out += bytes([b | (128 if n else 0)])
            if not n:
                return out

    assert [(r[0].lower(), r[1], r[2]) for r in got] == [(leb(i).hex(), len(leb(i)), i) for i in xs]
    df = spark.createDataFrame([("k", "v", True, 5, 1), ("key2", None, False, 2**33, 2)], "key string, value string, tombstone boolean, ts long, seq long")
    records = wal.encode(df)
    raw = bytes(records.where("seq = 1").first()["record"])
    body = (5).to_bytes(8, "little") + b"\x01" + (1).to_bytes(8, "little") * 2 + b"kv"
    assert raw == zlib.crc32(bytes(4) + body).to_bytes(4, "little") + body
    assert [tuple(r) for r in wal.decode(records).orderBy("seq").collect()] == [("k", "v", True, 5, 1), ("key2", "", False, 2**33, 2)]
    damaged = records.withColumn("record", F.concat(F.col("record"), F.lit(b"x")))
    assert wal.decode(damaged).count() == 0


def test_running_sum_over_blocks(spark):
    df = spark.range(0, 1000, 3).withColumn("n", F.col("id") % 7)
    got = prefix_sum.running_sum(df, "id", F.col("n"), "before", block=16).orderBy("id").collect()
    total = 0
    for r in got:
        assert r["before"] == total
        total += r["n"]


def test_wal_recovery_skips_whole_records(spark, rows):
    df = frame(spark, rows)
    sizes = [29 + len(k) + len(v) for k, v, _, _ in rows]
    skip = sum(sizes[:50]) + 1
    assert wal.recover(df, skip).count() == len({k for k, *_ in rows[51:]})
    assert wal.truncate(df, 450, 200).where("removed").count() == 2


def test_compaction_keeps_the_view(spark, rows):
    flushed = runs.flush(runs.daily(frame(spark, rows)))
    want = model(rows)
    for config_ in (config.EngineConfig(), config.EngineConfig(compaction_condition="bytes")):
        done = compaction.size_tiered(flushed, config_)
        assert {r["key"]: r["value"] for r in log.live(done.select(*log.RECORD)).collect()} == want
    parts = compaction.leveled(flushed, config.EngineConfig())
    assert parts.groupBy("key").count().where("count > 1").isEmpty()
    assert compaction.size_tiered_plan([(1, i, 10) for i in range(5)], config.EngineConfig()) == {0: (2, 0), 1: (2, 0), 2: (2, 2), 3: (2, 2), 4: (1, 4)}


def test_bloom_never_misses_and_cms_never_undercounts(spark):
    keys = spark.range(200).select(F.concat(F.lit("x"), F.col("id") % 70).alias("key"))
    m, k = sketches.bloom_params(100, 0.01)
    assert sketches.bloom_contains(keys, sketches.bloom_bits(keys, m, k), m, k).where("not maybe").isEmpty()
    assert sketches.bloom_fnv_contains(keys, sketches.bloom_fnv_bits(keys, 500, 2), 500, 2).where("not maybe").isEmpty()
    k, m = sketches.cms_params(0.05, 0.01)
    assert (k, m) == (6, 55) and sketches.bloom_params(10, 0.001) == (144, 10) and sketches.cms_params(0.001, 0.001) == (8, 2719)
    estimates = sketches.cms_frequency(keys, sketches.cms_build(keys, m, k), m, k).collect()
    assert all(r["estimate"] >= (3 if int(r["key"][1:]) < 60 else 2) for r in estimates)
    count = spark.range(20_000).select(F.col("id").cast("string").alias("key"))
    assert abs(sketches.hll_estimate(sketches.hll_registers(count, 8), 8).first()[0] / 20_000 - 1) < 0.25


def test_simhash(spark):
    assert len(simhash.STOP_WORDS) == len(set(simhash.STOP_WORDS))
    docs = spark.createDataFrame([(1, "Ada Lovelace wrote"), (2, "Bea Lovelace wrote"), (3, "something else entirely"), (4, None)], "doc_id long, text string")

    def one(text):
        total = [0] * 256
        for w in (text or "").split(" "):
            if w not in simhash.STOP_WORDS:
                bits = "".join(f"{ord(c):08b}" for c in hashlib.md5(w.encode()).hexdigest())
                total = [t + (1 if b == "1" else -1) for t, b in zip(total, bits, strict=True)]
        return "".join("1" if t > 0 else "0" for t in total)

    got = {r[0]: r[1] for r in simhash.fingerprint(docs, "doc_id").collect()}
    assert got == {r[0]: one(r[1]) for r in docs.collect()}
    far = simhash.nearest(docs.where("doc_id = 1"), docs.where("doc_id > 1").select(F.col("doc_id").alias("item"), "text"), "doc_id", "item").first()
    assert far["item"] == 2


@pytest.mark.parametrize("n", [1, 2, 3, 5, 255, 256, 257, 600])
def test_merkle_root(spark, n):
    level = [hashlib.sha1(f"k{i:05d}v{i}".encode()).digest() for i in range(n)]
    while len(level) > 1:
        level = [hashlib.sha1(level[i] + level[min(i + 1, len(level) - 1)]).digest() for i in range(0, len(level), 2)]
    df = spark.createDataFrame([(f"k{i:05d}", f"v{i}", 1) for i in range(n)], "key string, value string, run_id int")
    assert merkle.roots(df).first()["root"] == level[0].hex()


def test_dictionary(spark):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(["k1", "k2", "k3", "k1", "k2"])], "i long, key string")
    assert [r["code"] for r in dictionary.encode(df, "key", "i").orderBy("i").collect()] == [0, 1, 2, 0, 1]


def test_lru_against_model(spark):
    rng = random.Random(3)
    keys, cache, want = [chr(97 + rng.randrange(26)) for _ in range(200)], OrderedDict(), []
    for k in keys:
        want.append(k in cache)
        cache[k] = 1
        cache.move_to_end(k)
        if len(cache) > 10:
            cache.popitem(last=False)
    df = spark.createDataFrame([(1, k, i, False) for i, k in enumerate(keys)], "cache int, key string, seq int, dead boolean")
    assert [r["hit"] for r in stateful.lru_trace(df, "cache", "key", "seq", 10, "dead").orderBy("seq").collect()] == want


def test_token_bucket_and_ring():
    last, tokens, out = None, 5, []
    for s in [0, 0, 0, 0, 0, 0, 1, 2, 2]:
        ok, last, tokens = stateful.allow(s, last, tokens, 1, 5)
        out.append(ok)
    assert out == [True] * 5 + [False, False, True, True]
    assert stateful.ring_flushes(list("abcdef"), 2, 2) == [(0, 3, 2), (1, 5, 2)]


def test_ordered_sums_over_ranges(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), f"k{i:05d}", rng.randrange(9)) for i in range(2000)] + [(None, "x", 4)]
    rng.shuffle(rows)
    got = prefix_sum.ordered_sums(spark.createDataFrame(rows, "g string, k string, n int"), ["g"], "k", before=F.col("n"), at=F.lit(1)).collect()
    want = {}
    for g, k, n in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        want.setdefault(g, []).append((k, n))
    assert len(got) == len(rows)
    for r in got:
        own = want[r["g"]]
        assert own[r["at"]] == (r["k"], r["n"]) and r["before"] == sum(n for _, n in own[: r["at"]])
    assert prefix_sum.ordered_sums(spark.createDataFrame([], "k string, n int"), [], "k", before=F.col("n")).count() == 0


def test_lookup_chain_checks_values(spark, rows):
    flushed = runs.flush(runs.daily(frame(spark, rows)))
    check = F.crc32(F.encode("value", "UTF-8"))
    bad = flushed.withColumn("crc", F.when(F.col("key") == "k03", check + 1).otherwise(check))
    probes = spark.createDataFrame([(f"k{i:02d}",) for i in range(40)] + [(None,)], "key string")
    got = {(r["run_id"], r["key"]): r["value"] for r in runs.lookup_chain(bad, probes, 200, 3).collect()}
    assert got == {(r["run_id"], r["key"]): r["value"] for r in flushed.collect() if not r["tombstone"] and r["key"] != "k03"}


def test_arrival_pushes_down(spark):
    made = lambda a, b, tag, s: frame(spark, [(f"k{i:03d}", f"{tag}{i}" * 5, False, s + i) for i in range(a, b)])
    c = config.EngineConfig(leveled_base_bytes=1500, leveled_run_bytes=300, max_levels=3)
    levels = compaction.leveled(made(0, 100, "old", 0).withColumn("run_id", F.lit(1)).withColumn("level", F.lit(1)), c)
    after = compaction.pushed_down(levels, made(50, 90, "new", 500), c).cache()
    sizes = {r["level"]: r["b"] for r in after.groupBy("level").agg(F.sum(F.lit(25) + F.octet_length("key") + F.octet_length("value")).alias("b")).collect()}
    assert sizes[1] <= 1500 + 300 and sizes[2] <= 3000 + 300
    assert after.groupBy("level", "key").count().where("count > 1").isEmpty()
    first = {}
    for r in after.orderBy("level").collect():
        first.setdefault(r["key"], r["value"])
    assert first == {f"k{i:03d}": (f"new{i}" if 50 <= i < 90 else f"old{i}") * 5 for i in range(100)}
    kept = compaction.pushed_down(after, made(0, 0, "none", 0), c)
    assert kept.count() == after.count()


def test_nearest_in_blocks(spark):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice(["ada", "bea", "cal", "dot", "eve", "fay"]) for _ in range(6))
    docs = spark.createDataFrame([(i, text()) for i in range(30)] + [(50, None)], "doc_id long, text string")
    items = spark.createDataFrame([(i, text()) for i in range(25)] + [(None, "x")], "item long, text string")
    whole = simhash.nearest(docs, items, "doc_id", "item").orderBy("doc_id").collect()
    assert simhash.nearest(docs, items, "doc_id", "item", block=4).orderBy("doc_id").collect() == whole and len(whole) == 31
    prints = {r[0]: r[1] for r in simhash.fingerprint(items, "item").collect()}
    own = {r[0]: r[1] for r in simhash.fingerprint(docs, "doc_id").collect()}
    for r in whole:
        apart = lambda i, d=r["doc_id"]: sum(a != b for a, b in zip(own[d], prints[i], strict=True))
        assert (r["distance"], r["item"]) == min((apart(i), i) for i in range(25))
    assert simhash.nearest(docs, items.limit(0), "doc_id", "item").count() == 0


def test_states_keep_their_kind(spark, tmp_path):
    path, cells = f"file://{tmp_path}/state", spark.createDataFrame([(0, 3, 7)], "row int, bucket long, cnt long")
    states.save(cells, path, "frequencies", m=10, k=1)
    assert states.load(spark, path, "frequencies", k=1, m=10).collect() == cells.collect()
    for kind, parameters in (("frequencies", {"m": 11, "k": 1}), ("registers", {"m": 10, "k": 1})):
        with pytest.raises(ValueError):
            states.load(spark, path, kind, **parameters)


def test_log_on_files(spark, tmp_path, rows):
    log_ = wal.seconds(frame(spark, rows))
    files = wal_files.LogFiles(spark, f"file://{tmp_path}/log", config.EngineConfig(wal_segment_records=40, wal_segment_bytes=600))
    assert files.segments() == [] and files.recover().count() == 0
    files.append(log_.where("seq < 100"))
    first = files.segments()
    again = wal_files.LogFiles(spark, files.root, files.config)
    again.append(log_.where("seq >= 100"))
    assert first == list(range(1, len(first) + 1)) and again.segments()[: len(first)] == first
    sizes = [29 + len(k) + len(v) for k, v, _, _ in rows]
    assert again.end() == sum(sizes)
    listed = wal_files.listing(again.rows()).orderBy("segment").collect()
    assert sum(r["n_records"] for r in listed) == 300 and all(r["n_records"] <= 40 and r["bytes"] <= 600 + 40 for r in listed)
    skip = sum(sizes[:130]) + 5  # ends within a record
    gone = again.truncate(skip)
    assert gone and again.segments()[0] == gone[-1] + 1
    assert {r["seq"] for r in again.replay().collect()} == set(range(131, 300))
    want = {k: s for k, _, _, s in sorted(rows[131:], key=lambda r: (1 + r[3] % 28, r[3] % 60, r[3]))}
    assert {r["key"]: r["seq"] for r in again.recover().collect()} == want
    assert len(again.keep_newest()) == len(listed) - len(gone) - 2 and len(again.segments()) == 2


def test_shared_folder_is_asked_for(spark):
    assert folders.shared_dir(spark).startswith("file:")


def test_one_of_two_writers_wins(spark, tmp_path, rows):
    a, b = (Store(spark, f"file://{tmp_path}/s") for _ in range(2))
    a.flush(frame(spark, rows[:50]))
    seen = b._last()
    a.flush(frame(spark, rows[50:100]))
    with pytest.raises(RuntimeError):
        b._swap([tuple(r) for r in b.manifest()], seen)
    assert len(a.manifest()) == 2
    (tmp_path / "s" / "manifest" / "3").write_text("tables/half")  # a writer that ended before its version was whole
    assert len(b.manifest()) == 2
    (tmp_path / "s" / "manifest" / "3").unlink()
    before = b.log()
    a.compact()
    assert before.count() and {r["key"] for r in log.live(before).collect()} == set(model(rows[:100]))  # old readers keep their runs
    assert a.expire(1) and {r["key"] for r in log.live(a.log()).collect()} == set(model(rows[:100]))


def test_store(spark, tmp_path, rows):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.get("k01") is None
    for i in range(0, 300, 60):
        store.flush(frame(spark, rows[i : i + 60]))
    want = model(rows)
    assert {k: store.get(k) for k in list(want)[:3]} == {k: want[k] for k in list(want)[:3]}
    store.compact()
    assert [tuple(r) for r in store.range_scan("k00", "k99", 1, 100).collect()] == sorted(want.items())


def test_config(tmp_path):
    path = str(tmp_path / "c.json")
    assert config.load(path) == config.EngineConfig()
    (tmp_path / "c.json").write_text('{"memtable_size": -1, "hll_precision": 99, "max_levels": 6, "other": 1}')
    got = config.load(path)
    assert (got.memtable_size, got.hll_precision, got.max_levels) == (10, 8, 6)
    config.save(got, path)
    assert config.load(path) == got
