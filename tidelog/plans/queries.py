"""The registered queries of the core engine: each takes (spark, folder of tables) and returns a DataFrame over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import codecs, hashing
from ..operators import compaction, dictionary, log, merkle, runs, scan, simhash, sketches, stateful
from ..sources import states, wal, wal_files
from ..sources.folders import new_folder
from ..streaming import ingest

CONFIG = EngineConfig()
#: The events of a caller are days apart, so the queries' bucket refills after two days.
BUCKET_SECONDS, BUCKET_TOKENS = CONFIG.token_refresh_seconds * 86_400, CONFIG.token_number // 5


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _log(spark: SparkSession, d: str) -> DataFrame:
    return log.from_events(_t(spark, d, "events"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.flush(runs.daily(_log(spark, d)))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return scan.prefix_scan(_log(spark, d), "user", 1, 20)


def _keys(spark: SparkSession, d: str, table: str, column: str) -> DataFrame:
    return _t(spark, d, table).select(F.col(column).cast("string").alias("key"))


def kv_log(s, d):
    return _log(s, d)


def kv_latest(s, d):
    return log.latest(_log(s, d))


def kv_live(s, d):
    return log.live(_log(s, d))


def kv_get(s, d):
    return log.get(_log(s, d), "user000042")


def kv_multi_get(s, d):
    keys = _t(s, d, "supplier").select(F.concat(F.lit("user"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("key"))
    return log.multi_get(_log(s, d), keys)


def kv_delete(s, d):
    """Live view after deleting the key of every nation."""
    keys = _t(s, d, "nation").select(F.concat(F.lit("user"), F.lpad(F.col("n_nationkey").cast("string"), 6, "0")).alias("key"))
    now = F.to_timestamp_ntz(F.lit("2100-01-01 00:00:00"))
    return log.live(log.delete(_log(s, d), keys, now, F.lit(1 << 60)))


def prefix_scan(s, d):
    return scan.prefix_scan(_log(s, d), "user0000", 2, 20)


def range_scan(s, d):
    return scan.range_scan(_log(s, d), "user000010", "user000090", 1, 30)


def prefix_iterate(s, d):
    return scan.Cursor(_log(s, d), prefix="user0000", after="user000020").batch(10)


def range_iterate(s, d):
    return scan.Cursor(_log(s, d), low="user000030", high="user000120", after="user000055").batch(10)


def customer_range(s, d):
    return scan.range_scan(_t(s, d, "customer").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"), F.lit(False).alias("tombstone"), F.lit(0).alias("ts"), F.col("c_custkey").alias("seq")), "Customer#000000100", "Customer#000000900", 2, 25)


def flush_runs(s, d):
    return _runs(s, d)


def run_count(s, d):
    return runs.manifest(_runs(s, d)).select("run_id", "n_rows")


def run_listing(s, d):
    return runs.listing(_runs(s, d))


def run_manifest(s, d):
    return runs.manifest(_runs(s, d))


def level_bytes(s, d):
    return runs.level_bytes(_runs(s, d))


def sparse_index(s, d):
    return runs.sparse_index(_runs(s, d), CONFIG.block_records)


def sparse_summary(s, d):
    return runs.sparse_index(_runs(s, d), CONFIG.block_records * CONFIG.summary_blocks)


def stride_summary(s, d):
    return runs.stride_summary(_runs(s, d), 5)


def sample_summary(s, d):
    return runs.sample_summary(_runs(s, d))


def block_offsets(s, d):
    return runs.with_offsets(_runs(s, d)).select("run_id", "pos", "key", "size", "offset")


def zone_lookup(s, d):
    probes = runs.daily(_log(s, d)).select("run_id", "key").distinct()
    return runs.zone_lookup(_runs(s, d), probes)


def merge_two_runs(s, d):
    return compaction.merge(_runs(s, d).where("run_id in (20240101, 20240102)")).select("key", "value", "tombstone", "ts", "seq")


def size_tiered_trigger(s, d):
    return compaction.triggers(runs.level_bytes(_runs(s, d)), CONFIG)


def size_tiered_round(s, d):
    return compaction.one_round(_runs(s, d), 1).select("to_level", "pair", "key", "value", "tombstone", "ts", "seq")


def size_tiered_full(s, d):
    return compaction.size_tiered(_runs(s, d), CONFIG)


def compaction_purge(s, d):
    return compaction.purge(compaction.merge(_runs(s, d))).select("key", "value", "ts", "seq")


def run_split(s, d):
    return compaction.split(_runs(s, d), CONFIG.leveled_run_bytes, "run_id").select("run_id", "key", "part")


def leveled_compact(s, d):
    return compaction.leveled(_runs(s, d), CONFIG)


def wal_offsets(s, d):
    return wal.offsets(_log(s, d)).select("seq", "size", "start", "stop")


def wal_segments(s, d):
    return wal.segments(_log(s, d), CONFIG.wal_segment_bytes)


def wal_truncate(s, d):
    return wal.truncate(_log(s, d), 10_050, CONFIG.wal_segment_bytes)


def wal_low_water(s, d):
    return wal.low_water(_log(s, d), CONFIG.wal_segment_bytes, CONFIG.wal_low_water)


def wal_recover(s, d):
    return wal.recover(_log(s, d), 100_000)


def wal_crc(s, d):
    return wal.checksums(wal.seconds(_log(s, d)))


def wal_roundtrip(s, d):
    """Encodes the log as binary records and decodes them again."""
    return wal.decode(wal.encode(wal.seconds(_log(s, d))))


def bloom_params(s, d):
    got = [(n, p, *sketches.bloom_params(n, p)) for n, p in ((2, 0.001), (10, 0.001), (1000, 0.001), (1000, 0.01))]
    return s.createDataFrame(got, "n int, p double, m int, k int")


def bloom_bits(s, d):
    return sketches.bloom_bits(_log(s, d), *sketches.bloom_params(CONFIG.bloom_expected, CONFIG.bloom_fpp))


def bloom_contains(s, d):
    m, k = sketches.bloom_params(CONFIG.bloom_expected, CONFIG.bloom_fpp)
    probes = _t(s, d, "customer").select(F.concat(F.lit("user"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("key"))
    return sketches.bloom_contains(probes, sketches.bloom_bits(_log(s, d), m, k), m, k)


def bloom_fnv_contains(s, d):
    probes = _t(s, d, "customer").select(F.concat(F.lit("user"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("key"))
    return sketches.bloom_fnv_contains(probes, sketches.bloom_fnv_bits(_log(s, d), 1000, 2), 1000, 2)


def cms_params(s, d):
    got = [(e, x, *sketches.cms_params(e, x)) for e, x in ((0.05, 0.01), (0.001, 0.001), (0.01, 0.02))]
    return s.createDataFrame(got, "epsilon double, delta double, k int, m int")


def cms_build(s, d):
    k, m = sketches.cms_params(CONFIG.cms_epsilon, CONFIG.cms_delta)
    return sketches.cms_build(_keys(s, d, "orders", "o_custkey"), m, k)


def cms_frequency(s, d):
    k, m = sketches.cms_params(CONFIG.cms_epsilon, CONFIG.cms_delta)
    keys = _keys(s, d, "orders", "o_custkey")
    return sketches.cms_frequency(keys, sketches.cms_build(keys, m, k), m, k)


def hll_registers(s, d):
    return sketches.hll_registers(_keys(s, d, "orders", "o_orderkey"), CONFIG.hll_precision)


def hll_registers_64(s, d):
    return sketches.hll_registers(_keys(s, d, "orders", "o_orderkey"), CONFIG.hll_precision, wide=True)


def hll_estimate(s, d):
    return sketches.hll_estimate(hll_registers(s, d), CONFIG.hll_precision)


def approx_distinct_native(s, d):
    return _t(s, d, "lineitem").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("n_orders"), F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey")).alias("n_parts"))


def simhash_terms(s, d):
    return simhash.terms(_t(s, d, "documents").select("doc_id", "text"), "doc_id")


def simhash_fingerprint(s, d):
    return simhash.fingerprint(_t(s, d, "documents").select("doc_id", "text"), "doc_id")


def simhash_hamming(s, d):
    """The benchmark item nearest to every document."""
    return simhash.nearest(_t(s, d, "documents").select("doc_id", "text"), _t(s, d, "benchmark"), "doc_id", "item_id")


def merkle_leaves(s, d):
    return merkle.leaves(_runs(s, d))


def merkle_root(s, d):
    return merkle.roots(_runs(s, d))


def merkle_verify(s, d):
    """Roots of the flushed runs against runs whose first record is changed where the run's day is even."""
    flushed = _runs(s, d)
    changed = runs.numbered(flushed).withColumn("value", F.when((F.col("pos") == 0) & (F.col("run_id") % 2 == 0), F.concat("value", F.lit("x"))).otherwise(F.col("value"))).drop("pos")
    return merkle.verify(changed, merkle.roots(flushed))


def dict_encode(s, d):
    return dictionary.dictionary(_log(s, d), "key", "seq")


def dict_encode_parts(s, d):
    return dictionary.encode(_t(s, d, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey")


def varint(s, d):
    x = F.col("o_orderkey") * 1000
    return _t(s, d, "orders").select("o_orderkey", codecs.varint_len(x).alias("n_bytes"), F.lower(codecs.varint_hex(x)).alias("bytes"), codecs.varint_value(codecs.varint_hex(x)).alias("back"))


def lru_trace(s, d):
    accesses = _log(s, d).select(F.substring("key", -1, 1).alias("cache"), "key", "seq")
    return stateful.lru_trace(accesses, "cache", "key", "seq", 5)


def token_bucket(s, d):
    requests = wal.seconds(_log(s, d)).select("key", F.col("ts").alias("second"), "seq")
    return stateful.token_bucket(requests, "key", "second", "seq", BUCKET_SECONDS, BUCKET_TOKENS)


def flush_trace(s, d):
    rows = _log(s, d).select(F.substring("key", -1, 1).alias("store"), "key", "seq")
    return stateful.flush_trace(rows, "store", "key", "seq", 2, CONFIG.memtable_instances)


def bulk_load(s, d):
    return dictionary.bulk_load(s)


def bulk_dict_load(s, d):
    return dictionary.bulk_load_encoded(s)


def scalar_functions(s, d):
    key = F.col("c_name")
    h = hashing.fnv1a64(key)
    return _t(s, d, "customer").select("c_custkey", hashing.fnv1a32(key).alias("fnv32"), h["hi"].alias("fnv64_hi"), h["lo"].alias("fnv64_lo"), hashing.md5_u64(key, F.lit(1234)).cast("string").alias("md5_u64"), F.sha1(key).alias("sha1"), hashing.char_bits(F.substring(F.md5(key), 1, 4)).alias("bits"), hashing.trailing_zeros(F.col("c_custkey"), 64).alias("zeros"), hashing.codepoints_to_text(F.array(F.lit(75), F.lit(101), F.lit(121))).alias("letters"))


def stream_latest(s, d):
    events = _t(s, d, "events")
    stream = log.from_events(s.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").parquet(_folder(d, "events")))
    return ingest.settled(ingest.run_to_end(ingest.latest_stream(stream), "update"))


def stream_token_bucket(s, d):
    events = _t(s, d, "events")
    stream = wal.seconds(log.from_events(s.readStream.schema(events.schema).parquet(_folder(d, "events")))).select("key", F.col("ts").alias("second"), "seq")
    return ingest.run_to_end(ingest.token_bucket_stream(stream, BUCKET_SECONDS, BUCKET_TOKENS), "append")


def _folder(d: str, table: str) -> str:
    """A table's files as a glob, as streams read folders: a table may be one file or a folder of parts."""
    return f"{d}/{table}.parque[t]"


def kv_delete_present(s, d):
    """The latest records, the keys of nations deleted where they are present."""
    keys = _t(s, d, "nation").select(F.concat(F.lit("user"), F.lpad((F.col("n_nationkey") * 10).cast("string"), 6, "0")).alias("key"))
    return log.delete_present(_log(s, d), keys)


def _log_files(s, d) -> wal_files.LogFiles:
    """A log on files of the events, appended in two parts."""
    files = wal_files.LogFiles(s, new_folder(s, "log"), EngineConfig(wal_segment_records=1_000, wal_segment_bytes=40_000))
    records = wal.seconds(_log(s, d))
    half = records.agg(F.max("seq")).first()[0] // 2
    files.append(records.where(F.col("seq") <= half))
    wal_files.LogFiles(s, files.root, files.config).append(records.where(F.col("seq") > half))  # opened again
    return files


def log_files_segments(s, d):
    return wal_files.listing(_log_files(s, d).rows())


def log_files_recover(s, d):
    """Recovery after a truncation by bytes that ends within a segment, with the covered segments removed."""
    files = _log_files(s, d)
    files.truncate(files.end() // 3)
    return files.recover()


def log_files_low_water(s, d):
    files = _log_files(s, d)
    files.keep_newest()
    return wal_files.listing(files.rows())


def run_lookup_chain(s, d):
    """Every customer's key, and every key of the log, in the runs that hold them."""
    m, k = sketches.bloom_params(CONFIG.bloom_expected, CONFIG.bloom_fpp)
    probes = _t(s, d, "customer").select(F.concat(F.lit("user"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("key")).union(_log(s, d).select("key"))
    return runs.lookup_chain(_runs(s, d), probes, m, k, CONFIG.block_records, CONFIG.summary_blocks)


def compressed_run(s, d):
    return dictionary.compressed_run(_runs(s, d), dictionary.dictionary(_log(s, d), "key", "seq"))


def _kept(s, state: DataFrame, kind: str, **parameters) -> DataFrame:
    """A state saved and loaded again."""
    path = new_folder(s, kind)
    states.save(state, path, kind, **parameters)
    return states.load(s, path, kind, **parameters)


def saved_cms_frequency(s, d):
    k, m = sketches.cms_params(CONFIG.cms_epsilon, CONFIG.cms_delta)
    keys = _keys(s, d, "orders", "o_custkey")
    return sketches.cms_frequency(keys, _kept(s, sketches.cms_build(keys, m, k), "frequencies", m=m, k=k), m, k)


def saved_hll_estimate(s, d):
    p = CONFIG.hll_precision
    return sketches.hll_estimate(_kept(s, sketches.hll_registers(_keys(s, d, "orders", "o_orderkey"), p, CONFIG.hll_64bit), "registers", p=p, wide=CONFIG.hll_64bit), p)


def saved_bloom_contains(s, d):
    m, k = sketches.bloom_params(CONFIG.bloom_expected, CONFIG.bloom_fpp)
    probes = _t(s, d, "customer").select(F.concat(F.lit("user"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("key"))
    return sketches.bloom_contains(probes, _kept(s, sketches.bloom_bits(_log(s, d), m, k), "filter", m=m, k=k), m, k)


def saved_dictionary(s, d):
    return _kept(s, dictionary.dictionary(_log(s, d), "key", "seq"), "dictionary")


def saved_fingerprints(s, d):
    return _kept(s, simhash.fingerprint(_t(s, d, "documents").select("doc_id", "text"), "doc_id"), "fingerprints")


def saved_merkle_verify(s, d):
    """Roots recorded as metadata of the runs, against the runs with every even day's first record changed."""
    flushed = _runs(s, d)
    changed = runs.numbered(flushed).withColumn("value", F.when((F.col("pos") == 0) & (F.col("run_id") % 2 == 0), F.concat("value", F.lit("x"))).otherwise(F.col("value"))).drop("pos")
    return merkle.verify(changed, _kept(s, merkle.roots(flushed), "roots"))


def cms_reset(s, d):
    return sketches.cms_reset(cms_build(s, d))


def level_runs(s, d):
    """The runs of each level after size-tiered compaction."""
    return runs.manifest(compaction.size_tiered(_runs(s, d), CONFIG)).select("level", "run_id", "n_rows")


def leveled_arrival(s, d):
    """The first ten days as levels, then the eleventh arrives and what is over a level's budget moves down."""
    flushed = _runs(s, d)
    levels = compaction.leveled(flushed.where("run_id <= 20240110"), CONFIG)
    return compaction.pushed_down(levels, flushed.where("run_id = 20240111"), CONFIG)


def lru_delete_trace(s, d):
    """Deletes of the log invalidate their keys."""
    accesses = _log(s, d).select(F.substring("key", -1, 1).alias("cache"), "key", "seq", "tombstone")
    return stateful.lru_trace(accesses, "cache", "key", "seq", 5, "tombstone")


def lru_find_value(s, d):
    """Cached records whose value is a purchase."""
    accesses = _log(s, d).select(F.substring("key", -1, 1).alias("cache"), "key", "value", "seq")
    return stateful.cached(accesses, "cache", "key", "seq", CONFIG.cache_capacity // 20).where(F.col("value").startswith("purchase"))


def shuffled_keys(s, d):
    return dictionary.shuffled(_log(s, d), 42)


def trimmed_lines(s, d):
    """Values that end in line breaks, without them."""
    typed = F.concat("value", F.when(F.col("seq") % 2 == 0, F.lit("\r\n")).otherwise(F.lit("\n")))
    return _log(s, d).select("seq", codecs.trim_line(typed).alias("line"))


def demo_frequency(s, d):
    """A thousand keys once and one key a thousand times in a sketch of precision 0.05 and safety 0.99: the frequent key."""
    k, m = sketches.cms_params(0.05, 0.01)
    keys = s.range(2000).select(F.when(F.col("id") < 1000, codecs.seeded_text(F.lit(16), F.col("id"))).otherwise(F.lit("frequent-key")).alias("key"))
    return sketches.cms_frequency(s.createDataFrame([("frequent-key",)], "key string"), _kept(s, sketches.cms_build(keys, m, k), "frequencies", m=m, k=k), m, k)


def demo_cache(s, d):
    """Forty accesses to keys of one character in a cache of ten."""
    accesses = s.range(40).select(F.lit("c").alias("cache"), F.substring(F.md5(F.col("id").cast("string")), 1, 1).alias("key"), F.col("id").alias("seq"))
    return stateful.lru_trace(accesses, "cache", "key", "seq", 10)


def demo_filter(s, d):
    """Three words in a filter of twenty bits and three hashes, two other words asked for too."""
    words = lambda *x: s.createDataFrame([(w,) for w in x], "key string")
    return sketches.bloom_fnv_contains(words("alder", "birch", "cedar", "orange", "willow"), sketches.bloom_fnv_bits(words("alder", "birch", "cedar"), 20, 3), 20, 3)


def demo_fingerprint(s, d):
    """Three two-word names, two of which share the second word: their distances."""
    names = s.createDataFrame([(1, "Ada River"), (2, "Bea River"), (3, "Cal Stone")], "id long, text string")
    marked = simhash.fingerprint(names, "id").withColumn("w", simhash.words64(F.col("fingerprint")))
    other = marked.select(F.col("id").alias("other"), F.col("w").alias("v"))
    return marked.join(other, F.col("id") < F.col("other")).select("id", "other", simhash.hamming(F.col("w"), F.col("v")).alias("distance"))


def demo_dictionary(s, d):
    keys = s.createDataFrame(list(enumerate(["k1", "k2", "k3", "k1", "k2"])), "i long, key string")
    return dictionary.encode(keys, "key", "i").select("i", "key", "code")


QUERIES = [kv_log, kv_latest, kv_live, kv_get, kv_multi_get, kv_delete, prefix_scan, range_scan, prefix_iterate, range_iterate, customer_range, flush_runs, run_count, run_listing, run_manifest, level_bytes, sparse_index, sparse_summary, stride_summary, sample_summary, block_offsets, zone_lookup, merge_two_runs, size_tiered_trigger, size_tiered_round, size_tiered_full, compaction_purge, run_split, leveled_compact, wal_offsets, wal_segments, wal_truncate, wal_low_water, wal_recover, wal_crc, wal_roundtrip, bloom_params, bloom_bits, bloom_contains, bloom_fnv_contains, cms_params, cms_build, cms_frequency, hll_registers, hll_registers_64, hll_estimate, approx_distinct_native, simhash_terms, simhash_fingerprint, simhash_hamming, merkle_leaves, merkle_root, merkle_verify, dict_encode, dict_encode_parts, varint, lru_trace, token_bucket, flush_trace, bulk_load, bulk_dict_load, scalar_functions, stream_latest, stream_token_bucket, kv_delete_present, log_files_segments, log_files_recover, log_files_low_water, run_lookup_chain, compressed_run, saved_cms_frequency, saved_hll_estimate, saved_bloom_contains, saved_dictionary, saved_fingerprints, saved_merkle_verify, cms_reset, level_runs, leveled_arrival, lru_delete_trace, lru_find_value, shuffled_keys, trimmed_lines, demo_frequency, demo_cache, demo_filter, demo_fingerprint, demo_dictionary]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}
