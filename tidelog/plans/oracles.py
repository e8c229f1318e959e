"""The same results in DuckDB's SQL, written apart from the Spark plans."""

from __future__ import annotations

from ..operators.simhash import STOP_WORDS

KEY = "'user' || lpad(CAST({} AS VARCHAR), 6, '0')"
LOG = f"SELECT {KEY.format('user_id')} AS key, event_type || ':' || CAST(event_id AS VARCHAR) AS value, event_type = 'error' AS tombstone, ts, event_id AS seq FROM events"
BASE = f"""WITH log AS ({LOG}),
latest AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS rn FROM log) WHERE rn = 1),
live AS (SELECT * FROM latest WHERE NOT tombstone)"""
DAY = "CAST(strftime(ts, '%Y%m%d') AS INTEGER)"
RUNS = f"""{BASE}, runs AS (SELECT * EXCLUDE rn FROM (SELECT *, {DAY} AS run_id, 1 AS level, row_number() OVER (PARTITION BY {DAY}, key ORDER BY ts DESC, seq DESC) AS rn FROM log) WHERE rn = 1),
placed AS (SELECT *, CAST(25 + strlen(key) + strlen(value) AS BIGINT) AS size, row_number() OVER (PARTITION BY run_id ORDER BY key) - 1 AS pos,
  CAST(32 + coalesce(sum(25 + strlen(key) + strlen(value)) OVER (PARTITION BY run_id ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM runs)"""
WAL = f"""{BASE}, wal AS (SELECT *, start + size AS stop FROM (SELECT *, CAST(29 + strlen(key) + strlen(value) AS BIGINT) AS size,
  CAST(coalesce(sum(29 + strlen(key) + strlen(value)) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM log)),
segs AS (SELECT CAST(floor(start / 200) AS BIGINT) AS segment, count(*) AS n_records, min(seq) AS first_seq, max(seq) AS last_seq, CAST(sum(size) AS BIGINT) AS bytes FROM wal GROUP BY 1)"""


def u64(text: str, seed: str) -> str:
    """Seeded MD5 as an unsigned number."""
    return f"CAST(('0x' || substr(md5(encode({text}) || unhex(lpad(to_hex({seed}), 8, '0') || repeat('00', 28))), 1, 16)) AS UBIGINT)"


def fnv32(text: str) -> str:
    raw = f"hex(encode({text}))"
    return f"list_reduce(list_concat([CAST(2166136261 AS HUGEINT)], list_transform(range(0, CAST(strlen({text}) AS BIGINT)), lambda i: CAST(('0x' || substr({raw}, CAST(2 * i + 1 AS BIGINT), 2)) AS HUGEINT))), lambda h, b: (xor(h, b) * 16777619) % 4294967296)"


def fnv64(text: str) -> str:
    raw = f"hex(encode({text}))"
    # the prime is 2^40 + 435; products are taken apart to stay within 128 bits
    return f"list_reduce(list_concat([CAST(14695981039346656037 AS HUGEINT)], list_transform(range(0, CAST(strlen({text}) AS BIGINT)), lambda i: CAST(('0x' || substr({raw}, CAST(2 * i + 1 AS BIGINT), 2)) AS HUGEINT))), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)"


def hll(h: str, width: int) -> str:
    zeros = f"CASE WHEN h = 0 THEN {width} ELSE CAST(bit_count(CAST(xor(h, h - 1) AS HUGEINT)) - 1 AS INTEGER) END"
    return f"SELECT CAST(h // CAST({1 << (width - 8)} AS HUGEINT) AS BIGINT) AS bucket, max(CAST(least({width - 8}, 1 + {zeros}) AS INTEGER)) AS rank FROM (SELECT {h} AS h FROM (SELECT CAST(o_orderkey AS VARCHAR) AS key FROM orders)) GROUP BY 1"


def terms(table: str, id_col: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"SELECT {id_col}, word, count(*) AS n FROM (SELECT {id_col}, unnest(string_split(text, ' ')) AS word FROM {table}) WHERE word NOT IN ({stop}) GROUP BY 1, 2"


def fingerprint(table: str, id_col: str) -> str:
    bits = " || ".join(f"CASE WHEN sum(CASE WHEN (ascii(digit) >> {7 - b}) & 1 = 1 THEN n ELSE -n END) > 0 THEN '1' ELSE '0' END" for b in range(8))
    return f"""SELECT {id_col}, string_agg(s, '' ORDER BY place) AS fingerprint FROM (
  SELECT {id_col}, place, {bits} AS s FROM (
    SELECT {id_col}, place, substr(h, place, 1) AS digit, CAST(sum(n) AS BIGINT) AS n FROM (SELECT {id_col}, n, md5(word) AS h, unnest(range(1, 33)) AS place FROM ({terms(table, id_col)})) GROUP BY 1, 2, 3
  ) GROUP BY 1, 2) GROUP BY 1"""


def merkle_levels(source: str, depth: int = 14) -> str:
    """CTEs l0 .. l<depth> over (run_id, pos, hash), unrolled; a run with one node stays."""
    parts = [f"l0 AS ({source})"]
    for k in range(1, depth + 1):
        parts.append(f"""l{k} AS (SELECT run_id, pos // 2 AS pos, CASE WHEN any_value(n) = 1 THEN any_value(hash) ELSE sha1(unhex(min_by(hash, pos)) || unhex(max_by(hash, pos))) END AS hash
  FROM (SELECT *, count(*) OVER (PARTITION BY run_id) AS n FROM l{k - 1}) GROUP BY run_id, pos // 2)""")
    return ",\n".join(parts)


LEAF = "SELECT run_id, pos, sha1(encode(key || value)) AS hash FROM placed"
TREE = f"{RUNS}, {merkle_levels(LEAF)}"

ORDERED = "SELECT *, row_number() OVER (ORDER BY run_id) - 1 AS ord, count(*) OVER () AS n FROM (SELECT DISTINCT run_id FROM {})"


def _rounds(levels: int = 3) -> str:
    """Size-tiered rounds, unrolled: g<k> maps every flushed run to its (level, run) after round k."""
    parts = ["g0 AS (SELECT DISTINCT run_id AS src, 1 AS lvl, run_id AS dst FROM runs)"]
    for k in range(1, levels + 1):
        parts.append(f"""g{k} AS (SELECT g.src, CASE WHEN c.n >= {2 * 2 ** (k - 1)} AND NOT (c.n % 2 = 1 AND c.ord = c.n - 1) THEN {k + 1} ELSE g.lvl END AS lvl,
  CASE WHEN c.n >= {2 * 2 ** (k - 1)} AND NOT (c.n % 2 = 1 AND c.ord = c.n - 1) THEN c.first_of_pair ELSE g.dst END AS dst
  FROM g{k - 1} g LEFT JOIN (SELECT dst, ord, n, min(dst) OVER (PARTITION BY ord // 2) AS first_of_pair FROM (SELECT dst, row_number() OVER (ORDER BY dst) - 1 AS ord, count(*) OVER () AS n FROM (SELECT DISTINCT dst FROM g{k - 1} WHERE lvl = {k}))) c ON g.lvl = {k} AND g.dst = c.dst)""")
    return ",\n".join(parts)


PARAMS_BLOOM = "SELECT n, p, CAST(ceil(n * abs(ln(p)) / pow(ln(2), 2)) AS INTEGER) AS m, CAST(ceil(ceil(n * abs(ln(p)) / pow(ln(2), 2)) / n * ln(2)) AS INTEGER) AS k FROM (VALUES (CAST(2 AS INTEGER), CAST(0.001 AS DOUBLE)), (10, 0.001), (1000, 0.001), (1000, 0.01)) t(n, p)"
PARAMS_CMS = "SELECT epsilon, delta, CAST(ceil(ln(exp(1) / delta)) AS INTEGER) AS k, CAST(ceil(exp(1) / epsilon) AS INTEGER) AS m FROM (VALUES (CAST(0.05 AS DOUBLE), CAST(0.01 AS DOUBLE)), (0.001, 0.001), (0.01, 0.02)) t(epsilon, delta)"
BITS = f"{BASE}, bits AS (SELECT DISTINCT CAST({u64('key', '1234 + i')} % 14378 AS BIGINT) AS pos FROM (SELECT DISTINCT key FROM log), range(0, 10) r(i))"
PROBES = f"(SELECT DISTINCT {KEY.format('c_custkey')} AS key FROM customer)"
CELLS = f"SELECT key, CAST(i AS INTEGER) AS row, CAST({u64('key', '1234 + i')} % 2719 AS BIGINT) AS bucket FROM (SELECT CAST(o_custkey AS VARCHAR) AS key FROM orders), range(0, 8) r(i)"
CMS = f"SELECT row, bucket, count(*) AS cnt FROM ({CELLS}) GROUP BY 1, 2"
REG32 = hll(fnv32("key"), 32)
SIZE = "CAST(25 + strlen(key) + strlen(value) AS BIGINT)"
SECONDS = "CAST(epoch(ts) // 1 AS BIGINT)"
BUCKET = f"""WITH RECURSIVE req AS (SELECT {KEY.format('user_id')} AS key, CAST(floor(epoch(ts)) AS BIGINT) AS second, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS rn FROM events),
run AS (SELECT key, second, seq, rn, second AS last, 3 AS tokens, true AS allowed FROM req WHERE rn = 1
UNION ALL SELECT r.key, r.second, r.seq, r.rn, CASE WHEN r.second - p.last > 172800 THEN r.second ELSE p.last END,
 CASE WHEN r.second - p.last > 172800 THEN 3 ELSE greatest(p.tokens - 1, 0) END, CASE WHEN r.second - p.last > 172800 THEN true ELSE p.tokens > 0 END
 FROM run p JOIN req r ON r.key = p.key AND r.rn = p.rn + 1)
SELECT key, second, seq, allowed FROM run"""
BULK = "SELECT i, 'key' || CAST(i % 100 AS VARCHAR) AS key, substr(sha256(CAST(i AS VARCHAR) || ':0') || sha256(CAST(i AS VARCHAR) || ':1') || sha256(CAST(i AS VARCHAR) || ':2'), 1, CAST(i % 100 AS BIGINT)) AS value FROM range(0, 100000) r(i)"


SAMPLE = """SELECT run_id, key, "offset" FROM (SELECT *, count(*) OVER (PARTITION BY run_id) AS n FROM placed) WHERE pos = 0 OR pos = n - 1 OR CAST(('0x' || substr(md5(key), 1, 8)) AS BIGINT) % 100 < 49"""


def crc32(data: str) -> str:
    """CRC-32 of a blob, by bytes over a table that SQL makes from the polynomial."""
    byte = f"CAST(('0x' || substr(hex({data}), CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT)"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(0, octet_length({data})), lambda i: {byte})), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295)"


TABLE = "SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([CAST(i AS BIGINT)], range(0, 8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) AS v FROM range(0, 256) r(i))"


def le64(x: str) -> str:
    """Little-endian hexadecimal digits of a number."""
    return " || ".join(f"lpad(hex(({x} >> {8 * i}) & 255), 2, '0')" for i in range(8))


RECORD = f"unhex('00000000' || {le64('second')} || CASE WHEN tombstone THEN '01' ELSE '00' END || {le64('strlen(key)')} || {le64('strlen(value)')} || hex(encode(key)) || hex(encode(value)))"
WAL_CRC = f"""WITH log AS ({LOG}), t AS ({TABLE}), r AS (SELECT seq, {RECORD} AS data FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS second FROM log))
SELECT seq, CAST({crc32('data')} AS BIGINT) AS crc FROM r, t"""

#: Rings of two memtables of two keys: by record, the distinct keys of both tables, the active one, whether a flush follows.
RING = f"""WITH RECURSIVE log AS ({LOG}), rec AS (SELECT right(key, 1) AS store, key, row_number() OVER (PARTITION BY right(key, 1) ORDER BY seq) - 1 AS i FROM log),
run AS (SELECT DISTINCT store, CAST(-1 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS here, CAST([] AS VARCHAR[]) AS other, false AS flushed FROM rec
UNION ALL SELECT store, i, CASE WHEN filled THEN CASE WHEN flushed THEN CAST([] AS VARCHAR[]) ELSE other END ELSE next END, CASE WHEN filled THEN next ELSE other END, flushed
 FROM (SELECT *, filled AND len(other) = 2 AS flushed FROM (SELECT r.store, r.i, p.other, list_distinct(list_append(p.here, r.key)) AS next, len(list_distinct(list_append(p.here, r.key))) = 2 AS filled
  FROM run p JOIN rec r ON r.store = p.store AND r.i = p.i + 1)))
SELECT store, row_number() OVER (PARTITION BY store ORDER BY i) - 1 AS flush, i AS at_record, CAST(2 AS BIGINT) AS n_keys FROM run WHERE flushed"""

#: The log on files: two appends, segments of 1,000 records or 40,000 bytes of their append.
FILES = f"""WITH log AS ({LOG}), half AS (SELECT *, seq > (SELECT max(seq) // 2 FROM log) AS second_half, CAST(29 + strlen(key) + strlen(value) AS BIGINT) AS size FROM log),
put AS (SELECT *, row_number() OVER (PARTITION BY second_half ORDER BY seq) - 1 AS number, coalesce(sum(size) OVER (PARTITION BY second_half ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin,
  coalesce(sum(size) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(size) OVER () AS whole FROM half),
seg AS (SELECT *, dense_rank() OVER (ORDER BY second_half, number // 1000 + CAST(floor(begin / 40000) AS BIGINT)) - 1 AS segment FROM put)"""
SEGMENTS = "SELECT segment, count(*) AS n_records, min(seq) AS first_seq, CAST(sum(size) AS BIGINT) AS bytes FROM seg GROUP BY 1"
LEVELS_10 = f"""m AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY run_id DESC, ts DESC, seq DESC) AS rn FROM placed WHERE run_id <= 20240110) WHERE rn = 1),
b AS (SELECT *, coalesce(sum(size) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS whole FROM m),
lv AS (SELECT *, whole - floor(before / 1500) * 1500 AS after, CAST(floor(before / 1500) AS INTEGER) AS part FROM b),
l0 AS (SELECT key, value, tombstone, ts, seq, size, part, CASE WHEN after <= 3000 THEN 1 WHEN after <= 9000 THEN 2 WHEN after <= 21000 THEN 3 ELSE 4 END AS level FROM lv),
a1 AS (SELECT key, value, tombstone, ts, seq, size FROM placed WHERE run_id = 20240111)"""


def _arrival(levels: int = 4) -> str:
    """Levels after one arrival, unrolled: j<k> is level k with what arrives, s<k> what stays there, a<k+1> what moves on."""
    parts = [LEVELS_10]
    for k in range(1, levels + 1):
        keep = "true" if k == levels else f"whole - part * 1500 <= {3000 * 2 ** (k - 1)}"
        parts.append(f"""j{k} AS (SELECT *, CAST(floor(before / 1500) AS INTEGER) AS part FROM (SELECT *, coalesce(sum(size) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS whole
  FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY new DESC, ts DESC, seq DESC) AS rn FROM (SELECT key, value, tombstone, ts, seq, size, 0 AS new FROM l0 WHERE level = {k} UNION ALL SELECT key, value, tombstone, ts, seq, size, 1 FROM a{k})) WHERE rn = 1))),
t{k} AS (SELECT count(*) > 0 AS any_arrives FROM a{k}),
s{k} AS (SELECT key, value, tombstone, ts, seq, part, {k} AS level FROM j{k} WHERE (SELECT any_arrives FROM t{k}) AND ({keep}) UNION ALL SELECT key, value, tombstone, ts, seq, part, level FROM l0 WHERE level = {k} AND NOT (SELECT any_arrives FROM t{k})),
a{k + 1} AS (SELECT key, value, tombstone, ts, seq, size FROM j{k} WHERE (SELECT any_arrives FROM t{k}) AND NOT ({keep}))""")
    return ",\n".join(parts)


def leb(x: str) -> str:
    """Varint of a number below 2^14, in hexadecimal digits."""
    return f"CASE WHEN {x} < 128 THEN lpad(lower(hex({x})), 2, '0') ELSE lpad(lower(hex({x} % 128 + 128)), 2, '0') || lpad(lower(hex({x} // 128)), 2, '0') END"


#: Whether a key is among the five last used of its cache, deleted keys not counted: by recursion over each cache's list.
LRU_DELETES = """WITH RECURSIVE acc AS (SELECT right(key, 1) AS c, key AS k, seq AS s, tombstone AS dead, row_number() OVER (PARTITION BY right(key, 1) ORDER BY seq) AS i FROM log),
st AS (SELECT DISTINCT c, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS s, CAST([] AS VARCHAR[]) AS held, false AS hold FROM acc
UNION ALL SELECT a.c, a.i, a.s, CASE WHEN a.dead THEN list_filter(p.held, lambda x: x <> a.k) ELSE list_slice(list_prepend(a.k, list_filter(p.held, lambda x: x <> a.k)), 1, 5) END, list_contains(p.held, a.k)
 FROM st p JOIN acc a ON a.c = p.c AND a.i = p.i + 1)
SELECT s AS seq, hold FROM st WHERE i > 0"""


def oracle_sql() -> dict[str, str]:
    page = lambda where, size, skip: f"{BASE} SELECT key, value FROM live WHERE {where} ORDER BY key LIMIT {size} OFFSET {skip}"
    gone = f"SELECT {KEY.format('n_nationkey')} FROM nation"
    index = lambda stride: f'{RUNS} SELECT run_id, pos, key, "offset" FROM placed WHERE pos % {stride} = 0'
    pick = "key, value, tombstone, ts, seq"
    stored = f"{RUNS}, {_rounds()}"
    words = lambda *x: " UNION ALL ".join(f"SELECT '{w}' AS key" for w in x)
    found = {
        "kv_log": LOG,
        "kv_latest": f"{BASE} SELECT {pick} FROM latest",
        "kv_live": f"{BASE} SELECT {pick} FROM live",
        "kv_get": f"{BASE} SELECT key, value FROM live WHERE key = 'user000042'",
        "kv_multi_get": f"{BASE} SELECT key, value FROM live WHERE key IN (SELECT {KEY.format('s_suppkey')} FROM supplier)",
        "kv_delete": f"{BASE} SELECT {pick} FROM live WHERE key NOT IN ({gone})",
        "prefix_scan": page("starts_with(key, 'user0000')", 20, 20),
        "range_scan": page("key BETWEEN 'user000010' AND 'user000090'", 30, 0),
        "prefix_iterate": page("starts_with(key, 'user0000') AND key > 'user000020'", 10, 0),
        "range_iterate": page("key BETWEEN 'user000030' AND 'user000120' AND key > 'user000055'", 10, 0),
        "customer_range": "SELECT c_name AS key, max_by(c_mktsegment, c_custkey) AS value FROM customer WHERE c_name BETWEEN 'Customer#000000100' AND 'Customer#000000900' GROUP BY 1 ORDER BY 1 LIMIT 25 OFFSET 25",
        "flush_runs": f"{RUNS} SELECT {pick}, run_id, level FROM runs",
        "run_count": f"{RUNS} SELECT run_id, count(*) AS n_rows FROM runs GROUP BY 1",
        "run_listing": f"{RUNS} SELECT run_id, level, count(*) AS n_rows FROM runs GROUP BY 1, 2",
        "run_manifest": f"{RUNS} SELECT level, run_id, count(*) AS n_rows, CAST(sum(size) AS BIGINT) AS bytes, min(key) AS min_key, max(key) AS max_key FROM placed GROUP BY 1, 2",
        "level_bytes": f"{RUNS} SELECT level, count(DISTINCT run_id) AS n_runs, CAST(sum(size) AS BIGINT) AS bytes FROM placed GROUP BY 1",
        "sparse_index": index(2),
        "sparse_summary": index(4),
        "stride_summary": f"""{RUNS} SELECT run_id, key, "offset" FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY key) - 1 AS ord FROM ({SAMPLE})) WHERE ord % 5 = 0""",
        "sample_summary": f"{RUNS} {SAMPLE}",
        "block_offsets": f'{RUNS} SELECT run_id, pos, key, size, "offset" FROM placed',
        "zone_lookup": f"""{RUNS}, probes AS (SELECT DISTINCT {DAY} AS run_id, key FROM log), heads AS (SELECT run_id, key, "offset" FROM placed WHERE pos % 4 = 0)
SELECT p.run_id, p.key, max(h.key) AS leader, max_by(h."offset", h.key) AS "offset" FROM probes p LEFT JOIN heads h ON h.run_id = p.run_id AND h.key <= p.key GROUP BY 1, 2""",
        "merge_two_runs": f"{RUNS} SELECT {pick} FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC, run_id DESC) AS rn FROM runs WHERE run_id IN (20240101, 20240102)) WHERE rn = 1",
        "size_tiered_trigger": f"{RUNS} SELECT level, n_runs, bytes, n_runs >= 2 * pow(2, level - 1) AS by_tables, bytes >= 5000 * pow(2, level - 1) AS by_bytes FROM (SELECT level, count(DISTINCT run_id) AS n_runs, CAST(sum(size) AS BIGINT) AS bytes FROM placed GROUP BY 1) WHERE level < 4",
        "size_tiered_round": f"""{RUNS}, o AS ({ORDERED.format('runs')}), m AS (SELECT r.*, CAST(o.ord // 2 AS INTEGER) AS pair, CAST(CASE WHEN o.n % 2 = 1 AND o.ord = o.n - 1 THEN 1 ELSE 2 END AS INTEGER) AS to_level FROM runs r JOIN o USING (run_id))
SELECT to_level, pair, {pick} FROM (SELECT *, row_number() OVER (PARTITION BY to_level, pair, key ORDER BY ts DESC, seq DESC, run_id DESC) AS rn FROM m) WHERE rn = 1""",
        "size_tiered_full": f"""{RUNS}, {_rounds()}
SELECT {pick}, CAST(dst AS INTEGER) AS run_id, CAST(lvl AS INTEGER) AS level FROM (SELECT r.*, g.lvl, g.dst, row_number() OVER (PARTITION BY g.lvl, g.dst, r.key ORDER BY r.ts DESC, r.seq DESC, r.run_id DESC) AS rn FROM runs r JOIN g3 g ON g.src = r.run_id) WHERE rn = 1""",
        "compaction_purge": f"{BASE} SELECT key, value, ts, seq FROM live",
        "run_split": f"""{RUNS} SELECT run_id, key, CAST(floor(("offset" - 32) / 1500) AS INTEGER) AS part FROM placed""",
        "leveled_compact": f"""{RUNS}, m AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY run_id DESC, ts DESC, seq DESC) AS rn FROM placed) WHERE rn = 1),
b AS (SELECT *, coalesce(sum(size) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS whole FROM m),
c AS (SELECT *, CAST(floor(before / 1500) AS INTEGER) AS part, whole - floor(before / 1500) * 1500 AS after FROM b)
SELECT {pick}, part, CAST(CASE WHEN after <= 3000 THEN 1 WHEN after <= 9000 THEN 2 WHEN after <= 21000 THEN 3 ELSE 4 END AS INTEGER) AS level FROM c""",
        "wal_offsets": f"{WAL} SELECT seq, size, start, stop FROM wal",
        "wal_segments": f"{WAL} SELECT segment, n_records, first_seq, last_seq, bytes FROM segs",
        "wal_truncate": f"{WAL} SELECT segment, segment < 50 AS removed, CAST(CASE WHEN segment = 50 THEN 50 ELSE 0 END AS BIGINT) AS skip FROM segs",
        "wal_low_water": f"{WAL} SELECT segment, n_records, first_seq, last_seq, bytes FROM segs ORDER BY segment DESC LIMIT 2",
        "wal_recover": f"{WAL} SELECT {pick} FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS rn FROM wal WHERE start >= 100000) WHERE rn = 1",
        "wal_roundtrip": f"WITH log AS ({LOG}) SELECT key, value, tombstone, CAST(floor(epoch(ts)) AS BIGINT) AS ts, seq FROM log",
        "bloom_params": PARAMS_BLOOM,
        "bloom_bits": f"{BITS} SELECT pos FROM bits",
        "bloom_contains": f"{BITS}, p AS (SELECT key, CAST({u64('key', '1234 + i')} % 14378 AS BIGINT) AS pos FROM {PROBES}, range(0, 10) r(i)) SELECT key, bool_and(pos IN (SELECT pos FROM bits)) AS maybe FROM p GROUP BY 1",
        "bloom_fnv_contains": f"""{BASE}, bits AS (SELECT DISTINCT xor(h, CAST(i AS HUGEINT)) % 1000 AS pos FROM (SELECT {fnv32('key')} AS h FROM (SELECT DISTINCT key FROM log)), range(0, 2) r(i)),
p AS (SELECT key, xor(h, CAST(i AS HUGEINT)) % 1000 AS pos FROM (SELECT key, {fnv32('key')} AS h FROM {PROBES}), range(0, 2) r(i)) SELECT key, bool_and(pos IN (SELECT pos FROM bits)) AS maybe FROM p GROUP BY 1""",
        "cms_params": PARAMS_CMS,
        "cms_build": CMS,
        "cms_frequency": f"WITH c AS ({CMS}), p AS (SELECT DISTINCT key, row, bucket FROM ({CELLS})) SELECT key, min(cnt) AS estimate FROM p JOIN c USING (row, bucket) GROUP BY 1",
        "hll_registers": REG32,
        "hll_registers_64": hll(fnv64("key"), 64),
        "hll_estimate": f"""WITH g AS (SELECT sum(pow(2.0, -rank)) AS s, count(*) AS n FROM ({REG32})), e AS (SELECT 0.7213 / (1.0 + 1.079 / 256) * 65536 / (s + 256 - n) AS raw, 256.0 - n AS empty FROM g)
SELECT round(CASE WHEN raw <= 640 THEN CASE WHEN empty > 0 THEN 256 * ln(256 / empty) ELSE raw END WHEN raw > 4294967296.0 / 30 THEN -4294967296.0 * ln(1 - raw / 4294967296.0) ELSE raw END, 6) AS estimate FROM e""",
        "simhash_terms": terms("documents", "doc_id"),
        "simhash_fingerprint": fingerprint("documents", "doc_id"),
        "simhash_hamming": f"""WITH a AS ({fingerprint('documents', 'doc_id')}), b AS ({fingerprint('benchmark', 'item_id')}),
p AS (SELECT doc_id, item_id, CAST(bit_count(xor(CAST(a.fingerprint AS BIT), CAST(b.fingerprint AS BIT))) AS INTEGER) AS distance FROM a, b)
SELECT doc_id, item_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, item_id) AS rn FROM p) WHERE rn = 1""",
        "merkle_leaves": f"{RUNS} {LEAF}",
        "merkle_root": f"{TREE} SELECT run_id, hash AS root FROM l14",
        "merkle_verify": f"{RUNS} SELECT DISTINCT run_id, run_id % 2 = 1 AS ok FROM runs",
        "dict_encode": f"{BASE} SELECT key, row_number() OVER (ORDER BY min(seq)) - 1 AS code FROM log GROUP BY key",
        "dict_encode_parts": "WITH d AS (SELECT p_brand, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS code FROM part GROUP BY 1) SELECT p_brand, p_partkey, code FROM part JOIN d USING (p_brand)",
        "varint": """SELECT o_orderkey, CAST(len(b) AS INTEGER) AS n_bytes, array_to_string(list_transform(b, lambda x: lpad(lower(to_hex(x)), 2, '0')), '') AS bytes, o_orderkey * 1000 AS back FROM (
SELECT o_orderkey, list_transform(range(0, n), lambda i: ((x // CAST(pow(128, i) AS BIGINT)) % 128) + CASE WHEN i < n - 1 THEN 128 ELSE 0 END) AS b FROM (
SELECT o_orderkey, o_orderkey * 1000 AS x, CAST(greatest(1, ceil(len(ltrim(CAST(CAST(o_orderkey * 1000 AS BIT) AS VARCHAR), '0')) / 7.0)) AS BIGINT) AS n FROM orders))""",
        "lru_trace": f"""{BASE}, a AS (SELECT right(key, 1) AS cache, key, seq, lag(seq) OVER (PARTITION BY key ORDER BY seq) AS prev FROM log)
SELECT a.cache, a.key, a.seq, a.prev IS NOT NULL AND count(DISTINCT b.key) < 5 AS hit FROM a LEFT JOIN a b ON b.cache = a.cache AND b.seq > a.prev AND b.seq < a.seq GROUP BY a.cache, a.key, a.seq, a.prev""",
        "token_bucket": BUCKET,
        "bulk_load": BULK,
        "bulk_dict_load": f"SELECT i, i % 100 AS code, CAST(len(value) AS BIGINT) AS value_bytes, CAST(1 AS INTEGER) AS size_bytes FROM ({BULK})",
        "scalar_functions": f"""SELECT c_custkey, CAST({fnv32('c_name')} AS BIGINT) AS fnv32, CAST(h // 4294967296 AS BIGINT) AS fnv64_hi, CAST(h % 4294967296 AS BIGINT) AS fnv64_lo, CAST({u64('c_name', '1234')} AS VARCHAR) AS md5_u64, sha1(c_name) AS sha1,
array_to_string(list_transform(string_split(substr(md5(c_name), 1, 4), ''), lambda c: right(CAST(CAST(ascii(c) AS BIT) AS VARCHAR), 8)), '') AS bits, CASE WHEN c_custkey = 0 THEN 64 ELSE CAST(bit_count(xor(c_custkey, c_custkey - 1)) - 1 AS INTEGER) END AS zeros, 'Key' AS letters FROM (SELECT *, {fnv64('c_name')} AS h FROM customer)""",
        "stream_latest": f"{BASE} SELECT {pick} FROM latest",
        "stream_token_bucket": BUCKET,
        "wal_crc": WAL_CRC,
        "flush_trace": RING,
        "kv_delete_present": f"{BASE} SELECT key, value, tombstone OR key IN (SELECT {KEY.format('n_nationkey * 10')} FROM nation) AS tombstone, ts, seq FROM latest",
        "log_files_segments": f"{FILES} {SEGMENTS}",
        "log_files_recover": f"{FILES} SELECT key, value, tombstone, CAST(floor(epoch(ts)) AS BIGINT) AS ts, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY floor(epoch(ts)) DESC, seq DESC) AS rn FROM seg WHERE start >= whole // 3) WHERE rn = 1",
        "log_files_low_water": f"{FILES}, l AS ({SEGMENTS}) SELECT segment - min(segment) OVER () AS segment, n_records, first_seq, bytes FROM l WHERE segment > (SELECT max(segment) FROM l) - 2",
        "run_lookup_chain": f"""{RUNS}, asked AS (SELECT key FROM {PROBES} UNION SELECT key FROM log)
SELECT p.run_id, p.key, s."offset" AS summary_offset, i."offset" AS index_offset, p."offset", p.value FROM placed p JOIN placed s ON s.run_id = p.run_id AND s.pos = p.pos - p.pos % 4 JOIN placed i ON i.run_id = p.run_id AND i.pos = p.pos - p.pos % 2
WHERE NOT p.tombstone AND p.key IN (SELECT key FROM asked)""",
        "compressed_run": f"""{RUNS}, codes AS (SELECT key, row_number() OVER (ORDER BY min(seq)) - 1 AS code FROM log GROUP BY key),
r AS (SELECT run_id, key, code, CAST(1 AS INTEGER) AS size_bytes, {leb('code')} || {leb('strlen(value)')} || lower(hex(encode(value))) AS record_hex FROM runs JOIN codes USING (key) WHERE NOT tombstone)
SELECT run_id, code, size_bytes, record_hex, CAST(32 + coalesce(sum(len(record_hex) // 2) OVER (PARTITION BY run_id ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM r""",
        "saved_fingerprints": fingerprint("documents", "doc_id"),
        "saved_merkle_verify": f"{RUNS} SELECT DISTINCT run_id, run_id % 2 = 1 AS ok FROM runs",
        "cms_reset": f"SELECT row, bucket, CAST(0 AS BIGINT) AS cnt FROM ({CMS})",
        "level_runs": f"{stored} SELECT CAST(lvl AS INTEGER) AS level, CAST(dst AS INTEGER) AS run_id, count(DISTINCT key) AS n_rows FROM runs JOIN g3 ON src = run_id GROUP BY 1, 2",
        "leveled_arrival": f"{RUNS}, {_arrival()} " + " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(1, 5)),
        "lru_delete_trace": f"""{BASE}, a AS (SELECT right(key, 1) AS cache, key, seq, tombstone, lag(seq) OVER (PARTITION BY key ORDER BY seq) AS prev, lag(tombstone) OVER (PARTITION BY key ORDER BY seq) AS prev_dead FROM log),
v AS (SELECT a.*, NOT a.tombstone AND a.prev IS NOT NULL AND NOT a.prev_dead AS may FROM a)
SELECT cache, key, seq, tombstone, may AND hold AS hit FROM v JOIN ({LRU_DELETES}) h USING (seq)""",
        "lru_find_value": f"""{BASE} SELECT cache, key, value, seq, rank FROM (SELECT right(key, 1) AS cache, key, value, seq, CAST(row_number() OVER (PARTITION BY right(key, 1) ORDER BY seq DESC) AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1) WHERE rank <= 5 AND starts_with(value, 'purchase')""",
        "shuffled_keys": f"{BASE} SELECT key, row_number() OVER (ORDER BY md5('42:' || key)) - 1 AS place FROM (SELECT DISTINCT key FROM log)",
        "trimmed_lines": f"WITH log AS ({LOG}) SELECT seq, value AS line FROM log",
        "demo_frequency": f"""WITH k AS (SELECT CASE WHEN i < 1000 THEN substr(sha256(CAST(i AS VARCHAR) || ':0'), 1, 16) ELSE 'frequent-key' END AS key FROM range(0, 2000) r(i)),
c AS (SELECT key, j, CAST({u64('key', '1234 + j')} % 55 AS BIGINT) AS bucket FROM k, range(0, 6) r(j)), n AS (SELECT j, bucket, count(*) AS cnt FROM c GROUP BY 1, 2)
SELECT key, min(cnt) AS estimate FROM (SELECT DISTINCT key, j, bucket FROM c WHERE key = 'frequent-key') JOIN n USING (j, bucket) GROUP BY 1""",
        "demo_cache": """WITH a AS (SELECT 'c' AS cache, substr(md5(CAST(i AS VARCHAR)), 1, 1) AS key, i AS seq FROM range(0, 40) r(i)), b AS (SELECT *, lag(seq) OVER (PARTITION BY key ORDER BY seq) AS prev FROM a)
SELECT b.cache, b.key, b.seq, b.prev IS NOT NULL AND count(DISTINCT o.key) < 10 AS hit FROM b LEFT JOIN a o ON o.seq > b.prev AND o.seq < b.seq GROUP BY b.cache, b.key, b.seq, b.prev""",
        "demo_filter": f"""WITH k AS ({words('alder', 'birch', 'cedar')}), p AS ({words('alder', 'birch', 'cedar', 'orange', 'willow')}), bits AS (SELECT DISTINCT xor({fnv32('key')}, CAST(i AS HUGEINT)) % 20 AS pos FROM k, range(0, 3) r(i))
SELECT key, bool_and(pos IN (SELECT pos FROM bits)) AS maybe FROM (SELECT key, xor({fnv32('key')}, CAST(i AS HUGEINT)) % 20 AS pos FROM p, range(0, 3) r(i)) GROUP BY 1""",
        "demo_fingerprint": f"""WITH names AS (SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'Ada River'), (2, 'Bea River'), (3, 'Cal Stone')) t(id, text)), f AS ({fingerprint('names', 'id')})
SELECT a.id, b.id AS other, CAST(bit_count(xor(CAST(a.fingerprint AS BIT), CAST(b.fingerprint AS BIT))) AS INTEGER) AS distance FROM f a JOIN f b ON a.id < b.id""",
        "demo_dictionary": "SELECT i, key, code FROM (VALUES (CAST(0 AS BIGINT), 'k1', CAST(0 AS BIGINT)), (1, 'k2', 1), (2, 'k3', 2), (3, 'k1', 0), (4, 'k2', 1)) t(i, key, code)",
    }
    same = {"saved_cms_frequency": "cms_frequency", "saved_hll_estimate": "hll_estimate", "saved_bloom_contains": "bloom_contains", "saved_dictionary": "dict_encode"}
    return found | {name: found[of] for name, of in same.items()}
