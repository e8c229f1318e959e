import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidelog.llm import packing, topk, warc
from tidelog.llm.tokens import Encoder


def histograms():
    rng = random.Random(3)
    yield from ({}, {5: 1}, {2048: 7}, {1: 100_000, 2048: 5}, {700: 1000, 690: 500, 1100: 300, 400: 77}, {1025: 10})
    for low, high, n in ((1, 2048, 5), (1, 2048, 400), (700, 2048, 3000), (1, 300, 2000), (500, 800, 3000)):
        yield Counter(rng.randrange(low, high + 1) for _ in range(n))
    yield {x: 10**9 + x for x in range(3, 2000, 37)}


def test_solver_covers_the_histogram():
    """Every piece has its place, and the sequences are near the dual bound."""
    for h in histograms():
        plan, bound = packing.solve(h)
        got = Counter()
        for column, times in plan:
            assert sum(x * n for x, n in column.items()) <= 2048 and times > 0
            for x, n in column.items():
                got[x] += n * times
        assert got == Counter(h)
        assert bound - 1e-6 <= sum(t for _, t in plan) <= 1.06 * bound + 2


def test_bounds_hold_and_are_met():
    rng = random.Random(5)
    for h, used in (({700: 1000, 690: 500, 1100: 300}, 900), ({1025: 10}, 10), ({2048: 3, 1: 2048}, 4), ({683: 9}, 5)):
        assert packing.solve(h)[1] == pytest.approx(used, abs=0.6) and sum(t for _, t in packing.solve(h)[0]) == used
    for _ in range(40):  # small cases against an exhaustive search
        h = Counter(rng.randrange(3, 20) for _ in range(rng.randrange(1, 8)))
        items, least = sorted(h.elements(), reverse=True), [len(list(h.elements()))]

        def search(k, rooms, items=items, least=least):
            if len(rooms) >= least[0]:
                return
            if k == len(items):
                least[0] = len(rooms)
                return
            for i, room in enumerate(rooms):
                if room >= items[k] and room not in rooms[:i]:
                    search(k + 1, [*rooms[:i], room - items[k], *rooms[i + 1 :]])
            search(k + 1, [*rooms, 20 - items[k]])

        search(0, [])
        plan, bound = packing.solve(h, 20)
        assert bound <= least[0] + 1e-9 and least[0] <= sum(t for _, t in plan) <= least[0] + 1


def test_best_fit_is_best_fit():
    """Against piece by piece, by falling length into the tightest room."""
    rng = random.Random(6)
    for _ in range(50):
        h = Counter(rng.randrange(1, 60) for _ in range(rng.randrange(1, 200)))
        rooms = []
        for x in sorted(h.elements(), reverse=True):
            fit = min((r for r in rooms if r[0] >= x), default=None, key=lambda r: r[0])
            if fit is None:
                fit = [100]
                rooms.append(fit)
            fit[0] -= x
        got = packing.best_fit(h, 100)
        assert Counter(100 - sum(a * b for a, b in c.items()) for c, t in got for _ in range(t)) == Counter(r[0] for r in rooms)


def test_relaxation_never_covers_too_often():
    for h in histograms():
        if h:
            mix, _ = packing.relaxed(h)
            covered = Counter()
            for column, amount in mix:
                for x, n in column.items():
                    covered[x] += n * amount
            assert all(covered[x] <= n * (1 + 1e-6) for x, n in h.items())


def test_knapsack_is_best():
    rng = random.Random(2)
    for _ in range(20):
        lengths = np.array(sorted(rng.sample(range(2, 12), 3)))
        price = np.array([rng.random() for _ in lengths])
        got = packing.best_configuration(price, lengths, 25)
        assert sum(x * n for x, n in got.items()) <= 25
        best = max(a * price[0] + b * price[1] + c * price[2] for a in range(14) for b in range(10) for c in range(10) if a * lengths[0] + b * lengths[1] + c * lengths[2] <= 25)
        assert sum(price[list(lengths).index(x)] * n for x, n in got.items()) == pytest.approx(best)


def test_packing(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "cat", "sat", "zebra"]) for _ in range(rng.choice([1, 30, 900, 2047, 2048, 5000])))) for i in range(40)] + [(100, None), (101, ""), (None, "x"), (5, "again")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, length string").repartition(5)
    got = packing.pack(df).collect()
    e = Encoder().library
    want = Counter()
    for i, t in rows:
        ids = np.array([*e.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)] if len(ids) > first else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by: dict = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in by.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(df.limit(0)).count() == 0


def brute_top(rows, every, k):
    ok = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in ok:
        if q % every == 0:
            found = sorted((-int(v @ w), i) for i, w in ok if i != q and len(w) == len(v))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("scale", [0.1, 3.0])
def test_top_k_against_brute_force(spark, scale):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=8) * scale * (1 + i % 5)).tolist()) for i in range(300)]
    rows += [(300 + i, rows[3][1]) for i in range(40)] + [(400, None), (450, []), (451, [None] * 8), (500, [float("nan")] * 8), (550, [float("inf")] * 8), (600, [1.0, 2.0]), (601, [2.0, 2.0]), (None, rows[1][1]), (650, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = topk.top_k(df, 50, 5, bucket_rows=32, block_queries=3)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == brute_top(rows, 50, 5)
    assert topk.top_k(df.limit(0)).count() == 0


def test_survivors_keep_all_that_reach():
    rng = np.random.default_rng(1)
    m = np.floor(rng.normal(size=(400, 6)) * 100)
    m = m[np.argsort(-np.sqrt((m * m).sum(1)))]
    norm = np.sqrt((m * m).sum(1))
    for _ in range(200):
        q = np.floor(rng.normal(size=6) * 100)
        beat = float(np.quantile(m @ q, rng.uniform(0.8, 1)))
        assert set(np.flatnonzero(m @ q >= beat)) <= set(topk.survivors(q, m, norm, beat).tolist())


def test_archive(spark):
    rows = [(3, "http://a", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "http://b\r\nX: y", "other"), (5, "u", None), (4, "u", ""), (6, "u", "x" * 400_000), (7, "u", "x" * 400_000), (None, "u", "other")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    folder = warc.new_folder(spark, "test")
    index = warc.read_index(warc.write_bundles(df, folder, bundle_bytes=1000)).collect()
    first: dict = {}
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(h or "", i)
    assert len(index) == len(rows)
    names, refers = {}, []
    for r in index:
        if r["page_id"] is None:
            continue
        html = next(h for i, _, h in rows if i == r["page_id"]) or ""
        raw = html.encode()
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first[html] == r["page_id"] else ("revisit", first[html]))
        headers, block = warc.read_record(r)
        assert headers["X-Page-ID"] == str(r["page_id"]) and re.fullmatch("<urn:uuid:[0-9a-f-]{36}>", headers["WARC-Record-ID"])
        assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", headers["WARC-Date"])
        names[r["page_id"], r["payload_digest"]] = headers["WARC-Record-ID"]
        if r["record_type"] == "revisit":
            refers.append((headers["WARC-Refers-To"], (r["refers_to"], r["payload_digest"])))
        if r["record_type"] == "response":
            assert block.split(b"\r\n\r\n", 1)[1] == raw
    assert len(refers) == 3 and all(names[k] == x for x, k in refers) and len(set(names.values())) == len(names)
    assert warc.archive(df.limit(0)).count() == 0
    kept = warc.archive(df, least=10).where("record_type = 'revisit'").collect()
    assert {r["page_id"] for r in kept} == {7}


def test_rows_that_share_an_identifier(spark):
    """Every row is a query of its own (equal rows one) and a candidate of its own for the other identifiers."""
    rng = np.random.default_rng(17)
    rows = [(i, (rng.normal(size=4) * 3).tolist()) for i in range(60)]
    rows += [(50, rows[7][1]), (50, rows[50][1]), (0, rows[9][1]), (8, rows[8][1]), (8, rows[11][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, 50, 5, bucket_rows=8).collect())
    whole, want = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows], []
    for i, v in {(i, tuple(v)) for i, v in whole if i % 50 == 0}:
        found = sorted((-int(np.array(v) @ w), j) for j, w in whole if j != i)[:5]
        want += [(i, k + 1, j, -x) for k, (x, j) in enumerate(found)]
    assert got == sorted(want)
