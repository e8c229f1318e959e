import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelog.llm import components, decontam, jaccard, langid, pii, substring_dedup, toxicity
from tidelog.llm.words import word_hash

DOCS = "doc_id long, text string, score string, a string, n string"


def docs(spark, rows, schema=DOCS):
    return spark.createDataFrame([(i, t, "s", "a", "n") for i, t in rows], schema)


# substring de-duplication


def test_repeated_passages_go_but_the_first(spark, prose):
    passage, long = prose(1, 60), " ".join(prose(9, 80).replace(".", "").split())
    rows = [(1, prose(2, 40) + " " + passage), (2, passage + " " + prose(3, 40)), (3, prose(4, 80)), (4, prose(4, 80)), (5, None), (6, ""), (7, long + " tail"), (8, "head " + long), (9, prose(5, 30))]
    got = {r["doc_id"]: r for r in substring_dedup.dedup(docs(spark, rows)).collect()}
    text = dict(rows)
    for i in (1, 3, 5, 6, 7, 9):
        assert got[i]["text"] == text[i] and got[i]["removed_words"] == 0
    assert got[2]["removed_words"] >= 40 and prose(3, 40)[-100:] in got[2]["text"]
    assert got[4]["text"] == "" and got[4]["removed_words"] == 80
    assert got[8]["removed_words"] > 40
    assert got[1].asDict().keys() == {"doc_id", "text", "score", "a", "n", "removed_sentences", "removed_words"}


def brute_sentences(text):
    """(begin, end, words) of each sentence, places in the text; what stands between goes with that before."""
    found = list(re.finditer("[^\x20\x09-\x0d]+", text))
    low = [re.sub("[A-Z]", lambda m: m.group().lower(), m.group()) for m in found]
    groups = []
    for k, m in enumerate(found):
        if k == 0 or re.search("[.!?\n]", text[found[k - 1].start() : m.start()]):
            groups.append([])
        groups[-1].append(k)
    h = [word_hash(x) for x in low]
    least = [all(h[k] <= x for x in h[max(0, k - 2) : k + 3]) for k in range(len(h))]
    out = []
    for g in groups:
        out.append([])
        for k in g:
            out[-1].append(k)
            if len(g) > substring_dedup.LONG and least[k] and k != g[-1]:
                out.append([])
    begins = [0, *(found[g[0]].start() for g in out[1:]), len(text)]
    return [(a, b, tuple(low[k] for k in g)) for a, b, g in zip(begins[:-1], begins[1:], out, strict=True)] if out else []


def brute_dedup(rows, run, min_words, within):
    """(text, removed sentences, removed words) of each row."""
    texts = sorted({(i is not None, i or 0, k, t) for i, k, t in rows if t is not None})
    sentences, spans, first = {x: brute_sentences(x[3]) for x in texts}, {}, {}
    for x in texts:
        words = [w for *_, w in sentences[x]]
        for s in range(len(words)):
            e = s + run
            while sum(map(len, words[s:e])) < min_words and e <= len(words):
                e += 1
            if e <= len(words):
                h = sum(words[s:e], ())
                spans.setdefault(x, []).append((s, e, h))
                first.setdefault(h, (x, s))
    out = []
    for i, k, t in rows:
        x = (i is not None, i or 0, k, t)
        gone = set()
        for s, e, h in spans.get(x, []):
            if first[h][0] != x or within and first[h][1] != s:
                gone.update(range(s, e))
        parts = sentences.get(x, [])
        kept = t if not gone else "".join(t[a:b] for n, (a, b, _) in enumerate(parts) if n not in gone)
        out.append((i, kept, len(gone), sum(len(parts[n][2]) for n in gone)))
    return out


@pytest.mark.parametrize("within", [False, True])
def test_spans_against_brute_force(spark, prose, within):
    rng, rows = random.Random(12), []
    passages = [prose(700 + i, rng.choice([14, 40, 90]), rng.choice([3, 9, 10**6])) for i in range(8)]
    for i in range(120):
        parts = [prose(i, rng.randrange(0, 40), rng.choice([4, 10**6]))] + [rng.choice(passages) for _ in range(rng.randrange(3))] + [prose(1000 + i, rng.randrange(0, 30))]
        rows.append((i * 37 % 113, rng.choice([" ", "\n", ". "]).join(parts)))
    rows += [rows[0], rows[1], (None, rows[2][1]), (None, rows[3][1]), (None, passages[2]), (None, None), (7, None), (7, ""), (8, " \n"), (900, "la " * 400), (901, "la " * 300), (902, "li la " * 200), (903, "Été! " * 90), (904, "x" * 5000)]
    df = docs(spark, rows)
    keyed = [tuple(r) for r in df.select("doc_id", F.xxhash64("text"), "text").collect()]
    want = brute_dedup(keyed, 3, 12, within)
    got = substring_dedup.dedup(df, min_words=12, within=within).select("doc_id", "text", "removed_sentences", "removed_words").collect()
    assert Counter(tuple(r) for r in got) == Counter(want)
    assert sum(n > 0 for *_, n in want) > 60


def test_substring_edge_tables(spark, prose):
    assert substring_dedup.dedup(docs(spark, [])).count() == 0
    same = substring_dedup.dedup(docs(spark, [(1, prose(1, 50)), (1, prose(1, 50)), (None, prose(2, 50))])).collect()
    assert all(r["removed_words"] == 0 for r in same)
    # columns named like those in use, and like the result's own
    clash = spark.createDataFrame([(1, prose(1, 50), 5, 6, 7, 8, 9), (2, prose(1, 50), 5, 6, 7, 8, 9)], "doc_id long, text string, at int, of_id int, Of_Key int, removed_words int, other int")
    got = {r["doc_id"]: r for r in substring_dedup.dedup(clash).collect()}
    assert got[1].asDict().keys() == {"doc_id", "text", "at", "of_id", "Of_Key", "other", "removed_sentences", "removed_words"}
    assert (got[1]["removed_words"], got[2]["removed_words"], got[2]["at"], got[2]["other"]) == (0, 50, 5, 9)
    with pytest.raises(ValueError):
        substring_dedup.dedup(clash.withColumnRenamed("removed_words", "Removed_Sentences"), text_col="Removed_Sentences")


# personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(x):
    return sum((d if i % 2 == 0 else d * 2 - 9 * (d > 4)) for i, d in enumerate(map(int, reversed(x)))) % 10 == 0


def base(text):
    def ok(kind, m):
        digits = re.sub("[^0-9]", "", m)
        return kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m.split("."))) or (kind == "card" and 14 <= len(digits) <= 19 and luhn(digits)) or (kind == "phone" and 10 <= len(digits) <= 15)

    found = sorted((m.start(), j, m.end(), k) for j, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if ok(k, m.group()))
    return [f"{k}:{a}:{b}" for a, _, b, k in found]


def test_base_spans(spark):
    rng = random.Random(5)
    bits = ["a@b.co", "@", ".", "x_y", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (202) 555-0175", "+", "12", " ", "-", "é", "a@b.c_d@e.f.g", "mail me: ", "\n", "0001.2.3.4.5.6.7.8"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(25)))) for i in range(300)] + [(1000, None), (1001, ""), (1002, "9" * 20000), (1003, "a" * 30000 + "@b.c"), (1003, "a@b.c")]
    got = pii.report(docs(spark, rows)).collect()
    want = sorted((i, hashlib.sha256(",".join(base(t)).encode()).hexdigest(), sum(x.startswith("email") for x in base(t))) for i, t in rows)
    assert sorted((r["doc_id"], r["base_sha256"], r["n_email"]) for r in got) == want
    for r in got:
        assert r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] <= len([x for x in r["spans"].split(",") if x])


def test_masking(spark):
    rows = [(1, "mail é a@b.co now"), (2, "clean text"), (3, None), (4, "+1 (202) 555-0175")]
    got = {r["doc_id"]: r["text"] for r in pii.masked(docs(spark, rows)).collect()}
    assert got == {1: "mail é [EMAIL] now", 2: "clean text", 3: None, 4: "[PHONE]"}
    assert pii.report(docs(spark, [])).count() == 0


def _odds(codes, q):
    """One round of expectation-maximisation by plain sums: soft labels of (votes, feats, n) from soft labels."""
    mass = [sum(n * w for (_, _, n), w in zip(codes, q, strict=True)), sum(n * (1 - w) for (_, _, n), w in zip(codes, q, strict=True))]
    digits = lambda v: [v // 3**j % 3 for j in range(4)]
    cell = [[[0.5] * 3 for _ in range(4)] for _ in range(2)]
    for (v, _, n), w in zip(codes, q, strict=True):
        for j, x in enumerate(digits(v)):
            cell[0][j][x] += n * w
            cell[1][j][x] += n * (1 - w)
    out = []
    for v, _, _ in codes:
        odds = math.log((mass[0] + 1) / (mass[1] + 1))
        for j, x in enumerate(digits(v)):
            if x != 1:  # an abstention
                odds += math.log(cell[0][j][x] / (cell[0][j][0] + cell[0][j][2])) - math.log(cell[1][j][x] / (cell[1][j][0] + cell[1][j][2]))
        out.append(1 / (1 + math.exp(-odds)))
    return out


def test_expectation_maximisation_and_classifier(spark):
    """Soft labels and weights against plain sums and gradient steps."""
    rng = random.Random(8)
    codes = sorted({(rng.randrange(81), rng.randrange(64)): float(rng.randrange(1, 50)) for _ in range(12)}.items())
    codes = [(v, f, n) for (v, f), n in codes]
    df = spark.createDataFrame([([(v, f, n) for v, f, n in codes],)], "p array<struct<votes: int, feats: int, n: double>>")
    got = df.withColumn("q", pii.soft_labels(F.col("p"))).withColumn("w", pii.classifier(F.col("p"), F.col("q"))).first()
    q = [min(max(sum(v // 3**j % 3 for j in range(4)) / 8, 0.05), 0.95) for v, _, _ in codes]
    for _ in range(15):
        q = _odds(codes, q)
    assert got["q"] == pytest.approx(q, abs=1e-9)
    w, total = [0.0] * 7, 1 + sum(n for *_, n in codes)
    for _ in range(80):
        margin = [sum(w[i] * (f >> i & 1) for i in range(6)) + w[6] for _, f, _ in codes]
        r = [n * (x - 1 / (1 + math.exp(-m))) for (_, _, n), x, m in zip(codes, q, margin, strict=True)]
        pull = [sum(e * (f >> i & 1) for e, (_, f, _) in zip(r, codes, strict=True)) for i in range(6)] + [sum(r)]
        w = [a * 0.999 + 2.0 * p / total for a, p in zip(w, pull, strict=True)]
    assert got["w"] == pytest.approx(w, abs=1e-9)


def test_the_method_adds_spans(spark):
    """A number that no base pattern takes is found by what the labelers agree on elsewhere; base spans stay as they are."""
    rows = [(i, f"please call or phone 202-555-0{100 + i} today, my tel. +1 202 555 0{100 + i}") for i in range(60)]
    rows += [(100 + i, f"version no. 555.123.{4000 + i}/7 of the order") for i in range(20)] + [(500, "write to ann [at] example [dot] com")]
    clash = docs(spark, rows, "doc_id long, text string, spans string, found string, n string")
    got = {r["doc_id"]: r for r in pii.report(clash).collect()}
    added = [x for i in range(60) for x in got[i]["spans"].split(",") if x.startswith("phone:") and x not in base(rows[i][1])]
    assert len(added) == 60 and added[0] == "phone:21:33"
    for i, t in rows:
        assert set(base(t)) <= set(got[i]["spans"].split(",")) | {""} and got[i]["base_sha256"] == hashlib.sha256(",".join(base(t)).encode()).hexdigest()
    masked = {r["doc_id"]: r for r in pii.masked(clash).collect()}
    assert masked[0]["text"] == "please call or phone [PHONE] today, my tel. [PHONE]" and masked[0]["spans"] == "s"


def test_fit_learns_the_labelers(spark):
    rows = [(i, f"call {i} at 202-555-01{i:02d} or +1 202 555 01{i:02d}, card 4111 1111 1111 1111") for i in range(20)] + [(100 + i, f"order id {i}4111111111111112 version 1.2.3.999") for i in range(20)]
    fitted = {r["k"]: r for r in pii.fit(docs(spark, rows)).collect()}
    card = {x["p"]["votes"] % 3: x["q"] for x in fitted[2]["labelled"]}
    assert card[2] > 0.9 > 0.5 > card[0]


# language identification


@pytest.fixture(scope="module")
def model():
    counts = [("en", w, n) for w, n in [("the", 90), ("of", 50), ("house", 9), ("thing", 9), ("nothing", 1)]] + [("de", w, n) for w, n in [("der", 90), ("und", 50), ("haus", 9), ("schicht", 9), ("schach", 1)]]
    return langid.fit(counts)


def test_words_first_then_characters(spark, model):
    rows = [(1, "the house of"), (2, "und der haus"), (3, "thinghouse"), (4, "Schachhaus"), (5, None), (6, "123 !!"), (7, ""), (8, "THE OF")]
    schema = "doc_id long, text string, lang_score string, __lowered2 string, n string"
    got = {r["doc_id"]: r for r in langid.predict(docs(spark, rows, schema), model).collect()}
    assert {i: r["lang_pred"] for i, r in got.items()} == {1: "en", 2: "de", 3: "en", 4: "de", 5: "und", 6: "und", 7: "und", 8: "en"}
    assert all(0 <= r["score"] <= 1 for r in got.values())


def brute_scores(counts, text, min_count=3):
    """Sum of the words' scores in each language."""
    langs = sorted({lang for lang, *_ in counts})
    total = {x: 1 + sum(n for lang, _, n in counts if lang == x) for x in langs}
    known, grams = {}, {}
    for lang, word, n in counts:
        if n >= min_count:
            known.setdefault(word, {})[lang] = n
        marked = f"\x02{word}\x03"
        for size in range(1, 5):
            for end in range(2, len(marked) + 1):
                if end >= size:
                    c = grams.setdefault(marked[end - size : end], dict.fromkeys(langs, 0))
                    c[lang] += 1
    kept = {g: c for g, c in grams.items() if len(g) == 1 or sum(c.values()) > 1}

    def value(gram, lang):
        c = grams[gram][lang]
        if c:
            return math.log(c / sum(o[lang] for g, o in grams.items() if len(g) == len(gram) and g[:-1] == gram[:-1]))
        back = next((gram[k:] for k in range(1, len(gram)) if gram[k:] in kept), "")
        return (value(back, lang) if back else math.log(1e-4)) + math.log(0.4) * (len(gram) - len(back))

    out = dict.fromkeys(langs, 0.0)
    for word in re.findall("[a-z\x80-\U0010ffff]+", text.lower()):
        marked = f"\x02{word}\x03"
        for lang in langs:
            if word in known:
                out[lang] += math.log(max(known[word].get(lang, 0), 0.5) / total[lang])
                continue
            out[lang] += math.log(0.05)
            for end in range(2, len(marked) + 1):
                gram = next((marked[end - size : end] for size in (4, 3, 2, 1) if end >= size and marked[end - size : end] in kept), "")
                out[lang] += (value(gram, lang) if gram else math.log(1e-4)) + math.log(0.4) * (4 - len(gram))
    return [out[x] for x in langs]


def test_backoff_against_brute_force(prose):
    rng = random.Random(9)
    counts = sorted({(lang, "".join(rng.choice(letters) for _ in range(rng.randrange(1, 6)))): rng.choice([1, 1, 2, 3, 50]) for lang, letters in [("a", "abcé"), ("b", "bcdß"), ("c", "cdeñ")] for _ in range(60)}.items())
    counts = [(*k, n) for k, n in counts]
    model = langid.fit(counts)
    texts = [" ".join("".join(rng.choice("abcdeéßñ") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(6))) for _ in range(40)] + ["Abc!bcd,ÉZ", "", counts[0][1]]
    got = langid.score_batch(model, pa.array([t.lower() for t in texts]))
    for t, row in zip(texts, got.tolist(), strict=True):
        assert row == pytest.approx(brute_scores(counts, t), abs=1e-6)


def test_trained_by_spark_as_at_once(spark, prose):
    """Counts by Spark, rare words too, give the model of the same words counted in one place."""
    rows = [(i, prose(i, 30) + (f" {'é' * (i % 7)}un" if i % 2 else " der"), "en" if i % 3 else "de") for i in range(60)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5))
    counts = Counter((lang, w) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 3 != 1 for w in re.findall("[a-z\x80-\U0010ffff]+", t.lower()))
    whole = langid.fit([(*k, n) for k, n in sorted(counts.items())])
    assert model.langs == whole.langs and (model.words == whole.words).all() and np.allclose(model.word_scores, whole.word_scores)
    for a, b, x, y in zip(model.grams, whole.grams, model.gram_scores, whole.gram_scores, strict=True):
        assert (a == b).all() and np.allclose(x, y)


def test_language_columns(spark, model, prose):
    """Columns named like the result's own are replaced, others stay, whatever their names."""
    rows = [(1, "the house of " * 3000, "x", 7, 8, 9), (1, "the house of " * 3000, "x", 7, 8, 9), (None, "und der", None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Score string, lang_pred int, lowered int, letter int")
    for m in (model, None):
        got = langid.predict(df, m)
        assert got.columns == ["doc_id", "text", "lowered", "letter", "lang_pred", "score"]
        assert Counter((r["doc_id"], r["lang_pred"], r["lowered"]) for r in got.collect()) == Counter([(1, "en" if m else "und", 8)] * 2 + [(None, "de" if m else "und", None)])
        assert langid.predict(df.limit(0), m).count() == 0
    with pytest.raises(ValueError):
        langid.predict(df, model, text_col="Score")


def test_training_ignores_held_out_rows(spark):
    rows = [(i, "der und haus schicht" if i % 2 else "the of house thing", "de" if i % 2 else "en") for i in range(60)]
    rows = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else lang) for i, t, lang in rows] + [(100, None, "en"), (101, "the", None), (None, "the", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trained = langid.train(df)
    assert trained.langs == ["de", "en"]
    assert langid.train(df.limit(0)) is None
    assert {r["lang_pred"] for r in langid.predict(df, None).collect()} == {"und"}


# decontamination


def brute_tiles(a, b, least):
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        out.append((i, j, n))
        for k in range(n):
            free_a[i + k] = free_b[j + k] = False


def test_tiling_against_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 25))] for _ in range(2))
        assert decontam.tile(np.array(a), np.array(b), 3) == brute_tiles(a, b, 3)


def test_reordered_leaks_are_found(spark, prose):
    item = prose(11, 40)
    half = item.split()
    moved = " ".join(half[20:] + ["between"] + half[:20])
    rows = [(1, prose(12, 50) + " " + item), (2, moved.upper() + "!"), (3, prose(13, 300)), (4, None), (5, ""), (6, item), (6, item)]
    bench = spark.createDataFrame([(10, item, 1), (11, prose(14, 30), 1), (12, None, 1), (13, "", 1)], "item_id long, text string, doc_id int")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontam.leaks(docs(spark, rows), bench).collect())
    assert got == [(1, 10), (2, 10), (6, 10), (6, 10)]
    assert sorted(r["doc_id"] for r in decontam.clean(docs(spark, rows), bench).collect()) == [3, 4, 5]
    small = decontam.leaks(docs(spark, rows), bench, block_tokens=1)
    assert sorted((r["doc_id"], r["item_id"]) for r in small.collect()) == got
    assert decontam.leaks(docs(spark, rows), bench.limit(0)).count() == 0
    assert decontam.clean(docs(spark, rows), bench.limit(0)).count() == len(rows)
    assert sorted(r["doc_id"] for r in decontam.clean(docs(spark, rows), bench, block_tokens=1).collect()) == [3, 4, 5]
    assert decontam.leaks(docs(spark, []), bench).count() == 0


def test_leaks_against_brute_force(spark, prose):
    """The whole query: every text against every item, without seeds or blocks; very long texts too."""
    rng, items = random.Random(31), []
    for i in range(14):
        items.append((i, prose(i, rng.choice([3, 5, 12, 40, 60]))))
    items += [(20, items[4][1]), (20, items[4][1]), (21, None), (22, "?!"), (23, "One two")]
    rows = []
    for d in range(60):
        w = prose(500 + d, rng.randrange(0, 60)).split()
        for _ in range(rng.randrange(3)):
            x = rng.choice(items[:14])[1].split()
            cut = rng.randrange(len(x) + 1)
            w += rng.choice([x, x[cut:] + w[:2] + x[:cut], x[: len(x) // 2]])
        rows.append((d // 2, " ".join(w).upper() if d % 3 else ", ".join(w)))
    rows += [(99, None), (98, ""), (None, items[3][1]), (97, "one TWO"), (96, prose(9, 20_000) + " " + items[5][1])]
    bench = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, doc_id string")
    words = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    want = Counter()
    for i, t in rows:
        b = words(t)
        for k, x in items:
            a = words(x)
            if not a or len(b) > 1000 and k != 5:
                continue
            tiles = brute_tiles(a, b[-200:], min(5, len(a)))
            covered = sum(n for *_, n in tiles)
            if covered >= 0.5 * len(a):
                want[i, k, len(a), covered, len(tiles)] += 1
    columns = ["doc_id", "item_id", "tokens", "covered", "tiles"]
    for options in ({}, {"block_tokens": 100}):
        got = decontam.leaks(docs(spark, rows), bench, **options).select(*columns).collect()
        assert Counter(tuple(r) for r in got if r["doc_id"] != 96 or r["item_id"] == 5) == want
    assert len(want) > 20


# near copies


def brute_classes(rows, percent=75):
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    part = list(range(len(rows)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                part[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(rows):
        least[find(x)] = min(least.get(find(x), i), i)
    return sorted((i, len(sets[x]), least[find(x)]) for x, (i, _) in enumerate(rows))


def test_classes_against_brute_force(spark, prose):
    rng, rows = random.Random(4), []
    for g in range(12):  # families of near copies around a text that may be missing
        words = prose(100 + g, rng.choice([3, 8, 40, 120])).split()
        for _ in range(rng.randrange(1, 14)):
            w = list(words)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(1000)}"
            rows.append((len(rows) * 7 % 1009, " ".join(w)))
    common = prose(999, 30)
    rows += [(2000 + i, common + " " + prose(500 + i, 20)) for i in range(15)]
    rows += [(3000, None), (3001, ""), (3002, "One"), (3003, "one"), (3004, "one  two three"), (3005, " \t\n"), (3006, common), (3006, common)]
    got = sorted(tuple(r) for r in jaccard.classes(docs(spark, rows)).collect())
    assert got == brute_classes(rows)


def test_bitmaps_count_all_bits():
    """The bound is the number of differing bits, the top one of a word too."""
    maps = np.zeros((2, jaccard.MAP_WORDS), np.int64)
    maps[1, 0], maps[1, 3] = np.iinfo(np.int64).min + 32, -1
    table = {"g": [1, 2], "n": [200, 200], "c": [1, 2], "lead": [False, False], "own": [0, 0], "low": [0, 0], "high": [0, 0], **{m: maps[:, k] for k, m in enumerate(jaccard._maps)}}
    assert jaccard._across(75, False)(pa.table(table)).num_rows == 0  # 66 bits apart: 200 and 200 may differ by 57
    maps[1, 3] = 0
    assert jaccard._across(75, False)(pa.table(table | {m: maps[:, k] for k, m in enumerate(jaccard._maps)})).to_pydict() == {"a": [1], "b": [2]}


@pytest.mark.parametrize("parts", [1, 7])
def test_long_lists_in_blocks(spark, prose, monkeypatch, parts):
    """Lists longer than a block, under several partition counts; many rows without identifiers."""
    monkeypatch.setattr(jaccard, "LIST", 5)
    rng, rows = random.Random(21), []
    common = prose(800, 60).split()
    for i in range(90):
        w = common[: rng.choice([60, 60, 30])] + [f"f{i // 3}x{k}" for k in range(rng.choice([0, 8, 16]))]
        w[rng.randrange(len(w))] = f"own{i}"
        rows.append((i, " ".join(w)))
    got = sorted(tuple(r) for r in jaccard.classes(docs(spark, rows).repartition(parts)).collect())
    assert got == brute_classes(rows)
    assert len({c for *_, c in got}) > 2
    none = jaccard.classes(docs(spark, [(None, t) for _, t in rows[:40]])).collect()
    assert len(none) == 40 and all(r["component_id"] is None for r in none)


def test_links_without_the_leader(spark):
    """Pairs that link with each other alone, among many texts that share their prefix tokens."""
    rows = []
    for f in range(4):
        base = [f"w{f}x{k}" for k in range(200)]
        for at in range(0, 181, 10):
            for _ in range(2):
                i = len(rows)
                rows.append((i, " ".join(base[:at] + [f"own{i}x{k}" for k in range(20)] + base[at + 20 :])))
    want = brute_classes(rows)
    assert all(c == i - i % 2 for i, _, c in want)
    assert sorted(tuple(r) for r in jaccard.classes(docs(spark, rows)).collect()) == want


def test_no_documents(spark):
    assert jaccard.classes(docs(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(5, 5)]
    part = {x: x for e in edges for x in e}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        part[y] = x
    got = {r[0]: r[1] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}


# toxicity


def test_risk_and_its_gradient():
    """The step is the gradient of the corrected risk, and against that of a negative risk below zero; by plain sums and
    finite differences."""
    rng = np.random.default_rng(3)
    sets = lambda n: [np.flatnonzero(rng.random(6) < 0.4) for _ in range(n)]
    flat = lambda x: (np.repeat(np.arange(len(x)), [len(r) for r in x]), np.concatenate(x), len(x))
    seen = set()
    for _ in range(30):
        pos, unl, w, prior = sets(9), sets(14), rng.normal(size=7) * 2, rng.uniform(0.1, 0.9)

        def parts(w, pos=pos, unl=unl, prior=prior):
            g = lambda x: sum(w[i] for i in x) + w[-1]
            loss = lambda z: math.log1p(math.exp(-z))
            return prior * sum(loss(g(x)) for x in pos) / 9, sum(loss(-g(x)) for x in unl) / 14 - prior * sum(loss(-g(x)) for x in pos) / 9

        risks, step = toxicity.risk_and_step(w, flat(pos), flat(unl), prior)
        assert risks == pytest.approx(parts(w))
        seen.add(bool(risks[1] < 0))
        for k in range(7):
            h = np.eye(7)[k] * 1e-5
            up, down = parts(w + h), parts(w - h)
            slope = [(a - b) / 2e-5 for a, b in zip(up, down, strict=True)]
            assert step[k] == pytest.approx(-slope[1] if risks[1] < 0 else sum(slope), abs=1e-6)
    assert seen == {True, False}


def test_scores_by_hand(spark, prose):
    """Scores of whole texts against sums of weights; columns named like the result's own are replaced."""
    pos = [np.unique(toxicity.hashed_words(pa.array([f"vermin {prose(i, 30)}"]))[0]) for i in range(40)]
    unl = [np.unique(toxicity.hashed_words(pa.array([prose(100 + i, 30)]))[0]) for i in range(80)]
    model = toxicity.fit(pos, unl, 0.2)
    rows = [(1, "vermin"), (2, "Vermin vermin! " * 4000 + prose(1, 10)), (2, "vermin"), (3, None), (4, ""), (None, "the stone")]
    df = spark.createDataFrame([(i, t, 1, "p", 5) for i, t in rows], "doc_id long, text string, Predicted int, score string, lowered int")
    got = toxicity.score(df, model)
    assert got.columns == ["doc_id", "text", "lowered", "score", "predicted"]
    for r in got.collect():
        words = {w for w in re.findall("[a-z]+", (r["text"] or "").lower())}
        at = {int(model.slot[toxicity.hashed_words(pa.array([w]))[0][0]]) for w in words} - {-1}
        p = 1 / (1 + math.exp(-sum(model.weights[k] for k in at) - model.bias))
        assert r["score"] == pytest.approx(p) and r["predicted"] == (p >= 0.3)
    assert toxicity.score(df.limit(0), model).count() == 0


def test_positive_unlabelled_learning(spark, prose):
    rng, rows, labels = random.Random(6), [], []
    for i in range(600):
        bad = i % 6 == 0
        rows.append((i, prose(i, 60) + (" " + rng.choice(["vermin", "scoundrel", "cretin"]) if bad else "")))
        if i % 5 < 2:
            labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (None, "vermin")]
    schema = "doc_id long, text string, label string, predicted_ string, n string"
    df, known = docs(spark, rows, schema), spark.createDataFrame([*labels, (None, 1), (3, None), (0, 1)], "doc_id long, toxic int")
    got = toxicity.score(df, toxicity.train(df, known)).collect()
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 600 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    right = sum((r["predicted"] == 1) == (r["doc_id"] % 6 == 0) for r in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got) and len(got) == len(rows)
    none = toxicity.score(df, toxicity.train(df, known.limit(0))).agg(F.max("score")).first()[0]
    assert none < 0.01
