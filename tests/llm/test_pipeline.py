"""The pipeline over a small corpus of known content."""

import corpus_pipeline
from tidelog.llm.tokens import Encoder


def test_stages(spark, prose, tmp_path):
    item = prose(77, 40)
    rows = [(i, prose(i, 60), "en", "s", 0) for i in range(40)]
    rows += [(100, rows[0][1], "en", "s", 0), (101, rows[1][1] + " more", "en", "s", 0), (102, "1234 5678", "en", "s", 0), (103, None, "en", "s", 0), (104, prose(200, 30) + " " + item, "en", "s", 0), (105, prose(201, 30) + " a@b.co", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {i: t for i, t, *_ in rows if i < 100}
    kept[105] = prose(201, 30) + " [EMAIL]"
    assert {r["doc_id"] for r in got} == set(kept)
    e = Encoder()
    assert sum(r["length"] for r in got) == sum(len(e.encode([t])[0]) for t in kept.values())


def test_near_duplicates_by_row(spark, prose):
    """Rows that share an identifier, or have none, are told apart by their texts."""
    a, b, c, d, e = (prose(i, 60) for i in (300, 301, 302, 303, 304))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (3, c.upper()), (None, d), (None, d), (None, a), (4, d + " more"), (None, e), (None, e), (5, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    want = [(1, a), (2, b), (3, c.upper()), (4, d + " more"), (None, e), (5, None), (5, "")]
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted(want, key=repr)
    assert got[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}


def test_texts_of_no_learned_language_go(spark, prose):
    rows = [(i, prose(i, 60), "en", "s", 0) for i in range(40)] + [(50, "xq zvw qqk wvx pqz jjx", None, "s", 0), (51, "mi huomenna menemme metsaan katsomaan lintuja", None, "s", 0), (52, "river stonely thorning heathstone", None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.language(spark, docs, "")
    assert got.columns == docs.columns
    assert {r["doc_id"] for r in got.collect()} == {*range(40), 52}


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred int, spans int, found int, gone int, sig string, words int, keep_id int, row int, lowered int"


def odd(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, None, f"s{k}", 1, 2, 3, 4, "five", 6, 7, 8, 9) for k, (i, t, lang) in enumerate(rows)], COLUMNS)


def test_stages_on_odd_tables(spark, prose, tmp_path):
    """Nulls in every column, repeated rows and identifiers, very long and empty texts, and columns with names that stages use."""
    item, long = prose(77, 40), prose(5, 30_000)
    spark.createDataFrame([(1, item, 5), (1, item, 5), (None, None, 5), (2, "", 5)], "item_id long, text string, doc_id int").write.parquet(f"{tmp_path}/benchmark.parquet")
    learn = [(i, prose(i, 60), "en") for i in range(40)]
    rows = [*learn, learn[3], (3, prose(400, 50), None), (None, prose(401, 50), None), (None, None, None), (60, None, "en"), (61, "", "en"), (62, " \n ", "xx"), (63, "12 !? 34", "en"), (64, long, "en"), (65, prose(6, 30) + " " + item, "en"), (65, prose(7, 30) + " mail a@b.co", "en")]
    df, d = odd(spark, rows), str(tmp_path)
    told = lambda got: sorted(((r["doc_id"], r["text"]) for r in got), key=repr)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        got = stage(spark, df, d)
        assert got.dtypes == df.dtypes, name
        kept = got.collect()
        assert all(r["score"].startswith("s") and (r["lang_pred"], r["spans"], r["found"], r["gone"], r["sig"], r["words"], r["lowered"]) == (1, 2, 3, 4, "five", 6, 9) for r in kept)
        want = {
            "language": [(i, t) for i, t, _ in rows if t and any(c.isalpha() for c in t)],
            "near_duplicates": [(i, t) for n, (i, t, _) in enumerate(rows) if n != 40],
            "benchmark": [(i, t) for i, t, _ in rows if item not in (t or "")],
            "personal_data": [(i, t and t.replace("a@b.co", "[EMAIL]")) for i, t, _ in rows],
        }[name]
        assert told(kept) == sorted(want, key=repr), name
        empty = stage(spark, df.limit(0), d)
        assert empty.count() == 0 and empty.dtypes == df.dtypes
    e = Encoder()
    pieces = corpus_pipeline.packed(spark, df, d).collect()
    assert sum(r["length"] for r in pieces) == len(e.encode([t for _, t, _ in rows])[0])
    assert corpus_pipeline.packed(spark, df.limit(0), d).count() == 0


def test_no_benchmark_and_no_languages(spark, prose, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = odd(spark, [(i, prose(i, 30), None) for i in range(5)])
    assert corpus_pipeline.benchmark(spark, df, str(tmp_path)).count() == 5
    assert corpus_pipeline.language(spark, df, str(tmp_path)).count() == 0
