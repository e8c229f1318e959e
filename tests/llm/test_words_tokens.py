import random
import re
import struct

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.llm import coder, token_files
from tidelog.llm.tokens import Encoder
from tidelog.llm.words import shingles_of, slices, words_of


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbBé \t\n ", max_size=30)), max_size=8))
def test_words_and_shingles(texts):
    w = words_of(pa.array(texts, pa.string()))
    plain = [re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) for t in texts]
    assert np.diff(w.first).tolist() == [len(p) for p in plain]
    hashes, seen = w.hash.tolist(), {}
    for h, word in zip(hashes, [x for p in plain for x in p], strict=True):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    sets = [{tuple(p[i : i + 5]) for i in range(max(1, len(p) - 4))} if p else set() for p in plain]
    assert [len(s) for s in shingles_of(w)] == [len(s) for s in sets]


def test_slices_cover_the_batch():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * n for n in (1, 50, 3, 0, 200, 2)], "i": list(range(6))})
    assert [i for p in slices(batch, "text", 60) for i in p.column("i").to_pylist()] == list(range(6))


@pytest.fixture(scope="module")
def enc():
    return Encoder()


CASES = ["", None, " a", "a  b", "a\n\n b", "x\n", "<|endoftext|>", "a b", "a \nb\n\n\nc", "\n\n", "é !! don't 've", "A B\tC", "the cat.\nSat on the mat, 12 34", "日本語 テスト 🙂 ok", "a\u00a0 b", "\u2003x", "x \u3000 y", "don't x's\n\ny\n z", "l'été d'où", "é\n\u0085x", "a\x1cb c\x00 d", "9 a1 1a ___ _a", "ﬁn Ⅷ ²x", "x" * 3000 + " y"]


def test_encoder_is_exact(enc):
    rng = random.Random(1)
    texts = CASES + ["".join(rng.choice(["the", " ", "\n", "Cat", "'s", "é", "12", "!", "\t", " "]) for _ in range(rng.randrange(40))) for _ in range(300)]
    odd = " \n\t\x0b\r\x1c\x85\u00a0\u2003\u3000'stdmrevlASé9²!.,_|<>"
    texts += ["".join(rng.choice(odd) for _ in range(rng.randrange(30))) for _ in range(2000)]
    ids, at = enc.encode(texts)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == [*enc.library.encode(t or "", add_special_tokens=False).ids, 0], t


def test_encoder_is_the_plain_library(enc):
    from tokenizers import Tokenizer

    from tidelog.llm.tokens import default_path

    plain = Tokenizer.from_file(default_path())
    texts = [*CASES, "x <|endoftext|> y", "x<|endoftext|>y", "<|endoftext|> <|endoftext|>", "a\n<|endoftext|>", "x <|endoftext| > y"]
    ids, at = enc.encode(texts)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == [*plain.encode(t or "", add_special_tokens=False).ids, 0], t


@pytest.mark.parametrize("n", [0, 1, 2, 5, coder.BLOCK, 2 * coder.BLOCK + 7])
@pytest.mark.parametrize("top", [1, 2, 300, 65536])
def test_coder_round_trip(spark, n, top):
    rng = np.random.default_rng(n)
    for x in (rng.integers(0, top, n), np.minimum(rng.zipf(1.3, n), top) - 1):
        coded = coder.encode(spark, x)
        assert (coder.decode(spark, coded) == x).all() and len(coded) <= 3 * n + 32 * (1 + n // coder.BLOCK)


def _blocks(coded):
    """(ids, bytes) of each block."""
    at, out = 0, []
    while at < len(coded):
        n, size, _ = struct.unpack_from(token_files.HEAD, coded, at)
        out.append((n, coded[at : at + token_files.HEAD_BYTES + size]))
        at += token_files.HEAD_BYTES + size
    return out


def test_blocks_stand_alone_and_damage_is_found(spark):
    x = np.tile(np.random.default_rng(1).integers(0, 5000, 999), 80)
    blocks = _blocks(coder.encode(spark, x))
    assert [n for n, _ in blocks] == [coder.BLOCK] * (len(x) // coder.BLOCK) + [len(x) % coder.BLOCK]
    for k, (n, block) in enumerate(blocks):
        assert (coder.decode(spark, block) == x[k * coder.BLOCK :][:n]).all()
    for at in (0, 5, 9, 20, 300):
        broken = bytearray(blocks[0][1])
        broken[at] ^= 255
        with pytest.raises(ValueError):
            coder.decode(spark, bytes(broken))
    with pytest.raises(ValueError):
        coder.encode(spark, np.array([70000]))


def test_orders_beat_counts_alone(spark, enc, prose):
    """Mixed orders cost less than the entropy of the ids' own frequencies, and than general compression."""
    import zlib

    ids, _ = enc.encode([prose(i, 400) + " of the " + prose(1000 + i % 40, 60) for i in range(120)])
    n, bits = len(ids), 8 * len(coder.encode(spark, ids)) / len(ids)
    share = np.bincount(ids)[np.unique(ids)] / n
    assert bits < -(share * np.log2(share)).sum() and bits < 8 * len(zlib.compress(ids.astype("<u2").tobytes(), 9)) / n
    repeated = np.tile(np.arange(50), 400)
    assert 8 * len(coder.encode(spark, repeated)) < 1.0 * len(repeated)


def expected(spark, texts, enc):
    """(doc_id, start, n_tokens, ids_crc32) in order of identifier (none first), then of the text's hash, then of the text."""
    import zlib

    hashed = spark.createDataFrame([(t or "",) for _, t in texts], "t string").select("t", F.xxhash64("t")).collect()
    of, start, want = {r[0]: r[1] for r in hashed}, 0, []
    for i, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, of[x[1] or ""], x[1] or "")):
        ids = [*enc.library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return want


def test_token_files(spark, enc, prose, monkeypatch):
    texts = [(3, "the cat sat"), (1, None), (2, "the cat sat. " * 900), (7, ""), (5, "x"), (None, "no id"), (5, "y"), (5, "y"), (8, prose(3, 9000))]
    texts += [(100 + i, prose(i, i % 50)) for i in range(150)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, start string, n_tokens int")
    want = expected(spark, texts, enc)
    assert [tuple(r) for r in token_files.encoded(df).orderBy("start").collect()] == want
    assert token_files.encoded(df.limit(0)).count() == 0
    # many files and groups: documents over several groups, files of one document
    monkeypatch.setattr(token_files, "GROUP", 700)
    for options in ({"file_ids": 1000}, {"file_docs": 3}, {"file_ids": 1}):
        manifest = token_files.write_files(df, token_files.new_folder(spark, "test"), **options)
        assert [tuple(r) for r in token_files.read_files(manifest).orderBy("start").collect()] == want
        assert manifest.count() > 4


def test_damaged_files_are_refused(spark, tmp_path):
    df = spark.createDataFrame([(1, "the cat sat")], "doc_id long, text string")
    manifest = token_files.write_files(df, f"file://{tmp_path}")
    path = manifest.first()["path"].removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[22] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="damaged"):
        token_files.read_files(manifest).collect()
    open(path, "wb").write(b"other")
    with pytest.raises(Exception, match="not a token file"):
        token_files.read_files(manifest).collect()
