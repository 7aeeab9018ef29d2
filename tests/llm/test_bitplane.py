"""Id files: planes, round trip, and encoding against the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from powerlens.llm import bitplane

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("planes", ["byte", "bit"])
@pytest.mark.parametrize("n", [1, 7, 8, 1000])
def test_planes_round_trip(planes, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    for x in (ids, ids % 49408, ids * 0):
        assert np.array_equal(bitplane.from_planes(bitplane.to_planes(x, planes), n, planes), x)


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_file_round_trip(planes, tmp_path):
    rng = np.random.default_rng(1)
    docs = [(i, rng.integers(0, 49408, n, dtype=np.uint32)) for i, n in enumerate([0, 1, 63, 64, 65, 1000, 0, 3])] + [(None, np.array([5], np.uint32))]
    with open(tmp_path / "x.ids", "wb") as f:
        w = bitplane.Writer(f, planes, 64)
        for d, ids in docs:
            w.add(d, ids)
        w.close()
    back = list(bitplane.read_docs(pa.OSFile(str(tmp_path / "x.ids"), "rb")))
    assert [d for d, _ in back] == [d for d, _ in docs]
    assert all(np.array_equal(a, b) for (_, a), (_, b) in zip(back, docs, strict=True))


def test_incomplete_file_is_refused():
    with pytest.raises(ValueError):
        bitplane.read_index(pa.BufferReader(b"BITPLANE" + bytes(40)))


def test_words_equal_the_library():
    library, own = Tokenizer.from_file(PATH), bitplane.WordEncoder(PATH)
    for text in ("It's  the\nEND.\t<|endoftext|>x", " a　b ", "é é ΣΑΣ ok", "<|startoftext|> 12 3", "", "\x1c\x85a", "don't we'LL",
                 "a.b a,. ,a <|endoftext|> 0 0. x0 ªº ÿß ÀÉ! É́ é \x00 a\x00 ~~`` '' a' a-b a--  (x) x) %%% &&& ÷×", "naïve!!! Straße, ÆON;", "<|ENDOFTEXT|> x<|endoftext|>,Y"):
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_written_and_read_back(spark, tmp_path):
    texts = [(4, "the cat"), (1, None), (2, ""), (None, "null id"), (3, "word " * 20_000), (3, "tie"), (9, "last")]
    df = spark.createDataFrame([(d, t, 1) for d, t in texts], "doc_id long, text string, start int")
    manifest = bitplane.write_ids(df, PATH, f"file://{tmp_path}/ids", end_id=2, files=3, block_ids=128, planes="bit")
    rows = bitplane.read_ids(spark, manifest).collect()
    library = Tokenizer.from_file(PATH)
    rows.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 3, 4, 9]
    want = sorted((zlib.crc32(np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()), d) for d, t in texts if d != 3)
    assert sorted((zlib.crc32(r["ids"]), r["doc_id"]) for r in rows if r["doc_id"] != 3) == want
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    manifest = bitplane.write_ids(df, PATH, f"file://{tmp_path}/ids", end_id=2, files=2)
    assert bitplane.read_ids(spark, manifest).count() == 0


def test_random_words_equal_the_library(monkeypatch):
    import random

    monkeypatch.setattr(bitplane, "CACHED_WORDS", 50)
    library, own, rng = Tokenizer.from_file(PATH), bitplane.WordEncoder(PATH), random.Random(5)
    signs = "aAzZéÉßÿ×÷.,!?;:#%$&*\"'()-<>|_`~^0 \n\t 9xyèñ́ªΣ"
    for _ in range(4000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(60)))
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
