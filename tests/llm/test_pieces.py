"""Piece encoding against the sentencepiece library."""

import random

import public_tokenizers
import pytest
import sentencepiece

from powerlens.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_random_texts_equal_the_library(library):
    rng = random.Random(7)
    model = pieces.load(PATH)
    kinds = [
        list("  \n\t▁abethinor.,'éß梦\x00　<0x>A1😀́"),
        ["▁", " ", "  ", "a", " th", "\n", " \n", "\n "],
        ["aa", "a", "in", "inin", "er", "0", "00", "==", "="],
    ]
    for k in range(3000):
        text = "".join(rng.choice(kinds[k % 3]) for _ in range(rng.choice([1, 3, 8, 40, 200])))
        ids = model.encode(text).tolist()
        assert ids == library.encode(text), text
        assert model.decode(ids) == library.decode(ids), text


def test_random_ids_decode_like_the_library(library):
    rng = random.Random(8)
    model = pieces.load(PATH)
    for _ in range(2000):
        ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(259) for _ in range(rng.choice([1, 2, 5]))]
        assert model.decode(ids) == library.decode(ids), ids


def test_long_word_and_edges(spark, library):
    texts = [None, "", " ", "a" * 30_000, "no spaces " * 4000, "\x00", "▁▁", "the end"]
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    out = pieces.decode(pieces.encode(df, PATH), PATH).orderBy("doc_id").collect()
    for row, t in zip(out, texts, strict=True):
        assert row["ids"] == library.encode(t or "")
        assert row["decoded"] == library.decode(row["ids"])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.decode(pieces.encode(df, PATH), PATH).count() == 0


def test_cache_turnover(monkeypatch, library):
    monkeypatch.setattr(pieces, "CACHED_WORDS", 3)
    model = pieces.PieceModel(PATH)
    for text in ("one two three four five", "one six seven two", "one two three") * 3:
        assert model.encode(text).tolist() == library.encode(text)
