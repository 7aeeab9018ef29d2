"""The corpus pipeline stage by stage against plain versions, on the small tables with odd rows added."""

import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as CP
from powerlens.llm import pii
from test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LONG = " ".join(f"w{i * i % 9973}" for i in range(30_000))
ODD = [
    (90_001, None, None, None, None), (90_002, "", "en", "web", 0), (90_003, " \n\t ", "en", "web", 4), (90_004, LONG, "en", "web", len(LONG)),
    (90_005, "Write to ann.lee@example.org or +1 (555) 010-9999 about the seventh harbour report", "en", "books", 83),
    (90_006, "The server 10.20.30.40 holds card 4111 1111 1111 1111 for the eastern tram depot", "en", None, 80),
    (90_007, "one unrepeated line on slow green ferries crossing at dawn", "en", "web", 58),
    (90_008, "one unrepeated line on slow green ferries crossing at dawn", "fr", "books", 58),
    (90_008, "one unrepeated line on slow green ferries crossing at dawn", "fr", "books", 58),
]
RUDE = ["grobnik", "vlatching", "smurdle", "quaffoon"]


def planted():
    """240 texts of 40 plain words, a rude one in each ten of every third: (id, text, toxic); the last 60 carry no label."""
    rnd = random.Random(5)
    for i in range(240):
        words = [rnd.choice("aeiou").join(rnd.choices("bdklmnprst", k=3)) for _ in range(40)]
        if i % 3 == 0:
            words[::10] = rnd.choices(RUDE, k=4)
        yield 80_000 + i, " ".join(words), int(i % 3 == 0)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(folder of the tables, rows after each stage, from the documents on)."""
    sf = str(tmp_path_factory.mktemp("sf"))
    spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS).unionByName(
        spark.createDataFrame([*ODD, *((i, t, "en", "web", len(t)) for i, t, _ in planted())], "doc_id long, text string, lang string, source string, n_chars long")).write.parquet(f"{sf}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in planted() if i < 80_180], "doc_id long, quality int, toxic int")
    spark.read.parquet(f"{SF}/labels.parquet").unionByName(labels).write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    after = [docs]
    for i, (_, stage) in enumerate(CP.STAGES):
        stage(spark, after[-1], sf).write.parquet(f"{sf}/after-{i}")
        after.append(spark.read.parquet(f"{sf}/after-{i}"))
    return sf, after


def test_columns(stages):
    _, after = stages
    for df in after[:-1]:
        assert sorted(df.columns) == sorted(COLUMNS)


def test_toxicity_drops_toxic_texts_only(spark, stages):
    sf, after = stages
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()} | {i for i, _, t in planted() if t}
    before, kept = rows(after[0].select(*COLUMNS)), rows(after[1].select(*COLUMNS))
    dropped = {r[0] for r in Counter(before) - Counter(kept)}
    assert not Counter(kept) - Counter(before)
    assert dropped <= toxic  # the odd rows and all clean texts stay
    assert dropped >= {i for i, _, t in planted() if t}  # those without a label too


def test_simhash_keeps_one_of_each_group(stages):
    _, after = stages
    before, kept = rows(after[1].select(*COLUMNS)), rows(after[2].select(*COLUMNS))
    component = plain_components([(r[0], plain_fingerprint(r[1], 3)) for r in before], 2)
    assert sorted(r[0] for r in kept) == sorted(set(component))
    assert not Counter(kept) - Counter(before)


def test_pii_leaves_no_base_span_and_other_texts_alone(stages):
    _, after = stages
    before = {r[0]: r for r in rows(after[2].select(*COLUMNS))}
    got = {r[0]: r for r in rows(after[3].select(*COLUMNS))}
    assert got.keys() == before.keys()
    for doc_id, (_, text, lang, source, n_chars) in got.items():
        assert (lang, source) == before[doc_id][2:4]
        if text is None:
            assert before[doc_id][1] is None and n_chars == before[doc_id][4]
            continue
        assert n_chars == len(text) and not pii.base_spans(text)
        if not pii.base_spans(before[doc_id][1]):
            assert text == before[doc_id][1]
    changed = [d for d in got if got[d][1] != before[d][1]]
    assert {90_005, 90_006} <= set(changed)
    assert "seventh harbour report" in got[90_005][1] and "ann.lee" not in got[90_005][1]


def test_mix_keeps_every_document_and_repeats_small_sources(stages):
    _, after = stages
    before, mixed = Counter(rows(after[3].select(*COLUMNS))), Counter(rows(after[4].select(*COLUMNS)))
    assert mixed.keys() == before.keys()
    assert all(1 <= n <= 4 * before[r] for r, n in mixed.items())


def test_pieces_are_the_librarys(stages):
    _, after = stages
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(CP.PIECES))
    want = sorted((r.doc_id, r.source, tuple(library.encode(r.text or ""))) for r in after[4].collect() if r.source)
    assert sorted((r.doc_id, r.source, tuple(r.ids)) for r in after[5].collect() if r.source) == want
    assert after[5].where(F.size("ids") != F.col("n_tokens")).count() == 0
    assert after[5].count() == after[4].count()


def test_run_is_the_stages_in_turn(spark, stages):
    sf, after = stages
    columns = ["doc_id", "source", "n_tokens", "ids"]
    assert rows(CP.run(spark, sf).select(*columns)) == rows(after[5].select(*columns))


def test_empty_tables(spark, tmp_path):
    sf = str(tmp_path)
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{sf}/{name}.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [stage(spark, docs, sf).count() for _, stage in CP.STAGES] == [0] * len(CP.STAGES)


def test_extra_columns_with_clashing_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40)
    extra = ["severity", "Fingerprint", "component_id", "position", "key", "words", "spans", "ids", "n_tokens", "toxic", "block"]
    for _, stage in CP.STAGES[:-1]:
        plain, more = stage(spark, docs, SF), stage(spark, docs.select("*", *[F.lit("z").alias(c) for c in extra]), SF)
        assert set(more.columns) == {*docs.columns, *extra}
        assert rows(more.select(*COLUMNS)) == rows(plain.select(*COLUMNS))
