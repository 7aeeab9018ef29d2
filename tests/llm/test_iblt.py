"""Sketches: peeling against set differences, neighbours and edits against plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from powerlens.llm import iblt


@pytest.mark.parametrize("full", [32, 400])  # 400: the first sketch is too small, so splits are retried
def test_differences_equal_sets(spark, full):
    rng = random.Random(full)
    rows = []
    for k in range(120):
        shared = {rng.getrandbits(63) for _ in range(rng.choice([0, 1, 10, 60, 300]))}
        a, b = ({rng.getrandbits(63) for _ in range(rng.choice([0, 0, 1, 5, 40, 200]))} for _ in range(2))
        rows.append((k, sorted(shared | a), sorted(shared | b)))
    rows.append((200, [], []))
    got = {r.key: r.differ for r in iblt.differences(spark.createDataFrame(rows, "key int, a array<bigint>, b array<bigint>"), full).collect()}
    assert got == {k: len(set(a) ^ set(b)) for k, a, b in rows}


def test_peeling_recovers_the_digests(spark):
    df = spark.createDataFrame([([1, 2, 3, 50], [3, 4, 50]), ([], []), ([7], [7])], "a array<bigint>, b array<bigint>")
    seed = F.lit(0)
    rows = df.select(iblt.peeled(iblt.subtracted(iblt.sketch(F.col("a"), seed), iblt.sketch(F.col("b"), seed)), seed).alias("f")).collect()
    assert [sorted((x.k, x.n) for x in r.f) for r in rows] == [[(1, 1), (2, 1), (4, -1)], [], []]
    # far more than the cells can hold: failure, not a wrong answer
    full = spark.createDataFrame([(list(range(1000)), [0])], "a array<bigint>, b array<bigint>")
    assert full.select(iblt.peeled(iblt.subtracted(iblt.sketch(F.col("a"), seed), iblt.sketch(F.col("b"), seed)), seed)).first()[0] is None


def plain_paragraphs(text):
    out = set()
    for line in re.split(r"\n", text):
        words = re.findall(r"[^ \t\n\x0b\f\r]+[ \t\x0b\f\r]*", line)
        out |= {"".join(words[k:k + iblt.WORDS]).rstrip(" ") for k in range(0, len(words), iblt.WORDS)}
    return out


def plain(rows):
    """By id: (n_chars, sha of the edited text, likeness to it, likeness to the next)."""
    order = sorted((t or "" for _, t in rows if True), key=str) and sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (d, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]

        def near(a, b):
            a, b = plain_paragraphs(a), plain_paragraphs(b)
            return len(a & b) / len(a | b) if a | b else 1.0

        out[d] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), near(t, edited), near(t, nxt))
    return out


@pytest.mark.parametrize("n", [1, 2, 90])
def test_against_plain_python(spark, n):
    rng = random.Random(n)
    words = ["aa", "bé", "c", "dd\tx", "e\n", "😀", "ff. "]
    rows = [(k * 7 - 50, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 30, 400])))) for k in range(n)]
    if n > 10:
        rows[3] = (rows[3][0], None)
        rows[4] = (rows[4][0], rows[5][1])
        rows[10] = (rows[10][0], "same line\n" * 500 + "w " * 5000)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, next string, bucket int")
    got = {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in iblt.compare_with_next(df).collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    for d in want:
        assert got[d][:2] == want[d][:2]
        assert got[d][2:] == pytest.approx(want[d][2:])
    prints = {r.doc_id: r.fingerprint for r in iblt.compare_with_next(df).collect()}
    texts = {d: t or "" for d, t in rows}
    assert all((prints[a] == prints[b]) or texts[a] != texts[b] for a in texts for b in texts)


def test_ties_nulls_and_empty(spark):
    rows = [(5, "b"), (5, "a"), (None, "n"), (None, None), (1, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert iblt.compare_with_next(df).count() == 5
    assert iblt.compare_with_next(df.limit(0)).count() == 0
    assert iblt.compare_with_next(df.where(F.col("doc_id").isNull())).count() == 2


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = iblt.compare_with_next(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
