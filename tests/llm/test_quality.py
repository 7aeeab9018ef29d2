"""Factorisation machine: pair sums, interactions, held-out accuracy, edges."""

import math
import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from powerlens.llm import quality, queries
from powerlens.llm.common import table

SF = "/root/testdata/sf0.01"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n1 = label.sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


def test_linear_time_equals_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    model = quality.Model([np.array([0.5])] * 3, 0.3)
    model.weights = rng.normal(size=model.size)
    model.pairs = rng.normal(size=(model.size, quality.RANK))
    words = [quality.hashed(quality.word_counts(t)) for t in (b"a b b c", b"", b"one two three four")]
    numbers = np.array([[0.1, 0.9, np.nan], [1.0, 0.0, 0.5], [0.4, 0.6, 0.2]])
    slots, values, starts = model.inputs(words, numbers)
    got = model.logits(slots, values, starts)
    for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(slots)])):
        x = list(zip(slots[a:b], values[a:b]))
        want = model.bias + sum(model.weights[s] * v for s, v in x)
        want += sum(model.pairs[s] @ model.pairs[t] * v * u for (s, v), (t, u) in combinations(x, 2))
        assert math.isclose(got[i], want, rel_tol=1e-5)


def test_learns_what_only_pairs_can_tell():
    """Label 1 if just one of two signs is there: no linear model can tell."""
    rng = np.random.default_rng(2)
    signs = rng.integers(0, 2, (4000, 2))
    rows = [(np.array([10 + a, 20 + b]), np.array([0.7, 0.7])) for a, b in signs]
    label = (signs[:, 0] != signs[:, 1]).astype(float)
    model = quality.Model([])
    quality.fit_machine(model, rows[:3000], label[:3000])
    slots = np.concatenate([s for s, _ in rows[3000:]])
    out = model.logits(slots, np.full(len(slots), 0.7), np.arange(0, 2000, 2))
    assert ((out > 0) == (label[3000:] == 1)).all()


def test_held_out_accuracy_of_the_query(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op11_quality_fm"](spark, SF).collect()}
    docs = {r.doc_id for r in table(spark, SF, "documents").select("doc_id").collect()}
    assert got.keys() == docs
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    labels = [(r.doc_id, r.quality) for r in table(spark, SF, "labels").collect()]
    held = [(got[i].score, y) for i, y in labels if got[i].held_out]
    score, y = (np.array(x) for x in zip(*held))
    assert auc(score, y) > 0.95
    assert ((score >= 0.7) == (y == 1)).mean() > 0.93


def test_score_reads_neither_label_nor_source_nor_id(spark):
    docs = table(spark, SF, "documents").limit(60)
    labels = table(spark, SF, "labels")
    model = quality.fit(table(spark, SF, "documents"), labels, metadata=["n_chars"])
    one = {r.doc_id: r.score for r in quality.score(docs, model, metadata=["n_chars"]).collect()}
    other = docs.withColumns({"doc_id": F.col("doc_id") + 1, "lang": F.lit("xx"), "source": F.lit("y"), "Score": F.lit("own")})
    two = {r.doc_id - 1: r.score for r in quality.score(other, model, metadata=["n_chars"]).collect()}
    assert one == two


def test_edges(spark):
    rng = random.Random(1)
    good = ["".join(rng.choice("abcdeé ") for _ in range(200)) + "." for _ in range(150)]
    bad = ["|".join(rng.choice("ABCD%$") for _ in range(100)) for _ in range(150)]
    rows = [(i, t, "m", 1.0, "own") for i, t in enumerate(good + bad)]
    rows += [(None, None, None, None, None), (900, "", "m", None, "own"), (0, good[0], "m", 1.0, "own"), (901, "a b " * 600_000, "z", math.nan, "own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `me.ta` string, weight double, score string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)] + [(0, 1), (None, 1), (5, None)], "doc_id long, quality int")
    meta = ["me.ta", "weight"]
    model = quality.fit(docs, labels, metadata=meta)
    out = quality.score(docs, model, metadata=meta)
    assert sorted(out.columns) == sorted(docs.columns)
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 0}) == 1
    assert all((r.score > 0.5) == (r.doc_id < 150) for r in got if r.doc_id is not None and r.doc_id < 300)
    assert quality.score(docs.limit(0), model, metadata=meta).count() == 0
    none = labels.limit(0)
    assert {r.score for r in quality.score(docs, quality.fit(docs, none)).collect()} == {0.5}
    ones = quality.fit(docs, labels.where("quality = 1"))
    assert {round(r.score, 3) for r in quality.score(docs, ones).collect()} == {0.999}
    assert quality.statistics(b"", quality.word_counts(b"")) == [0.0] * len(quality.STATISTICS)
    assert len(quality.statistics(b"x", quality.word_counts(b"x"))) == len(quality.STATISTICS)


@pytest.mark.parametrize("bound", [50, 300])
def test_fitting_rows_are_bounded(spark, bound, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit_machine", lambda model, rows, label, **k: seen.append(len(rows)))
    quality.fit(table(spark, SF, "documents"), table(spark, SF, "labels"), max_labelled=bound)
    assert seen == [min(bound, 399)]
