"""Ordinal toxicity regression: gradient, held-out accuracy, edges."""

import random

import numpy as np

from powerlens.llm import toxicity

RUDE = ["idiot", "Müll", "escoria", "clown", "trash"]
CLEAN = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("a", "e", "oun", "ithe", "ar", "is")]
LETTERS = str.maketrans("0123456789", "abcdefghij")


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(CLEAN) for _ in range(rng.randrange(5, 60))]
        toxic = int(rng.random() < 0.2)
        for _ in range(rng.randrange(2, 7) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(RUDE) + rng.choice(["", ",", "!!"]))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(1500, 1)
    docs = spark.createDataFrame([(i, t, 9.0) for i, t, _ in rows], "doc_id long, text string, Severity double")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows if i < 700], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert {w.lower() for w in RUDE} <= model.words.keys()
    out = {r.doc_id: r.severity for r in toxicity.score(docs, model).collect()}
    wrong = [i for i, _, x in rows if i >= 700 and (out[i] >= toxicity.REJECT_AT) != bool(x)]
    assert len(wrong) <= 8, len(wrong)
    # more rude words: no lower severity
    by_count = [model.severity(" ".join(RUDE[:k])) for k in range(6)]
    assert by_count == sorted(by_count) and by_count[0] < 0.5 and by_count[2] >= toxicity.REJECT_AT
    kept = toxicity.keep_mild(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in out if out[i] < toxicity.REJECT_AT}


def test_gradient_descent_finds_the_optimum():
    rng = np.random.default_rng(0)
    x = [np.nonzero(rng.random(4) < 0.5)[0] for _ in range(600)]
    latent = np.array([sum([2.0, 1.0, 0.0, -1.0][f] for f in r) for r in x]) + rng.logistic(size=600)
    grade = (latent > 0).astype(int) + (latent > 2)
    w, theta = toxicity.fit_ordinal(x, grade, 4, steps=2000)

    def loss(w, theta):
        score = np.array([w[f].sum() for f in x])
        cdf = np.hstack([np.zeros((600, 1)), 1 / (1 + np.exp(score[:, None] - theta[None, :])), np.ones((600, 1))])
        at = np.arange(600)
        return -np.log(cdf[at, grade + 1] - cdf[at, grade]).sum() + 0.05 * (w**2).sum()

    best = loss(w, theta)
    assert theta[0] < theta[1] and w[0] > w[1] > w[3]
    for k in range(4):
        for step in (0.05, -0.05):
            moved = w.copy()
            moved[k] += step
            assert loss(moved, theta) > best - 1e-3


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x y"), (3, "12 --"), (3, "12 --")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for labels in (none, spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id long, toxic int")):
        model = toxicity.fit(docs, labels)
        assert [r.severity for r in toxicity.score(docs, model).collect()] == [0.0] * 5
        assert toxicity.keep_mild(docs, model).count() == 5
    assert toxicity.fit(docs.limit(0), none).words == {}


def test_tail_bound():
    assert toxicity.binomial_tail(1, 10, 0.2) == 0.0
    assert abs(toxicity.binomial_tail(10, 10, 0.1) - 10 * np.log(0.1)) < 1e-9
