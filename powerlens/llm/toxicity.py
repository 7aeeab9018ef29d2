"""Toxicity grades by cumulative-link ordinal regression (operator 9).

Model: P(grade <= k) = sigmoid(theta_k - w.x), one weight vector for all ordered
thresholds theta_0 < theta_1 < ...; the output is the expected grade.

Features are sparse: how often a text has each vocabulary entry, a word (letters
only, lower case) or a beginning of words (written ``abcd*``); ``MOST_REPEATS`` at
most.  The vocabulary is learned: a word enters when its share of
toxic texts among the labelled ones cannot be chance (binomial tail under the
overall share, divided by the number of words tried).  How many of them a
labelled toxic text has gives its severity grade (grade 0: not toxic;
1, 2, 3: up to ``GRADE_ENDS`` words).

The classifier is fitted on at most ``max_labelled`` labelled rows (those with
the smallest hash of their id), a documented bound; of those that share their
beginning, middle or end with another one only one counts, so that copies
prove nothing.  Scoring reads every text whole.  The driver holds the vocabulary (at most ``max_words``) and the fitting
rows' word numbers.

Defined results: null and empty texts have no words and get the intercept's
severity; rows without a label, or with a null one, don't take part in
fitting; without any toxic label every severity is 0 and nothing is rejected.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, free_name, small_batches, stored, without

MAX_LABELLED = 20_000
MAX_WORDS = 5_000
MOST_REPEATS = 4
CHANCE = 0.01  # expected number of words that enter by chance
REJECT_AT = 1.0  # expected grade from which a text is rejected: the mildest toxic one
GRADE_ENDS = (2, 4)  # words of grade 1 and of grade 2, at most
STEMS = (4, 5, 6)  # letters of the beginnings of words that are features
SHARED = 12  # words at a text's beginning, middle and end by which copies are known
WORD = re.compile(r"[^\W\d_]+")


def features(words: list[str]) -> Counter:
    """How often each word and each beginning of words occurs."""
    times = Counter(words)
    for w, n in list(times.items()):
        for k in STEMS:
            if len(w) > k:
                times[w[:k] + "*"] += n
    return times


@dataclass
class Model:
    words: dict[str, float]
    thresholds: list[float]

    def __post_init__(self):
        self.stems = {w[:STEMS[0]] for w in self.words if w.endswith("*")}

    def severity(self, text: str | None) -> float:
        """Expected grade: the sum over k of P(grade > k)."""
        if not self.thresholds:
            return 0.0
        times = Counter(WORD.findall((text or "").lower()))
        words, stems = self.words, self.stems
        hits = {w for w in times if w in words or w[:STEMS[0]] in stems}
        x = 0.0
        if hits:
            found = features([w for w in hits for _ in range(times[w])])
            x = sum(words[w] * min(n, MOST_REPEATS) for w, n in sorted(found.items()) if w in words)
        return sum(1 / (1 + math.exp(min(700.0, t - x))) for t in self.thresholds)


def fit_ordinal(x: list[np.ndarray], grade: np.ndarray, n_features: int, ridge: float = 0.1, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds of the cumulative-link model.

    Penalised likelihood by gradient descent with adaptive steps (Adam).
    Thresholds are the first one and the logarithms of the gaps, so they stay
    in order.  ``x``: each row's feature numbers.
    """
    n, top = len(x), int(grade.max())
    row = np.repeat(np.arange(n), [len(f) for f in x])
    col = np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64)
    share = np.array([(grade <= k).mean() for k in range(top)]).clip(1e-6, 1 - 1e-6)
    start = np.log(share / (1 - share))
    params = np.concatenate([np.zeros(n_features), start[:1], np.log(np.maximum(np.diff(start), 0.1))])
    m, v = np.zeros_like(params), np.zeros_like(params)

    def thresholds(p: np.ndarray) -> np.ndarray:
        return p[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(p[n_features + 1:]))])

    for step in range(1, steps + 1):
        theta = thresholds(params)
        score = np.bincount(row, params[col], n)
        below = 1 / (1 + np.exp(-np.clip(theta[None, :] - score[:, None], -30, 30)))  # P(grade <= k)
        cdf = np.hstack([np.zeros((n, 1)), below, np.ones((n, 1))])
        slope = np.hstack([np.zeros((n, 1)), below * (1 - below), np.zeros((n, 1))])
        at = np.arange(n)
        p = np.maximum(cdf[at, grade + 1] - cdf[at, grade], 1e-12)
        d_score = (slope[at, grade + 1] - slope[at, grade]) / p  # of the negative log-likelihood
        d_theta = np.array([-(slope[at, k + 1] / p)[grade == k].sum() + (slope[at, k + 1] / p)[grade == k + 1].sum() for k in range(top)])
        gaps = np.exp(params[n_features + 1:])
        tail = np.cumsum(d_theta[::-1])[::-1]
        grad = np.concatenate([np.bincount(col, d_score[row], n_features) + ridge * params[:n_features], [d_theta.sum()], tail[1:] * gaps])
        grad /= n
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        params = params - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return params[:n_features], thresholds(params)


def binomial_tail(hits: int, n: int, share: float) -> float:
    """log P(at least ``hits`` of ``n``) at most: the Chernoff bound."""
    q = hits / n
    if q <= share:
        return 0.0
    first = q * math.log(q / share)
    return -n * (first + ((1 - q) * math.log((1 - q) / (1 - share)) if q < 1 else 0.0))


def fit(
    docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_words: int = MAX_WORDS, text: str = "text"
) -> Model:
    """Fit on the labelled rows (``labels``: doc_id, toxic 0/1)."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # repeated labels: the worst
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)

    @F.arrow_udf("struct<words:array<string>,shared:array<bigint>>")
    def read(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            words = WORD.findall((t or "").lower())
            middle = max(0, len(words) - SHARED) // 2
            ends = (words[:SHARED], words[middle:middle + SHARED], words[-SHARED:])
            repeated = [w for w, n in features(words).items() for _ in range(min(n, MOST_REPEATS))]
            out.append({"words": repeated, "shared": [xxhash.xxh64_intdigest(" ".join(e), k) - 2**63 for k, e in enumerate(ends)]})
        return pa.array(out, pa.struct([("words", pa.list_(pa.string())), ("shared", pa.list_(pa.int64()))]))

    rows = docs.select(column("doc_id").alias("doc_id"), column(text).alias("text")).join(F.broadcast(known), "doc_id")  # max_labelled rows
    rows = rows.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"), read("text").alias("read"))
    rows = stored(rows.select("toxic", "read.*", F.xxhash64("doc_id", "read").alias("row")), "labelled")
    for k in range(3):  # one row for each beginning, middle and end; max_labelled numbers at most
        firsts = rows.groupBy(F.col("shared")[k]).agg(F.min("row").alias("row")).select("row")
        alone = firsts if k == 0 else alone.join(firsts, "row", "left_semi")
    rows = stored(rows.join(F.broadcast(alone), "row", "left_semi").select("toxic", "words"), "labelled")
    n, n_toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n_toxic or n_toxic == n:
        return Model({}, [])
    counts = rows.select("toxic", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("hits"))
    counts = stored(counts, "label-words")
    tried = counts.count()
    share = n_toxic / n
    limit = math.log(CHANCE / tried) if tried else 0.0
    # the bound is at most n log(1/share): words with fewer texts can't pass
    least = max(1, math.floor(-limit / -math.log(share)))
    likely = counts.where((F.col("hits") >= least) & (F.col("hits") > F.col("n") * share))
    order = (F.col("hits") / F.col("n")).desc(), F.col("hits").desc(), F.col("word")
    found = [r["word"] for r in likely.orderBy(*order).limit(max_words).collect() if binomial_tail(r["hits"], r["n"], share) <= limit]
    number = {w: k for k, w in enumerate(found)}
    if not number:
        return Model({}, [])

    @F.arrow_udf("array<int>")
    def numbered(lists: pa.Array) -> pa.Array:
        return pa.array([[number[w] for w in x if w in number] for x in lists.to_pylist()], pa.list_(pa.int32()))

    sample = rows.select("toxic", numbered("words").alias("words")).collect()  # max_labelled rows of vocabulary words
    x = [np.array(sorted(r["words"]), np.int64) for r in sample]
    count = np.array([len(f) for f in x])
    grade = np.where([r["toxic"] for r in sample], 1 + sum((count > e).astype(int) for e in GRADE_ENDS), 0)
    present = np.unique(grade)
    weights, theta = fit_ordinal(x, np.searchsorted(present, grade), len(number))
    # a grade that no labelled text has lies on the next one's threshold
    thresholds = [float(theta[min(np.searchsorted(present, k + 1), len(present) - 1) - 1]) for k in range(int(grade.max()))]
    return Model({w: float(weights[k]) for w, k in number.items()}, thresholds)


def score(df: DataFrame, model: Model, text: str = "text", out: str = "severity") -> DataFrame:
    """Add the expected severity (0 to 3) of the whole text."""
    small_batches(df.sparkSession)

    @F.arrow_udf("double")
    def severity(texts: pa.Array) -> pa.Array:
        return pa.array([model.severity(t) for t in texts.to_pylist()], pa.float64())

    return without(df, *([out] if out.lower() != text.lower() else [])).withColumn(out, severity(column(text)))


def keep_mild(df: DataFrame, model: Model, reject_at: float = REJECT_AT, text: str = "text") -> DataFrame:
    """The rows whose severity stays under ``reject_at``; columns as before."""
    mark = free_name(df, "severity")
    return score(df, model, text, mark).where(column(mark) < reject_at).drop(mark)
