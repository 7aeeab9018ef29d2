"""Quality classifier: a factorisation machine (operator 11).

Features of a text, sparse:

- hashed words: runs of ASCII letters and digits and of characters beyond ASCII, A-Z
  lower-cased; CRC-32 modulo ``WORDS`` slots; value 1 + ln(times), the vector scaled to norm 1;
- structure statistics (``STATISTICS``) and numeric metadata columns: each is one of
  ``BINS`` indicators, cut at quantiles of the labelled rows; text metadata columns are hashed.

Score: sigmoid of  w0 + sum w_i x_i + sum over pairs i < j of <v_i, v_j> x_i x_j,
the pairs in linear time as  1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2).

The model is fitted by penalised logistic loss (mini-batches, Adam) on at most
``max_labelled`` labelled rows, those with the smallest hash of their id: a
documented bound, and the only thing that is not read whole.  The driver holds
these rows' features and the model.  Scoring reads every text whole.

Defined results: null texts count as empty; an empty text has no words and
its statistics' indicators, so it gets a score like any other; a null or missing
metadata value has an indicator of its own; rows without a label, with a null
label or id don't take part in fitting, repeated labels of one id count as their least
(any 0 makes it 0); repeated rows are scored alike; with labels of one kind only, or
none, every score is the share of 1, from 0.001 to 0.999 (0.5 without labels); an empty table
gives an empty result; further columns stay, an own ``score`` column is
replaced.  Ties don't arise: a score is a function of the row.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, free_name, small_batches, stored, without

MAX_LABELLED = 8_000
WORDS = 1 << 14  # slots of hashed words
BINS = 10  # indicators of a statistic
RANK = 8  # numbers of a slot's pair vector
EPOCHS = 12  # passes over the labelled rows, more where these are few:
LEAST_STEPS = 1_000  # mini-batches
BATCH = 128
PIECE = 1 << 20  # bytes of a text that are split at once

WORD_BYTES = bytes(
    b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
UPPER = bytes(range(65, 91))
LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
DIGITS = b"0123456789"
PLAIN_MARKS = b" \n.,'-"
SPACES = bytes([9, 10, 11, 12, 13, 32])
ENDS = (b".", b"!", b"?", b":", b'"')

STATISTICS = [
    "bytes", "letters", "upper", "digits", "marks", "most_common_mark", "lines", "line_length", "open_lines", "repeated_lines",
    "words", "word_length", "long_words", "repeated_words", "most_common_word", "short_words", "marks_in_words", "links",
]


def word_counts(text: bytes) -> Counter:
    """How often each word occurs in a text (UTF-8)."""
    flat = text.translate(WORD_BYTES)
    out: Counter = Counter()
    at = 0
    while at < len(flat):
        end = flat.find(b" ", at + PIECE)
        end = len(flat) if end < 0 else end
        out.update(flat[at:end].split())
        at = end
    return out


def statistics(text: bytes, words: Counter) -> list[float]:
    """The structure statistics of a text, in the order of ``STATISTICS``; shares are 0 where nothing is there."""
    size = len(text)
    if not size:
        return [0.0] * len(STATISTICS)

    def held(these: bytes) -> int:
        return size - len(text.translate(None, these))

    letters, upper, digits = held(LETTERS), held(UPPER), held(DIGITS)
    marks = text.translate(None, LETTERS + DIGITS + PLAIN_MARKS + SPACES)
    common = max((marks.count(bytes([b])) for b in set(marks)), default=0)
    lines = [x for x in text.split(b"\n") if x.strip()]
    total = words.total()
    pieces = max(1, size - len(text.translate(None, SPACES)) + 1)
    length = sum(len(w) * k for w, k in words.items())
    return [
        math.log1p(size), letters / size, upper / max(1, letters), digits / size, len(marks) / size, common / size,
        math.log1p(len(lines)), math.log1p(size / max(1, len(lines))), sum(not x.rstrip().endswith(ENDS) for x in lines) / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        math.log1p(total), length / max(1, total), sum(k for w, k in words.items() if len(w) > 12) / max(1, total),
        1 - len(words) / max(1, total), max(words.values(), default=0) / max(1, total),
        sum(k for w, k in words.items() if len(w) < 4) / max(1, total), len(marks) / pieces,
        (text.count(b"http") + text.count(b"www.") + text.count(b"@")) / pieces,
    ]


def hashed(words: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Slots (ascending) and values of the word part."""
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    slot = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % WORDS
    value = 1 + np.log(np.fromiter(words.values(), float, len(words)))
    slots, at = np.unique(slot, return_inverse=True)
    value = np.bincount(at, value)
    return slots.astype(np.int32), (value / np.sqrt((value**2).sum())).astype(np.float32)


@dataclass
class Model:
    """Weights of the hashed words, then of the indicators of each statistic and metadata column."""

    cuts: list[np.ndarray]  # bin borders of statistics and numeric metadata
    bias: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros((0, RANK), np.float32))

    @property
    def size(self) -> int:
        return WORDS + len(self.cuts) * (BINS + 1)

    def indicators(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots and values of rows of statistics and metadata (NaN: missing)."""
        n = len(self.cuts)
        out = np.empty(numbers.shape, np.int32)
        for k, cuts in enumerate(self.cuts):
            at = np.searchsorted(cuts, numbers[:, k], side="right")
            out[:, k] = WORDS + k * (BINS + 1) + np.where(np.isnan(numbers[:, k]), BINS, at)
        return out, np.full(numbers.shape, 1 / math.sqrt(max(1, n)), np.float32)

    def inputs(self, words: list[tuple[np.ndarray, np.ndarray]], numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All rows' slots and values one after another, and each row's first place."""
        slots, values = self.indicators(numbers)
        sizes = np.array([len(s) for s, _ in words]) + numbers.shape[1]
        flat_slots = np.concatenate([p for (s, _), row in zip(words, slots) for p in (s, row)])
        flat_values = np.concatenate([p for (_, v), row in zip(words, values) for p in (v, row)])
        return flat_slots, flat_values, np.cumsum(sizes) - sizes

    def logits(self, slots: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(starts), self.bias)
        linear = np.add.reduceat(self.weights[slots] * values, starts)
        vx = self.pairs[slots] * values[:, None]
        total = np.add.reduceat(vx, starts)
        return self.bias + linear + 0.5 * (total**2 - np.add.reduceat(vx**2, starts)).sum(1)


def fit_machine(model: Model, rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, ridge: float = 2e-4, rate: float = 0.02, seed: int = 7) -> None:
    """Fit bias, weights and pair vectors to rows of (slots, values): penalised logistic loss, mini-batches, Adam."""
    rng = np.random.default_rng(seed)
    share = label.mean()
    model.bias = float(np.log(share / (1 - share)))
    table = np.zeros((model.size, 1 + RANK))  # weight, then the pair vector
    table[:, 1:] = rng.normal(0, 0.05, (model.size, RANK))
    m, v, step = np.zeros_like(table), np.zeros_like(table), 0
    mb = vb = 0.0
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // len(rows)))
    for epoch in range(epochs):
        pace = rate * (1 - epoch / epochs)
        order = rng.permutation(len(rows))
        for first in range(0, len(order), BATCH):
            batch = order[first:first + BATCH]
            slots = np.concatenate([rows[i][0] for i in batch])
            x = np.concatenate([rows[i][1] for i in batch]).astype(float)
            sizes = np.array([len(rows[i][0]) for i in batch])
            starts = np.cumsum(sizes) - sizes
            used, at = np.unique(slots, return_inverse=True)
            now = table[used]
            vx = now[at, 1:] * x[:, None]
            total = np.add.reduceat(vx, starts)
            out = model.bias + np.add.reduceat(now[at, 0] * x, starts) + 0.5 * (total**2 - np.add.reduceat(vx**2, starts)).sum(1)
            error = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - label[batch]) / len(batch)
            each = np.repeat(error, sizes) * x
            grad = np.empty((len(used), 1 + RANK))
            grad[:, 0] = np.bincount(at, each, len(used))
            pull = each[:, None] * (np.repeat(total, sizes, axis=0) - vx)
            for f in range(RANK):
                grad[:, 1 + f] = np.bincount(at, pull[:, f], len(used))
            grad += ridge * now
            step += 1
            m[used] = 0.9 * m[used] + 0.1 * grad
            v[used] = 0.999 * v[used] + 0.001 * grad**2
            scale = math.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            table[used] = now - pace * scale * m[used] / (np.sqrt(v[used]) + 1e-8)
            mb, vb = 0.9 * mb + 0.1 * error.sum(), 0.999 * vb + 0.001 * error.sum() ** 2
            model.bias -= float(pace * scale * mb / (math.sqrt(vb) + 1e-8))
    model.weights, model.pairs = table[:, 0].astype(np.float32), table[:, 1:].astype(np.float32)


def _numbers(columns: list[pa.Array]) -> np.ndarray:
    """Metadata columns as rows of doubles; texts by their hash's place between 0 and 1, NaN where missing."""
    out = []
    for c in columns:
        if pa.types.is_string(c.type):
            out.append(np.array([math.nan if x is None else zlib.crc32(x.encode()) / 2**32 for x in c.to_pylist()], float))
        else:
            out.append(c.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float))
    return np.array(out).T if out else np.empty((0, 0))


def _metadata(df: DataFrame, names: Sequence[str]) -> list:
    kinds = dict(df.dtypes)
    return [column(n) if kinds[n] == "string" else column(n).cast("double") for n in names]


def _read(texts: pa.Array, metadata: tuple) -> tuple[list, np.ndarray]:
    words, numbers = [], []
    for t in texts.cast(pa.binary()):
        data = t.as_py() or b""
        counts = word_counts(data)
        words.append(hashed(counts))
        numbers.append(statistics(data, counts))
    numbers = np.array(numbers, float).reshape(len(words), len(STATISTICS))
    return words, np.hstack([numbers, _numbers(list(metadata))]) if metadata else numbers


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED, text: str = "text",
    metadata: Sequence[str] = (), doc_id: str = "doc_id",
) -> Model:
    """Fit on the rows of ``docs`` that ``labels`` (``doc_id``, ``label`` 0/1) marks."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").alias("id"), column(label).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    known = known.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_labelled)

    @F.arrow_udf("struct<slots:array<int>,sizes:array<float>,numbers:array<double>>")
    def read(texts: pa.Array, *more: pa.Array) -> pa.Array:
        words, numbers = _read(texts, more)
        return pa.StructArray.from_arrays([
            pa.array([s for s, _ in words], pa.list_(pa.int32())), pa.array([v for _, v in words], pa.list_(pa.float32())),
            pa.array(list(numbers), pa.list_(pa.float64()))], ["slots", "sizes", "numbers"])

    rows = docs.select(column(doc_id).alias("id"), column(text).cast("string").alias("text"), *[c.alias(f"m{i}") for i, c in enumerate(_metadata(docs, metadata))])
    rows = rows.join(F.broadcast(known), "id")  # max_labelled rows
    rows = rows.select("id", "y", read("text", *[f"m{i}" for i in range(len(metadata))]).alias("read"))
    # repeated documents: one row for each id
    rows = stored(rows.groupBy("id").agg(F.min("y").alias("y"), F.min("read").alias("read")), "labelled")
    sample = rows.select("y", "read.*").orderBy("id").toArrow()  # max_labelled rows
    y = sample["y"].to_numpy().astype(float)
    n = len(STATISTICS) + len(metadata)
    model = Model([np.empty(0)] * n)
    if not len(y) or y.min() == y.max():
        share = float(y.mean().clip(1e-3, 1 - 1e-3)) if len(y) else 0.5
        model.bias = math.log(share / (1 - share))
        return model
    numbers = np.array(sample["numbers"].to_pylist(), float)
    for k in range(n):
        there = numbers[~np.isnan(numbers[:, k]), k]
        model.cuts[k] = np.unique(np.quantile(there, np.arange(1, BINS) / BINS)) if len(there) else np.empty(0)
    slots, values = model.indicators(numbers)
    words = zip(sample["slots"], sample["sizes"])
    inputs = [
        (np.concatenate([s.values.to_numpy(), slots[i]]), np.concatenate([v.values.to_numpy(), values[i]])) for i, (s, v) in enumerate(words)]
    fit_machine(model, inputs, y)
    return model


def score(df: DataFrame, model: Model, text: str = "text", metadata: Sequence[str] = (), out: str = "score") -> DataFrame:
    """Add the score, from 0 to 1, of each whole text and its metadata (the columns that ``fit`` was given)."""
    small_batches(df.sparkSession)

    @F.arrow_udf("double")
    def scores(texts: pa.Array, *more: pa.Array) -> pa.Array:
        if not len(texts):
            return pa.array([], pa.float64())
        words, numbers = _read(texts, more)
        x = model.logits(*model.inputs(words, numbers))
        return pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30).astype(float))))

    mark = free_name(df, "new_score")
    scored = df.withColumn(mark, scores(column(text).cast("string"), *_metadata(df, metadata)))
    return without(scored, *([out] if out.lower() != text.lower() else [])).withColumnRenamed(mark, out)
