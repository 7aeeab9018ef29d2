"""Ranked lexical search by norm buckets, LEMP style (operator 12).

A text's terms are the maximal runs of ASCII letters and digits and of all other
characters beyond ASCII, with A-Z lower-cased.  With N texts that have a term, L
terms in all, n terms in a text, df texts that hold a term and tf its occurrences:

    w = floor(1000 ln((2N + 2) / (2 df + 1)))
    m = 100 - 90 + (90 n N) div L
    impact of a term in a text = w ((10^9 tf) div (1000 tf + 8 m))

and a text's score for a query is the sum of the impacts of the query's terms, an
inner product with a query vector of ones.  Statistics cover all rows.

Search.  Queries are taken in blocks of about ``block_terms`` terms; a block's terms,
their weights and its queries are what tasks get.  For a block:

1.  every text becomes an impact vector over the block's terms (whole text; other
    terms add nothing to a score), and the vectors are dealt and sorted by length
    (Euclidean norm), longest first: a batch of them is a bucket;
2.  the longest hundredth of the vectors is searched first and gives each query a
    threshold, its k-th score so far; vectors so short that |q||v| stays under every
    threshold (Cauchy-Schwarz) are not read any more, and a bucket skips the queries
    whose threshold is over |q| times its longest vector;
3.  in a bucket, each coordinate's largest impact bounds what a term can add: only
    vectors that have one of the terms without which no score reaches the threshold
    are candidates, and a candidate stays if its partial product plus the least of the
    other terms' bounds and of Cauchy-Schwarz on the rest of its norm can reach it;
4.  survivors are scored over all terms in 64-bit integers; a task's threshold rises
    as it goes, and each task hands on its k best of each query.

Pruning compares bounds with thresholds strictly, so equal scores are never lost.

Defined results: null and empty texts have no terms and are no result; a query
without terms, or whose terms no text holds, has no rows; equal scores go by
ascending id, null ids last, and rows that are alike in both by any order;
repeated documents and repeated queries are each ranked by themselves (two queries with one id
give two rows for each rank); empty tables give no rows; the tables may
have any further columns, the result has only its own.  Very long texts are
split in pieces between terms.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, small_batches, stored

BLOCK_TERMS = 200_000  # terms of the queries that are answered at once
FIRST_SHARE = 0.01  # of the vectors, the longest, that give the first thresholds
BUCKET = 2_048  # vectors of a bucket
PIECE = 1 << 20  # bytes of a text that are split at once
SLACK = 1 + 1e-9  # for rounding in bounds, which are doubles

TERM_BYTES = bytes(
    b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def term_counts(text: bytes) -> Counter:
    """How often each term occurs in a text (UTF-8)."""
    flat = text.translate(TERM_BYTES)
    out: Counter = Counter()
    at = 0
    while at < len(flat):
        end = flat.find(b" ", at + PIECE)
        end = len(flat) if end < 0 else end
        out.update(flat[at:end].split())
        at = end
    return out


def _texts(values: pa.Array) -> Iterator[bytes]:
    for v in values.cast(pa.binary()):
        yield v.as_py() or b""


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def vectors(docs: DataFrame, number: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(``id``, ``n``, ``terms``, ``tfs``): number of terms of each text, and the numbered ones among them."""
    small_batches(docs.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, terms, tfs = [], [], []
            for t in _texts(batch.column(1)):
                found = term_counts(t)
                n.append(found.total())
                held = sorted((number[w], k) for w, k in found.items() if w in number)
                terms.append(np.array([i for i, _ in held], np.int32))
                tfs.append(np.array([k for _, k in held], np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), _lists(terms, pa.int32()), _lists(tfs, pa.int64())],
                ["id", "n", "terms", "tfs"])

    rows = docs.select(column(doc_id).cast("bigint").alias("id"), column(text).cast("string").alias("text"))
    return rows.mapInArrow(read, "id bigint, n bigint, terms array<int>, tfs array<bigint>")


def impacts(found: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """(``id``, ``length``, ``terms``, ``impacts``) of the texts with any impact."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, terms, tfs = batch.columns
            sizes = terms.value_lengths().to_numpy()
            m = np.array([100 - 90 + 90 * k * n_docs // n_terms for k in n.to_pylist()], np.int64)
            at, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy()
            each = weights[at] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, sizes)))
            row = np.repeat(np.arange(len(sizes)), sizes)
            square = np.bincount(row, each.astype(float) ** 2, len(sizes))
            some = each > 0
            kept = np.bincount(row[some], minlength=len(sizes))
            offsets = pa.array(np.concatenate([[0], np.cumsum(kept)]), pa.int32())
            out = pa.RecordBatch.from_arrays(
                [ids, pa.array(np.sqrt(square)), pa.ListArray.from_arrays(offsets, pa.array(at[some], pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(each[some], pa.int64()))],
                ["id", "length", "terms", "impacts"])
            yield out.filter(pa.array(kept > 0))

    return found.where(F.size("terms") > 0).mapInArrow(weigh, "id bigint, length double, terms array<int>, impacts array<bigint>")


def _slices(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of several slices, one after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Best:
    """The k best (score, id) of a query so far; null ids come as the largest number with a flag."""

    def __init__(self, k: int, threshold: int):
        self.k, self.threshold = k, threshold
        self.score, self.id, self.null = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score, ids, null = (np.concatenate(p) for p in ((self.score, score), (self.id, ids), (self.null, null)))
        top = np.lexsort((ids, null, -score))[:self.k]
        self.score, self.id, self.null = score[top], ids[top], null[top]
        if len(top) == self.k:
            self.threshold = max(self.threshold, int(self.score[-1]))


class Bucket:
    """Impact vectors of similar length, by row and by coordinate."""

    def __init__(self, batch: pa.RecordBatch):
        ids, length, terms, each = batch.columns
        self.null = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()
        self.length = length.to_numpy()
        self.longest = float(self.length.max())
        self.sizes = terms.value_lengths().to_numpy().astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.terms, self.impacts = terms.flatten().to_numpy(), each.flatten().to_numpy()
        order = np.argsort(self.terms, kind="stable")
        self.row = np.repeat(np.arange(len(self.sizes)), self.sizes)[order]
        self.by_term = self.impacts[order]
        self.held, self.first = np.unique(self.terms[order], return_index=True)
        self.held_n = np.diff(np.append(self.first, len(order)))
        self.peak = np.maximum.reduceat(self.by_term, self.first)

    def search(self, query: np.ndarray, asked: np.ndarray, best: Best) -> None:
        """``query``: its terms' numbers, ascending; ``asked``: a flag for each term of the block, all unset."""
        need = best.threshold
        if need > math.sqrt(len(query)) * self.longest * SLACK:
            return
        at = np.searchsorted(self.held, query).clip(max=len(self.held) - 1)
        at = at[self.held[at] == query]
        at = at[np.argsort(-self.peak[at], kind="stable")]
        rest = np.append(np.cumsum(self.peak[at][::-1])[::-1], 0)  # what the terms from each place on can add
        must = int(np.count_nonzero(rest[:-1] >= max(need, 1)))  # a score without any of these is too low
        if not must:
            return
        places = _slices(self.first[at[:must]], self.held_n[at[:must]])
        rows, part = self.row[places], self.by_term[places].astype(float)
        n = len(self.ids)
        partial = np.bincount(rows, part, n)
        left = self.length ** 2 * SLACK - np.bincount(rows, part ** 2, n)
        bound = partial + np.minimum(float(rest[must]), np.sqrt(np.maximum(left, 0) * (len(at) - must)))
        rows = np.nonzero((partial > 0) & (bound * SLACK >= need))[0]
        if not len(rows):
            return
        asked[query] = True
        sizes = self.sizes[rows]
        places = _slices(self.starts[rows], sizes)
        score = np.add.reduceat(np.where(asked[self.terms[places]], self.impacts[places], 0), np.cumsum(sizes) - sizes)
        asked[query] = False
        good = score >= max(need, 1)
        best.add(score[good], self.ids[rows[good]], self.null[rows[good]])


def scan(table: DataFrame, queries: list[np.ndarray], thresholds: list[int], n_terms: int, k: int) -> DataFrame:
    """(``query``, ``id``, ``score``): each task's k best vectors of every query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k, t) for t in thresholds]
        asked = np.zeros(n_terms, bool)
        for batch in batches:
            if batch.num_rows:
                bucket = Bucket(batch)
                for q, b in zip(queries, best):
                    bucket.search(q, asked, b)
        for number, b in enumerate(best):
            if len(b.score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(b.score), number), pa.int32()), pa.array(b.id, pa.int64(), mask=b.null), pa.array(b.score, pa.int64())],
                    ["query", "id", "score"])

    return table.select("id", "length", "terms", "impacts").mapInArrow(run, "query int, id bigint, score bigint")


def _block(docs: DataFrame, block: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    """(``key``, ``id``, ``score``): candidates of one block of queries (``key``, ``terms``), its results among them."""
    spark = docs.sparkSession
    asked = block.orderBy("key").collect()  # about BLOCK_TERMS terms
    names = sorted({w for r in asked for w in r["terms"]})
    number = {w.encode(): i for i, w in enumerate(names)}
    found = stored(vectors(docs, number, doc_id, text), "vectors")
    n_docs, n_terms = found.where(F.col("n") > 0).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(names), np.int64)
    for r in found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():  # names
        df[r["term"]] = r["df"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) if x else 0 for x in df], np.int64)
    small_batches(spark, BUCKET)
    # longest first; the id parts vectors of one length (copies) among tasks
    table = impacts(found, weights, n_docs, max(n_terms, 1))
    table = table.repartitionByRange((-F.col("length")).asc(), F.xxhash64("id").asc()).sortWithinPartitions((-F.col("length")).asc())
    table = stored(table, "impacts")
    # terms without weight add nothing and would only loosen the bounds
    queries = [np.array([i for i in sorted(number[w.encode()] for w in r["terms"]) if weights[i] > 0], np.int64) for r in asked]
    cut = table.agg(F.percentile_approx("length", 1 - FIRST_SHARE, 1000)).first()[0]
    if cut is None:
        return scan(table, queries, [0] * len(queries), len(names), k).select(F.lit(None).cast("bigint").alias("key"), "id", "score")
    first = stored(scan(table.where(F.col("length") >= cut), queries, [0] * len(queries), len(names), k), "first-buckets")
    thresholds = [0] * len(queries)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    for r in first.withColumn("place", place).where(F.col("place") == k).collect():  # one row a query
        thresholds[r["query"]] = r["score"]
    least = min((t / math.sqrt(len(q)) for t, q in zip(thresholds, queries) if len(q)), default=0.0)
    rest = table.where((F.col("length") < cut) & (F.col("length") * SLACK >= least))
    keys = spark.createDataFrame([(i, r["key"]) for i, r in enumerate(asked)], "query int, key bigint")
    return first.unionByName(scan(rest, queries, thresholds, len(names), k)).join(F.broadcast(keys), "query").select("key", "id", "score")


def search(
    docs: DataFrame, queries: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """The ``k`` best rows of ``docs`` with a score above 0 for each row of ``queries``:
    ``item_id``, ``rank`` (from 1), ``doc_id``, ``score``."""
    spark = docs.sparkSession
    small_batches(spark)

    @F.arrow_udf("array<string>")
    def terms_of(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(w.decode() for w in term_counts(t)) for t in _texts(texts)], pa.list_(pa.string()))

    asked = queries.select(column(item_id).alias("item_id"), terms_of(column(item_text).cast("string")).alias("terms"))
    asked = stored(asked.withColumn("key", F.monotonically_increasing_id()), "queries")
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-total // block_terms))
    block = F.pmod(F.xxhash64("key"), F.lit(blocks))
    parts = [_block(docs, asked.where(block == b).select("key", "terms"), k, doc_id, text) for b in range(blocks)]
    if blocks > 1:
        parts = [stored(p, "block-best") for p in parts]
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    top = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(asked.select("key", "item_id"), "key").select("item_id", "rank", F.col("id").alias("doc_id"), "score")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def oracle(k: int = 10) -> str:
    """DuckDB SQL of ``search`` over ``documents`` and ``benchmark``."""

    def terms(name: str) -> str:
        return f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') FROM {name}"

    return f"""
WITH d(doc_id, terms) AS (SELECT doc_id, {terms('documents')}),
     b(item_id, terms) AS (SELECT item_id, {terms('benchmark')}),
     q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(terms) AS term FROM b)),
     s AS (SELECT count(*) FILTER (len(terms) > 0) AS docs, sum(len(terms))::BIGINT AS total FROM d),
     t AS (SELECT doc_id, n, term, count(*) AS tf
           FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
           WHERE term IN (SELECT term FROM q) GROUP BY ALL),
     w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, s GROUP BY term),
     i AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total))) AS impact
           FROM t JOIN w USING (term), s),
     r AS (SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM r WHERE score > 0
QUALIFY rank <= {k}
"""
