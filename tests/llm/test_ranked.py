"""Norm-bucket search against plain scoring of every pair."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from powerlens.llm import queries, ranked
from powerlens.llm.common import table

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    """Sorted rows (item, rank, doc, score)."""
    counted = [(i, Counter(plain_terms(t))) for i, t in docs]
    n_docs = sum(1 for _, c in counted if c)
    total = sum(c.total() for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counted:
            m = 100 - 90 + (90 * c.total() * n_docs) // total if total else 0
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m))
                for w in set(plain_terms(text)) if c[w])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted([tuple(r) for r in df.collect()], key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    return [(i, " ".join(rng.choices(words, weights, k=rng.choice([0, 3, 20, 200])))) for i in range(n)]


@pytest.mark.parametrize("block_terms", [200_000, 40])
def test_search_equals_plain_scoring(spark, block_terms, monkeypatch):
    monkeypatch.setattr(ranked, "BUCKET", 16)
    docs = corpus(1, 700)
    docs += [(1000 + i, docs[3][1] or "w1 w2") for i in range(40)]  # many equal scores
    items = [(i, " ".join(t.split()[:25])) for i, t in corpus(2, 60)]
    got = ranked.search(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"),
        block_terms=block_terms)
    assert rows(got) == plain(docs, items)


def test_bucket_prunes_only_what_cannot_reach_the_threshold():
    rng = np.random.default_rng(3)
    n_terms, k = 40, 5
    vecs = [(t := np.sort(rng.choice(n_terms, rng.integers(1, 12), replace=False)).astype(np.int32), rng.integers(1, 10**6, len(t))) for _ in range(500)]
    for _ in range(40):
        query = np.sort(rng.choice(n_terms, 8, replace=False))
        exact = np.array([v[np.isin(t, query)].sum() for t, v in vecs])
        want = sorted(zip(-exact, range(500)))[:k]
        best = ranked.Best(k, 0)
        order = sorted(range(500), key=lambda i: -np.linalg.norm(vecs[i][1]))
        for part in (order[i:i + 50] for i in range(0, 500, 50)):
            offsets = pa.array(np.cumsum([0, *[len(vecs[i][0]) for i in part]]), pa.int32())
            batch = pa.RecordBatch.from_arrays([
                pa.array(part, pa.int64()), pa.array([float(np.linalg.norm(vecs[i][1])) for i in part]),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([vecs[i][0] for i in part]))),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([vecs[i][1] for i in part]))),
            ], ["id", "length", "terms", "impacts"])
            ranked.Bucket(batch).search(query, np.zeros(n_terms, bool), best)
        assert list(zip(-best.score, best.id)) == want


def test_query_equals_plain_scoring_and_sql(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    got = rows(queries.QUERIES["op12_ranked_search"](spark, SF))
    assert got == plain(docs, items)
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    assert sorted(con.execute(queries.ORACLES["op12_ranked_search"]).fetchall(), key=str) == got


def test_edges(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns, empty tables."""
    long = "zeta " + "filler " * 400_000 + "omega"
    docs = [(None, "Alpha beta"), (5, "ALPHA beta"), (5, "alpha beta"), (2, "alpha-beta"), (1, None), (3, ""), (4, "--- !!"), (7, "ÄÖ alpha Äö"), (8, long)]
    items = [(1, "alpha"), (1, "alpha"), (2, "beta ALPHA alpha"), (3, None), (4, ""), (None, "äÖ äö"), (6, "unknown"), (7, "omega zeta")]
    frame = spark.createDataFrame([(*r, 1, "x", 0.5) for r in docs], "doc_id long, text string, rank int, item_id string, length double")
    asked = spark.createDataFrame([(*r, "y", 2) for r in items], "item_id long, text string, key string, doc_id int")
    got = rows(ranked.search(frame, asked))
    assert got == plain(docs, items)
    assert [r[2] for r in sorted(got, key=lambda r: r[1]) if r[0] == 2] == [2, 5, 5, None, 7]
    assert rows(ranked.search(frame.limit(0), asked)) == []
    assert rows(ranked.search(frame, asked.limit(0))) == []
    assert rows(ranked.search(frame.where(F.col("text").isNull()), asked)) == []
