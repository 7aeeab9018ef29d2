"""Spelling variants: the search scheme and the whole operator against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from powerlens.llm import queries, variants
from powerlens.llm.common import table

SF = "/root/testdata/sf0.001"


def one_change(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_words(rows, every=None, length=5, count=3):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
            if every and h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            total[w] += 1
    return {w: n for w, n in total.items() if len(w) >= length and n >= count}


def plain_groups(n, times=2):
    holes = {}  # words by themselves with a hole at each place, or less a letter
    for w in n:
        for i in range(len(w)):
            holes.setdefault(w[:i] + "\0" + w[i + 1:], []).append(w)
            holes.setdefault(w[:i] + w[i + 1:], []).append(w)
        holes.setdefault(w, []).append(w)
    near = {w: set() for w in n}
    for group in holes.values():
        for a in set(group):
            near[a] |= {b for b in set(group) if one_change(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= times * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)
    return out


def result(df):
    rows = [(r.word, (r.form, r.root, r.n, r.n_near, r.form_n)) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def some_words(seed, number, letters="abcé", longest=7):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(1, longest + 1))) for _ in range(number)})


@pytest.mark.parametrize("seed", range(4))
def test_one_error_walk_finds_just_the_words_one_change_away(seed):
    words = some_words(seed, 400)
    asked = words + some_words(seed + 99, 50, "abcéz")
    exact = np.array([len(w) - len(w) // 2 for w in asked])
    q, w = variants.SuffixRanks(words).one_error(asked, exact)
    want = set()
    for i, a in enumerate(asked):
        half = a[len(a) // 2:]
        want |= {(i, j) for j, b in enumerate(words)
                 if one_change(a, b) and b.endswith(half) and (one_change(a[:len(a) // 2], b[:len(b) - len(half)]))}
    assert len(q) == len(set(zip(q.tolist(), w.tolist())))
    assert set(zip(q.tolist(), w.tolist())) == want


@pytest.mark.parametrize("shard", [40_000, 25])
def test_groups_equal_brute_force(spark, shard):
    """Small shards cut crowded halves into pieces; counts and forms stay the same."""
    rng = random.Random(5)
    words = some_words(7, 900, "ab", 9) + some_words(8, 500, "stñ", 8)
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 400)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = result(variants.group(docs, least_length=2, least_count=2, shard=shard))
    assert got == plain_groups(plain_words(rows, length=2, count=2))


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    got = result(queries.QUERIES["op13_spelling_variants"](spark, SF))
    want = plain_groups(plain_words(rows, 97))
    assert got == want
    assert any(v[0] for v in want.values())


def test_chains_of_forms(spark):
    rows = [(i, "abcde " * 40 + "abcdf " * 10 + "abcgf " * 5 + "abhgf " * 3) for i in range(1)]
    got = result(variants.group(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {w: v[:2] for w, v in got.items()} == {
        "abcde": (None, "abcde"), "abcdf": ("abcde", "abcde"), "abcgf": ("abcdf", "abcde"), "abhgf": (None, "abhgf")}
    long = spark.createDataFrame([(f"w{i:03}", f"w{i + 1:03}") for i in range(100)], "word string, form string")
    assert {r.word: r.root for r in variants.roots(long).collect()} == {f"w{i:03}": "w100" for i in range(100)}


def test_edges(spark):
    """Nulls, empty texts, repeated rows, clashing columns, an empty table, long texts, ties."""
    rows = [(None, "Straße straße STRASSE strasse"), (1, None), (2, ""), (2, "12 ÷÷÷ x"), (3, "hello hellp hellq"), (3, "hello hellp hellq")]
    rows = rows * 3 + [(9, "ÀÉÎÕÜ " * 4 + "àéîõüĀàéîõ " * 3)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    want = plain_groups(plain_words(rows))
    assert result(variants.group(docs)) == want
    assert want["hellq"][:1] == (None,) and want["hello"][3] == 2  # equal counts: no form, two near words
    empty = docs.limit(0)
    assert variants.group(empty).count() == 0
    assert variants.group(empty).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    text = "abcdefg " * 200_000 + "abcdef " * 3
    big = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert result(variants.group(big)) == plain_groups({"abcdefg": 200_000, "abcdef": 3})
    tie = spark.createDataFrame([(1, "xxxxb " * 6 + "xxxxa " * 6 + "xxxxc " * 3)], "doc_id long, text string")
    assert result(variants.group(tie))["xxxxc"] == ("xxxxa", "xxxxa", 3, 2, 6)
    with pytest.raises(ValueError):
        variants.group(docs, times=1)
    assert variants.vocabulary(docs.select(F.col("doc_id"), F.col("text"))).where("word = 'straße'").first().n == 6
