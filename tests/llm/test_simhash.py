"""SimHash near-duplicates against brute force."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from powerlens.llm import simhash


def plain_fingerprint(text, shingle):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    parts = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, distance):
    """rows: (id, fingerprint); smallest id reachable, by search over all pairs."""
    n = len(rows)
    left, comp = set(range(n)), [None] * n
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            i = todo.pop()
            group.add(i)
            near = {j for j in left if bin(rows[i][1] ^ rows[j][1]).count("1") <= distance}
            left -= near
            todo += near
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        for i in group:
            comp[i] = min(ids, default=None)
    return comp


TEXTS = [None, "", " \n", "One", "one", "one two", "ONE  two\tthree", "one two three", "é È x", "a\x1cb c d", "nul l"]


@pytest.mark.parametrize("shingle", [1, 3, 5])
def test_fingerprints(shingle, monkeypatch):
    monkeypatch.setattr(simhash, "HASHES_AT_ONCE", 4)
    rng = random.Random(shingle)
    texts = TEXTS + [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 30))) for _ in range(200)]
    for t in texts:
        assert simhash.fingerprint_of(t, shingle) % 2**64 == plain_fingerprint(t, shingle), t


@pytest.mark.parametrize("crowd", [1024, 2])
@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_links_equal_all_pairs(spark, monkeypatch, distance, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(distance)
    values = {0, 1, -1, 2**63 - 1, -(2**63)}
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(8):
            y = x
            for b in rng.sample(range(64), rng.randrange(0, 4)):
                y ^= 1 << b
            values.add(y - 2**64 if y >= 2**63 else y)
    values = sorted(values)
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), distance).collect()}
    want = {(a, b) for a in values for b in values if a < b and bin((a ^ b) % 2**64).count("1") <= distance}
    assert got == want


def test_whole_operator(spark):
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    base = [" ".join(rng.choice("abcdefghijklm") for _ in range(400)) for _ in range(5)]
    for b in base:
        for _ in range(6):
            words = b.split()
            words[rng.randrange(400)] = "new"
            rows.append((len(rows), " ".join(words)))
    rows += [(None, base[0]), (3, "other text entirely"), (3, "One"), (None, "alone without id")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df, 3, 2).collect()), key=str)
    prints = [plain_fingerprint(t, 3) for _, t in rows]
    comp = plain_components([(d, p) for (d, _), p in zip(rows, prints, strict=True)], 2)
    assert got == sorted(((d, f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, comp, strict=True)), key=str)
    kept = simhash.keep_one(df, 3, 2).collect()
    assert df.columns == list(kept[0].asDict())
    with_id = [r.doc_id for r in kept if r.doc_id is not None]
    assert set(with_id) == {c for c in comp if c is not None}
    assert [r.text for r in kept if r.doc_id is None] == ["alone without id"]


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "same text here"), (1, "same text here"), (2, "same text here")], "doc_id long, text string")
    assert [tuple(r) for r in simhash.keep_one(df, 3, 2).collect()] == [(1, "same text here")]
    assert simhash.near_duplicates(df.where(F.lit(False)), 3, 2).count() == 0
    assert simhash.keep_one(df.where(F.lit(False)), 3, 2).count() == 0
