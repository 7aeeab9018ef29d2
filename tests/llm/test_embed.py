"""Vector near-duplicates against brute force."""

import math

import numpy as np
import pytest

from powerlens.llm import embed


def plain(rows, threshold):
    ok = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok[k] = np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64))
    near = {k: {j for j in ok if j != k and len(ok[j]) == len(ok[k]) and ok[j] @ ok[k] >= threshold} for k in ok}
    out = []
    for k, (i, _) in enumerate(rows):
        group, todo = {k}, [k]
        while todo:
            new = near.get(todo.pop(), set()) - group
            group |= new
            todo += new
        comp = min((rows[g][0] for g in group if rows[g][0] is not None), default=None)
        out.append((i, len(near.get(k, ())), comp, i is not None and i == comp))
    return sorted(out, key=str)


def frame(spark, rows):
    data = [(i, None if v is None else [None if x is None else float(x) for x in v], "x") for i, v in rows]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, vector string")


@pytest.mark.parametrize(("tile", "block"), [(8192, 1024), (30, 7)])
def test_against_all_pairs(spark, monkeypatch, tile, block):
    monkeypatch.setattr(embed, "TILE", tile)
    monkeypatch.setattr(embed, "BLOCK", block)
    rng = np.random.default_rng(5)
    rows = []
    for c in rng.normal(size=(12, 16)):
        for _ in range(12):
            rows.append((len(rows), (c + 0.25 * rng.normal(size=16)).astype(np.float32).tolist()))
    rows += [(len(rows) + k, rows[k][1]) for k in (0, 0, 0, 5, 20)]  # copies
    rows += [(500, None), (501, []), (502, [0.0] * 16), (503, [None] + [1.0] * 15), (504, [math.nan] * 16), (505, [math.inf] * 16),
             (506, [1.0, 2.0]), (507, [1.0, 2.1]), (None, rows[3][1]), (None, None), (508, rows[7][1]), (508, rows[30][1]),
             (509, [1e-30] * 16), (510, [3e-30] * 16), (511, [1e38] * 16)]
    got = sorted((tuple(r) for r in embed.near_duplicates(frame(spark, rows), 0.9).collect()), key=str)
    assert got == plain(rows, 0.9)


def test_one_group_of_many(spark, monkeypatch):
    monkeypatch.setattr(embed, "TILE", 40)
    rng = np.random.default_rng(6)
    rows = [(k, (np.ones(8) + 0.02 * rng.normal(size=8)).tolist()) for k in range(200)]
    got = embed.near_duplicates(frame(spark, rows), 0.9).collect()
    assert {tuple(r)[1:3] for r in got} == {(199, 0)}


def test_far_tiles_are_not_formed_and_chains_hold(spark, monkeypatch):
    monkeypatch.setattr(embed, "TILE", 10)
    rows = [(k, [math.cos(k * 0.3), math.sin(k * 0.3), 0.0]) for k in range(21)]
    got = sorted((tuple(r) for r in embed.near_duplicates(frame(spark, rows), 0.95).collect()), key=str)
    assert got == plain(rows, 0.95)


def test_empty(spark):
    assert embed.near_duplicates(frame(spark, []), 0.9).count() == 0
    assert [tuple(r) for r in embed.near_duplicates(frame(spark, [(1, None)]), 0.9).collect()] == [(1, 0, 1, True)]
