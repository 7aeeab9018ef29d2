"""n-way merge of series: repeated and null keys, colliding names, empty frames."""

import random

import pytest

from powerlens.operators import enrich as C


def frame(spark, rows, name, kind="double"):
    return spark.createDataFrame(rows, f"ts long, hostname string, {name} {kind}")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plain(tables):
    """Chain of full outer joins over lists of ((key), values); a key with a null part matches nothing."""
    acc = [(k, (v,)) for k, v in tables[0]]
    for i, table in enumerate(tables[1:], 1):
        hit, out = set(), []
        for k, vs in acc:
            found = [j for j, (k2, _) in enumerate(table) if k2 == k and None not in k]
            hit.update(found)
            out += [(k, (*vs, table[j][1])) for j in found] or [(k, (*vs, None))]
        acc = out + [(k, (None,) * i + (v,)) for j, (k, v) in enumerate(table) if j not in hit]
    return sorted(((*k, *vs) for k, vs in acc), key=str)


@pytest.mark.parametrize("n_frames", [2, 3, 4])
def test_equals_plain_loops(spark, n_frames):
    """Repeated keys, null keys and null values."""
    rnd = random.Random(n_frames)
    tables = [[((rnd.choice([1, 2, 3, 4, 5, None]), rnd.choice(["a", "b", None])), rnd.choice([float(j), None])) for j in range(rnd.randrange(5, 25))]
              for _ in range(n_frames)]
    frames = [frame(spark, [(*k, v) for k, v in t], f"v{i}") for i, t in enumerate(tables)]
    assert rows_of(C.merge_series(frames)) == plain(tables)


def test_text_values_names_and_empty_frames(spark):
    a, b = frame(spark, [(1, "h", "x")], "value", "string"), frame(spark, [(1, "h", 2.0), (2, "h", 3.0)], "value")
    c = frame(spark, [(2, "h", float("nan"))], "value")
    out = C.merge_series([a, None, b, c])
    assert out.columns == ["ts", "hostname", "value", "value_y", "value_y_y"]
    assert [str(tuple(r)) for r in out.orderBy("ts").collect()] == ["(1, 'h', 'x', 2.0, None)", "(2, 'h', None, 3.0, nan)"]
    assert rows_of(C.merge_series([a, b.limit(0)])) == [(1, "h", "x", None)]
    assert rows_of(C.merge_series([a.limit(0), b.limit(0)])) == []
    assert rows_of(C.merge_series([a])) == [(1, "h", "x")]
