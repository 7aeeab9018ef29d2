"""Energy operators against plain Python loops on random series.

The loops follow the documented rules directly (sort by time, pair
neighbours, skip by gap, split at midnight); the Spark side uses buckets,
border stitching and prefix sums.  Small buckets force many borders."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from powerlens.operators import energy as E

START = datetime(2025, 3, 1, 0, 0, 0)


def make_rows(seed, n_series=4, n=60):
    rnd = random.Random(seed)
    rows, eid = [], 0
    for s in range(n_series):
        t = START + timedelta(seconds=rnd.randint(0, 3600))
        for _ in range(n):
            step = rnd.choice([0, 30, 60, 120, 300, 900, 3600 * 5, 3600 * 30])
            t = t + timedelta(seconds=step, microseconds=rnd.randint(0, 999999) if step else 0)
            p = round(rnd.uniform(0, 500), 2)
            rows.append((eid, t, f"h{s % 2}", f"m{s}", None, p, rnd.choice(["W", "kW", "mW"])))
            eid += 1
    rnd.shuffle(rows)
    return rows


def watts(v, u):
    return v / 1000.0 if u == "mW" else v * 1000.0 if u == "kW" else v


def series(rows):
    out = {}
    for eid, t, h, m, f, v, u in rows:
        out.setdefault((h, m, f), []).append((t, eid, watts(v, u)))
    return {k: sorted(v) for k, v in out.items()}


def secs(a, b):
    return (b - a) / timedelta(microseconds=1) / 1e6


def loop_gap(pts, gap):
    e = 0.0
    for (t0, _, p0), (t1, _, p1) in zip(pts, pts[1:]):
        dt = secs(t0, t1)
        if 0 < dt <= gap:
            e += (p0 + p1) / 2 * dt
    return e / 3.6e6


def loop_daily(pts, gap):
    """Each kept pair is a line p(t); every day that it touches gets the area under its own part,
    mean of the line's two end values there times their distance."""
    firsts = {}
    for t, eid, p in sorted(pts, key=lambda x: (x[0], x[1]), reverse=True):
        firsts[t] = p  # of equal times the smallest id stays
    line = sorted(firsts.items())
    area = {}
    for (a, pa), (b, pb) in zip(line, line[1:]):
        if secs(a, b) > gap:
            continue

        def power(t):
            return pa + (pb - pa) * secs(a, t) / secs(a, b)

        for n in range((b.date() - a.date()).days + 1):
            midnight = datetime.combine(a.date() + timedelta(days=n), datetime.min.time())
            lo, hi = max(a, midnight), min(b, midnight + timedelta(days=1))
            if lo < hi:
                day = midnight.date().isoformat()
                area[day] = area.get(day, 0.0) + 0.5 * (power(lo) + power(hi)) * secs(lo, hi)
    return {k: v / 3.6e6 for k, v in area.items()}


def loop_boundary(pts, s, e):
    rows = list(pts)
    if rows[0][0] > s:
        rows = [(s, -1, rows[0][2])] + rows
    if rows[-1][0] < e:
        rows = rows + [(e, -2, rows[-1][2])]
    return sum((a[2] + b[2]) / 2 * secs(a[0], b[0]) for a, b in zip(rows, rows[1:])) / 3.6e6


@pytest.fixture(scope="module", params=[1, 2])
def data(request, spark):
    rows = make_rows(request.param)
    df = spark.createDataFrame(
        rows, "event_id long, ts timestamp_ntz, hostname string, metric string, fqdd string, value double, units string"
    )
    return rows, df


KEYS = ["hostname", "metric", "fqdd"]


def test_gap_energy(data):
    rows, df = data
    got = {tuple(r[k] for k in KEYS): r["energy_kwh"] for r in E.energy_gap(df, KEYS, 4000.0).collect()}
    want = {k: loop_gap(v, 4000.0) for k, v in series(rows).items()}
    for k, v in want.items():
        assert got.get(k, 0.0) == pytest.approx(v, rel=1e-9, abs=1e-12)


def test_daily_energy_small_buckets(data):
    rows, df = data
    d = E.kept_intervals(df, KEYS, 200000.0, dedupe=True)
    got = {}
    for r in E.day_pieces(d).groupBy(*KEYS, "day").agg(F.sum("piece_j").alias("j")).collect():
        got[(tuple(r[k] for k in KEYS), r["day"].isoformat())] = r["j"] / 3.6e6
    want = {}
    for k, v in series(rows).items():
        for day, e in loop_daily(v, 200000.0).items():
            want[(k, day)] = e
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("bucket", [3600, 86400])
def test_boundary_and_cumulative(data, bucket):
    rows, df = data
    s, e = datetime(2025, 2, 28), datetime(2025, 4, 1)
    parts = E.boundary_parts(df, KEYS, bucket_seconds=bucket)
    got = {tuple(r[k] for k in KEYS): r["energy_kwh"] for r in parts.select(
        *KEYS, E.boundary_kwh(F.lit(int((s - datetime(1970, 1, 1)).total_seconds() * 1e6)),
                              F.lit(int((e - datetime(1970, 1, 1)).total_seconds() * 1e6))).alias("energy_kwh")).collect()}
    ser = series(rows)
    for k, v in ser.items():
        assert got[k] == pytest.approx(loop_boundary(v, s, e), rel=1e-9)
    cum = E.cumulative_energy(df, KEYS, bucket_seconds=bucket)
    last = {tuple(r[k] for k in KEYS): r["c"] for r in cum.groupBy(*KEYS).agg(
        F.max_by("cumulative_energy_kwh", F.struct("ts", "event_id")).alias("c")).collect()}
    for k, v in ser.items():
        allpairs = sum((a[2] + b[2]) / 2 * secs(a[0], b[0]) for a, b in zip(v, v[1:])) / 3.6e6
        assert last[k] == pytest.approx(allpairs, rel=1e-9, abs=1e-12)


def _expand(pattern):
    """Plain-Python reference expansion of one host pattern."""
    import re as _re

    m = _re.search(r"\[([^\]]*)\]", pattern)
    if not m:
        return [pattern]
    head, tail = pattern[: m.start()], pattern[m.end():]
    out = []
    for part in m.group(1).split(","):
        lo, _, hi = part.partition("-")
        hi = hi or lo
        for n in range(int(lo), int(hi) + 1):
            num = str(n).rjust(len(lo), "0") if lo.startswith("0") else str(n)
            out += _expand(head + num + tail)
    return out


def test_nodelist_random(spark):
    from powerlens.functions import nodes as N

    rnd = random.Random(5)
    lists = []
    for j in range(40):
        pats = []
        for _ in range(rnd.randint(1, 3)):
            groups = []
            for _ in range(rnd.randint(0, 2)):
                ranges = []
                for _ in range(rnd.randint(1, 3)):
                    a = rnd.randint(0, 12)
                    b = a + rnd.randint(0, 3)
                    w = rnd.choice([1, 2])
                    ranges.append(f"{a:0{w}d}-{b:0{w}d}" if rnd.random() < 0.6 else f"{a:0{w}d}")
                groups.append("[" + ",".join(ranges) + "]")
            pats.append(rnd.choice(["rpc-9", "rpg-", "n"]) + "x".join(groups) + rnd.choice(["", "-ib"]))
        lists.append((j, ",".join(pats)))
    df = spark.createDataFrame(lists, "job_id long, nodelist string")
    got = {}
    for r in N.explode_nodelist(df).collect():
        got.setdefault(r["job_id"], []).append(r["hostname"])
    for j, nl in lists:
        import re as _re

        want = [h for p in _re.split(r",(?![^\[]*\])", nl) for h in _expand(p.strip())]
        assert sorted(got.get(j, [])) == sorted(want), nl


def test_window_time_formats_random(spark):
    from powerlens.functions import times as TM

    rnd = random.Random(9)
    rows = []
    for i in range(60):
        t = datetime(2020, 1, 1) + timedelta(seconds=rnd.randint(0, 10 ** 8))
        fmt = rnd.choice(["%m/%d/%y %H:%M", "%m/%d/%y %H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%m/%d/%Y %H:%M", "%m/%d/%Y %H:%M:%S"])
        text = t.strftime(fmt)
        if fmt.startswith("%m") and rnd.random() < 0.5:  # unpadded month/day/hour as exported by spreadsheets
            text = text.lstrip("0").replace("/0", "/").replace(" 0", " ")
        want = t if "%S" in fmt else t.replace(second=0)
        rows.append((i, text, want))
    df = spark.createDataFrame(rows, "i long, s string, want timestamp_ntz")
    for r in df.select("i", TM.parse_window_time("s").alias("got"), "want").collect():
        assert r["got"] == r["want"], r
