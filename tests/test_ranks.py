"""Rank selection against sorted lists, on continuous values; tails in watts; plan shape."""

import math
import random

import pytest
from pyspark.sql import functions as F

from powerlens.operators import ranks
from powerlens.operators import stats as ST
from powerlens.sources import telemetry as T

SF = "/root/testdata/sf0.001"


def percentile(values, q):
    x = sorted(values, key=lambda v: (math.isnan(v), v))
    p = (len(x) - 1) * q
    lo, hi = math.floor(p), math.ceil(p)
    return x[lo] if lo == hi or x[lo] == x[hi] else (hi - p) * x[lo] + (p - lo) * x[hi]


def series(seed):
    rng = random.Random(seed)
    out = {
        "continuous": [rng.lognormvariate(5, 1) for _ in range(3000)],
        "negative": [rng.gauss(0, 10) for _ in range(501)],
        "few": [rng.choice([0.0, 1.0, 2.5, 1e-300, 1e300]) for _ in range(200)],
        "close": [100 + rng.random() * 1e-9 for _ in range(400)],  # all in one bin
        "one": [7.25],
        "two": [3.0, 4.0],
        "equal": [5.0] * 99,
        "odd": [math.inf, -math.inf, *[rng.uniform(1, 2) for _ in range(20)]],
    }
    return {k: [v for v in vs] for k, vs in out.items()}


@pytest.fixture(params=["10m", "-1"])
def threshold(spark, request):
    """The chosen bins broadcast, or joined by a shuffle."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_percentiles_equal_sorted_lists(spark, threshold):
    data = series(1)
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in [*vs, None]], "k string, v double").repartition(5)
    qs = {"a": 0.0, "b": 0.03, "m": 0.5, "d": 0.75, "e": 0.97, "f": 1.0}
    got = {r.k: r for r in ranks.percentiles(df, ["k"], qs, beyond=True).collect()}
    assert got.keys() == data.keys()
    for k, vs in data.items():
        for name, q in qs.items():
            want = percentile(vs, q)
            assert got[k][name] == pytest.approx(want, rel=1e-12, nan_ok=True), (k, name)
            if math.isfinite(want) and k != "odd":
                le, ge = [v for v in vs if v <= got[k][name]], [v for v in vs if v >= got[k][name]]
                assert (got[k][f"{name}_n_le"], got[k][f"{name}_n_ge"]) == (len(le), len(ge)), (k, name)
                assert got[k][f"{name}_s_le"] == pytest.approx(math.fsum(le), rel=1e-9, abs=1e-6)
                assert got[k][f"{name}_s_ge"] == pytest.approx(math.fsum(ge), rel=1e-9, abs=1e-6)


def test_bins_keep_the_order(spark):
    rng = random.Random(3)
    vs = sorted([rng.choice([-1, 1]) * 2.0 ** rng.uniform(-1074, 1023) for _ in range(2000)] + [0.0, -0.0, 5e-324, -5e-324, math.inf, -math.inf])
    near = [x for v in (1.0, 2.0, 64.0, 1e-3) for x in (math.nextafter(v, 0), v, math.nextafter(v, 9e9))]
    for values in (vs, sorted(near)):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
        bins = [r.b for r in df.orderBy("i").select(ranks.value_bin(F.col("v")).alias("b")).collect()]
        assert bins == sorted(bins)


def test_names_must_not_clash(spark):
    with pytest.raises(ValueError):
        ranks.percentiles(spark.createDataFrame([("a", 1.0)], "n string, v double"), ["n"], {"q": 0.5})


def frame(spark, rows):
    df = spark.createDataFrame([(i, f"2025-01-01 00:{t // 60:02}:{t % 60:02}", "rpg-93-1", m, d, v, u) for i, (t, m, d, v, u) in enumerate(rows)],
                               "event_id long, ts string, hostname string, metric string, fqdd string, value double, units string")
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_tails_of_mixed_units_are_in_watts(spark):
    """Half of the readings in kW: the percentile orders watts, not numbers."""
    rows = [(t, "SystemInputPower", None, 0.1 + t / 1000 if t % 2 else 100.0 + t, "kW" if t % 2 else "W") for t in range(100)]
    watts = [v * 1000 if u == "kW" else v for _, _, _, v, u in rows]
    r = ST.idle_power(frame(spark, rows)).collect()[0]
    assert r.units == "W" and r.p3_value == pytest.approx(percentile(watts, 0.03)) and r.min_nonzero == pytest.approx(100.0)
    tail = [w for w in watts if w <= percentile(watts, 0.03) + 1e-9]
    assert r.samples_in_lower3 == len(tail) and r.lower3_mean == pytest.approx(sum(tail) / len(tail))
    same = ST.peak_power(frame(spark, [(t, "PowerConsumption", "g1", 1000.0 * t, "mW") for t in range(1, 51)])).where("fqdd = 'g1'").collect()[0]
    assert same.units == "mW" and same.max_value == pytest.approx(50_000.0)


def test_devices_and_their_total(spark):
    """A row without a device counts in TOTAL only; a device called TOTAL stays by itself."""
    rows = [(t, "PowerConsumption", d, v, "W") for t in range(10) for d, v in (("g1", 10.0 + t), ("TOTAL", 1.0), (None, 100.0))]
    rows += [(t, "SystemInputPower", None, 5.0, "W") for t in range(4)]
    got = sorted((r.metric, r.fqdd, r.max_value, r.sample_count) for r in ST.peak_power(frame(spark, rows)).where("metric = 'PowerConsumption'").collect())
    assert got == [("PowerConsumption", "TOTAL", 1.0, 10), ("PowerConsumption", "TOTAL", 120.0, 10), ("PowerConsumption", "g1", 19.0, 10)]
    lone = ST.peak_power(frame(spark, rows)).where("metric = 'SystemInputPower'").collect()
    assert [(r.fqdd, r.max_value, r.sample_count) for r in lone] == [(None, 5.0, 4)]


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", ["power_statistics", "raw_statistics", "idle_power", "peak_power"])
def test_no_value_map_in_the_plan(spark, name):
    r = T.compute_readings(spark, SF)
    p = final_plan(getattr(ST, name)(r))
    assert "percentile(" not in p and "SortAggregate" not in p and "ObjectHashAggregate" not in p
