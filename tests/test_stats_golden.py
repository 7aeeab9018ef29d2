"""Statistics, tails, anomalies, cleaning (FIXTURES.md G15-G19)."""

import pytest
from pyspark.sql import functions as F

from powerlens.operators import stats as ST


def _series(spark, values, fqdd=None):
    rows = [(i, f"2025-01-01 00:{i // 60:02d}:{i % 60:02d}", "rpg-93-1", "TotalCPUPower", fqdd, float(v), "W") for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "event_id long, ts string, hostname string, metric string, fqdd string, value double, units string")
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_g15_idle(spark):
    r = ST.idle_power(_series(spark, range(101))).collect()[0]
    assert r["p3_value"] == pytest.approx(3.97)
    assert r["lower3_mean"] == pytest.approx(2.0)
    assert r["min_nonzero"] == 1.0
    assert r["sample_count"] == 101
    assert r["samples_in_lower3"] == 3


def test_g16_peak(spark):
    r = ST.peak_power(_series(spark, range(101))).collect()[0]
    assert r["p97_value"] == pytest.approx(97.03)
    assert r["upper3_mean"] == pytest.approx(99.0)
    assert r["max_value"] == 100.0
    assert r["samples_in_upper3"] == 3


def test_tail_all_zero(spark):
    r = ST.idle_power(_series(spark, [0, 0, 0])).collect()[0]
    assert (r["p3_value"], r["lower3_mean"], r["min_nonzero"], r["sample_count"], r["samples_in_lower3"]) == (0.0, 0.0, 0.0, 3, 0)


def test_tail_total_series(spark):
    a = _series(spark, [1, 2, 3], fqdd="dev.1")
    b = _series(spark, [10, 20, 30], fqdd="dev.2").withColumn("event_id", F.col("event_id") + 100)
    rows = {r["fqdd"]: r for r in ST.peak_power(a.unionByName(b)).collect()}
    assert set(rows) == {"dev.1", "dev.2", "TOTAL"}
    assert rows["TOTAL"]["max_value"] == 33.0
    pref = ST.tail_preferred(ST.peak_power(a.unionByName(b)), "p97_value", True).collect()
    assert [r["fqdd"] for r in pref] == ["TOTAL"]


def test_g18_rolling(spark):
    df = _series(spark, range(10)).withColumn("power_w", F.col("value"))
    rows = ST.detect_anomalies(df, window_size=4).orderBy("event_id").collect()
    means = [r["power_rolling_mean"] for r in rows]
    assert means[:2] == [None, None] and means[9] is None
    assert means[2:9] == pytest.approx([1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 7.5])
    assert not any(r["is_anomaly"] for r in rows)


def test_rolling_odd_window(spark):
    df = _series(spark, range(10)).withColumn("power_w", F.col("value"))
    rows = ST.detect_anomalies(df, window_size=3).orderBy("event_id").collect()
    assert rows[1]["power_rolling_mean"] == pytest.approx(1.0)  # rows 0..2 centred on 1


def test_g19_zero_variance_kept(spark):
    df = _series(spark, [5] * 12)
    assert ST.clean_readings(df, "2030-01-01 00:00:00", 10_000, 10).count() == 12


def test_clean_drops_outlier_and_range(spark):
    vals = [100] * 30 + [100000, -5, 5000]
    out = ST.clean_readings(_series(spark, vals), "2030-01-01 00:00:00", 10_000, 10)
    kept = sorted(r["value"] for r in out.collect())
    assert 100000.0 not in kept and -5.0 not in kept
    assert 5000.0 not in kept  # z-score > 3 among the remaining 31 rows


def test_power_statistics_quartiles(spark):
    from powerlens.operators import energy as E

    df = _series(spark, [1, 2, 3, 4])
    r = ST.power_statistics(df).collect()[0]
    assert (r["median_power_w"], r["q25_power_w"], r["q75_power_w"]) == (2.5, 1.75, 3.25)


def test_bucket_rejects_non_divisor(spark):
    with pytest.raises(ValueError):
        ST.bucket_aggregate(_series(spark, [1]), bucket="7 minutes")


def test_bucket_last_value_by_time_and_event(spark):
    """Ties of time go to the larger event id; ids far apart, negative or missing; times before the epoch."""
    big = 2**62
    rows = [("a", "2025-01-01 00:10:00", 1, 1.0), ("a", "2025-01-01 00:59:59.999999", -big, 2.0), ("a", "2025-01-01 00:59:59.999999", None, 3.0),
            ("b", "2025-01-01 00:00:00", big, 4.0), ("b", "2025-01-01 00:00:00", big - 1, 5.0), ("b", "2025-01-01 00:00:00", -1, 6.0),
            ("c", "1969-12-31 23:59:59", 9, 7.0), ("c", "1969-12-31 23:59:59.000001", -9, 8.0), ("d", "2025-01-01 00:00:00", None, 9.0)]
    df = spark.createDataFrame([(h, t, i, v, v, v) for h, t, i, v in rows],
                               "hostname string, ts string, event_id long, power_w double, value double, cumulative_energy_kwh double")
    out = ST.bucket_aggregate(df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))).collect()
    assert {r.hostname: r.cumulative_energy_kwh_last for r in out} == {"a": 2.0, "b": 4.0, "c": 8.0, "d": 9.0}


def test_rolling_chunks_match_unchunked(spark):
    """Chunked rolling windows with halos equal one window over the series."""
    import random

    random.seed(7)
    vals = [random.uniform(0, 100) for _ in range(257)]
    df = _series(spark, vals).withColumn("power_w", F.col("value"))
    for w in (4, 5):
        ref = {r["event_id"]: (r["power_rolling_mean"], r["is_anomaly"]) for r in ST.detect_anomalies(df, w).collect()}
        for chunk in (7, 16, 50):
            got = {r["event_id"]: (r["power_rolling_mean"], r["is_anomaly"]) for r in ST.detect_anomalies(df, w, chunk_rows=chunk).collect()}
            assert got.keys() == ref.keys()
            for k in ref:
                a, b = got[k][0], ref[k][0]
                assert (a is None and b is None) or a == pytest.approx(b)
                assert got[k][1] == ref[k][1]


def test_series_index_across_buckets(spark):
    from powerlens.operators import energy as E

    rows = [(i, f"2025-01-{1 + i // 5:02d} 0{i % 5}:00:00", "h", "m", None, 1.0, "W") for i in range(23)]
    df = spark.createDataFrame(rows, "event_id long, ts string, hostname string, metric string, fqdd string, value double, units string")
    df = df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    idx = sorted((r["event_id"], r["_idx"]) for r in E.series_index(df, bucket_seconds=3600).collect())
    assert [i for _, i in idx] == list(range(23))


def test_validate_long_form(spark):
    df = _series(spark, [5, -1, 20000])
    rows = {r["check"]: r["value"] for r in ST.validate_readings_long(df).collect()}
    assert rows["total_records"] == 3.0 and rows["negative_values"] == 1.0 and rows["over_10kw"] == 1.0
    assert rows["null_fqdd"] == 3.0
