"""KPI ladders and formulas (FIXTURES.md G10-G14)."""

import pytest
from pyspark.sql import functions as F

from powerlens.operators import kpi


def test_g10_pue_ladder(spark):
    df = spark.createDataFrame([(25.0, 100.0), (0.0, 0.0), (0.0, 100.0), (25.0, 0.0)], "irc double, pdu double")
    got = [r[0] for r in df.select(kpi.pue_value(F.col("irc"), F.col("pdu"))).collect()]
    assert got == [1.25, 0.0, 1.0, None]


def test_g11_pue_band(spark):
    df = spark.createDataFrame([(1.19,), (1.2,), (1.5,), (2.0,), (0.0,), (1.0,), (None,)], "p double")
    got = [r[0] for r in df.select(kpi.pue_band(F.col("p"))).collect()]
    assert got == ["excellent", "good", "average", "poor", "down", "irc_down", "unavailable"]


def test_g12_cop(spark):
    df = spark.createDataFrame([(10.0, 2.0, 36.0), (0.0, 0.0, 5.0)], "CompressorPower double, CondenserFanPower double, CoolDemand double")
    got = [r["cop"] for r in kpi._cop_columns(df).collect()]
    assert got == [3.0, None]


def test_g13_job_segments(spark, monkeypatch):
    from powerlens.operators import windows as W

    energy = spark.createDataFrame(
        [(1, m, e) for m, e in [("TotalCPUPower", 10.0), ("TotalMemoryPower", 2.0), ("TotalStoragePower", 1.0),
                                ("TotalFanPower", 1.0), ("PowerConsumption", 8.0), ("SystemInputPower", 30.0),
                                ("SystemOutputPower", 27.0)]],
        "job_id long, metric string, energy_kwh double",
    )
    energy = energy.withColumn("is_h100", F.lit(1))
    jobs = None
    seg = {r["segment"]: r["energy_kwh"] for r in W.job_segments(None, jobs, energy).collect()}
    assert seg["PSU loss"] == pytest.approx(3.0)
    assert seg["Others"] == pytest.approx(5.0)
    assert seg["GPU"] == 8.0
    # no rows when input energy is not positive
    zero = energy.withColumn("energy_kwh", F.when(F.col("metric") == "SystemInputPower", 0.0).otherwise(F.col("energy_kwh")))
    assert W.job_segments(None, jobs, zero).count() == 0


def test_g14_rack_verdict(spark):
    c, p, x = 860.0, 1000.0, 2.0 * 48
    raw = (c - p) / p * 100
    adj = (c + x - p) / p * 100
    assert raw == pytest.approx(-14.0)
    assert adj == pytest.approx(-4.4)
    df = spark.createDataFrame([(adj,), (15.0,), (-25.0,), (None,)], "pct double")
    got = [r[0] for r in df.select(kpi.rack_verdict(F.col("pct"))).collect()]
    assert got == ["GOOD", "ACCEPTABLE", "NEEDS INVESTIGATION", None]


def test_date_spine_inclusive(spark):
    d = [r["date"] for r in kpi.date_spine(spark, "2024-01-30 12:00:00", "2024-02-01 00:00:00").collect()]
    assert d == ["2024-01-30", "2024-01-31", "2024-02-01"]
