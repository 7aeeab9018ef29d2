"""Hand-computed energy cases (FIXTURES.md section 2, G1-G9)."""

import pytest

from powerlens.operators import energy as E


def one(df, col="energy_kwh"):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0][col]


def test_g1_readme_table(readings):
    df = readings([("2025-01-01 23:00:01", 150), ("2025-01-01 23:00:31", 155), ("2025-01-01 23:01:01", 148), ("2025-01-01 23:01:31", 152)])
    e = E.energy_boundary(df, start="2025-01-01 23:00:00", end="2025-01-01 23:01:31")
    assert one(e) == pytest.approx(0.003825, abs=1e-12)
    rows = E.power_intervals(df).orderBy("ts").collect()
    assert rows[0]["energy_interval_kwh"] is None
    assert [round(r["energy_interval_kwh"] * 3.6e6, 6) for r in rows[1:]] == [4575.0, 4545.0, 4500.0]
    cum = E.cumulative_energy(df).orderBy("ts").collect()
    assert cum[0]["cumulative_energy_kwh"] == 0.0
    assert cum[-1]["cumulative_energy_kwh"] == pytest.approx((4575 + 4545 + 4500) / 3.6e6)


def test_g2_constant_hour(readings):
    rows = [(f"2025-01-01 10:{m:02d}:00", 100) for m in range(60)] + [("2025-01-01 11:00:00", 100)]
    e = E.energy_boundary(readings(rows), start="2025-01-01 10:00:00", end="2025-01-01 11:00:00")
    assert one(e) == pytest.approx(0.1)


def test_g3_ramp(readings):
    df = readings([("2025-01-01 10:00:00", 100), ("2025-01-01 10:01:00", 200), ("2025-01-01 10:02:00", 300)])
    assert one(E.energy_boundary(df)) == pytest.approx(24000 / 3.6e6)


def test_g4_single_reading_with_bounds(readings):
    df = readings([("2025-01-01 10:30:00", 100)])
    assert one(E.energy_boundary(df, start="2025-01-01 10:00:00", end="2025-01-01 11:00:00")) == pytest.approx(0.1)
    assert one(E.energy_hold(df, start="2025-01-01 10:00:00", end="2025-01-01 11:00:00")) == pytest.approx(0.1)


def test_g5_single_reading_no_bounds(readings):
    assert one(E.energy_boundary(readings([("2025-01-01 10:30:00", 100)]))) == 0.0


def _secs(offsets, p=1000):
    from datetime import datetime, timedelta

    t0 = datetime(2025, 1, 1, 12, 0, 0)
    return [((t0 + timedelta(seconds=s)).strftime("%Y-%m-%d %H:%M:%S"), p) for s in offsets]


def test_g6_gap_skipped(readings):
    e = E.energy_gap(readings(_secs([0, 120, 240, 721, 841])), max_gap_seconds=480)
    assert one(e) == pytest.approx(0.1)


def test_g7_gap_kept_at_limit(readings):
    e = E.energy_gap(readings(_secs([0, 120, 240, 720, 840])), max_gap_seconds=480)
    assert one(e) == pytest.approx(0.233333, abs=1e-6)


def test_g6_default_gap_by_node_type(readings):
    # pdu cadence 60 s -> limit 240 s: the 481 s and the 241 s intervals are skipped
    df = readings(_secs([0, 60, 120, 601, 842]), node_type="pdu")
    assert one(E.energy_gap(df)) == pytest.approx(1000 * 120 / 3.6e6)


def test_g8_midnight_split(readings):
    df = readings([("2025-01-01 23:59:00", 100), ("2025-01-02 00:01:00", 200)])
    d = {r["date"]: r["energy_kwh"] for r in E.energy_daily(df, max_gap_seconds=240).collect()}
    assert d["2025-01-01"] == pytest.approx(7500 / 3.6e6)
    assert d["2025-01-02"] == pytest.approx(10500 / 3.6e6)


def test_g9_interval_ending_at_midnight(readings):
    df = readings([("2025-01-01 23:59:00", 100), ("2025-01-02 00:00:00", 100)])
    d = {r["date"]: r["energy_kwh"] for r in E.energy_daily(df, max_gap_seconds=240).collect()}
    assert d == {"2025-01-01": pytest.approx(6000 / 3.6e6)}


def test_multi_day_interval_split(readings):
    # one 3-day interval, constant power: a quarter day before, full day, rest after
    df = readings([("2025-01-01 18:00:00", 100), ("2025-01-03 06:00:00", 100)])
    d = {r["date"]: r["energy_kwh"] for r in E.energy_daily(df, max_gap_seconds=10**7).collect()}
    assert d["2025-01-01"] == pytest.approx(0.6)
    assert d["2025-01-02"] == pytest.approx(2.4)
    assert d["2025-01-03"] == pytest.approx(0.6)


def test_dedupe_keeps_lowest_event(readings):
    df = readings([("2025-01-01 10:00:00", 100), ("2025-01-01 10:00:00", 999), ("2025-01-01 10:01:00", 100)])
    out = E.dedupe_timestamps(df).orderBy("ts").collect()
    assert [r["value"] for r in out] == [100.0, 100.0]


def test_units_converted_per_row(readings, spark):
    df = readings([("2025-01-01 10:00:00", 100000), ("2025-01-01 10:01:00", 100000)], units="mW")
    assert one(E.energy_boundary(df)) == pytest.approx(100 * 60 / 3.6e6)


def test_energy_simple(readings):
    df = readings([("2025-01-01 10:00:00", 100), ("2025-01-01 11:00:00", 300)])
    assert one(E.energy_simple(df)) == pytest.approx(0.2)


def test_a_device_called_total_is_not_the_total(readings):
    hours = [f"2025-01-01 0{h}:00:00" for h in range(3)]
    df = readings([(t, 100.0) for t in hours], fqdd="TOTAL").unionByName(readings([(t, 50.0) for t in hours], fqdd="d1"))
    got = sorted((r.fqdd, r.is_total, round(r.energy_kwh, 9)) for r in E.energy_per_fqdd(df).collect())
    assert got == [("TOTAL", False, 0.2), ("TOTAL", True, 0.3), ("d1", False, 0.1)]
