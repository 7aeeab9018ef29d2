"""KPIs end to end on small hand-built readings (expected values by hand)."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from powerlens.operators import kpi
from powerlens.operators import windows as W

T0 = datetime(2025, 1, 1, 12, 0, 0)
DDL = "event_id long, ts string, nodeid long, hostname string, node_type string, fqdd string, metric string, value double, units string"


def frame(spark, rows):
    data = []
    for i, (sec, host, nt, metric, value, units, fqdd) in enumerate(rows):
        ts = (T0 + timedelta(seconds=sec)).strftime("%Y-%m-%d %H:%M:%S")
        data.append((i, ts, 0, host, nt, fqdd, metric, float(value), units))
    return spark.createDataFrame(data, DDL).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_pue_default_gaps(spark):
    rows = [(t, "irc-91-5", "irc", "CompressorPower", 1.0, "kW", None) for t in (0, 120, 240)]
    rows += [(t, "irc-91-5", "irc", "CompressorPower", 1.0, "kW", None) for t in (1000,)]  # 760 s gap > 480: skipped
    rows += [(t, "pdu-91-1", "pdu", "pdu", 2000.0, "W", None) for t in (0, 60, 120, 180, 240)]
    r = frame(spark, rows)
    out = kpi.pue(spark, r, "2025-01-01 00:00:00", "2025-01-02 00:00:00").collect()[0]
    assert out["irc_energy_kwh"] == pytest.approx(240000 / 3.6e6)
    assert out["pdu_energy_kwh"] == pytest.approx(480000 / 3.6e6)
    assert out["pue"] == pytest.approx(1.5)
    assert out["band"] == "average"
    assert out["avg_pdu_power_kw"] == pytest.approx(480000 / 3.6e6 / 24)
    nodes = {(x["hostname"], x["metric"]): x["energy_kwh"] for x in kpi.pue_node_breakdown(spark, r, "2025-01-01 00:00:00", "2025-01-02 00:00:00").collect()}
    assert len(nodes) == 6 * 2 + 24
    assert nodes[("irc-92-5", "CompressorPower")] == 0.0


def test_pue_daily_spine_and_split(spark):
    # PDU 1 kW across midnight (23:58 -> 00:02, 60 s steps), no IRC -> PUE 1 on both days, 0 elsewhere
    start = datetime(2025, 1, 1, 23, 58, 0)
    rows = []
    for k in range(5):
        ts = start + timedelta(seconds=60 * k)
        rows.append(((ts - T0).total_seconds(), "pdu-91-1", "pdu", "pdu", 1000.0, "W", None))
    r = frame(spark, rows)
    d = {x["date"]: x for x in kpi.pue_daily(spark, r, "2024-12-31 00:00:00", "2025-01-03 00:00:00").collect()}
    assert sorted(d) == ["2024-12-31", "2025-01-01", "2025-01-02", "2025-01-03"]
    assert d["2025-01-01"]["pdu_energy_kwh"] == pytest.approx(120000 / 3.6e6)
    assert d["2025-01-02"]["pdu_energy_kwh"] == pytest.approx(120000 / 3.6e6)
    assert d["2025-01-01"]["pue"] == 1.0
    assert d["2024-12-31"]["pue"] == 0.0


def test_rack_cop(spark):
    rows = []
    for m, v, u in (("CompressorPower", 10.0, "kW"), ("CondenserFanPower", 2000.0, "W"), ("CoolDemand", 36.0, "kW")):
        rows += [(t, "irc-93-3", "irc", m, v, u, None) for t in (0, 120, 240)]
    r = frame(spark, rows)
    got = {x["rack"]: x for x in kpi.rack_cop(spark, r, "2025-01-01 00:00:00", "2025-01-02 00:00:00").collect()}
    assert sorted(got) == [91, 92, 93, 94, 95, 96]
    assert got[93]["cop"] == pytest.approx(3.0)
    assert got[91]["cop"] is None
    s = kpi.rack_cop_summary(spark, r, "2025-01-01 00:00:00", "2025-01-02 00:00:00").collect()[0]
    assert (s["total_racks"], s["racks_with_data"]) == (6, 1)


def test_job_energy_with_boundaries(spark):
    # two rpc hosts, 100 W SystemInputPower readings inside a 1 h job; T3 extends to the job bounds
    rows = []
    for host in ("rpc-91-1", "rpc-91-2"):
        rows += [(t, host, "compute", "SystemInputPower", 100.0, "W", None) for t in (600, 1800, 3000)]
    rows += [(1200, "rpg-93-1", "compute", "PowerConsumption", 50000.0, "mW", "gpu.1")]
    r = frame(spark, rows)
    jobs = spark.createDataFrame(
        [(7, "u", "rpc-91-[1-2],rpg-93-1", "2025-01-01 12:00:00", "2025-01-01 13:00:00")],
        "job_id long, job_user string, nodelist string, start_ts string, end_ts string",
    ).select("job_id", "job_user", "nodelist", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start_ts", "end_ts")])
    e = {x["metric"]: x["energy_kwh"] for x in W.job_energy(r, jobs).collect()}
    assert e["SystemInputPower"] == pytest.approx(2 * 0.1)
    assert e["PowerConsumption"] == pytest.approx(0.05)  # one reading held over the whole hour
    summ = {x["label"]: x["energy_kwh"] for x in W.job_energy_summary(r, jobs).collect()}
    assert summ["Energy_SystemInputPower"] == pytest.approx(0.2)
    assert summ["Energy_GPU_total"] == pytest.approx(0.05)
    assert summ["Energy_GPU_fqdd_gpu.1"] == pytest.approx(0.05)
    # no SystemOutputPower: PSU loss = in - 0; Others = max(0, in - (psu + gpu)) = 0 -> no row
    assert summ["Energy_PSU_loss"] == pytest.approx(0.2)
    assert "Energy_Others" not in summ


def test_window_guard(spark):
    rows = [(t, "rpc-95-2", "compute", "SystemInputPower", 100.0, "W", None) for t in (4 * 3600, 5 * 3600)]
    r = frame(spark, rows)
    win = spark.createDataFrame([(1, "rpc-95-2", "2025-01-01 12:00:00", "2025-01-01 18:00:00")],
                                "window_id long, hostname string, start_ts string, end_ts string")
    win = win.select("window_id", "hostname", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start_ts", "end_ts")])
    out = W.window_energy(r, win).collect()[0]
    assert out["use_boundaries"] is False  # data start 4 h after the window start
    assert out["energy_kwh"] == pytest.approx(0.1)


def test_empty_window(spark):
    r = frame(spark, [(0, "pdu-91-1", "pdu", "pdu", 1000.0, "W", None)]).where("false")
    s, e = "2025-01-01 00:00:00", "2025-01-03 00:00:00"
    p = kpi.pue(spark, r, s, e).collect()[0]
    assert (p["pue"], p["band"], p["status"]) == (0.0, "down", "success")
    daily = kpi.pue_daily(spark, r, s, e).collect()
    assert len(daily) == 3 and all(x["pue"] == 0.0 for x in daily)
    assert all(x["cop"] is None for x in kpi.rack_cop(spark, r, s, e).collect())
    assert kpi.rack_validation(spark, r, s, e).where("verdict IS NOT NULL").count() == 0
    from powerlens.operators import stats as ST

    assert ST.idle_power(r).count() == 0
    v = ST.validate_readings(r).collect()[0]
    assert (v["total_records"], v["is_valid"]) == (0, False)


def test_nan_reading_spoils_only_its_own_window(spark, readings):
    from powerlens.operators import windows as W

    rows = [(f"2025-01-0{d} 0{h}:00:00", float("nan") if (d, h) == (1, 1) else 100.0) for d in (1, 2, 3) for h in range(4)]
    df = readings(rows, hostname="rpc-91-1", metric="SystemInputPower")
    win = spark.createDataFrame([(d, "rpc-91-1", f"2025-01-0{d} 00:00:00", f"2025-01-0{d} 03:00:00") for d in (1, 2, 3)],
                                "window_id long, hostname string, start_ts string, end_ts string")
    win = win.select("window_id", "hostname", F.col("start_ts").cast("timestamp_ntz"), F.col("end_ts").cast("timestamp_ntz"))
    got = {r["window_id"]: r["energy_kwh"] for r in W.window_energy(df, win).collect()}
    assert got[1] != got[1] and got[2] == pytest.approx(0.3) and got[3] == pytest.approx(0.3)


def test_gpu_rows_without_a_device_are_skipped(spark, readings):
    from powerlens.operators import windows as W

    rows = [(f"2025-01-01 0{h}:00:00", 100.0) for h in range(4)]
    a = readings(rows, hostname="rpg-93-1", metric="PowerConsumption", fqdd="gpu.1")
    b = readings(rows, hostname="rpg-93-1", metric="PowerConsumption")
    job = spark.createDataFrame([(1, "u", "rpg-93-1", "2025-01-01 00:00:00", "2025-01-01 03:00:00")],
                                "job_id long, job_user string, nodelist string, start_ts string, end_ts string")
    job = job.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_ts", "end_ts")})
    assert [r["energy_kwh"] for r in W.job_energy(a.unionByName(b), job).collect()] == [pytest.approx(0.3)]


def test_rack_summary_reports_silent_racks(spark):
    r = frame(spark, [(t, "rpc-91-1", "compute", "SystemInputPower", 100.0, "W", None) for t in (0, 3600)])
    got = {x["rack"]: x for x in kpi.rack_summary(spark, r, "2025-01-01 12:00:00", "2025-01-01 13:00:00").collect()}
    assert sorted(got) == list(range(91, 98))
    assert {k: x["status"] for k, x in got.items() if k != 91} == dict.fromkeys(range(92, 98), "no_data")
    assert (got[91]["status"], got[91]["nodes_analyzed"]) == ("success", 1)
    assert got[91]["compute_energy_kwh"] == pytest.approx(0.1) and got[91]["pdu_energy_kwh"] == got[92]["total_energy_kwh"] == 0.0


def test_components_of_hosts_with_and_without_gpu(spark):
    rows = [(t, h, "compute", m, p, "W", d) for t in (0, 3600) for h in ("rpg-93-1", "rpc-91-1")
            for m, p, d in (("TotalCPUPower", 100.0, None), ("PowerConsumption", 50.0, "GPU_1"), ("SystemOutputPower", 400.0, None))]
    s, e = "2025-01-01 12:00:00", "2025-01-01 13:00:00"
    r = frame(spark, rows)
    got = {}
    for x in kpi.component_breakdown(r, s, e).collect():
        got.setdefault(x.hostname, {})[x.component] = round(x.energy_kwh, 6)
    assert got["rpg-93-1"]["GPU Total"] == got["rpg-93-1"]["GPU (fqdd=1)"] == 0.05
    assert got["rpc-91-1"] == {"CPU": 0.1, "MEMORY": 0.0, "FAN": 0.0, "STORAGE": 0.0, "SystemOutputPower": 0.4}
    share = {(x.hostname, x.component): round(x.energy_kwh, 6) for x in kpi.component_share(r, s, e).collect()}
    assert share[("rpg-93-1", "Other")] == 0.25 and share[("rpc-91-1", "Other")] == 0.3 and ("rpc-91-1", "GPU Total") not in share
    total = {x.hostname: round(x.energy2_kwh, 6) for x in kpi.components_vs_system(r, s, e).collect()}
    assert total == {"rpg-93-1": 0.15, "rpc-91-1": 0.1}
