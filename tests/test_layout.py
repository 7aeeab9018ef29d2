"""Production layout: partition pruning and pushed filters on the readings table."""

from powerlens.operators import filters as B
from powerlens.operators import kpi
from powerlens.sources import sinks as SK
from powerlens.sources import telemetry as T

SF = "/root/testdata/sf0.001"


def test_written_readings_prune_and_roundtrip(spark, tmp_path):
    path = str(tmp_path / "readings")
    rd = T.readings(spark, SF)
    SK.write_readings(rd, path)
    back = T.parquet_readings(spark, path)
    q = B.scan(back, "SystemInputPower", None, "2024-01-10 00:00:00", "2024-01-20 00:00:00")
    plan = q._jdf.queryExecution().executedPlan().toString()
    days = plan.split("PartitionFilters")[1].split("]")[0]
    assert "date" in days and "2024-01-10" in days and "2024-01-20" in days
    assert "PartitionFilters" in plan and "metric" in plan.split("PartitionFilters")[1][:300]
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
    want = B.scan(rd, "SystemInputPower", None, "2024-01-10 00:00:00", "2024-01-20 00:00:00")
    cols = ["event_id", "ts", "hostname", "fqdd", "metric", "value", "units"]
    assert {r["database"] for r in back.select("database").distinct().collect()} == {"infra", "zen4", "h100"}
    assert sorted(map(tuple, q.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_kpis_prune_days(spark, tmp_path):
    path = str(tmp_path / "readings")
    SK.write_readings(T.readings(spark, SF), path)
    back = T.parquet_readings(spark, path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    for df in (kpi.pue_daily(spark, back, "2024-01-10 00:00:00", "2024-01-12 00:00:00"),
               kpi.rack_validation(spark, back, "2024-01-10 00:00:00", "2024-01-12 00:00:00")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        scans = [x.split("]")[0] for x in plan.split("PartitionFilters")[1:]]
        assert scans and all("date" in x and "2024-01-10" in x for x in scans)


def test_another_date_column_is_no_day_of_the_time(spark, readings):
    """A column that happens to be called ``date`` must not cut rows."""
    from pyspark.sql import functions as F

    from powerlens.functions.times import within
    from powerlens.operators import energy as E

    df = readings([(f"2025-01-01 0{h}:00:00", 100.0) for h in range(4)]).withColumn("date", F.lit("2019-05-05").cast("date"))
    assert within(df, "2025-01-01 00:00:00", "2025-01-01 02:00:00").count() == 3
    got = E.energy_gap(df, max_gap_seconds=7200, start="2025-01-01 00:00:00", end="2025-01-02 00:00:00").collect()
    assert [round(r.energy_kwh, 9) for r in got] == [0.3]
