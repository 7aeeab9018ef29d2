"""Plan-shape regressions: the scale properties the README claims."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
Q = entry.queries()


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize(
    "name",
    ["pue_daily", "pue", "energy_daily", "energy_boundary", "energy_gap", "cumulative_energy", "rack_cop_daily",
     "job_energy", "window_energy", "idle_power", "component_breakdown", "power_statistics", "detect_anomalies",
     "bucket_aggregate"],
)
def test_hash_aggregates_only(spark, name):
    assert "SortAggregate" not in final_plan(Q[name](spark, SF))


def test_daily_pue_shuffles_raw_rows_once(spark):
    p = final_plan(Q["pue_daily"](spark, SF))
    assert "ReusedExchange" in p
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts,2024-01-01T00:00), LessThanOrEqual(ts,2024-01-31T00:00)]" in p
    assert p.count("FileScan parquet") == 1  # the readings are read and shuffled once


def test_no_python_udfs(spark):
    for name in ["pue_daily", "job_energy_summary", "detect_anomalies", "explode_nodelist", "parse_window_times"]:
        p = final_plan(Q[name](spark, SF))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "PythonUDF" not in p


def test_column_pruning_at_scan(spark):
    p = final_plan(Q["scan_pdu_readings"](spark, SF))
    schema = p.split("ReadSchema: ")[1].split("\n")[0]
    assert "props" not in schema
