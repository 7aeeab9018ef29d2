"""Column functions (G17, G20-G22) and filters."""

import pytest
from pyspark.sql import functions as F

from powerlens.functions import nodes as N
from powerlens.functions import times as TM
from powerlens.functions import units as U
from powerlens.operators import filters as B


def test_g17_units(spark):
    df = spark.createDataFrame([(1000.0, "W"), (50000.0, "mW"), (2.5, "kW"), (7.0, None), (8.0, "btu"), (9.0, "KW")], "value double, units string")
    got = [r[0] for r in df.select(U.to_watts()).collect()]
    assert got == [1000.0, 50.0, 2500.0, 7.0, 8.0, 9000.0]


def test_unit_info(spark):
    df = spark.createDataFrame([("mw",), ("W",), (None,)], "units string")
    rows = df.select(*U.unit_info("units")).collect()
    assert [tuple(r) for r in rows] == [("mW", "W", True), ("W", "W", False), ("Unknown", "W", None)]


def test_temperature(spark):
    df = spark.createDataFrame([(100.0,)], "c double")
    r = df.select(U.convert_temperature("c", "C", "F").alias("f"), U.convert_temperature("c", "C", "K").alias("k")).collect()[0]
    assert (r["f"], r["k"]) == (212.0, pytest.approx(373.15))


def test_g20_window_times(spark):
    df = spark.createDataFrame([("12/6/25 17:10",), ("12/06/2025 17:10",), ("2025-12-06 17:10:00",), ("junk",), ("12/7/25 4:36:10",)], "s string")
    got = [r[0] for r in df.select(TM.parse_window_time("s")).collect()]
    assert got[0] == got[1] == got[2]
    assert str(got[0]) == "2025-12-06 17:10:00"
    assert got[3] is None
    assert str(got[4]) == "2025-12-07 04:36:10"


def test_g21_nodelist(spark):
    df = spark.createDataFrame([(1, "rpc-91-[1-3,7],rpg-93-2"), (2, "rpc-95-[08-10]")], "job_id long, nodelist string")
    got = [(r["job_id"], r["hostname"]) for r in N.explode_nodelist(df).collect()]
    assert [h for j, h in got if j == 1] == ["rpc-91-1", "rpc-91-2", "rpc-91-3", "rpc-91-7", "rpg-93-2"]
    assert [h for j, h in got if j == 2] == ["rpc-95-08", "rpc-95-09", "rpc-95-10"]


def test_nodelist_several_groups_and_suffix(spark):
    df = spark.createDataFrame([(1, "a[1-2]b[3-4],rpg-93-[1-2]-ib, ,x")], "job_id long, nodelist string")
    got = [r["hostname"] for r in N.explode_nodelist(df).collect()]
    assert got == ["a1b3", "a1b4", "a2b3", "a2b4", "rpg-93-1-ib", "rpg-93-2-ib", "x"]


def test_g22_end_without_start(spark):
    df = spark.createDataFrame([("2025-01-01 00:00:00",)], "ts string")
    with pytest.raises(ValueError):
        B.filter_time(df, None, "2025-01-02 00:00:00")


def test_classify(spark):
    df = spark.createDataFrame([("irc-91-5",), ("pdu-97-4",), ("rpg-93-1",), ("rpc-91-1",), ("foo",)], "hostname string")
    rows = df.select(N.node_type(), N.node_database(), N.known_host(), N.rack_of()).collect()
    assert [tuple(r) for r in rows] == [
        ("irc", "infra", True, 91), ("pdu", "infra", True, 97), ("compute", "h100", True, 93),
        ("compute", "zen4", True, 91), ("compute", "h100", False, None),
    ]


def test_category_contains_system_never_gpu(spark):
    df = spark.createDataFrame([("SystemPowerConsumption",), ("PowerConsumption",), ("SystemOutputPower",), ("TotalCPUPower",), ("Foo",)], "metric string")
    got = [r[0] for r in df.select(N.metric_category_contains()).collect()]
    assert got == ["Other", "GPU", "SystemOutput", "CPU", "Other"]


def test_render_local_time(spark):
    df = spark.createDataFrame([("2024-07-01 12:00:00",), ("2024-01-01 12:00:00",)], "ts string").select(F.col("ts").cast("timestamp_ntz").alias("ts"))
    got = [r[0] for r in df.select(TM.render_local_time("ts", "America/Chicago")).collect()]
    assert got == ["2024-07-01 07:00:00-05", "2024-01-01 06:00:00-06"]
    half = [r[0] for r in df.select(TM.render_local_time("ts", "America/St_Johns")).collect()]
    assert half == ["2024-07-01 09:30:00-02", "2024-01-01 08:30:00-03"]


def test_window_table_requires_columns(spark, tmp_path):
    from powerlens.sources import sinks as SK

    p = str(tmp_path / "w.csv")
    spark.createDataFrame([(1, "12/6/25 17:10")], "Rank int, `Start time` string").write.option("header", True).csv(p)
    with pytest.raises(ValueError):
        SK.read_window_table(spark, p)


def test_window_table_drops_bad_rows(spark, tmp_path):
    from powerlens.sources import sinks as SK

    p = str(tmp_path / "w2.csv")
    rows = [(1, "rpc-95-2", "12/6/25 17:10", "12/6/25 17:40"), (2, "rpc-95-2", "junk", "12/6/25 18:00"),
            (3, "rpc-95-2", "2025-12-06 18:00:00", "12/06/2025 18:30")]
    spark.createDataFrame(rows, "Rank int, Hostname string, `Start time` string, `End time` string").write.option("header", True).csv(p)
    got = sorted((r["window_id"], str(r["start_ts"]), str(r["end_ts"])) for r in SK.read_window_table(spark, p).collect())
    assert got == [(1, "2025-12-06 17:10:00", "2025-12-06 17:40:00"), (3, "2025-12-06 18:00:00", "2025-12-06 18:30:00")]


def test_write_report_skips_empty_and_raises_when_nothing(spark, tmp_path):
    from powerlens.sources import sinks as SK

    full = spark.createDataFrame([(1,)], "a int")
    empty = full.where("a > 1")
    out = SK.write_report({"full": full, "empty": empty, "x" * 40: full}, str(tmp_path / "rep"))
    assert [n for n, _ in out] == ["full", "x" * 40]
    with pytest.raises(ValueError):
        SK.write_report({"empty": empty}, str(tmp_path / "rep2"))


def test_write_report_counts_while_writing_and_drops_what_became_empty(spark, tmp_path):
    """Every row is computed once (an accumulator counts them), and an old folder of an empty dataset goes."""
    from powerlens.sources import sinks as SK

    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def touch(x):
        seen.add(1)
        return x

    df = spark.range(50).select(touch(F.col("id").cast("int")).alias("a"))
    counts = {}
    path = str(tmp_path / "rep")
    SK.write_report({"a": df, "b": spark.range(7)}, path, counts=counts)
    assert counts == {"a": 50, "b": 7} and seen.value == 50
    assert [n for n, _ in SK.write_report({"a": spark.range(3), "b": spark.range(7).where("id > 9")}, path)] == ["a"]
    assert spark.read.parquet(f"{path}/a").count() == 3 and not (tmp_path / "rep" / "b").exists()


def test_energy_units(spark):
    df = spark.createDataFrame([(3600000.0, 2.5)], "j double, kwh double")
    r = df.select(U.joules_to_kwh("j").alias("a"), U.kwh_to_joules("kwh").alias("b"), U.kwh_to_wh("kwh").alias("c")).collect()[0]
    assert (r["a"], r["b"], r["c"]) == (1.0, 9000000.0, 2500.0)


def test_register_views_adhoc_sql(spark):
    """Ad-hoc SQL on the registered views (the reference's custom-query path)."""
    from powerlens.sources.tables import register_views

    register_views(spark, "/root/testdata/sf0.001")
    n = spark.sql("SELECT count(*) AS n FROM readings r JOIN inventory i USING (hostname) WHERE i.node_type = 'pdu'").collect()[0]["n"]
    m = spark.sql("SELECT count(*) AS n FROM infra_readings WHERE node_type = 'pdu'").collect()[0]["n"]
    assert n == m > 0
    assert spark.sql("SELECT count(*) FROM metric_defs").collect()[0][0] > 0


def test_strict_host_check(spark):
    ok = spark.createDataFrame([("rpc-91-1",), ("irc-91-5",)], "hostname string")
    assert [r["node_type"] for r in N.check_known_hosts(ok).collect()] == ["compute", "irc"]
    with pytest.raises(ValueError, match="foo-1"):
        N.check_known_hosts(ok.union(spark.createDataFrame([("foo-1",)], "hostname string")))


def test_node_lists_of_any_depth(spark):
    def hosts(text):
        return [r["hostname"] for r in N.explode_nodelist(spark.createDataFrame([(text,)], "nodelist string")).collect()]

    assert hosts("a[1-2]b[1]c[1]d[1]e[1-2]") == ["a1b1c1d1e1", "a1b1c1d1e2", "a2b1c1d1e1", "a2b1c1d1e2"]
    assert hosts("n[08-10,3]x, m ,") == ["n08x", "n09x", "n10x", "n3x", "m"]
    assert hosts(None) == hosts("") == []
    for bad in ("n[x-2]", "n[2-1]", "n[1", "n]1["):
        with pytest.raises(Exception, match="node list"):
            hosts(bad)


def test_offsets_become_utc(spark):
    df = spark.createDataFrame([("2025-12-06 17:10:00-05:00",), ("2025-12-06T17:10:00Z",), ("2025-12-06 17:10:00 +0530",), ("2025-12-06 17:10:00",),
                                ("12/06/25 17:10",), ("2025-12-06",), ("17:10-05",), ("bad",), (None,)], "s string")
    want = ["2025-12-06 22:10:00", "2025-12-06 17:10:00", "2025-12-06 11:40:00", "2025-12-06 17:10:00", "2025-12-06 17:10:00", "2025-12-06 00:00:00"]
    got = [str(r["t"]) if r["t"] else None for r in df.select(TM.parse_window_time("s").alias("t")).collect()]
    assert got[:6] == want and got[7:] == [None, None]
    got = [str(r["t"]) if r["t"] else None for r in df.select(TM.coerce_timestamp("s").alias("t")).collect()]
    assert got[:4] == want[:4] and got[4] is None
    back = df.limit(1).select(TM.local_to_utc(F.lit("2025-07-01 12:00:00"), "America/Chicago").alias("t")).first()["t"]
    assert str(back) == "2025-07-01 17:00:00"


def test_skipped_window_rows_are_counted(spark, tmp_path):
    from powerlens.sources import sinks as SK

    p = str(tmp_path / "w.csv")
    spark.createDataFrame([(1, "2025-01-01 00:00", "2025-01-02 00:00"), (2, "?", "2025-01-02 00:00")], "Rank int, `Start time` string, `End time` string").write.option("header", True).csv(p)
    assert tuple(SK.skipped_windows(spark, p).first()) == (2, 1)


def test_no_shared_folder_on_a_cluster_is_an_error(monkeypatch):
    from types import SimpleNamespace

    from powerlens.session import checkpoint_dir

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d), sparkContext=context)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(session)
