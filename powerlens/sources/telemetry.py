"""Telemetry readings: the one fact table every operator reads.

Canonical schema (one row per sensor reading)::

    event_id bigint     tie-breaker for equal timestamps
    ts timestamp_ntz    UTC wall clock
    nodeid bigint, hostname string, node_type string ('irc'|'pdu'|'compute')
    fqdd string (device, null when the metric is per host)
    metric string, value double, units string

At scale the table lives as Parquet partitioned by ``database, metric`` (and a
date column); ``where(metric == m)`` then prunes partitions instead of the
reference's one-table-per-metric layout.  The driver test data carries no power
readings, so ``infra_readings`` / ``compute_readings`` derive them from
``events`` deterministically (FIXTURES.md section 3); the same derivation is
the head of every SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType

from ..constants import IRC_NODES, pdu_nodes
from ..functions import nodes as N
from ..functions.times import DAY_OF
from .tables import load

READINGS_SCHEMA = StructType(
    [
        StructField("event_id", LongType()),
        StructField("ts", TimestampNTZType()),
        StructField("nodeid", LongType()),
        StructField("hostname", StringType()),
        StructField("node_type", StringType()),
        StructField("fqdd", StringType()),
        StructField("metric", StringType()),
        StructField("value", DoubleType()),
        StructField("units", StringType()),
    ]
)
COLUMNS = [f.name for f in READINGS_SCHEMA.fields]

# host list of the infra adapter: 6 IRC hosts, then the 24 PDUs in inventory order
INFRA_HOSTS = IRC_NODES + pdu_nodes()


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events")


def _infra_cols() -> list[Column]:
    slot = (F.col("user_id") % len(INFRA_HOSTS)).cast("int")
    is_irc = slot < len(IRC_NODES)
    et = F.col("event_type")
    metric = (
        F.when(~is_irc, "pdu")
        .when(et == "click", "CompressorPower")
        .when(et == "error", "CondenserFanPower")
        .when(et == "purchase", "CoolDemand")
        .when(et == "signup", "CoolOutput")
        .otherwise("TotalSensibleCoolingPower")
    )
    kw = is_irc & (et != "error")
    return [
        F.col("event_id"),
        F.col("ts"),
        F.col("user_id").alias("nodeid"),
        F.element_at(F.array(*[F.lit(h) for h in INFRA_HOSTS]), slot + 1).alias("hostname"),
        F.when(is_irc, "irc").otherwise("pdu").alias("node_type"),
        F.lit(None).cast("string").alias("fqdd"),
        metric.alias("metric"),
        F.when(kw, F.col("value") / 1000.0).otherwise(F.col("value")).alias("value"),
        F.when(kw, "kW").otherwise("W").alias("units"),
    ]


def infra_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IRC and PDU readings derived from ``events`` (FIXTURES 3.1)."""
    return _events(spark, sf_dir).select(*_infra_cols())


# compute adapter: host slot i = (user_id * 37) % 118 -> host by inventory order
_COMPUTE_SLOTS = [  # (first slot, last slot + 1, prefix)
    (0, 20, "rpc-91-"),
    (20, 40, "rpc-92-"),
    (40, 48, "rpg-93-"),
    (48, 68, "rpc-94-"),
    (68, 78, "rpc-95-"),
    (78, 98, "rpc-96-"),
    (98, 118, "rpc-97-"),
]


def _compute_host(i: Column) -> Column:
    expr = None
    for lo, hi, prefix in _COMPUTE_SLOTS:
        name = F.concat(F.lit(prefix), (i - lo + 1).cast("string"))
        expr = F.when(i < hi, name) if expr is None else expr.when(i < hi, name)
    return expr


def _compute_cols() -> list[Column]:
    k = F.regexp_extract("props", "[0-9]+", 0).cast("bigint")
    i = (F.col("user_id") * 37) % 118
    et = F.col("event_type")
    even = (k % 2) == 0
    metric = (
        F.when((et == "click") & even, "TotalCPUPower")
        .when(et == "click", "CPUPower")
        .when((et == "error") & even, "TotalFanPower")
        .when(et == "error", "TotalStoragePower")
        .when((et == "purchase") & even, "SystemInputPower")
        .when(et == "purchase", "SystemOutputPower")
        .when((et == "signup") & even, "PowerConsumption")
        .when(et == "signup", "DRAMPwr")
        .when(even, "TotalMemoryPower")
        .otherwise("SystemPowerConsumption")
    )
    return [
        F.col("event_id"),
        F.col("ts"),
        F.col("user_id").alias("nodeid"),
        _compute_host(i).alias("hostname"),
        F.lit("compute").alias("node_type"),
        F.when(metric.isin("PowerConsumption", "CPUPower"), F.concat(F.lit("dev."), (k % 4 + 1).cast("string"))).alias("fqdd"),
        metric.alias("metric"),
        F.when(metric == "PowerConsumption", F.col("value") * 1000.0)
        .when(metric == "SystemPowerConsumption", F.col("value") / 1000.0)
        .otherwise(F.col("value"))
        .alias("value"),
        F.when(metric == "PowerConsumption", "mW").when(metric == "SystemPowerConsumption", "kW").otherwise("W").alias("units"),
    ]


def compute_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compute-node (iDRAC) readings derived from ``events`` (FIXTURES 3.2)."""
    return _events(spark, sf_dir).select(*_compute_cols())


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All readings, infra and compute, in one frame (no per-metric loop).

    Every event yields one infrastructure and one compute reading.  A union
    of two projections of the scan (measured faster than one scan emitting
    both rows with ``inline``: the two branches run as parallel tasks)."""
    return infra_readings(spark, sf_dir).unionByName(compute_readings(spark, sf_dir))


def parquet_readings(spark: SparkSession, path: str) -> DataFrame:
    """A1-A3 at scale: the Parquet ``readings`` dataset written by
    ``sinks.write_readings`` (partitioned by ``database``, ``metric`` and ``date``).

    Predicates on ``metric`` prune directories; predicates on ``ts`` are
    pushed to the Parquet reader.  ``date`` is marked as the day of ``ts``, so time-bounded
    operators prune its directories too (``times.within``).
    """
    return spark.read.parquet(path).withMetadata("date", {DAY_OF: "ts"})


def scan_jdbc(spark: SparkSession, url: str, table: str, lower, upper, partitions: int = 64, **props) -> DataFrame:
    """A4: parallel JDBC read of a readings table, split on its timestamp.

    ``partitionColumn``/``lowerBound``/``upperBound`` make Spark issue
    ``partitions`` range queries in parallel; ``fetchsize`` bounds memory per
    round trip (the reference's chunked fetch).
    """
    reader = (
        spark.read.format("jdbc")
        .option("url", url)
        .option("dbtable", table)
        .option("partitionColumn", "timestamp")
        .option("lowerBound", str(lower))
        .option("upperBound", str(upper))
        .option("numPartitions", str(partitions))
        .option("fetchsize", "10000")
    )
    for k, v in props.items():
        reader = reader.option(k, v)
    df = reader.load()
    return df.withColumnRenamed("timestamp", "ts").withColumn("node_type", N.node_type("hostname")) if "hostname" in df.columns else df


# --- raw compute facts with dimension ids (the reference's idrac.<metric> rows)


def compute_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(event_id, ts, nodeid, source, fqdd, metric, value)`` with integer
    source/fqdd ids, i.e. the fact rows before the dimension joins of C1."""
    r = compute_readings(spark, sf_dir)
    return r.select(
        "event_id",
        "ts",
        "nodeid",
        F.when(F.col("event_id").isNotNull(), 1).alias("source"),  # a column, so the join on it stays an equi-join
        F.regexp_extract("fqdd", "[0-9]+", 0).try_cast("int").alias("fqdd"),
        "metric",
        "value",
    )


def nodes_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``public.nodes(nodeid, hostname)``: one row per node id seen in events."""
    e = _events(spark, sf_dir).select("user_id").distinct()
    return e.select(F.col("user_id").alias("nodeid"), _compute_host((F.col("user_id") * 37) % 118).alias("hostname"))


def source_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, "iDRAC")], "id int, source string")


def fqdd_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, f"dev.{i}") for i in range(1, 5)], "id int, fqdd string")


def wide_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy wide table ``idrac_power_metrics`` (FIXTURES 3.5)."""
    e = _events(spark, sf_dir)
    return e.select(
        "event_id",
        F.col("ts"),
        F.col("user_id").alias("node_id"),
        F.col("value").alias("power_consumption_watts"),
        F.lit(1000.0).alias("power_limit_watts"),
        (F.lit(20.0) + F.col("value") / 10.0).alias("temperature_celsius"),
        (F.col("value") % 100).alias("cpu_utilization_percent"),
        (F.col("event_id") % 100).cast("double").alias("memory_utilization_percent"),
    )


def power_and_temperature(spark: SparkSession, sf_dir: str):
    """C4 inputs: power = click rows; temperature = view rows and the click
    rows of 100 W or more (so the full join has matched, power-only and
    temperature-only rows)."""
    e = _events(spark, sf_dir).select(F.col("user_id").alias("nodeid"), "ts", "value", "event_type", "event_id")
    power = e.where(F.col("event_type") == "click").select("nodeid", "ts", "value")
    temp = e.where(
        (F.col("event_type") == "view") | ((F.col("event_type") == "click") & (F.col("value") >= 100.0))
    ).select("nodeid", "ts", (F.lit(20.0) + F.col("value") / 10.0).alias("value"))
    return power, temp
