"""Scans, filters, definition filters, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import nodes as N
from ..functions.times import within
from ..functions.units import to_watts
from ..session import stored


def _ts(t) -> Column:
    return F.lit(str(t)).cast("timestamp_ntz")


def filter_host(df: DataFrame, hostname: str | None) -> DataFrame:
    """B1: host predicate only when a host is given."""
    return df if hostname is None else df.where(F.col("hostname") == hostname)


def filter_time(df: DataFrame, start=None, end=None, limit: int | None = None) -> DataFrame:
    """B2 (+S1/D9): both bounds -> inclusive BETWEEN; start only -> ``>=``;
    end only -> ValueError; neither -> all rows, or the ``limit`` oldest when
    one is asked for."""
    if start is None and end is not None:
        raise ValueError("end_time cannot be specified without start_time")
    if start is not None:
        return within(df, start, end)
    return df if limit is None else oldest_n(df, limit)


def scan(readings: DataFrame, metric: str, hostname=None, start=None, end=None, limit: int | None = None) -> DataFrame:
    """A1-A3: readings of one metric (case-insensitive), host/time filtered.

    Output columns ``ts, hostname, fqdd, value, units`` (+ metric), unordered.
    On a partitioned table the metric and the days prune partitions and the
    time predicate reaches the Parquet scan as a pushed filter.
    """
    df = readings.where(F.lower(F.col("metric")) == metric.lower())
    df = filter_time(filter_host(df, hostname), start, end, limit)
    return df.select("event_id", "ts", "hostname", "fqdd", "metric", "value", "units")


def scan_pdu(readings: DataFrame, hostname=None, start=None, end=None, limit: int | None = None) -> DataFrame:
    """A3: the single PDU table, unit constant 'W'."""
    return scan(readings.where(F.col("node_type") == "pdu"), "pdu", hostname, start, end, limit).withColumn(
        "units", F.lit("W")
    )


def oldest_n(df: DataFrame, n: int) -> DataFrame:
    """``ORDER BY ts ASC LIMIT n`` (TakeOrderedAndProject: per-partition top-n, then merge)."""
    return df.orderBy(F.col("ts").asc(), F.col("event_id").asc()).limit(n)


def recent_n(df: DataFrame, n: int = 100, now=None, hours: float | None = 1.0) -> DataFrame:
    """Newest ``n`` rows within the last ``hours`` before ``now``."""
    if now is not None and hours is not None:
        lo = F.timestamp_add("SECOND", F.lit(int(hours * 3600)) * -1, _ts(now))
        df = within(df, lo, now)
    return df.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(n)


def top_n_per(df: DataFrame, keys, n: int, newest: bool) -> DataFrame:
    """First or last ``n`` rows of every group.

    Two steps, so that no task sorts what it scans.  A hash aggregate counts the rows of every
    (group, day); a group's days up to the one in which the count reaches ``n`` hold its first
    ``n`` rows, and only theirs are numbered (``row_number``; Spark plans a WindowGroupLimit
    below the shuffle).  Rows without a time are a day of their own, first when
    ascending and last when descending, as in the sort.
    """
    keys = list(keys)
    day = F.to_date("ts")
    by_day = Window.partitionBy(*[f"_{k}" for k in keys]).orderBy(F.col("_day").desc() if newest else F.col("_day"))
    days = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys], day.alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    days = days.withColumn("_before", F.coalesce(F.sum("_n").over(by_day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # written and read back, so that Spark knows how few they are and the rows stay where they are
    days = stored(days.where(F.col("_before") < n).drop("_n", "_before"), "first-days")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [day.eqNullSafe(F.col("_day"))]
    df = df.join(days, same, "left_semi")
    order = [F.col("ts").desc(), F.col("event_id").desc()] if newest else [F.col("ts"), F.col("event_id")]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def power_metric_ids(defs: DataFrame) -> DataFrame:
    """Metric ids whose unit is a power unit (B16 ``defs_power_units``)."""
    return defs.where(F.col("units").isin("mW", "W", "kW")).select(F.col("metric_id").alias("metric"))


def oldest_n_per_metric(readings: DataFrame, defs: DataFrame, hostname: str | None, n: int) -> DataFrame:
    """First ``n`` readings of every power metric (definitions semi-join)."""
    df = filter_host(readings, hostname)
    df = df.join(F.broadcast(power_metric_ids(defs)), "metric", "left_semi")
    return top_n_per(df, ["hostname", "metric"], n, newest=False)


def recent_n_per_metric(readings: DataFrame, metrics, n: int) -> DataFrame:
    """S3: last ``n`` readings of each listed metric per host."""
    return top_n_per(readings.where(F.col("metric").isin(list(metrics))), ["hostname", "metric"], n, newest=True)


def exclude_metrics(df: DataFrame) -> DataFrame:
    """B8."""
    return df.where(~N.is_excluded("metric"))


def high_power_events(df: DataFrame, threshold: float = 1000.0, n: int = 10) -> DataFrame:
    """Readings above ``threshold`` W, highest first, top ``n``."""
    d = df.withColumn("power_w", to_watts())
    return d.where(F.col("power_w") > threshold).orderBy(F.col("power_w").desc(), F.col("event_id")).limit(n)


def nodeid_recent(readings: DataFrame, defs: DataFrame, nodeid: int | None, now, hours: float = 24) -> DataFrame:
    """Power readings (watts) of one nodeid in the last ``hours``, unordered."""
    lo = F.timestamp_add("SECOND", F.lit(-int(hours * 3600)), _ts(now))
    df = within(readings, lo, now)
    if nodeid is not None:
        df = df.where(F.col("nodeid") == nodeid)
    df = df.join(F.broadcast(power_metric_ids(defs)), "metric", "left_semi")
    return df.select("event_id", "ts", "nodeid", "hostname", "metric", "fqdd", to_watts().alias("value"))


# --------------------------------------------------------------------------
# definition filters

def _def_filter(defs: DataFrame, units, words, name_col: str) -> DataFrame:
    if not units and not words:
        return defs
    cond = F.lit(False)
    if units:
        cond = cond | F.col("units").isin(list(units))
    for w in words:
        cond = cond | F.col(name_col).contains(w)
    return defs.where(cond)


def defs_compute(defs: DataFrame, kind: str) -> DataFrame:
    """Compute definition filters (``LIKE '%x%'`` on metric_name)."""
    units, words = K.COMPUTE_DEF_RULES[kind]
    return _def_filter(defs, units, words, "metric_name")


def defs_infra(defs: DataFrame, kind: str) -> DataFrame:
    """Infra definition filters on metric_id."""
    units, words = K.INFRA_DEF_RULES[kind]
    return _def_filter(defs, units, words, "metric_id")


def compute_power_metric_list() -> list[str]:
    """Compute-node power metrics: compute definitions with a power unit
    (B11); exclusion of the headroom metric applies to charts only (B8)."""
    from ..sources.dimensions import METRIC_DEFS

    infra = set(K.IRC_ALL_METRICS + K.PDU_POWER_METRICS)
    return [d[0] for d in METRIC_DEFS if d[3] in ("mW", "W", "kW") and d[0] not in infra]


def metrics_for_node(inventory: DataFrame) -> DataFrame:
    """Default power metrics per listed host: IRC -> the 2 IRC power
    metrics, PDU -> pdu, compute -> power-unit definitions."""
    nt = F.col("node_type")
    lists = (
        F.when(nt == "irc", F.array(*[F.lit(m) for m in K.IRC_POWER_METRICS]))
        .when(nt == "pdu", F.array(*[F.lit(m) for m in K.PDU_POWER_METRICS]))
        .otherwise(F.array(*[F.lit(m) for m in compute_power_metric_list()]))
    )
    return inventory.select("hostname", "node_type", F.posexplode(lists).alias("position", "metric"))
