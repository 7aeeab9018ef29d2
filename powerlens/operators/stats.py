"""Aggregations, tails, data-quality checks, anomalies, cleaning.

Notes on scale: all aggregates are plain ``groupBy`` with map-side partial
aggregation.  Exact percentiles are selected by rank in two passes (``ranks``), whose
buffers are bounded by bins, not by the readings of a series.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.times import epoch_micros, within
from ..functions.units import to_watts
from . import energy as E
from . import ranks

US = 1_000_000.0


def _ts(t) -> Column:
    return F.lit(str(t)).cast("timestamp_ntz")


def _since(now, hours: float) -> Column:
    return (F.col("ts") >= F.timestamp_add("SECOND", F.lit(-int(hours * 3600)), _ts(now))) & (
        F.col("ts") <= _ts(now)
    )


def span_hours(ts: str = "ts") -> Column:
    """(max - min) of a timestamp column in hours (aggregate expression)."""
    return (F.max(epoch_micros(F.col(ts))) - F.min(epoch_micros(F.col(ts)))) / 3.6e9


# ------------------------------------------------------------ E1-E4 (SQL)


def node_summary(wide: DataFrame, now, hours: float = 24) -> DataFrame:
    """Per node over the last ``hours``."""
    return (
        wide.where(_since(now, hours))
        .groupBy("node_id")
        .agg(
            F.avg("power_consumption_watts").alias("avg_power_watts"),
            F.max("power_consumption_watts").alias("max_power_watts"),
            F.min("power_consumption_watts").alias("min_power_watts"),
            F.avg("temperature_celsius").alias("avg_temperature_celsius"),
            F.max("temperature_celsius").alias("max_temperature_celsius"),
            F.avg("cpu_utilization_percent").alias("avg_cpu_utilization"),
            F.avg("memory_utilization_percent").alias("avg_memory_utilization"),
            F.count(F.lit(1)).alias("data_points"),
        )
    )


def cluster_summary(wide: DataFrame, now, hours: float = 1) -> DataFrame:
    """Whole cluster over the last ``hours`` (one row)."""
    return wide.where(_since(now, hours)).agg(
        F.countDistinct("node_id").alias("total_nodes"),
        F.avg("power_consumption_watts").alias("cluster_avg_power_watts"),
        F.sum("power_consumption_watts").alias("cluster_total_power_watts"),
        F.max("power_consumption_watts").alias("cluster_max_power_watts"),
        F.avg("temperature_celsius").alias("cluster_avg_temperature_celsius"),
        F.max("temperature_celsius").alias("cluster_max_temperature_celsius"),
        F.avg("cpu_utilization_percent").alias("cluster_avg_cpu_utilization"),
        F.avg("memory_utilization_percent").alias("cluster_avg_memory_utilization"),
    )


def metric_summary(readings: DataFrame, metric: str, now, hours: float = 24, nodeid=None) -> DataFrame:
    """avg/max/min/count of one metric's raw value, optional node."""
    df = readings.where((F.col("metric") == metric) & _since(now, hours))
    if nodeid is not None:
        df = df.where(F.col("nodeid") == nodeid)
    return df.agg(
        F.avg("value").alias("avg_value"),
        F.max("value").alias("max_value"),
        F.min("value").alias("min_value"),
        F.count(F.lit(1)).alias("data_points"),
    )


def power_temp_full_join(power: DataFrame, temp: DataFrame, now, hours: float = 1) -> DataFrame:
    """C4: FULL OUTER JOIN power x temperature on (nodeid, ts), either side recent."""
    p = power.select(F.col("nodeid").alias("p_nodeid"), F.col("ts").alias("p_ts"), F.col("value").alias("p_value"))
    t = temp.select(F.col("nodeid").alias("t_nodeid"), F.col("ts").alias("t_ts"), F.col("value").alias("t_value"))
    lo = F.timestamp_add("SECOND", F.lit(-int(hours * 3600)), _ts(now))
    # the time is a join key, so rows that are too old match none that isn't: both scans are cut
    p, t = p.where(F.col("p_ts") >= lo), t.where(F.col("t_ts") >= lo)
    return p.join(t, (p["p_nodeid"] == t["t_nodeid"]) & (p["p_ts"] == t["t_ts"]), "full")


def power_temp_cluster_summary(power: DataFrame, temp: DataFrame, now, hours: float = 1) -> DataFrame:
    """Summary over C4."""
    j = power_temp_full_join(power, temp, now, hours)
    return j.agg(
        F.countDistinct("p_nodeid").alias("total_nodes"),
        F.avg("p_value").alias("cluster_avg_power"),
        F.max("p_value").alias("cluster_max_power"),
        F.avg("t_value").alias("cluster_avg_temp"),
        F.max("t_value").alias("cluster_max_temp"),
        F.count("p_value").alias("power_data_points"),
        F.count("t_value").alias("temp_data_points"),
    )


# ------------------------------------------------------------ E5-E9


def host_summary(readings: DataFrame, with_std: bool = True) -> DataFrame:
    """E5: per host mean/min/max/count(/std) of the raw value, rounded to 2."""
    aggs = [
        F.round(F.avg("value"), 2).alias("avg_power"),
        F.round(F.min("value"), 2).alias("min_power"),
        F.round(F.max("value"), 2).alias("max_power"),
        F.count("value").alias("sample_count"),
    ]
    if with_std:
        aggs.append(F.round(F.stddev_samp("value"), 2).alias("std_power"))
    return readings.groupBy("hostname").agg(*aggs)


def nodeid_summary(readings: DataFrame, metric: str, start, end) -> DataFrame:
    """Per nodeid AVG/MIN/MAX/COUNT/STDDEV of one metric, by avg desc."""
    df = within(readings, start, end).where(F.lower("metric") == metric.lower())
    return (
        df.groupBy("nodeid")
        .agg(
            F.avg("value").alias("avg_power"),
            F.min("value").alias("min_power"),
            F.max("value").alias("max_power"),
            F.count(F.lit(1)).alias("sample_count"),
            F.stddev_samp("value").alias("power_stddev"),
        )
        .orderBy(F.col("avg_power").desc())
    )


def _series_energy(df: DataFrame, keys: list[str]) -> DataFrame:
    """Total trapezoid kWh of every series (= its last cumulative value), from
    the bucket summaries; surrogate join keys so null devices match."""
    t = E._series_totals(E.prepare(df), keys)
    return t.select(*[F.col(k).alias(f"_e_{k}") for k in keys], (F.col("_trap_j") / K.JOULES_PER_KWH).alias("total_energy_kwh"))


def _named(keys: list[str], names: list[str]) -> list[Column]:
    """Key columns as texts without nulls, to join on."""
    return [F.coalesce(F.col(k).cast("string"), F.lit(E.SENTINEL)).alias(n) for k, n in zip(keys, names)]


def power_statistics(df: DataFrame, keys=E.SERIES) -> DataFrame:
    """Per series count, mean, median, std, min, max, q25, q75, final
    cumulative energy, span hours, points per hour.

    Reads raw readings: the statistics are one partially aggregated pass; the
    final cumulative energy equals the series' total trapezoid, taken from the
    bucket summaries instead of materialising per-row cumulative values.
    """
    keys = list(keys)
    if "power_w" not in df.columns:
        df = df.withColumn("power_w", to_watts())
    p = F.col("power_w")
    span = span_hours()
    n = F.count(F.lit(1))
    st = df.groupBy(*keys).agg(
        n.alias("count"),
        F.avg(p).alias("mean_power_w"),
        F.stddev_samp(p).alias("std_power_w"),
        F.min(p).alias("min_power_w"),
        F.max(p).alias("max_power_w"),
        F.when(n > 1, span).otherwise(F.lit(0.0)).alias("time_range_hours"),
        F.when((n > 1) & (span > 0), n / span).otherwise(F.lit(0.0)).alias("data_points_per_hour"),
    )
    sk = [f"_q_{k}" for k in keys]
    rows = df.select(*_named(keys, sk), p.alias("v"))
    quartiles = ranks.percentiles(rows, sk, {"q25_power_w": 0.25, "median_power_w": 0.5, "q75_power_w": 0.75})
    st = st.join(quartiles, [_named([k], [k])[0] == quartiles[q] for k, q in zip(keys, sk)], "left")
    en = _series_energy(df, keys)
    j = st.join(en, [st[k].eqNullSafe(en[f"_e_{k}"]) for k in keys], "left")
    return j.select(
        *keys, "count", "mean_power_w", "median_power_w", "std_power_w", "min_power_w", "max_power_w",
        "q25_power_w", "q75_power_w", F.coalesce("total_energy_kwh", F.lit(0.0)).alias("total_energy_kwh"),
        "time_range_hours", "data_points_per_hour",
    )


def bucket_aggregate(processed: DataFrame, group_by: str = "hostname", bucket: str = "1 hour") -> DataFrame:
    """Per (group, tumbling time bucket) stats with flat names.

    Buckets start at multiples of the duration since the epoch; for
    durations that divide a day this equals buckets from midnight (D23).
    The last cumulative value is that of the largest (ts, event_id), an event without
    an id before the others.  The pair is one exact decimal, a buffer that hash aggregates can hold.
    """
    allowed = {"1 minute", "5 minutes", "15 minutes", "30 minutes", "1 hour", "2 hours", "3 hours", "6 hours",
               "12 hours", "1 day"}
    if bucket not in allowed:
        raise ValueError(f"bucket must divide a day: one of {sorted(allowed)}")
    instant = epoch_micros(F.col("ts")).cast("decimal(18,0)") * F.lit(Decimal(2**64))
    rowkey = instant + F.coalesce(F.col("event_id").cast("bigint"), F.lit(-(2**63)).cast("bigint")).cast("decimal(19,0)")
    p, v = F.col("power_w"), F.col("value")
    return (
        processed.groupBy(group_by, F.window("ts", bucket).alias("w"))
        .agg(
            F.avg(p).alias("power_w_mean"),
            F.max(p).alias("power_w_max"),
            F.min(p).alias("power_w_min"),
            F.stddev_samp(p).alias("power_w_std"),
            F.count(p).alias("power_w_count"),
            F.avg(v).alias("value_mean"),
            F.max(v).alias("value_max"),
            F.min(v).alias("value_min"),
            F.max_by("cumulative_energy_kwh", rowkey).alias("cumulative_energy_kwh_last"),
        )
        .select(
            group_by,
            F.col("w.start").cast("timestamp_ntz").alias("ts"),
            "power_w_mean", "power_w_max", "power_w_min", "power_w_std", "power_w_count",
            "value_mean", "value_max", "value_min", "cumulative_energy_kwh_last",
        )
    )


def power_summary(df: DataFrame) -> DataFrame:
    """Per host records, span hours, sorted metric list, avg/max/min W,
    energy (sum of the final cumulative energy of each of its series)."""
    if "power_w" not in df.columns:
        df = df.withColumn("power_w", to_watts())
    n = F.count(F.lit(1))
    st = df.groupBy("hostname").agg(
        n.alias("total_records"),
        F.when(n > 1, span_hours()).otherwise(F.lit(0.0)).alias("time_range_hours"),
        F.concat_ws(",", F.array_sort(F.collect_set("metric"))).alias("metrics"),
        F.avg("power_w").alias("avg_power_w"),
        F.max("power_w").alias("max_power_w"),
        F.min("power_w").alias("min_power_w"),
    )
    en = _series_energy(df, list(E.SERIES)).groupBy(F.col("_e_hostname").alias("hostname")).agg(
        F.sum("total_energy_kwh").alias("total_energy_kwh")
    )
    return st.join(en, "hostname", "left").withColumn("total_energy_kwh", F.coalesce("total_energy_kwh", F.lit(0.0)))


# ------------------------------------------------------------ E10-E12 tails


def _tail_rows(readings: DataFrame) -> DataFrame:
    """Every reading in watts in its own series, and at each instant of a (host, metric) the sum of its
    readings in the TOTAL series: ``hostname, metric, is_total, dev, u0, u1, w`` (least and largest unit).
    One scan and one shuffle; which of these series count is seen from their statistics."""
    w = Window.partitionBy("hostname", "metric", "ts")
    x = readings.select("hostname", "metric", "ts", "fqdd", "units", to_watts().alias("w")).withColumns({
        "sum": F.sum("w").over(w), "u0": F.min("units").over(w), "u1": F.max("units").over(w),
        "place": F.row_number().over(w.orderBy("fqdd"))})
    own = F.struct(F.lit(False).alias("is_total"), F.coalesce("fqdd", F.lit(E.SENTINEL)).alias("dev"),
                   F.col("units").alias("u0"), F.col("units").alias("u1"), F.col("w"))
    instant = F.struct(F.lit(True).alias("is_total"), F.lit("TOTAL").alias("dev"), F.col("u0"), F.col("u1"), F.col("sum").alias("w"))
    return x.select("hostname", "metric", F.inline(F.when(F.col("place") == 1, F.array(own, instant)).otherwise(F.array(own))))


def _tail(readings: DataFrame, q: float, upper: bool) -> DataFrame:
    """Percentile of the positive readings per series, and mean and count of the readings
    beyond it, in watts; shown in the series' unit, or in watts where it has several."""
    keys = ["hostname", "metric", "is_total", "dev"]
    rows = _tail_rows(readings).withColumn("v", F.when(F.col("w") > 0, F.col("w")))
    # units are grouping keys first (texts in an aggregate's buffer would sort the rows); a series has few
    extreme = F.max if upper else F.min
    stats = rows.groupBy(*keys, "u0", "u1").agg(F.count(F.lit(1)).alias("sample_count"), extreme("v").alias("extreme"))
    series = Window.partitionBy(*keys)
    stats = stats.withColumns({
        "sample_count": F.sum("sample_count").over(series), "extreme": extreme("extreme").over(series),
        "least": F.min("u0").over(series), "most": F.max("u1").over(series), "place": F.row_number().over(series.orderBy("u0", "u1"))})
    stats = stats.where("place = 1").drop("place", "u0", "u1").withColumnsRenamed({"least": "u0", "most": "u1"})
    # a metric with devices has them and TOTAL (D22: rows without a device count there only), another one its host's series
    metric = Window.partitionBy("hostname", "metric")
    lone = F.col("dev") == E.SENTINEL
    stats = stats.withColumn("devices", F.max((~F.col("is_total") & ~lone).cast("int")).over(metric) == 1)
    stats = stats.where(F.when(F.col("devices"), F.col("is_total") | ~lone).otherwise(lone))
    thr = ranks.percentiles(rows.select(*keys, "v"), keys, {"thr": q}, beyond=True)
    side = "ge" if upper else "le"
    out = stats.join(thr, keys, "left")
    units = F.when(F.col("u0") == F.col("u1"), F.col("u0")).when(F.col("u0").isNotNull(), "W")
    z, factor = F.lit(0.0), to_watts(F.lit(1.0), F.col("units"))
    return out.withColumn("units", units).select(
        "hostname", "metric", F.when(F.col("dev") != E.SENTINEL, F.col("dev")).alias("fqdd"), "units",
        F.coalesce(F.col("thr") / factor, z).alias("thr"),
        F.coalesce(F.try_divide(f"thr_s_{side}", f"thr_n_{side}") / factor, z).alias("tail_mean"),
        F.coalesce(F.col("extreme") / factor, z).alias("extreme"),
        "sample_count",
        F.coalesce(f"thr_n_{side}", F.lit(0)).cast("bigint").alias("n_tail"),
    )


def idle_power(readings: DataFrame, q: float = K.IDLE_PERCENTILE) -> DataFrame:
    """Lower tail of non-zero readings per metric x device and TOTAL."""
    t = _tail(readings, q, upper=False)
    return t.select(
        "metric", "hostname", "fqdd", "units",
        F.col("thr").alias("p3_value"), F.col("tail_mean").alias("lower3_mean"),
        F.col("extreme").alias("min_nonzero"), "sample_count", F.col("n_tail").alias("samples_in_lower3"),
    )


def peak_power(readings: DataFrame, q: float = K.PEAK_PERCENTILE) -> DataFrame:
    """Upper tail of non-zero readings per metric x device and TOTAL."""
    t = _tail(readings, q, upper=True)
    return t.select(
        "metric", "hostname", "fqdd", "units",
        F.col("thr").alias("p97_value"), F.col("tail_mean").alias("upper3_mean"),
        F.col("extreme").alias("max_value"), "sample_count", F.col("n_tail").alias("samples_in_upper3"),
    )


def tail_preferred(tails: DataFrame, value_col: str, largest: bool) -> DataFrame:
    """One row per (host, metric): TOTAL row, else smallest p3 / largest p97."""
    v = F.col(value_col)
    w = Window.partitionBy("hostname", "metric").orderBy(
        (F.col("fqdd") == "TOTAL").cast("int").desc_nulls_last(), v.desc() if largest else v.asc(), F.col("fqdd").asc_nulls_first()
    )
    return tails.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


# ------------------------------------------------------------ E13-E20


def validate_readings(df: DataFrame) -> DataFrame:
    """Data-quality report in one aggregate pass (one row)."""
    v = F.col("value").cast("string").try_cast("double")
    n = F.count(F.lit(1))
    null_counts = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns]
    return df.agg(
        n.alias("total_records"),
        *null_counts,
        F.count_if(v.isNull() & F.col("value").isNotNull()).alias("non_numeric"),
        F.count_if(v < 0).alias("negative_values"),
        F.count_if(v > K.MAX_NODE_WATTS).alias("over_10kw"),
        F.countDistinct("hostname").alias("unique_hostnames"),
        F.when(n > 1, span_hours()).otherwise(F.lit(0.0)).alias("time_range_hours"),
    ).withColumn(
        "is_valid", F.col("total_records") > 0
    )


def validate_readings_long(df: DataFrame) -> DataFrame:
    """E13 long form: one ``(check, value)`` row per figure of the report
    (``stack`` over the single wide row)."""
    wide = validate_readings(df)
    cols = [c for c in wide.columns if c != "is_valid"]
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {pairs}) AS (check, value)", "is_valid")


def system_overview(readings: DataFrame, start, end) -> DataFrame:
    """Records, distinct metrics, window hours, healthy/no_data (one row)."""
    df = within(readings, start, end)
    hours = (epoch_micros(_ts(end)) - epoch_micros(_ts(start))) / 3.6e9
    return df.agg(F.count(F.lit(1)).alias("total_records"), F.countDistinct("metric").alias("metrics_count")).select(
        F.when(F.col("total_records") > 0, "healthy").otherwise("no_data").alias("status"),
        "total_records",
        "metrics_count",
        hours.alias("time_range_hours"),
    )


def energy_with_totals(node_energy: DataFrame, per_metric: bool = True) -> DataFrame:
    """Host x metric energies plus total rows in the same aggregation
    (GROUPING SETS): a TOTAL row per metric (IRC form) or one grand total
    (PDU form); ``is_total`` from ``grouping_id``."""
    sets = [[F.col("metric"), F.col("hostname")], [F.col("metric")] if per_metric else []]
    g = node_energy.groupingSets(sets, "metric", "hostname").agg(
        F.sum("energy_kwh").alias("energy_kwh"), F.grouping_id().cast("int").alias("is_total")
    )
    return g.select(
        F.coalesce("metric", F.lit("ALL")).alias("metric"),
        F.coalesce("hostname", F.lit("TOTAL")).alias("hostname"),
        "energy_kwh",
        (F.col("is_total") > 0).cast("int").alias("is_total"),
    )


def database_comparison(readings: DataFrame, metric_lower: str) -> DataFrame:
    """avg/max/count of one metric per database."""
    from ..functions.nodes import node_database

    return (
        readings.where(F.lower("metric") == metric_lower)
        .withColumn("database", node_database("hostname"))
        .groupBy("database")
        .agg(F.avg("value").alias("avg_value"), F.max("value").alias("max_value"), F.count(F.lit(1)).alias("data_points"))
    )


def raw_statistics(readings: DataFrame, keys=E.SERIES) -> DataFrame:
    """min/max/mean/median of raw and watt values, span, count per series."""
    keys, sk = list(keys), [f"_q_{k}" for k in keys]
    w = to_watts()
    st = readings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.min("value").alias("raw_min"), F.max("value").alias("raw_max"), F.avg("value").alias("raw_mean"),
        F.min(w).alias("w_min"), F.max(w).alias("w_max"), F.avg(w).alias("w_mean"),
        span_hours().alias("span_hours"),
    )
    # both units in one histogram
    both = F.array(F.struct(F.lit("raw").alias("_unit"), F.col("value").cast("double").alias("v")), F.struct(F.lit("w").alias("_unit"), w.alias("v")))
    medians = ranks.percentiles(readings.select(*_named(keys, sk), F.inline(both)), [*sk, "_unit"], {"median": 0.5})
    medians = medians.groupBy(*sk).agg(*[F.max(F.when(F.col("_unit") == u, F.col("median"))).alias(f"{u}_median") for u in ("raw", "w")])
    st = st.join(medians, [_named([k], [k])[0] == medians[q] for k, q in zip(keys, sk)], "left")
    return st.select(
        *keys, "n_points", "raw_min", "raw_max", "raw_mean", "raw_median", "w_min", "w_max", "w_mean", "w_median", "span_hours")


def definition_counts(defs: DataFrame, inventory: DataFrame) -> DataFrame:
    """Long-form counts: definitions by unit, by data type, accurate
    definitions (> 0.95), nodes by type."""
    by_unit = defs.groupBy(F.col("units").alias("key")).count().withColumn("kind", F.lit("by_unit"))
    by_type = defs.groupBy(F.col("metric_data_type").alias("key")).count().withColumn("kind", F.lit("by_type"))
    acc = defs.where(F.col("accuracy") > 0.95).agg(F.count(F.lit(1)).alias("count")).select(
        F.lit("accuracy_gt_0.95").alias("key"), "count", F.lit("accurate").alias("kind")
    )
    nodes = inventory.groupBy(F.col("node_type").alias("key")).count().withColumn("kind", F.lit("nodes_by_type"))
    return by_unit.unionByName(by_type).unionByName(acc).unionByName(nodes).select("kind", "key", "count")


# ------------------------------------------------------------ W1, Q1, Q3


def detect_anomalies(
    df: DataFrame, window_size: int, k: float = 2.0, keys=E.SERIES, chunk_rows: int = 1 << 20
) -> DataFrame:
    """Centred rolling mean/std of ``power_w`` per series; anomaly when
    |p - mean| > k x std.  Incomplete windows are not anomalous; a window of
    1 or less flags nothing.

    Skew: rows get their position in the series (``series_index``), series
    are cut into chunks of ``chunk_rows`` consecutive rows, and each chunk
    also receives the few rows before/after it that its frames need (halo).
    The rolling window is partitioned by (series, chunk), so no task holds
    more than ``chunk_rows`` + window rows whatever the series length.
    """
    keys = list(keys)
    if "power_w" not in df.columns:
        df = df.withColumn("power_w", to_watts())
    w = int(window_size)
    if w <= 1:
        return df.withColumn("power_rolling_mean", F.lit(None).cast("double")).withColumn(
            "power_rolling_std", F.lit(None).cast("double")
        ).withColumn("is_anomaly", F.lit(False))
    lo, hi = w - 1 - (w - 1) // 2, (w - 1) // 2  # rows before / after the centre
    cols = df.columns
    x = E.series_index(df, keys).select(*cols, "_idx")
    c = F.lit(int(max(chunk_rows, w)))  # a halo never reaches past the neighbouring chunk
    own = F.floor(F.col("_idx") / c)
    pos = F.col("_idx") % c
    chunks = F.array_compact(
        F.array(
            own,
            F.when(pos >= c - lo, own + 1),  # last rows: frames at the start of the next chunk look back here
            F.when(pos < hi, own - 1),  # first rows: frames at the end of the previous chunk look ahead here
        )
    )
    x = x.withColumn("_own", own).withColumn("_chunk", F.explode(chunks))
    win = Window.partitionBy(*keys, "_chunk").orderBy("_idx").rowsBetween(-lo, hi)
    full = F.count(F.lit(1)).over(win) == w
    out = (
        x.withColumn("power_rolling_mean", F.when(full, F.avg("power_w").over(win)))
        .withColumn("power_rolling_std", F.when(full, F.stddev_samp("power_w").over(win)))
        .where(F.col("_chunk") == F.col("_own"))
        .drop("_chunk", "_own", "_idx")
    )
    flag = F.abs(F.col("power_w") - F.col("power_rolling_mean")) > k * F.col("power_rolling_std")
    return out.withColumn("is_anomaly", F.coalesce(flag, F.lit(False)))


def clean_readings(
    df: DataFrame, now, max_watts: float | None, min_rows: int, threshold: float = 3.0, remove_outliers: bool = True, keys=None
) -> DataFrame:
    """Q1: keep 0 <= W <= ``max_watts`` (None: no upper bound) and non-null,
    non-future timestamps; then |z| < threshold in groups of more than
    ``min_rows`` rows.  Zero variance -> z = 0 (rows kept, D10).  ``keys`` =
    per-series statistics instead of global."""
    if "power_w" not in df.columns:
        df = df.withColumn("power_w", to_watts())
    d = df.where(F.col("power_w") >= 0)
    if max_watts is not None:
        d = d.where(F.col("power_w") <= max_watts)
    d = d.where(F.col("ts").isNotNull() & (F.col("ts") <= _ts(now)))
    if not remove_outliers:
        return d
    z = lambda m, s: F.coalesce(F.try_divide(F.abs(F.col("power_w") - m), s), F.lit(0.0))
    if keys:
        st = d.groupBy(*keys).agg(
            F.avg("power_w").alias("_m"), F.stddev_samp("power_w").alias("_s"), F.count(F.lit(1)).alias("_n")
        )
        st = st.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_m", "_s", "_n")
        j = d.join(st, [d[k].eqNullSafe(st[f"_k_{k}"]) for k in keys]).drop(*[f"_k_{k}" for k in keys])
        keep = (F.col("_n") <= min_rows) | (z(F.col("_m"), F.col("_s")) < threshold)
        return j.where(keep).drop("_m", "_s", "_n")
    # global statistics: three scalars from one aggregate, used as literals
    row = d.agg(F.count(F.lit(1)).alias("n"), F.avg("power_w").alias("m"), F.stddev_samp("power_w").alias("s")).first()
    if row["n"] <= min_rows:
        return d
    m = F.lit(row["m"]).cast("double")
    s = F.lit(row["s"]).cast("double")
    return d.where(z(m, s) < threshold)


def check_metric_units(readings: DataFrame) -> DataFrame:
    """Q3: (host, metric, unit) combinations whose unit is not the expected one."""
    spark = readings.sparkSession
    exp = spark.createDataFrame(list(K.EXPECTED_UNITS.items()), "metric string, expected_unit string")
    seen = readings.select("hostname", "metric", "units").distinct()
    return seen.join(F.broadcast(exp), "metric").where(F.lower("units") != F.lower("expected_unit"))
