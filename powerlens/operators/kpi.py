"""Domain KPIs: PUE, rack COP, rack validation, components, jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.times import within
from ..sources import dimensions
from . import energy as E

INFRA_KEYS = ["hostname", "metric", "fqdd", "node_type"]


def _ts(t) -> Column:
    return F.lit(str(t)).cast("timestamp_ntz")


def duration_hours(start, end) -> Column:
    return (F.unix_micros(_ts(end).cast("timestamp")) - F.unix_micros(_ts(start).cast("timestamp"))) / 3.6e9


def date_spine(spark: SparkSession, start, end) -> DataFrame:
    """One row per UTC date from date(start) to date(end), inclusive."""
    return spark.range(1).select(
        F.explode(F.sequence(F.to_date(_ts(start)), F.to_date(_ts(end)))).alias("day")
    ).select(F.date_format("day", "yyyy-MM-dd").alias("date"))


def pue_value(irc: Column, pdu: Column) -> Column:
    """K1 ladder: 0/0 -> 0, irc>0 & pdu=0 -> null, irc=0 -> 1, else (irc+pdu)/pdu."""
    return (
        F.when(pdu == 0, F.when(irc == 0, F.lit(0.0)).otherwise(F.lit(None).cast("double")))
        .when(irc == 0, F.lit(1.0))
        .otherwise((irc + pdu) / pdu)
    )


def pue_band(pue: Column) -> Column:
    """K3: interpretation of a PUE value, in the reference's order."""
    return (
        F.when(pue.isNull(), "unavailable")
        .when(pue == 0.0, "down")
        .when(pue == 1.0, "irc_down")
        .when(pue < K.PUE_BANDS[0][0], K.PUE_BANDS[0][1])
        .when(pue < K.PUE_BANDS[1][0], K.PUE_BANDS[1][1])
        .when(pue < K.PUE_BANDS[2][0], K.PUE_BANDS[2][1])
        .otherwise("poor")
    )


def pue_inputs(readings: DataFrame) -> DataFrame:
    """IRC power metrics of listed IRC hosts + PDU readings of listed PDUs."""
    h, m, nt = F.col("hostname"), F.col("metric"), F.col("node_type")
    irc = (nt == "irc") & m.isin(K.IRC_POWER_METRICS) & h.isin(K.IRC_NODES)
    pdu = (nt == "pdu") & m.isin(K.PDU_POWER_METRICS) & h.isin(K.pdu_nodes())
    return readings.where(irc | pdu)


def pue_node_breakdown(spark: SparkSession, readings: DataFrame, start, end, max_gap_seconds=None) -> DataFrame:
    """K2 (+C9): kWh per listed node and metric, 0.0 for silent nodes."""
    e = E.energy_gap(pue_inputs(readings), INFRA_KEYS, max_gap_seconds, start, end)
    inv = dimensions.inventory(spark).where(F.col("node_type").isin("irc", "pdu"))
    mets = spark.createDataFrame(
        [("irc", m) for m in K.IRC_POWER_METRICS] + [("pdu", m) for m in K.PDU_POWER_METRICS],
        "node_type string, metric string",
    )
    grid = F.broadcast(inv.join(mets, "node_type").select("hostname", "node_type", "metric"))
    return grid.join(e.select("hostname", "metric", "energy_kwh"), ["hostname", "metric"], "left").select(
        "hostname", "node_type", "metric", F.coalesce("energy_kwh", F.lit(0.0)).alias("energy_kwh")
    )


def pue(spark: SparkSession, readings: DataFrame, start, end, max_gap_seconds=None) -> DataFrame:
    """K1: cluster PUE over [start, end] as one row."""
    nodes = pue_node_breakdown(spark, readings, start, end, max_gap_seconds)
    nt = F.col("node_type")
    agg = nodes.agg(
        F.sum(F.when(nt == "irc", F.col("energy_kwh")).otherwise(0.0)).alias("irc_energy_kwh"),
        F.sum(F.when(nt == "pdu", F.col("energy_kwh")).otherwise(0.0)).alias("pdu_energy_kwh"),
    )
    hours = duration_hours(start, end)
    irc, pdu = F.col("irc_energy_kwh"), F.col("pdu_energy_kwh")
    p = pue_value(irc, pdu)
    return agg.select(
        _ts(start).alias("start_ts"),
        _ts(end).alias("end_ts"),
        hours.alias("duration_hours"),
        irc,
        pdu,
        (irc + pdu).alias("total_energy_kwh"),
        p.alias("pue"),
        E.avg_power_from_energy(irc, hours).alias("avg_irc_power_kw"),
        E.avg_power_from_energy(pdu, hours).alias("avg_pdu_power_kw"),
        E.avg_power_from_energy(irc + pdu, hours).alias("avg_total_power_kw"),
        F.lit(len(K.IRC_NODES)).cast("bigint").alias("irc_node_count"),
        F.lit(len(K.pdu_nodes())).cast("bigint").alias("pdu_node_count"),
        F.when(p.isNull(), "error").otherwise("success").alias("status"),
        pue_band(p).alias("band"),
    )


def pue_daily(spark: SparkSession, readings: DataFrame, start, end, max_gap_seconds=None) -> DataFrame:
    """K4: per UTC date IRC and PDU kWh and PUE over the full date spine."""
    # interval pieces straight to per-day sums (one map-side-combined aggregate)
    pairs = E.kept_intervals(pue_inputs(readings), INFRA_KEYS, max_gap_seconds, start, end, dedupe=True)
    nt = F.col("node_type")
    per_day = (
        E.day_pieces(pairs)
        .groupBy("day")
        .agg(
            (F.sum(F.when(nt == "irc", F.col("piece_j")).otherwise(0.0)) / K.JOULES_PER_KWH).alias("irc_energy_kwh"),
            (F.sum(F.when(nt == "pdu", F.col("piece_j")).otherwise(0.0)) / K.JOULES_PER_KWH).alias("pdu_energy_kwh"),
        )
        .select(F.date_format("day", "yyyy-MM-dd").alias("date"), "irc_energy_kwh", "pdu_energy_kwh")
    )
    out = date_spine(spark, start, end).join(per_day, "date", "left")
    irc = F.coalesce(F.col("irc_energy_kwh"), F.lit(0.0))
    pdu = F.coalesce(F.col("pdu_energy_kwh"), F.lit(0.0))
    return out.select("date", irc.alias("irc_energy_kwh"), pdu.alias("pdu_energy_kwh"), pue_value(irc, pdu).alias("pue"))


# --------------------------------------------------------------------------
# rack COP (K5-K7)


def _cop_inputs(readings: DataFrame) -> DataFrame:
    return readings.where(
        F.col("hostname").isin(list(K.RACK_TO_IRC.values())) & F.col("metric").isin(K.COP_METRICS)
    )


def _cop_columns(df: DataFrame) -> DataFrame:
    comp = F.coalesce(F.col("CompressorPower"), F.lit(0.0))
    fan = F.coalesce(F.col("CondenserFanPower"), F.lit(0.0))
    cool = F.coalesce(F.col("CoolDemand"), F.lit(0.0))
    return df.select(
        *[c for c in df.columns if c not in K.COP_METRICS],
        comp.alias("compressor_power_kwh"),
        fan.alias("condenser_fan_power_kwh"),
        cool.alias("cool_demand_kwh"),
        F.when(comp + fan > 0, cool / (comp + fan)).alias("cop"),
    )


def rack_cop(spark: SparkSession, readings: DataFrame, start, end, max_gap_seconds=None) -> DataFrame:
    """K5: per rack with an IRC: compressor, fan, cool-demand kWh and COP.

    Gap limit: 4 x IRC cadence (480 s) unless given.
    """
    gap = max_gap_seconds if max_gap_seconds is not None else float(K.GAP_FACTOR * K.IRC_SENSING_SECONDS)
    e = E.energy_gap(_cop_inputs(readings), ["hostname", "metric"], gap, start, end)
    piv = e.groupBy("hostname").pivot("metric", K.COP_METRICS).agg(F.first("energy_kwh"))
    racks = F.broadcast(dimensions.rack_info(spark).where(F.col("irc_node").isNotNull()))
    out = racks.join(piv, racks["irc_node"] == piv["hostname"], "left").select("rack", "irc_node", *K.COP_METRICS)
    return _cop_columns(out)


def rack_cop_summary(spark: SparkSession, readings: DataFrame, start, end, max_gap_seconds=None) -> DataFrame:
    """K6: racks, racks with a COP, mean COP, hours."""
    r = rack_cop(spark, readings, start, end, max_gap_seconds)
    return r.agg(
        F.count(F.lit(1)).alias("total_racks"),
        F.count("cop").alias("racks_with_data"),
        F.avg("cop").alias("avg_cop"),
    ).withColumn("duration_hours", duration_hours(start, end))


def rack_cop_daily(spark: SparkSession, readings: DataFrame, start, end, max_gap_minutes: float = 10) -> DataFrame:
    """K7: date x rack (91-96) grid with the K5 columns; no timestamp dedupe
    (zero-length intervals are skipped anyway, D7)."""
    pairs = E.kept_intervals(_cop_inputs(readings), ["hostname", "metric"], max_gap_minutes * 60.0, start, end, dedupe=False)
    m = F.col("metric")
    piv = (
        E.day_pieces(pairs)
        .groupBy("hostname", F.date_format("day", "yyyy-MM-dd").alias("date"))
        .agg(*[(F.sum(F.when(m == x, F.col("piece_j"))) / K.JOULES_PER_KWH).alias(x) for x in K.COP_METRICS])
    )
    # days x racks grid by explode over the 6-row rack literal (no join)
    grid = (
        dimensions.rack_info(spark)
        .where(F.col("irc_node").isNotNull())
        .select("rack", "irc_node", F.explode(F.sequence(F.to_date(_ts(start)), F.to_date(_ts(end)))).alias("day"))
        .select(F.date_format("day", "yyyy-MM-dd").alias("date"), "rack", "irc_node")
    )
    out = grid.join(
        piv, (grid["irc_node"] == piv["hostname"]) & (grid["date"] == piv["date"]), "left"
    ).select(grid["date"], "rack", "irc_node", *K.COP_METRICS)
    return _cop_columns(out)


# --------------------------------------------------------------------------
# node / metric energies feeding the component and rack KPIs


def device_energy(readings: DataFrame, start, end) -> DataFrame:
    """T11 over the window: per device T3 energy plus a TOTAL row per (host, metric)."""
    readings = within(readings, start, end)
    return E.energy_per_fqdd(readings, start, end)


def metric_energy(readings: DataFrame, start, end, dev: DataFrame | None = None) -> DataFrame:
    """Per (host, metric) T3 energy with the query bounds; devices are
    integrated separately and summed (T11).  Adds ``category`` (B13)."""
    from ..functions.nodes import metric_category

    dev = dev if dev is not None else device_energy(readings, start, end)
    per_metric = dev.where("is_total").select("hostname", "metric", "energy_kwh")
    return per_metric.withColumn("category", metric_category("metric"))


def node_energy(spark: SparkSession, readings: DataFrame, start, end) -> DataFrame:
    """T4 energy per listed host and default metric (B11), one plan."""
    from .filters import metrics_for_node

    wanted = F.broadcast(metrics_for_node(dimensions.inventory(spark)).select("hostname", "metric"))
    r = within(readings, start, end).join(wanted, ["hostname", "metric"], "left_semi")
    return E.energy_hold(r, ["hostname", "metric", "fqdd"], start, end).groupBy("hostname", "metric").agg(
        F.sum("energy_kwh").alias("energy_kwh")
    )


def multi_node_energy(readings: DataFrame, start, end) -> DataFrame:
    """T3 energy for every host and metric, with its database."""
    from ..functions.nodes import node_database

    r = within(readings, start, end)
    e = E.energy_boundary(r, ["hostname", "metric", "fqdd"], start, end)
    return e.groupBy("hostname", "metric").agg(F.sum("energy_kwh").alias("energy_kwh")).withColumn(
        "database", node_database("hostname")
    )


def metric_energy_table(readings: DataFrame, start, end) -> DataFrame:
    """The six fixed metrics of every compute host in kWh and Wh plus a
    per-host sum row (ROLLUP).  Bounds are used unless the data start or end
    more than 7200 s inside the window (T15 short form)."""
    from ..functions.times import epoch_micros
    from .windows import _guard

    r = within(readings, start, end).where(F.col("metric").isin(K.NODE_ENERGY_TABLE_METRICS))
    r = r.withColumn("start_ts", _ts(start)).withColumn("end_ts", _ts(end))
    # guard per (host, metric) from the metric's first/last reading, devices integrated apart
    parts = E.boundary_parts(r, ["hostname", "metric", "fqdd", "start_ts", "end_ts"])
    w = Window.partitionBy("hostname", "metric")
    parts = parts.withColumn("_m0", F.min("first_us").over(w)).withColumn("_m1", F.max("last_us").over(w))
    g = parts.select("*", *_guard(F.col("_m0"), F.col("_m1"), True))
    s_us = F.when(F.col("use_boundaries"), epoch_micros(F.col("start_ts")))
    e_us = F.when(F.col("use_boundaries"), epoch_micros(F.col("end_ts")))
    e = g.select("hostname", "metric", E.boundary_kwh(s_us, e_us).alias("energy_kwh"))
    per = e.groupBy("hostname", "metric").agg(F.sum("energy_kwh").alias("energy_kwh"))
    roll = per.rollup("hostname", "metric").agg(F.sum("energy_kwh").alias("energy_kwh"), F.grouping_id().alias("_g"))
    roll = roll.where(F.col("_g") < 3)
    return roll.select(
        "hostname",
        F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col("metric")).alias("metric"),
        "energy_kwh",
        (F.col("energy_kwh") * 1000.0).alias("energy_wh"),
    )


# --------------------------------------------------------------------------
# components


def _cat_energy(me: DataFrame, cat: str, total_metric: str | None) -> Column:
    """coalesce(energy of the category's total metric, sum of the category)."""
    in_cat = F.col("category") == cat
    tot = F.max(F.when(F.col("metric") == total_metric, F.col("energy_kwh"))) if total_metric else F.lit(None)
    return F.coalesce(tot, F.sum(F.when(in_cat, F.col("energy_kwh"))), F.lit(0.0))


def has_gpu(hostname="hostname") -> Column:
    """Hosts of the zen4 partition have no GPU; their forms of K11, K12 and K16 leave it out."""
    from ..functions.nodes import node_database

    return node_database(hostname) != "zen4"


def component_totals(readings: DataFrame, start, end, dev: DataFrame | None = None) -> DataFrame:
    """Per host: CPU, MEMORY, GPU total (null for hosts without GPU), FAN, STORAGE and SystemOutput kWh."""
    dev = dev if dev is not None else device_energy(readings.where(F.col("node_type") == "compute"), start, end)
    me = metric_energy(readings, start, end, dev)
    return me.groupBy("hostname").agg(
        _cat_energy(me, "CPU", K.CATEGORY_TOTAL_METRIC["CPU"]).alias("cpu"),
        _cat_energy(me, "MEMORY", K.CATEGORY_TOTAL_METRIC["MEMORY"]).alias("memory"),
        _cat_energy(me, "FAN", K.CATEGORY_TOTAL_METRIC["FAN"]).alias("fan"),
        _cat_energy(me, "STORAGE", K.CATEGORY_TOTAL_METRIC["STORAGE"]).alias("storage"),
        F.coalesce(F.max(F.when(F.col("metric") == "SystemOutputPower", F.col("energy_kwh"))), F.lit(0.0)).alias("system_output"),
        F.coalesce(F.sum(F.when(F.col("metric") == "PowerConsumption", F.col("energy_kwh"))), F.lit(0.0)).alias("gpu_total"),
    ).withColumn("gpu_total", F.when(has_gpu(), F.col("gpu_total")))


def component_breakdown(readings: DataFrame, start, end) -> DataFrame:
    """Per host rows CPU, MEMORY, GPU (fqdd=x)..., GPU Total, FAN,
    STORAGE, SystemOutputPower with an ``order_idx`` (missing -> 0.0); no GPU
    rows for hosts without GPU."""
    dev = device_energy(readings.where(F.col("node_type") == "compute"), start, end)
    t = component_totals(readings, start, end, dev)
    fixed = t.select(
        "hostname",
        F.inline(
            F.array(
                F.struct(F.lit("CPU").alias("component"), F.col("cpu").alias("energy_kwh"), F.lit(0).alias("order_idx")),
                F.struct(F.lit("MEMORY").alias("component"), F.col("memory").alias("energy_kwh"), F.lit(1).alias("order_idx")),
                F.struct(F.lit("GPU Total").alias("component"), F.col("gpu_total").alias("energy_kwh"), F.lit(3).alias("order_idx")),
                F.struct(F.lit("FAN").alias("component"), F.col("fan").alias("energy_kwh"), F.lit(4).alias("order_idx")),
                F.struct(F.lit("STORAGE").alias("component"), F.col("storage").alias("energy_kwh"), F.lit(5).alias("order_idx")),
                F.struct(F.lit("SystemOutputPower").alias("component"), F.col("system_output").alias("energy_kwh"), F.lit(6).alias("order_idx")),
            )
        ),
    )
    fixed = fixed.where(F.col("energy_kwh").isNotNull())  # the total of hosts without GPU
    gpu_rows = dev.where(has_gpu() & (F.col("metric") == "PowerConsumption") & ~F.col("is_total") & F.col("fqdd").isNotNull()).select(
        "hostname",
        # label: the part of the device id after its last underscore
        F.concat(F.lit("GPU (fqdd="), F.element_at(F.split(F.col("fqdd"), "_"), -1), F.lit(")")).alias("component"),
        "energy_kwh",
        F.lit(2).alias("order_idx"),
    )
    return fixed.unionByName(gpu_rows)


def component_share(readings: DataFrame, start, end) -> DataFrame:
    """Top-level shares; Other = max(output - sum of components, 0); no GPU
    row for hosts without GPU."""
    t = component_totals(readings, start, end)
    s = F.col("cpu") + F.coalesce("gpu_total", F.lit(0.0)) + F.col("memory") + F.col("fan") + F.col("storage")
    other = F.greatest(F.col("system_output") - s, F.lit(0.0))
    return t.select(
        "hostname",
        F.inline(
            F.array(
                F.struct(F.lit("GPU Total").alias("component"), F.col("gpu_total").alias("energy_kwh")),
                F.struct(F.lit("CPU").alias("component"), F.col("cpu").alias("energy_kwh")),
                F.struct(F.lit("MEMORY").alias("component"), F.col("memory").alias("energy_kwh")),
                F.struct(F.lit("FAN").alias("component"), F.col("fan").alias("energy_kwh")),
                F.struct(F.lit("STORAGE").alias("component"), F.col("storage").alias("energy_kwh")),
                F.struct(F.lit("Other").alias("component"), other.alias("energy_kwh")),
            )
        ),
    ).where(F.col("energy_kwh").isNotNull())


def cpu_fqdd_share(readings: DataFrame, start, end) -> DataFrame:
    """CPU energy per device (CPU metrics with devices)."""
    cpu = within(readings, start, end).where(F.col("metric").isin(K.METRIC_CATEGORIES["CPU"]) & F.col("fqdd").isNotNull())
    d = E.energy_per_fqdd(cpu, start, end)
    return d.where(~F.col("is_total")).select("hostname", "metric", "fqdd", "energy_kwh")


def component_share_contains(readings: DataFrame, start, end) -> DataFrame:
    """Substring grouping (B14) of positive metric energies; Other
    becomes output - sum of the named components when output > 0; zero
    groups dropped."""
    from ..functions.nodes import is_excluded, metric_category_contains

    me = metric_energy(readings.where(~is_excluded("metric")), start, end).where(F.col("energy_kwh") > 0)
    g = me.withColumn("grp", metric_category_contains("metric"))
    per = g.groupBy("hostname").agg(
        *[F.coalesce(F.sum(F.when(F.col("grp") == c, F.col("energy_kwh"))), F.lit(0.0)).alias(c) for c in K.CONTAINS_ORDER],
        F.coalesce(F.sum(F.when(F.col("grp") == "Other", F.col("energy_kwh"))), F.lit(0.0)).alias("Other"),
        F.coalesce(F.max(F.when(F.col("grp") == "SystemOutput", F.col("energy_kwh"))), F.lit(0.0)).alias("_out"),
    )
    comp = sum((F.col(c) for c in K.CONTAINS_ORDER), F.lit(0.0))
    other = F.when(F.col("_out") > 0, F.greatest(F.col("_out") - comp, F.lit(0.0))).otherwise(F.col("Other"))
    cats = [F.struct(F.lit(c).alias("component"), F.col(c).alias("energy_kwh")) for c in K.CONTAINS_ORDER]
    cats.append(F.struct(F.lit("Other").alias("component"), other.alias("energy_kwh")))
    return per.select("hostname", F.inline(F.array(*cats))).where(F.col("energy_kwh") > 0)


def metric_relationships(readings: DataFrame, start, end) -> DataFrame:
    """K15 (+C11): per host, every pair of metric totals inside the CPU,
    MEMORY and SYSTEM categories with both energies > 0 (alphabetical pairs)."""
    from .enrich import metric_pairs

    me = metric_energy(readings.where(F.col("node_type") == "compute"), start, end).where(
        F.col("category").isin("CPU", "MEMORY", "SYSTEM") & (F.col("energy_kwh") > 0)
    )
    p = metric_pairs(me, "category")
    diff = F.abs(F.col("energy_1") - F.col("energy_2"))
    pct = diff / F.greatest("energy_1", "energy_2") * 100.0
    return p.select(
        "hostname", "category", "metric_1", "metric_2",
        F.col("energy_1").alias("energy1_kwh"), F.col("energy_2").alias("energy2_kwh"),
        diff.alias("difference_kwh"), pct.alias("difference_percent"),
        F.when(pct < K.RELATION_IDENTICAL_PCT, "IDENTICAL").otherwise("DIFFERENT").alias("relationship"),
    )


def components_vs_system(readings: DataFrame, start, end) -> DataFrame:
    """SystemOutput vs CPU+MEMORY+GPU+FAN+STORAGE, MATCHES under 10 %."""
    t = component_totals(readings, start, end)
    comp = F.col("cpu") + F.col("memory") + F.coalesce("gpu_total", F.lit(0.0)) + F.col("fan") + F.col("storage")
    t = t.withColumn("components_total", comp).where((F.col("system_output") > 0) & (F.col("components_total") > 0))
    diff = F.abs(F.col("system_output") - F.col("components_total"))
    pct = diff / F.col("system_output") * 100.0
    return t.select(
        "hostname",
        F.col("system_output").alias("energy1_kwh"),
        F.col("components_total").alias("energy2_kwh"),
        diff.alias("difference_kwh"),
        pct.alias("difference_percent"),
        F.when(pct < K.SYSTEM_MATCH_PCT, "MATCHES").otherwise("MISMATCH").alias("relationship"),
    )


# --------------------------------------------------------------------------
# racks (K8-K10, K20, E16)


def estimated_energy_observed(spark: SparkSession, readings: DataFrame) -> DataFrame:
    """K20 over the data: unmeasured kW x hours spanned by each rack's PDU readings."""
    from ..functions.nodes import rack_of
    from ..functions.times import epoch_micros

    span = (
        readings.where(F.col("node_type") == "pdu")
        .groupBy(rack_of("hostname").alias("rack"))
        .agg(((F.max(epoch_micros(F.col("ts"))) - F.min(epoch_micros(F.col("ts")))) / 3.6e9).alias("hours"))
    )
    return F.broadcast(dimensions.rack_info(spark)).join(span, "rack").select(
        "rack", "analysis_type", "estimated_kw", "hours", (F.col("estimated_kw") * F.col("hours")).alias("estimated_kwh")
    )


def estimated_energy(spark: SparkSession, start, end) -> DataFrame:
    """Constant unmeasured kW x window hours per rack."""
    return dimensions.rack_info(spark).select(
        "rack", "analysis_type", "estimated_kw", (F.col("estimated_kw") * duration_hours(start, end)).alias("estimated_kwh")
    )


def rack_validation(spark: SparkSession, readings: DataFrame, start, end) -> DataFrame:
    """K8 (+K9): per rack compute SystemInputPower kWh vs PDU kWh (T3 with
    bounds), estimate, raw and adjusted differences, verdict."""
    inv = F.broadcast(dimensions.inventory(spark).select("hostname", "rack", F.col("node_type").alias("_nt")))
    m = F.lower(F.col("metric"))
    r = within(readings, start, end).where((m == "systeminputpower") | (m == "pdu"))
    e = E.energy_boundary(r, ["hostname", "metric", "fqdd"], start, end)
    e = e.join(inv, "hostname")
    per = e.groupBy("rack").agg(
        F.sum(F.when(F.col("_nt") == "compute", F.col("energy_kwh")).otherwise(0.0)).alias("compute_kwh"),
        F.sum(F.when(F.col("_nt") == "pdu", F.col("energy_kwh")).otherwise(0.0)).alias("pdu_kwh"),
        F.countDistinct(F.when(F.col("_nt") == "compute", F.col("hostname"))).alias("compute_nodes"),
        F.countDistinct(F.when(F.col("_nt") == "pdu", F.col("hostname"))).alias("pdu_nodes"),
    )
    est = estimated_energy(spark, start, end)
    j = est.join(per, "rack", "left").fillna(0.0, subset=["compute_kwh", "pdu_kwh"]).fillna(0, subset=["compute_nodes", "pdu_nodes"])
    c, p, x = F.col("compute_kwh"), F.col("pdu_kwh"), F.col("estimated_kwh")
    raw = c - p
    adj = c + x - p
    raw_pct = F.when(p > 0, raw / p * 100.0)
    adj_pct = F.when(p > 0, adj / p * 100.0)
    used = F.when(F.col("analysis_type") == "accurate", raw_pct).otherwise(adj_pct)
    return j.select(
        "rack", "analysis_type", "compute_nodes", "pdu_nodes", "compute_kwh", "pdu_kwh", "estimated_kwh",
        raw.alias("raw_difference_kwh"), raw_pct.alias("raw_difference_pct"),
        adj.alias("adjusted_difference_kwh"), adj_pct.alias("adjusted_difference_pct"),
        rack_verdict(used).alias("verdict"),
    )


def rack_verdict(pct: Column) -> Column:
    """K9: |%| < 10 GOOD, < 20 ACCEPTABLE, else NEEDS INVESTIGATION (null if no PDU)."""
    a = F.abs(pct)
    return (
        F.when(pct.isNull(), F.lit(None).cast("string"))
        .when(a < K.RACK_VERDICTS[0][0], K.RACK_VERDICTS[0][1])
        .when(a < K.RACK_VERDICTS[1][0], K.RACK_VERDICTS[1][1])
        .otherwise("NEEDS INVESTIGATION")
    )


def rack_power_comparison(spark: SparkSession, readings: DataFrame, start, end) -> DataFrame:
    """Rows compute, estimated, compute+estimated, PDU with % of PDU
    (only racks with compute and PDU energy; estimate rows only when > 0)."""
    v = rack_validation(spark, readings, start, end).where((F.col("compute_kwh") > 0) & (F.col("pdu_kwh") > 0))
    c, p, x = F.col("compute_kwh"), F.col("pdu_kwh"), F.col("estimated_kwh")
    rows = F.array(
        F.struct(F.lit("SystemInputPower (Compute Nodes)").alias("power_source"), c.alias("total_energy_kwh"), F.lit(0).alias("pos")),
        F.struct(F.lit("Estimated Switch/Unmeasured Components").alias("power_source"), x.alias("total_energy_kwh"), F.lit(1).alias("pos")),
        F.struct(F.lit("Total Compute + Estimated").alias("power_source"), (c + x).alias("total_energy_kwh"), F.lit(2).alias("pos")),
        F.struct(F.lit("PDU Nodes").alias("power_source"), p.alias("total_energy_kwh"), F.lit(3).alias("pos")),
    )
    out = v.select("rack", "pdu_kwh", "estimated_kwh", F.inline(rows))
    out = out.where(~F.col("pos").isin(1, 2) | (F.col("estimated_kwh") > 0))
    return out.select(
        "rack", "power_source", "total_energy_kwh",
        F.when(F.col("pos") == 3, F.lit(100.0)).otherwise(F.col("total_energy_kwh") / F.col("pdu_kwh") * 100.0).alias("percentage_of_pdu"),
    )


def rack_summary(spark: SparkSession, readings: DataFrame, start, end) -> DataFrame:
    """Per rack of the inventory nodes analysed, total and average energy
    per node (T9) and status (``no_data``: no node of the rack has readings).

    The total adds overlapping metrics and node types (D15); the totals per
    node type stand beside it.
    """
    ne = node_energy(spark, readings, start, end).groupBy("hostname").agg(F.sum("energy_kwh").alias("e"))
    inv = dimensions.inventory(spark).select("hostname", "rack", "node_type")
    nodes = inv.join(ne, "hostname", "left")
    n, total = F.count("e"), F.coalesce(F.sum("e"), F.lit(0.0))
    by_type = [
        F.coalesce(F.sum(F.when(F.col("node_type") == t, F.col("e"))), F.lit(0.0)).alias(f"{t}_energy_kwh") for t in ("irc", "pdu", "compute")
    ]
    return nodes.groupBy("rack").agg(
        F.when(n > 0, "success").otherwise("no_data").alias("status"),
        n.alias("nodes_analyzed"),
        total.alias("total_energy_kwh"),
        F.when(n > 0, total / n).otherwise(0.0).alias("avg_energy_per_node"),
        *by_type,
    )


def node_result_summary(spark: SparkSession, readings: DataFrame, start, end) -> DataFrame:
    """Per host status flags, records, avg/max W, energy summed over metrics."""
    from ..functions.units import to_watts

    r = within(readings, start, end)
    p = r.groupBy("hostname").agg(
        F.count(F.lit(1)).alias("total_records"), F.avg(to_watts()).alias("avg_power_w"), F.max(to_watts()).alias("max_power_w")
    )
    ne = node_energy(spark, readings, start, end).groupBy("hostname").agg(F.sum("energy_kwh").alias("total_energy_kwh"))
    j = p.join(ne, "hostname", "full")
    return j.select(
        "hostname",
        F.when(F.col("total_records").isNotNull(), "success").otherwise("no_data").alias("status"),
        F.col("total_records").isNotNull().alias("has_power_data"),
        F.col("total_energy_kwh").isNotNull().alias("has_energy_data"),
        F.coalesce("total_records", F.lit(0).cast("bigint")).alias("total_records"),
        "avg_power_w",
        "max_power_w",
        F.coalesce("total_energy_kwh", F.lit(0.0)).alias("total_energy_kwh"),
    )
