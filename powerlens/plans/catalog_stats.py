"""Registered queries: aggregations, tails, quality, anomalies, cleaning,
node energies (E1-E20, W1, W3, Q1-Q3, T9, T10, T16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import energy as E
from ..operators import kpi
from ..operators import stats as ST
from ..sources import dimensions as D
from ..sources import telemetry as T
from . import params as P
from . import sqlparts as S
from .catalog import CR, RD, SERIES, WIN, _all_heads, _head, _sql_power_intervals
from .catalog_rows import HOUR_ALL, _defs_values, _inventory_sql
from .registry import query, rounded

R = lambda c, a=None: S.r(c, a or c)

WIDE = """w AS (SELECT event_id, ts, user_id AS node_id, value AS power_consumption_watts, 1000.0 AS power_limit_watts,
  20.0 + value / 10.0 AS temperature_celsius, value % 100 AS cpu_utilization_percent,
  CAST(event_id % 100 AS DOUBLE) AS memory_utilization_percent FROM events)"""


def _recent(h) -> str:
    return f"ts >= {S.ts(P.NOW)} - INTERVAL {h} HOUR AND ts <= {S.ts(P.NOW)}"


@query("node_summary", lambda: "WITH " + WIDE + f"""
SELECT node_id, {R('avg(power_consumption_watts)', 'avg_power_watts')}, {R('max(power_consumption_watts)', 'max_power_watts')},
  {R('min(power_consumption_watts)', 'min_power_watts')}, {R('avg(temperature_celsius)', 'avg_temperature_celsius')},
  {R('max(temperature_celsius)', 'max_temperature_celsius')}, {R('avg(cpu_utilization_percent)', 'avg_cpu_utilization')},
  {R('avg(memory_utilization_percent)', 'avg_memory_utilization')}, count(*) AS data_points
FROM w WHERE {_recent(HOUR_ALL)} GROUP BY node_id""")
def q_node_summary(spark, sf):
    return rounded(ST.node_summary(T.wide_metrics(spark, sf), P.NOW, HOUR_ALL))


@query("cluster_summary", lambda: "WITH " + WIDE + f"""
SELECT count(DISTINCT node_id) AS total_nodes, {R('avg(power_consumption_watts)', 'cluster_avg_power_watts')},
  {R('sum(power_consumption_watts)', 'cluster_total_power_watts')}, {R('max(power_consumption_watts)', 'cluster_max_power_watts')},
  {R('avg(temperature_celsius)', 'cluster_avg_temperature_celsius')}, {R('max(temperature_celsius)', 'cluster_max_temperature_celsius')},
  {R('avg(cpu_utilization_percent)', 'cluster_avg_cpu_utilization')}, {R('avg(memory_utilization_percent)', 'cluster_avg_memory_utilization')}
FROM w WHERE {_recent(HOUR_ALL)}""")
def q_cluster_summary(spark, sf):
    return rounded(ST.cluster_summary(T.wide_metrics(spark, sf), P.NOW, HOUR_ALL))


@query("metric_summary", lambda: _head(*_all_heads()) + f"""
SELECT {R('avg(value)', 'avg_value')}, {R('max(value)', 'max_value')}, {R('min(value)', 'min_value')}, count(*) AS data_points
FROM readings WHERE metric = 'SystemPowerConsumption' AND {_recent(HOUR_ALL)}""")
def q_metric_summary(spark, sf):
    return rounded(ST.metric_summary(RD(spark, sf), "SystemPowerConsumption", P.NOW, HOUR_ALL))


@query("power_temp_cluster_summary", lambda: """WITH p AS (SELECT user_id AS nodeid, ts, value FROM events WHERE event_type = 'click'),
t AS (SELECT user_id AS nodeid, ts, 20.0 + value / 10.0 AS value FROM events
      WHERE event_type = 'view' OR (event_type = 'click' AND value >= 100.0)),
j AS (SELECT p.nodeid AS p_nodeid, p.value AS p_value, t.value AS t_value
      FROM p FULL OUTER JOIN t ON p.nodeid = t.nodeid AND p.ts = t.ts""" + f"""
      WHERE p.ts >= {S.ts(P.NOW)} - INTERVAL {HOUR_ALL} HOUR OR t.ts >= {S.ts(P.NOW)} - INTERVAL {HOUR_ALL} HOUR)
SELECT count(DISTINCT p_nodeid) AS total_nodes, {R('avg(p_value)', 'cluster_avg_power')}, {R('max(p_value)', 'cluster_max_power')},
  {R('avg(t_value)', 'cluster_avg_temp')}, {R('max(t_value)', 'cluster_max_temp')},
  count(p_value) AS power_data_points, count(t_value) AS temp_data_points FROM j""")
def q_power_temp_cluster_summary(spark, sf):
    p, t = T.power_and_temperature(spark, sf)
    return rounded(ST.power_temp_cluster_summary(p, t, P.NOW, HOUR_ALL))


@query("host_summary", lambda: _head(*_all_heads()) + """
SELECT hostname, round(avg(value), 2) AS avg_power, round(min(value), 2) AS min_power, round(max(value), 2) AS max_power,
  count(value) AS sample_count, round(stddev_samp(value), 2) AS std_power
FROM readings WHERE metric = 'SystemInputPower' GROUP BY hostname""")
def q_host_summary(spark, sf):
    return rounded(ST.host_summary(RD(spark, sf).where(F.col("metric") == "SystemInputPower")))


@query("nodeid_summary", lambda: _head(*_all_heads()) + f"""
SELECT nodeid, {R('avg(value)', 'avg_power')}, {R('min(value)', 'min_power')}, {R('max(value)', 'max_power')},
  count(*) AS sample_count, {R('stddev_samp(value)', 'power_stddev')}
FROM readings WHERE lower(metric) = 'systeminputpower' AND {WIN} GROUP BY nodeid""")
def q_nodeid_summary(spark, sf):
    return rounded(ST.nodeid_summary(RD(spark, sf), "SystemInputPower", P.START, P.END))


def _proc_sql() -> str:
    """T2 rows as a CTE named ``z`` (from the power_intervals oracle)."""
    body = _sql_power_intervals(True)
    head, _sel = body.rsplit("\nSELECT", 1)
    return head


@query("power_statistics", lambda: _proc_sql() + f"""
SELECT {SERIES}, count(*) AS count, {R('avg(power_w)', 'mean_power_w')}, round(quantile_cont(power_w, 0.5), 9) AS median_power_w,
  {R('stddev_samp(power_w)', 'std_power_w')}, {R('min(power_w)', 'min_power_w')}, {R('max(power_w)', 'max_power_w')},
  round(quantile_cont(power_w, 0.25), 9) AS q25_power_w, round(quantile_cont(power_w, 0.75), 9) AS q75_power_w,
  {R('last(cumulative_energy_kwh ORDER BY ts, event_id)', 'total_energy_kwh')},
  {R('CASE WHEN count(*) > 1 THEN (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 ELSE 0.0 END', 'time_range_hours')},
  {R('CASE WHEN count(*) > 1 AND max(ts) > min(ts) THEN count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9) ELSE 0.0 END', 'data_points_per_hour')}
FROM z GROUP BY {SERIES}""")
def q_power_statistics(spark, sf):
    return rounded(ST.power_statistics(CR(spark, sf)), fine=("median_power_w", "q25_power_w", "q75_power_w"))


@query("bucket_aggregate", lambda: _proc_sql() + f"""
SELECT hostname, time_bucket(INTERVAL 1 HOUR, ts) AS ts, {R('avg(power_w)', 'power_w_mean')}, {R('max(power_w)', 'power_w_max')},
  {R('min(power_w)', 'power_w_min')}, {R('stddev_samp(power_w)', 'power_w_std')}, count(power_w) AS power_w_count,
  {R('avg(value)', 'value_mean')}, {R('max(value)', 'value_max')}, {R('min(value)', 'value_min')},
  {R('last(cumulative_energy_kwh ORDER BY ts, event_id)', 'cumulative_energy_kwh_last')}
FROM z GROUP BY hostname, time_bucket(INTERVAL 1 HOUR, ts)""")
def q_bucket_aggregate(spark, sf):
    return rounded(ST.bucket_aggregate(E.cumulative_energy(CR(spark, sf)), "hostname", "1 hour"))


@query("power_summary", lambda: _proc_sql() + f"""
SELECT hostname, count(*) AS total_records,
  {R('CASE WHEN count(*) > 1 THEN (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 ELSE 0.0 END', 'time_range_hours')},
  array_to_string(list_sort(list_distinct(list(metric))), ',') AS metrics,
  {R('avg(power_w)', 'avg_power_w')}, {R('max(power_w)', 'max_power_w')}, {R('min(power_w)', 'min_power_w')},
  {R('sum(coalesce(energy_interval_kwh, 0.0))', 'total_energy_kwh')}
FROM z GROUP BY hostname""")
def q_power_summary(spark, sf):
    return rounded(ST.power_summary(CR(spark, sf)))


def _tail_sql(q: float, upper: bool) -> str:
    cmp = ">=" if upper else "<="
    ext = "max" if upper else "min"
    return _head(
        *_all_heads(),
        "hd AS (SELECT hostname, metric, max(CAST(fqdd IS NOT NULL AS INTEGER)) AS hd FROM compute_readings GROUP BY hostname, metric)",
        "r AS (SELECT c.*, hd.hd FROM compute_readings c JOIN hd USING (hostname, metric))",
        """s AS (SELECT hostname, metric, fqdd, units, value FROM r WHERE hd = 0 OR fqdd IS NOT NULL
          UNION ALL SELECT hostname, metric, 'TOTAL' AS fqdd, units, value FROM (
            SELECT hostname, metric, ts, sum(value) AS value, first(units) AS units FROM r WHERE hd = 1 GROUP BY hostname, metric, ts) t)""",
        "u AS (SELECT hostname, metric, fqdd, first(units) AS units, count(*) AS sample_count FROM s GROUP BY hostname, metric, fqdd)",
        f"th AS (SELECT hostname, metric, fqdd, quantile_cont(value, {q}) AS thr, {ext}(value) AS extreme FROM s WHERE value > 0 GROUP BY hostname, metric, fqdd)",
        f"""tl AS (SELECT s.hostname, s.metric, s.fqdd, avg(s.value) AS tail_mean, count(*) AS n_tail FROM s JOIN th
             ON s.hostname = th.hostname AND s.metric = th.metric AND s.fqdd IS NOT DISTINCT FROM th.fqdd
             WHERE s.value > 0 AND s.value {cmp} th.thr GROUP BY s.hostname, s.metric, s.fqdd)""",
        """o AS (SELECT u.hostname, u.metric, u.fqdd, u.units, u.sample_count, coalesce(th.thr, 0.0) AS thr,
             coalesce(tl.tail_mean, 0.0) AS tail_mean, coalesce(th.extreme, 0.0) AS extreme, coalesce(tl.n_tail, 0) AS n_tail
           FROM u LEFT JOIN th ON u.hostname = th.hostname AND u.metric = th.metric AND u.fqdd IS NOT DISTINCT FROM th.fqdd
           LEFT JOIN tl ON u.hostname = tl.hostname AND u.metric = tl.metric AND u.fqdd IS NOT DISTINCT FROM tl.fqdd)""",
    )


def _idle_sql() -> str:
    return _tail_sql(K.IDLE_PERCENTILE, False) + f"""
SELECT metric, hostname, fqdd, units, round(thr, 9) AS p3_value, {R('tail_mean', 'lower3_mean')}, round(extreme, 9) AS min_nonzero,
  sample_count, CAST(n_tail AS BIGINT) AS samples_in_lower3 FROM o"""


def _peak_sql() -> str:
    return _tail_sql(K.PEAK_PERCENTILE, True) + f"""
SELECT metric, hostname, fqdd, units, round(thr, 9) AS p97_value, {R('tail_mean', 'upper3_mean')}, round(extreme, 9) AS max_value,
  sample_count, CAST(n_tail AS BIGINT) AS samples_in_upper3 FROM o"""


IDLE_FINE = ("p3_value", "min_nonzero")
PEAK_FINE = ("p97_value", "max_value")


@query("idle_power", _idle_sql)
def q_idle_power(spark, sf):
    return rounded(ST.idle_power(CR(spark, sf)), fine=IDLE_FINE)


@query("peak_power", _peak_sql)
def q_peak_power(spark, sf):
    return rounded(ST.peak_power(CR(spark, sf)), fine=PEAK_FINE)


def _pref_sql(base: str, col: str, largest: bool) -> str:
    head, sel = base.rsplit("\nSELECT", 1)
    o = "DESC" if largest else "ASC"
    return head + f""",
sel AS (SELECT{sel})
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY hostname, metric
  ORDER BY CAST(fqdd = 'TOTAL' AS INTEGER) DESC NULLS LAST, {col} {o}, fqdd ASC NULLS FIRST) AS rn FROM sel) x WHERE rn = 1"""


@query("tail_preferred", lambda: _pref_sql(_idle_sql(), "p3_value", False))
def q_tail_preferred(spark, sf):
    return rounded(ST.tail_preferred(ST.idle_power(CR(spark, sf)), "p3_value", largest=False), fine=IDLE_FINE)


@query("rank_pick", lambda: _pref_sql(_peak_sql(), "p97_value", True))
def q_rank_pick(spark, sf):
    """Top-1 per group (peak tail preferred row)."""
    return rounded(ST.tail_preferred(ST.peak_power(CR(spark, sf)), "p97_value", largest=True), fine=PEAK_FINE)


@query("validate_readings", lambda: _head(*_all_heads()) + f"""
SELECT count(*) AS total_records, {', '.join(f"CAST(count_if({c} IS NULL) AS BIGINT) AS null_{c}" for c in T.COLUMNS)},
  CAST(count_if(TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE) IS NULL AND value IS NOT NULL) AS BIGINT) AS non_numeric,
  CAST(count_if(value < 0) AS BIGINT) AS negative_values, CAST(count_if(value > {K.MAX_NODE_WATTS}) AS BIGINT) AS over_10kw,
  count(DISTINCT hostname) AS unique_hostnames,
  {R('CASE WHEN count(*) > 1 THEN (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 ELSE 0.0 END', 'time_range_hours')},
  count(*) > 0 AS is_valid
FROM readings""")
def q_validate_readings(spark, sf):
    return rounded(ST.validate_readings(RD(spark, sf)))


@query("system_overview", lambda: _head(*_all_heads()) + f"""
SELECT CASE WHEN count(*) > 0 THEN 'healthy' ELSE 'no_data' END AS status, count(*) AS total_records,
  count(DISTINCT metric) AS metrics_count, {R(f'(({S.us(P.END)} - {S.us(P.START)}) / 3.6e9)', 'time_range_hours')}
FROM readings WHERE {WIN}""")
def q_system_overview(spark, sf):
    return rounded(ST.system_overview(RD(spark, sf), P.START, P.END))


@query("database_comparison", lambda: _head(*_all_heads()) + f"""
SELECT CASE WHEN hostname IN ({S.q(S.HOSTS)}) THEN 'infra' WHEN starts_with(hostname, 'rpg-') THEN 'h100'
            WHEN starts_with(hostname, 'rpc-') THEN 'zen4' ELSE 'h100' END AS database,
  {R('avg(value)', 'avg_value')}, {R('max(value)', 'max_value')}, count(*) AS data_points
FROM readings WHERE lower(metric) = 'systeminputpower' GROUP BY 1""")
def q_database_comparison(spark, sf):
    return rounded(ST.database_comparison(RD(spark, sf), "systeminputpower"))


@query("raw_statistics", lambda: _head(*_all_heads(), S.power_cte("readings", "pw")) + f"""
SELECT {SERIES}, count(*) AS n_points, {R('min(value)', 'raw_min')}, {R('max(value)', 'raw_max')}, {R('avg(value)', 'raw_mean')},
  round(quantile_cont(value, 0.5), 9) AS raw_median, {R('min(power_w)', 'w_min')}, {R('max(power_w)', 'w_max')},
  {R('avg(power_w)', 'w_mean')}, round(quantile_cont(power_w, 0.5), 9) AS w_median,
  {R('(max(us) - min(us)) / 3.6e9', 'span_hours')}
FROM pw GROUP BY {SERIES}""")
def q_raw_statistics(spark, sf):
    return rounded(ST.raw_statistics(RD(spark, sf)), fine=("raw_median", "w_median"))


@query("definition_counts", lambda: _head(*_all_heads(), f"defs0 AS {_defs_values()}") + """
, defs AS (SELECT * FROM defs0 WHERE metric_id IN (SELECT metric FROM readings)),
inv AS (SELECT DISTINCT hostname, node_type FROM readings)
SELECT 'by_unit' AS kind, units AS key, count(*) AS count FROM defs GROUP BY units
UNION ALL SELECT 'by_type', metric_data_type, count(*) FROM defs GROUP BY metric_data_type
UNION ALL SELECT 'accurate', 'accuracy_gt_0.95', count(*) FROM defs WHERE accuracy > 0.95
UNION ALL SELECT 'nodes_by_type', node_type, count(*) FROM inv GROUP BY node_type""")
def q_definition_counts(spark, sf):
    """E20 over the definitions of the metrics present in the readings and
    the hosts that report."""
    rd = RD(spark, sf)
    defs = D.metric_defs(spark).join(rd.select(F.col("metric").alias("metric_id")).distinct(), "metric_id", "left_semi")
    nodes = rd.select("hostname", "node_type").distinct()
    return ST.definition_counts(defs, nodes)


# ------------------------------------------------------------ W1, Q1-Q3

ANOMALY_WINDOW = 8


def _anomaly_sql() -> str:
    w = ANOMALY_WINDOW
    lo, hi = w - 1 - (w - 1) // 2, (w - 1) // 2
    frame = f"(PARTITION BY {SERIES} ORDER BY ts, event_id ROWS BETWEEN {lo} PRECEDING AND {hi} FOLLOWING)"
    return _head(*_all_heads(), S.power_cte("compute_readings", "pw"),
                 f"""a AS (SELECT event_id, {SERIES}, ts, power_w,
                       CASE WHEN count(*) OVER {frame} = {w} THEN avg(power_w) OVER {frame} END AS m,
                       CASE WHEN count(*) OVER {frame} = {w} THEN stddev_samp(power_w) OVER {frame} END AS s FROM pw)""") + f"""
SELECT event_id, {SERIES}, ts, {R('power_w')}, {R('m', 'power_rolling_mean')}, {R('s', 'power_rolling_std')},
  coalesce(abs(power_w - m) > 2.0 * s, false) AS is_anomaly FROM a"""


@query("detect_anomalies", _anomaly_sql)
def q_detect_anomalies(spark, sf):
    from ..functions.units import to_watts

    r = CR(spark, sf).withColumn("power_w", to_watts())
    a = ST.detect_anomalies(r, ANOMALY_WINDOW)
    return rounded(a.select("event_id", *E.SERIES, "ts", "power_w", "power_rolling_mean", "power_rolling_std", "is_anomaly"))


@query("clean_readings", lambda: _head(*_all_heads(), S.power_cte("compute_readings", "pw", f"ts <= {S.ts(P.NOW)}")) + f"""
, c AS (SELECT * FROM pw WHERE power_w >= 0 AND power_w <= {K.MAX_NODE_WATTS} AND ts IS NOT NULL),
st AS (SELECT {SERIES.replace('fqdd', 'fqdd')}, avg(power_w) AS m, stddev_samp(power_w) AS s, count(*) AS n FROM c GROUP BY {SERIES})
SELECT c.event_id, c.ts, c.hostname, c.fqdd, c.metric, c.value, c.units, {R('c.power_w', 'power_w')}
FROM c JOIN st ON c.hostname = st.hostname AND c.metric = st.metric AND c.fqdd IS NOT DISTINCT FROM st.fqdd
WHERE st.n <= 10 OR coalesce(abs(c.power_w - st.m) / nullif(st.s, 0), 0.0) < 3.0""")
def q_clean_readings(spark, sf):
    c = ST.clean_readings(CR(spark, sf), P.NOW, K.MAX_NODE_WATTS, 10, keys=list(E.SERIES))
    return rounded(c.select("event_id", "ts", "hostname", "fqdd", "metric", "value", "units", "power_w"))


@query("dedupe_timestamps", lambda: _head(*_all_heads()) + """
SELECT event_id, ts, hostname, fqdd, metric, value, units FROM readings
QUALIFY row_number() OVER (PARTITION BY hostname, metric, fqdd, ts ORDER BY event_id) = 1""")
def q_dedupe_timestamps(spark, sf):
    d = E.dedupe_timestamps(RD(spark, sf).select("event_id", "ts", "hostname", "fqdd", "metric", "value", "units"))
    return d


@query("check_metric_units", lambda: _head(*_all_heads()) + f"""
SELECT DISTINCT r.metric, r.hostname, r.units, e.expected_unit FROM readings r
JOIN (VALUES {', '.join(f"('{k}', '{v}')" for k, v in K.EXPECTED_UNITS.items())}) e(metric, expected_unit) ON r.metric = e.metric
WHERE lower(r.units) <> lower(e.expected_unit)""")
def q_check_metric_units(spark, sf):
    return ST.check_metric_units(RD(spark, sf)).select("metric", "hostname", "units", "expected_unit")


# ------------------------------------------------------------ node energies


def _node_energy_sql(final: str) -> str:
    comp = S.q(__import__("powerlens.operators.filters", fromlist=["x"]).compute_power_metric_list())
    return _head(
        *_all_heads(),
        f"inv AS {_inventory_sql()}",
        f"""want AS (SELECT hostname, unnest(CASE WHEN node_type = 'irc' THEN [{S.q(K.IRC_POWER_METRICS)}]
              WHEN node_type = 'pdu' THEN [{S.q(K.PDU_POWER_METRICS)}] ELSE [{comp}] END) AS metric FROM inv)""",
        S.power_cte("readings", "pw", f"{WIN} AND (hostname, metric) IN (SELECT hostname, metric FROM want)"),
        *S.boundary_energy_ctes("pw", SERIES, P.START, P.END),
        "ne AS (SELECT hostname, metric, sum(greatest(energy_kwh, 0.0)) AS energy_kwh FROM b_e GROUP BY hostname, metric)",
    ) + final


@query("node_energy", lambda: _node_energy_sql(f"\nSELECT hostname, metric, {R('energy_kwh')} FROM ne"))
def q_node_energy(spark, sf):
    return rounded(kpi.node_energy(spark, RD(spark, sf), P.START, P.END))


@query("energy_with_totals", lambda: _node_energy_sql(f"""
SELECT 'irc' AS part, metric, coalesce(hostname, 'TOTAL') AS hostname, {R('sum(energy_kwh)', 'energy_kwh')},
  CAST(grouping(metric, hostname) > 0 AS INTEGER) AS is_total
FROM ne WHERE metric IN ({S.q(K.IRC_POWER_METRICS)}) GROUP BY GROUPING SETS ((metric, hostname), (metric))
UNION ALL
SELECT 'pdu' AS part, coalesce(metric, 'ALL') AS metric, coalesce(hostname, 'TOTAL') AS hostname, {R('sum(energy_kwh)', 'energy_kwh')},
  CAST(grouping(metric, hostname) > 0 AS INTEGER) AS is_total
FROM ne WHERE metric IN ({S.q(K.PDU_POWER_METRICS)}) GROUP BY GROUPING SETS ((metric, hostname), ())"""))
def q_energy_with_totals(spark, sf):
    """IRC energies with a total per metric; PDU energies with a grand total."""
    ne = kpi.node_energy(spark, RD(spark, sf), P.START, P.END)
    irc = ST.energy_with_totals(ne.where(F.col("metric").isin(K.IRC_POWER_METRICS)), per_metric=True)
    pdu = ST.energy_with_totals(ne.where(F.col("metric").isin(K.PDU_POWER_METRICS)), per_metric=False)
    out = irc.select(F.lit("irc").alias("part"), "*").unionByName(pdu.select(F.lit("pdu").alias("part"), "*"))
    return rounded(out)


@query("rack_summary", lambda: _node_energy_sql(f"""
, pn AS (SELECT i.rack, i.node_type, n.e FROM inv i LEFT JOIN (SELECT hostname, sum(energy_kwh) AS e FROM ne GROUP BY hostname) n ON n.hostname = i.hostname)
SELECT rack, CASE WHEN count(e) > 0 THEN 'success' ELSE 'no_data' END AS status, count(e) AS nodes_analyzed,
  {R('coalesce(sum(e), 0.0)', 'total_energy_kwh')}, {R('CASE WHEN count(e) > 0 THEN sum(e) / count(e) ELSE 0.0 END', 'avg_energy_per_node')},
  {R("coalesce(sum(e) FILTER (node_type = 'irc'), 0.0)", 'irc_energy_kwh')}, {R("coalesce(sum(e) FILTER (node_type = 'pdu'), 0.0)", 'pdu_energy_kwh')},
  {R("coalesce(sum(e) FILTER (node_type = 'compute'), 0.0)", 'compute_energy_kwh')} FROM pn GROUP BY rack"""))
def q_rack_summary(spark, sf):
    return rounded(kpi.rack_summary(spark, RD(spark, sf), P.START, P.END))


@query("node_result_summary", lambda: _node_energy_sql(f"""
, p AS (SELECT hostname, count(*) AS total_records, avg({S.watts()}) AS avg_power_w, max({S.watts()}) AS max_power_w
        FROM readings WHERE {WIN} GROUP BY hostname),
t AS (SELECT hostname, sum(energy_kwh) AS total_energy_kwh FROM ne GROUP BY hostname)
SELECT coalesce(p.hostname, t.hostname) AS hostname,
  CASE WHEN p.total_records IS NOT NULL THEN 'success' ELSE 'no_data' END AS status,
  p.total_records IS NOT NULL AS has_power_data, t.total_energy_kwh IS NOT NULL AS has_energy_data,
  coalesce(p.total_records, 0) AS total_records, {R('p.avg_power_w', 'avg_power_w')}, {R('p.max_power_w', 'max_power_w')},
  {R('coalesce(t.total_energy_kwh, 0.0)', 'total_energy_kwh')}
FROM p FULL OUTER JOIN t ON p.hostname = t.hostname"""))
def q_node_result_summary(spark, sf):
    return rounded(kpi.node_result_summary(spark, RD(spark, sf), P.START, P.END))


@query("multi_node_energy", lambda: _head(*_all_heads(), S.power_cte("readings", "pw", WIN),
                                          *S.boundary_energy_ctes("pw", SERIES, P.START, P.END)) + f"""
SELECT hostname, metric, {R('sum(energy_kwh)', 'energy_kwh')},
  CASE WHEN hostname IN ({S.q(S.HOSTS)}) THEN 'infra' WHEN starts_with(hostname, 'rpg-') THEN 'h100'
       WHEN starts_with(hostname, 'rpc-') THEN 'zen4' ELSE 'h100' END AS database
FROM b_e GROUP BY hostname, metric""")
def q_multi_node_energy(spark, sf):
    return rounded(kpi.multi_node_energy(RD(spark, sf), P.START, P.END))


def _t16_sql() -> str:
    s_us, e_us = S.us(P.START), S.us(P.END)
    return _head(
        *_all_heads(),
        S.power_cte("compute_readings", "pw0", f"metric IN ({S.q(K.NODE_ENERGY_TABLE_METRICS)}) AND {WIN}"),
        f"""gd AS (SELECT hostname, metric,
              NOT (greatest((min(us) - {s_us}) / 1e6, 0.0) > {K.GUARD_EDGE_GAP_SECONDS}
                   OR greatest(({e_us} - max(us)) / 1e6, 0.0) > {K.GUARD_EDGE_GAP_SECONDS}) AS use_b
            FROM pw0 GROUP BY hostname, metric)""",
        "pw AS (SELECT pw0.*, gd.use_b FROM pw0 JOIN gd USING (hostname, metric))",
        S.pairs_cte("pw", "b_pr", SERIES),
        f"b_tr AS (SELECT {SERIES}, sum((p0 + p1) / 2.0 * ((t1_us - t0_us) / 1e6)) AS trap_j FROM b_pr GROUP BY {SERIES})",
        f"""b_ed AS (SELECT {SERIES}, first(power_w ORDER BY us, event_id) AS first_p, last(power_w ORDER BY us, event_id) AS last_p,
              min(us) AS first_us, max(us) AS last_us, CASE WHEN bool_and(use_b) THEN {s_us} END AS s_us,
              CASE WHEN bool_and(use_b) THEN {e_us} END AS e_us FROM pw GROUP BY {SERIES})""",
        f"""b_e AS (SELECT d.hostname, d.metric, ((CASE WHEN d.s_us IS NOT NULL AND d.first_us > d.s_us THEN d.first_p * (d.first_us - d.s_us) / 1e6 ELSE 0.0 END)
              + coalesce(t.trap_j, 0.0) + (CASE WHEN d.e_us IS NOT NULL AND d.last_us < d.e_us THEN d.last_p * (d.e_us - d.last_us) / 1e6 ELSE 0.0 END))
              / 3600000.0 AS energy_kwh
            FROM b_ed d LEFT JOIN b_tr t ON d.hostname = t.hostname AND d.metric = t.metric AND d.fqdd IS NOT DISTINCT FROM t.fqdd)""",
        "per AS (SELECT hostname, metric, sum(energy_kwh) AS e FROM b_e GROUP BY hostname, metric)",
    ) + f"""
SELECT hostname, metric, {R('e', 'energy_kwh')}, {R('e * 1000.0', 'energy_wh')} FROM per
UNION ALL SELECT hostname, 'TOTAL', {R('sum(e)', 'energy_kwh')}, {R('sum(e) * 1000.0', 'energy_wh')} FROM per GROUP BY hostname"""


@query("metric_energy_table", _t16_sql)
def q_metric_energy_table(spark, sf):
    return rounded(kpi.metric_energy_table(CR(spark, sf), P.START, P.END))
