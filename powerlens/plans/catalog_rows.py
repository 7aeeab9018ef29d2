"""Registered queries: scans, filters, column functions, joins, limits
(A1-A3, B1-B26, C1-C5, C11-C12, S1-S4, U1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import nodes as N
from ..functions import times as TM
from ..functions import units as U
from ..operators import enrich as C
from ..operators import filters as B
from ..sources import dimensions as D
from ..sources import jobs as J
from ..sources import telemetry as T
from . import params as P
from . import sqlparts as S
from .catalog import CR, IR, RD, WIN, _all_heads, _head
from .registry import query, rounded

COLS = "event_id, ts, hostname, fqdd, metric, value, units"
HOUR_ALL = 24 * 30  # look-back covering the whole 30-day data set
HIGH_W = 300.0  # driver readings stay below the reference's 1 kW example threshold


def _scan_sql(src: str, where: str, units: str = "units") -> str:
    return _head(*_all_heads()) + f"\nSELECT event_id, ts, hostname, fqdd, metric, value, {units} AS units FROM {src} WHERE {where}"


@query("scan_readings", lambda: _scan_sql("compute_readings", f"lower(metric) = 'systeminputpower' AND {WIN}"))
def q_scan_readings(spark, sf):
    return B.scan(CR(spark, sf), "SystemInputPower", None, P.START, P.END)


@query("scan_irc_readings", lambda: _scan_sql("infra_readings", f"node_type = 'irc' AND lower(metric) = 'compressorpower' AND {WIN}"))
def q_scan_irc_readings(spark, sf):
    return B.scan(IR(spark, sf).where(F.col("node_type") == "irc"), "CompressorPower", None, P.START, P.END)


@query("scan_pdu_readings", lambda: _scan_sql("infra_readings", f"node_type = 'pdu' AND {WIN}", "'W'"))
def q_scan_pdu_readings(spark, sf):
    return B.scan_pdu(IR(spark, sf), None, P.START, P.END)


@query("filter_host", lambda: _scan_sql("readings", "hostname = 'rpc-91-1'"))
def q_filter_host(spark, sf):
    return B.filter_host(RD(spark, sf), "rpc-91-1").select(*COLS.split(", "))


@query("filter_time", lambda: _scan_sql("readings", f"ts BETWEEN {S.ts('2024-01-10 00:00:00')} AND {S.ts('2024-01-20 00:00:00')}"))
def q_filter_time(spark, sf):
    return B.filter_time(RD(spark, sf), "2024-01-10 00:00:00", "2024-01-20 00:00:00").select(*COLS.split(", "))


@query("oldest_n", lambda: _head(*_all_heads()) + f"\nSELECT {COLS} FROM readings ORDER BY ts, event_id LIMIT 100")
def q_oldest_n(spark, sf):
    return B.filter_time(RD(spark, sf), None, None, limit=100).select(*COLS.split(", "))


def _recent_sql() -> str:
    lo = f"{S.ts(P.NOW)} - INTERVAL {HOUR_ALL} HOUR"
    return _head(*_all_heads()) + f"""
SELECT {COLS} FROM readings WHERE metric = 'SystemInputPower' AND ts >= {lo} AND ts <= {S.ts(P.NOW)}
ORDER BY ts DESC, event_id DESC LIMIT 100"""


@query("recent_n", _recent_sql)
def q_recent_n(spark, sf):
    r = RD(spark, sf).where(F.col("metric") == "SystemInputPower")
    return B.recent_n(r, 100, P.NOW, HOUR_ALL).select(*COLS.split(", "))


def _topn_sql(where: str, desc: bool, n: int) -> str:
    o = "ts DESC, event_id DESC" if desc else "ts, event_id"
    return _head(*_all_heads()) + f"""
SELECT {COLS}, CAST(rn AS INTEGER) AS rn FROM (
  SELECT *, row_number() OVER (PARTITION BY hostname, metric ORDER BY {o}) AS rn FROM readings WHERE {where}) x
WHERE rn <= {n}"""


RECENT_METRICS = ["SystemPowerConsumption", "CPUPower", "PowerConsumption"]


@query("recent_n_per_metric", lambda: _topn_sql(f"metric IN ({S.q(RECENT_METRICS)})", True, 5))
def q_recent_n_per_metric(spark, sf):
    return B.recent_n_per_metric(RD(spark, sf), RECENT_METRICS, 5).select(*COLS.split(", "), "rn")


def _power_ids_sql() -> str:
    return "SELECT metric_id FROM (VALUES " + ", ".join(f"('{d[0]}', '{d[3]}')" for d in D.METRIC_DEFS) + ") v(metric_id, units) WHERE units IN ('mW', 'W', 'kW')"


@query("oldest_n_per_metric", lambda: _topn_sql(f"metric IN ({_power_ids_sql()})", False, 5))
def q_oldest_n_per_metric(spark, sf):
    return B.oldest_n_per_metric(RD(spark, sf), D.metric_defs(spark), None, 5).select(*COLS.split(", "), "rn")


@query("power_to_watts", lambda: _head(*_all_heads()) + f"\nSELECT {COLS}, round({S.watts()}, 6) AS power_w FROM readings")
def q_power_to_watts(spark, sf):
    r = RD(spark, sf)
    return rounded(r.select(*COLS.split(", "), U.to_watts().alias("power_w")))


@query("normalize_power", lambda: _head(*_all_heads()) + f"\nSELECT {COLS}, round({S.watts()}, 6) AS power_w FROM compute_readings")
def q_normalize_power(spark, sf):
    return rounded(U.with_power_w(CR(spark, sf)).select(*COLS.split(", "), "power_w"))


@query("unit_info", lambda: _head(*_all_heads()) + """
SELECT units, CASE WHEN lower(units) = 'mw' THEN 'mW' WHEN lower(units) = 'kw' THEN 'kW' WHEN lower(units) = 'w' THEN 'W'
  ELSE coalesce(units, 'Unknown') END AS original_unit, 'W' AS converted_unit,
  lower(units) IN ('mw', 'kw') AS conversion_applied
FROM (SELECT DISTINCT units FROM readings) u""")
def q_unit_info(spark, sf):
    return RD(spark, sf).select("units").distinct().select("units", *U.unit_info("units"))


@query("convert_temperature", lambda: _head("w AS (SELECT event_id, user_id AS node_id, 20.0 + value / 10.0 AS c FROM events)") + """
SELECT event_id, node_id, round(c, 6) AS temperature_c, round(c * 9 / 5 + 32, 6) AS temperature_f,
  round(c + 273.15, 6) AS temperature_k, round(((c * 9 / 5 + 32) - 32) * 5 / 9, 6) AS roundtrip_c FROM w""")
def q_convert_temperature(spark, sf):
    w = T.wide_metrics(spark, sf)
    c = F.col("temperature_celsius")
    f = U.convert_temperature(c, "C", "F")
    return rounded(w.select(
        "event_id", "node_id", c.alias("temperature_c"), f.alias("temperature_f"),
        U.convert_temperature(c, "C", "K").alias("temperature_k"), U.convert_temperature(f, "F", "C").alias("roundtrip_c"),
    ))


@query("exclude_metrics", lambda: _scan_sql("readings", f"lower(metric) NOT IN ({S.q(K.EXCLUDED_METRICS)})"))
def q_exclude_metrics(spark, sf):
    return B.exclude_metrics(RD(spark, sf)).select(*COLS.split(", "))


@query("flag_derived", lambda: _head(*_all_heads()) + f"""
SELECT metric, lower(metric) IN ({S.q(K.DERIVED_METRICS)}) AS is_derived, lower(metric) IN ({S.q(K.EXCLUDED_METRICS)}) AS is_excluded,
  count(*) AS n_rows FROM readings GROUP BY metric""")
def q_flag_derived(spark, sf):
    return RD(spark, sf).groupBy("metric").agg(F.count(F.lit(1)).alias("n_rows")).select(
        "metric", N.is_derived("metric").alias("is_derived"), N.is_excluded("metric").alias("is_excluded"), "n_rows"
    )


def _classify_sql(h: str = "hostname") -> str:
    infra = S.q(K.IRC_NODES + K.pdu_nodes())
    return (f"CASE WHEN {h} IN ({S.q(K.IRC_NODES)}) THEN 'irc' WHEN {h} IN ({S.q(K.pdu_nodes())}) THEN 'pdu' ELSE 'compute' END AS node_type, "
            f"CASE WHEN {h} IN ({infra}) THEN 'infra' WHEN starts_with({h}, 'rpg-') THEN 'h100' WHEN starts_with({h}, 'rpc-') THEN 'zen4' ELSE 'h100' END AS database, "
            f"CASE WHEN {h} IN ({S.q(K.IRC_NODES)}) THEN 'irc' WHEN {h} IN ({S.q(K.pdu_nodes())}) THEN 'pdu' ELSE 'idrac' END AS schema_name, "
            f"({h} IN ({infra}) OR starts_with({h}, 'rpg-') OR starts_with({h}, 'rpc-')) AS known_host")


@query("classify_node", lambda: _head(*_all_heads()) + f"\nSELECT hostname, {_classify_sql()} FROM (SELECT DISTINCT hostname FROM readings) h")
def q_classify_node(spark, sf):
    h = RD(spark, sf).select("hostname").distinct()
    return h.select("hostname", N.node_type().alias("node_type"), N.node_database().alias("database"),
                    N.node_schema().alias("schema_name"), N.known_host().alias("known_host"))


def _inventory_sql() -> str:
    rows = [f"('{h}', 'irc', {h.split('-')[1]})" for h in K.IRC_NODES]
    rows += [f"('{h}', 'pdu', {h.split('-')[1]})" for h in K.pdu_nodes()]
    rows += [f"('{h}', 'compute', {h.split('-')[1]})" for h in K.compute_nodes()]
    return "(SELECT hostname, node_type, CAST(rack AS INTEGER) AS rack FROM (VALUES " + ", ".join(rows) + ") v(hostname, node_type, rack))"


@query("metrics_for_node", lambda: _head(*_all_heads(), f"inv AS {_inventory_sql()}") + f"""
SELECT b.hostname, node_type, CAST(pos - 1 AS INTEGER) AS position, m AS metric, coalesce(u.n, 0) AS n_readings FROM (
  SELECT hostname, node_type, unnest(l) AS m, generate_subscripts(l, 1) AS pos FROM (
    SELECT hostname, node_type, CASE WHEN node_type = 'irc' THEN [{S.q(K.IRC_POWER_METRICS)}]
      WHEN node_type = 'pdu' THEN [{S.q(K.PDU_POWER_METRICS)}] ELSE [{S.q(B.compute_power_metric_list())}] END AS l FROM inv) a) b
LEFT JOIN (SELECT hostname, metric, count(*) AS n FROM readings GROUP BY hostname, metric) u ON b.hostname = u.hostname AND b.m = u.metric""")
def q_metrics_for_node(spark, sf):
    """Default metrics of every listed host with its number of readings."""
    m = B.metrics_for_node(D.inventory(spark))
    use = RD(spark, sf).groupBy("hostname", "metric").agg(F.count(F.lit(1)).alias("n_readings"))
    return m.join(use, ["hostname", "metric"], "left").select(
        "hostname", "node_type", "position", "metric", F.coalesce("n_readings", F.lit(0)).cast("bigint").alias("n_readings")
    )


@query("assign_rack", lambda: _head(*_all_heads(), f"inv AS {_inventory_sql()}") + """
SELECT h.hostname, i.rack, i.node_type, h.n_rows FROM (SELECT hostname, count(*) AS n_rows FROM readings GROUP BY hostname) h
JOIN inv i ON h.hostname = i.hostname""")
def q_assign_rack(spark, sf):
    h = RD(spark, sf).groupBy("hostname").agg(F.count(F.lit(1)).alias("n_rows"))
    inv = F.broadcast(D.inventory(spark).select("hostname", "rack", "node_type"))
    return h.join(inv, "hostname").select("hostname", "rack", "node_type", "n_rows")


def _category_sql(m: str = "metric") -> str:
    parts = [f"WHEN {m} IN ({S.q(v)}) THEN '{c}'" for c, v in K.METRIC_CATEGORIES.items()]
    return "CASE " + " ".join(parts) + " END"


def _contains_sql(m: str = "metric") -> str:
    u = f"upper({m})"
    sys_hit = " OR ".join(f"contains({u}, '{x.upper()}')" for x in K.METRIC_CATEGORIES["SYSTEM"])
    parts = [f"WHEN contains({u}, 'SYSTEMOUTPUT') THEN 'SystemOutput'", f"WHEN {sys_hit} THEN 'Other'"]
    for c in K.CONTAINS_ORDER:
        hit = " OR ".join(f"contains({u}, '{x.upper()}')" for x in K.METRIC_CATEGORIES[c])
        parts.append(f"WHEN {hit} THEN '{c}'")
    return "CASE " + " ".join(parts) + " ELSE 'Other' END"


@query("metric_category", lambda: _head(*_all_heads()) + f"\nSELECT metric, {_category_sql()} AS category FROM (SELECT DISTINCT metric FROM readings) m")
def q_metric_category(spark, sf):
    return RD(spark, sf).select("metric").distinct().select("metric", N.metric_category().alias("category"))


@query("metric_category_contains", lambda: _head(*_all_heads()) + f"\nSELECT metric, {_contains_sql()} AS category FROM (SELECT DISTINCT metric FROM readings) m")
def q_metric_category_contains(spark, sf):
    return RD(spark, sf).select("metric").distinct().select("metric", N.metric_category_contains().alias("category"))


@query("high_power_events", lambda: _head(*_all_heads()) + f"""
SELECT {COLS}, round({S.watts()}, 6) AS power_w FROM readings WHERE {S.watts()} > {HIGH_W}
ORDER BY {S.watts()} DESC, event_id LIMIT 10""")
def q_high_power_events(spark, sf):
    return rounded(B.high_power_events(RD(spark, sf), HIGH_W).select(*COLS.split(", "), "power_w"))


def _defs_values() -> str:
    rows = ", ".join(f"('{a}', '{b}', '{c}', '{d}', {e}, {f})" for a, b, c, d, e, f in D.METRIC_DEFS)
    return (f"(SELECT metric_id, metric_name, metric_data_type, units, CAST(accuracy AS DOUBLE) AS accuracy, "
            f"CAST(sensing_interval AS INTEGER) AS sensing_interval FROM (VALUES {rows}) "
            f"v(metric_id, metric_name, metric_data_type, units, accuracy, sensing_interval))")


def _defs_sql(units, words, col) -> str:
    conds = []
    if units:
        conds.append(f"units IN ({S.q(units)})")
    conds += [f"{col} LIKE '%{w}%'" for w in words]
    where = " OR ".join(conds) if conds else "TRUE"
    return _head(*_all_heads()) + f"""
SELECT d.*, coalesce(u.n, 0) AS n_readings FROM {_defs_values()} d
LEFT JOIN (SELECT metric, count(*) AS n FROM readings GROUP BY metric) u ON d.metric_id = u.metric WHERE {where}"""


def defs_with_usage(spark, sf):
    """Metric definitions with the number of readings each metric has."""
    use = RD(spark, sf).groupBy(F.col("metric").alias("metric_id")).agg(F.count(F.lit(1)).alias("n_readings"))
    d = D.metric_defs(spark)
    return d.join(use, "metric_id", "left").select(*d.columns, F.coalesce("n_readings", F.lit(0)).cast("bigint").alias("n_readings"))


def _reg_defs(kind: str, infra: bool):
    rules = K.INFRA_DEF_RULES if infra else K.COMPUTE_DEF_RULES
    units, words = rules[kind]
    col = "metric_id" if infra else "metric_name"
    name = f"defs_infra_{kind}" if infra else f"defs_{kind}"

    @query(name, lambda: _defs_sql(units, words, col))
    def q(spark, sf):
        d = defs_with_usage(spark, sf)
        return B.defs_infra(d, kind) if infra else B.defs_compute(d, kind)

    return q


for _k in K.COMPUTE_DEF_RULES:
    _reg_defs(_k, False)
for _k in K.INFRA_DEF_RULES:
    _reg_defs(_k, True)


# ---------------------------------------------------------------- times


WINDOW_FORMATS_SPARK = ["M/d/yy H:mm", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy HH:mm"]


def _window_strings(spark, sf):
    """Window-table time strings in the three shapes of real window files,
    derived from the job table (shape chosen by job id), plus unparsable text
    for jobs whose user is user0."""
    j = J.jobs(spark, sf)
    shape = (F.col("job_id") % 3).cast("int")
    txt = (
        F.when(F.col("job_user") == "user0", F.lit("n/a"))
        .when(shape == 0, F.date_format("start_ts", WINDOW_FORMATS_SPARK[0]))
        .when(shape == 1, F.date_format("start_ts", WINDOW_FORMATS_SPARK[1]))
        .otherwise(F.date_format("start_ts", WINDOW_FORMATS_SPARK[2]))
    )
    return j.select("job_id", txt.alias("start_text"), "start_ts")


@query("parse_window_times", lambda: _head(S.jobs_cte()) + """
SELECT job_id, CASE WHEN job_id % 3 = 1 THEN start_ts ELSE date_trunc('minute', start_ts) END AS start_time
FROM jobs WHERE job_user <> 'user0'""")
def q_parse_window_times(spark, sf):
    w = _window_strings(spark, sf)
    p = w.select("job_id", TM.parse_window_time("start_text").alias("start_time"))
    return p.where(F.col("start_time").isNotNull())


@query("coerce_timestamps", lambda: """
SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN props ELSE CAST(ts AS VARCHAR) END AS TIMESTAMP) AS ts
FROM events WHERE TRY_CAST(CASE WHEN event_type = 'error' THEN props ELSE CAST(ts AS VARCHAR) END AS TIMESTAMP) IS NOT NULL""")
def q_coerce_timestamps(spark, sf):
    e = T._events(spark, sf)
    s = F.when(F.col("event_type") == "error", F.col("props")).otherwise(F.col("ts").cast("string"))
    return e.select("event_id", TM.coerce_timestamp(s).alias("ts")).where(F.col("ts").isNotNull())


@query("epoch_to_ts", lambda: "SELECT o_orderkey, make_timestamp(CAST((1704067200 + (o_orderkey * 7919) % 2500000) AS BIGINT) * 1000000) AS job_start FROM orders")
def q_epoch_to_ts(spark, sf):
    o = T.load(spark, sf, "orders")
    epoch = F.lit(1704067200) + (F.col("o_orderkey") * 7919) % 2500000
    return o.select("o_orderkey", TM.epoch_to_ts(epoch).alias("job_start"))


@query("render_local_time", lambda: _head(S.jobs_cte()) + """
SELECT job_id, start_ts, strftime(l, '%Y-%m-%d %H:%M:%S')
  || printf('%+03d', CAST(trunc((epoch_us(l) - epoch_us(start_ts)) / 3600000000) AS INTEGER)) AS start_local
FROM (SELECT job_id, start_ts, timezone('America/Chicago', start_ts AT TIME ZONE 'UTC') AS l FROM jobs) x""")
def q_render_local_time(spark, sf):
    """Job start rendered in US Central time with its UTC offset."""
    j = J.jobs(spark, sf)
    return j.select("job_id", "start_ts", TM.render_local_time("start_ts", "America/Chicago").alias("start_local"))


@query("explode_nodelist", lambda: _head(S.jobs_cte()) + "\nSELECT job_id, trim(unnest(string_split(nodelist, ','))) AS hostname FROM jobs")
def q_explode_nodelist(spark, sf):
    return N.explode_nodelist(J.jobs(spark, sf).select("job_id", "nodelist")).select("job_id", "hostname")


@query("display_labels", lambda: _head(*_all_heads()) + "\nSELECT metric, coalesce(l, metric) AS label FROM (SELECT DISTINCT metric FROM readings) m LEFT JOIN (VALUES "
       + ", ".join(f"('{k}', '{v}')" for k, v in K.DISPLAY_LABELS.items()) + ") v(k, l) ON m.metric = v.k")
def q_display_labels(spark, sf):
    m = RD(spark, sf).select("metric").distinct()
    lab = F.broadcast(D.display_labels(spark))
    return m.join(lab, "metric", "left").select("metric", F.coalesce("label", "metric").alias("label"))


@query("resolve_nodeid", lambda: _head(*_all_heads()) + f"""
SELECT DISTINCT user_id AS nodeid, {S.compute_host('((user_id * 37) % 118)')} AS hostname FROM events""")
def q_resolve_nodeid(spark, sf):
    return T.nodes_table(spark, sf)


@query("nodeid_recent", lambda: _head(*_all_heads()) + f"""
SELECT event_id, ts, nodeid, hostname, metric, fqdd, round({S.watts()}, 6) AS value FROM compute_readings
WHERE ts >= {S.ts(P.NOW)} - INTERVAL {HOUR_ALL} HOUR AND ts <= {S.ts(P.NOW)} AND metric IN ({_power_ids_sql()})""")
def q_nodeid_recent(spark, sf):
    return rounded(B.nodeid_recent(CR(spark, sf), D.metric_defs(spark), None, P.NOW, HOUR_ALL))


# ---------------------------------------------------------------- joins


def _facts_sql() -> str:
    return """facts AS (SELECT event_id, ts, nodeid, 1 AS source, TRY_CAST(regexp_extract(fqdd, '[0-9]+') AS INTEGER) AS fqdd_id, metric, value
    FROM compute_readings)"""


@query("enrich_compute", lambda: _head(*_all_heads(), _facts_sql(), f"defs AS {_defs_values()}") + f"""
SELECT f.event_id, f.ts, n.hostname, 'iDRAC' AS source, CASE WHEN f.fqdd_id IS NOT NULL THEN concat('dev.', CAST(f.fqdd_id AS VARCHAR)) END AS fqdd,
  f.metric, f.value, d.units
FROM facts f
LEFT JOIN (SELECT DISTINCT user_id AS nodeid, {S.compute_host('((user_id * 37) % 118)')} AS hostname FROM events) n ON f.nodeid = n.nodeid
LEFT JOIN (SELECT lower(metric_id) AS k, first(units ORDER BY metric_id) AS units FROM defs GROUP BY lower(metric_id)) d ON lower(f.metric) = d.k""")
def q_enrich_compute(spark, sf):
    return C.enrich_compute(T.compute_facts(spark, sf), T.nodes_table(spark, sf), T.source_table(spark),
                            T.fqdd_table(spark), D.metric_defs(spark))


@query("enrich_infra", lambda: _head(*_all_heads(), f"defs AS {_defs_values()}") + f"""
SELECT r.event_id, r.ts, n.hostname, r.metric, r.value, d.units
FROM infra_readings r
JOIN (SELECT DISTINCT user_id AS nodeid, ([{S.q(S.HOSTS)}])[CAST(user_id % 30 AS INT) + 1] AS hostname FROM events) n
  ON r.nodeid = n.nodeid
LEFT JOIN (SELECT lower(metric_id) AS k, first(units ORDER BY metric_id) AS units FROM defs GROUP BY lower(metric_id)) d ON lower(r.metric) = d.k""")
def q_enrich_infra(spark, sf):
    facts = IR(spark, sf).select("event_id", "ts", "nodeid", "metric", "value")
    nodes = T._events(spark, sf).select(F.col("user_id").alias("nodeid")).distinct().select(
        "nodeid", F.element_at(F.array(*[F.lit(h) for h in T.INFRA_HOSTS]), (F.col("nodeid") % 30).cast("int") + 1).alias("hostname")
    )
    return C.enrich_infra(facts, nodes, D.metric_defs(spark))


@query("join_units_ci", lambda: _head(*_all_heads(), f"defs AS {_defs_values()}") + """
SELECT r.metric, d.units AS def_units, count(*) AS n_rows FROM readings r
LEFT JOIN (SELECT lower(metric_id) AS k, first(units ORDER BY metric_id) AS units FROM defs GROUP BY lower(metric_id)) d ON lower(r.metric) = d.k
GROUP BY r.metric, d.units""")
def q_join_units_ci(spark, sf):
    d = C.defs_by_lower_id(D.metric_defs(spark)).select("_mkey", F.col("units").alias("def_units"))
    r = RD(spark, sf)
    j = r.join(F.broadcast(d), F.lower(F.col("metric")) == F.col("_mkey"), "left")
    return j.groupBy("metric", "def_units").agg(F.count(F.lit(1)).alias("n_rows"))


def _pt_sql() -> str:
    return """p AS (SELECT user_id AS nodeid, ts, value FROM events WHERE event_type = 'click'),
t AS (SELECT user_id AS nodeid, ts, 20.0 + value / 10.0 AS value FROM events
      WHERE event_type = 'view' OR (event_type = 'click' AND value >= 100.0))"""


@query("power_temp_full_join", lambda: "WITH " + _pt_sql() + f"""
SELECT CAST(p.nodeid AS DOUBLE) AS p_nodeid, p.ts AS p_ts, round(p.value, 6) AS p_value,
  CAST(t.nodeid AS DOUBLE) AS t_nodeid, t.ts AS t_ts, round(t.value, 6) AS t_value
FROM p FULL OUTER JOIN t ON p.nodeid = t.nodeid AND p.ts = t.ts
WHERE p.ts >= {S.ts(P.NOW)} - INTERVAL {HOUR_ALL} HOUR OR t.ts >= {S.ts(P.NOW)} - INTERVAL {HOUR_ALL} HOUR""")
def q_power_temp_full_join(spark, sf):
    from ..operators import stats as E

    p, t = T.power_and_temperature(spark, sf)
    j = E.power_temp_full_join(p, t, P.NOW, HOUR_ALL)
    # node ids are null on the unmatched side of the full join: doubles on both sides
    j = j.withColumn("p_nodeid", F.col("p_nodeid").cast("double")).withColumn("t_nodeid", F.col("t_nodeid").cast("double"))
    return rounded(j)


MERGE_METRICS = ["TotalCPUPower", "TotalMemoryPower", "SystemInputPower"]


@query("merge_series", lambda: _head(*_all_heads(), *[
    f"m{i} AS (SELECT ts, hostname, value AS {m} FROM compute_readings WHERE metric = '{m}')" for i, m in enumerate(MERGE_METRICS)
]) + """
SELECT coalesce(m0.ts, m1.ts, m2.ts) AS ts, coalesce(m0.hostname, m1.hostname, m2.hostname) AS hostname,
  TotalCPUPower, TotalMemoryPower, SystemInputPower
FROM m0 FULL OUTER JOIN m1 ON m0.ts = m1.ts AND m0.hostname = m1.hostname
FULL OUTER JOIN m2 ON coalesce(m0.ts, m1.ts) = m2.ts AND coalesce(m0.hostname, m1.hostname) = m2.hostname""")
def q_merge_series(spark, sf):
    r = CR(spark, sf)
    frames = [r.where(F.col("metric") == m).select("ts", "hostname", F.col("value").alias(m)) for m in MERGE_METRICS]
    return C.merge_series(frames).select("ts", "hostname", *MERGE_METRICS)


@query("missing_metrics", lambda: _head(*_all_heads(), f"inv AS {_inventory_sql()}") + f"""
, e AS (
  SELECT hostname, node_type, metric, strftime(d, '%Y-%m-%d') AS date FROM (
    SELECT hostname, node_type, unnest(CASE WHEN node_type = 'irc' THEN [{S.q(K.IRC_POWER_METRICS)}]
        WHEN node_type = 'pdu' THEN [{S.q(K.PDU_POWER_METRICS)}] ELSE [{S.q(B.compute_power_metric_list())}] END) AS metric FROM inv) x,
    generate_series(CAST(CAST({S.ts(P.START)} AS DATE) AS TIMESTAMP), CAST(CAST({S.ts(P.END)} AS DATE) AS TIMESTAMP), INTERVAL 1 DAY) t(d))
SELECT hostname, node_type, metric, date FROM e
WHERE NOT EXISTS (SELECT 1 FROM readings r WHERE r.hostname = e.hostname AND r.metric = e.metric
                  AND strftime(r.ts, '%Y-%m-%d') = e.date)""")
def q_missing_metrics(spark, sf):
    """Expected metric of a listed host with no reading on a day of the window."""
    days = F.explode(F.sequence(F.to_date(F.lit(P.START).cast("timestamp_ntz")), F.to_date(F.lit(P.END).cast("timestamp_ntz"))))
    expected = B.metrics_for_node(D.inventory(spark)).select("hostname", "node_type", "metric", days.alias("day")).select(
        "hostname", "node_type", "metric", F.date_format("day", "yyyy-MM-dd").alias("date")
    )
    seen = RD(spark, sf).select("hostname", "metric", F.date_format("ts", "yyyy-MM-dd").alias("date"))
    return C.missing_metrics(expected, seen, ("hostname", "metric", "date"))


@query("union_metrics", lambda: _head(*_all_heads()) + """
SELECT event_id, ts, hostname, metric, value, units, fqdd FROM infra_readings WHERE node_type = 'irc'
UNION ALL SELECT event_id, ts, hostname, metric, value, units, NULL AS fqdd FROM infra_readings WHERE node_type = 'pdu'
UNION ALL SELECT event_id, ts, hostname, metric, value, units, fqdd FROM compute_readings""")
def q_union_metrics(spark, sf):
    ir = IR(spark, sf)
    irc = ir.where(F.col("node_type") == "irc").select("event_id", "ts", "hostname", "metric", "value", "units", "fqdd")
    pdu = ir.where(F.col("node_type") == "pdu").select("event_id", "ts", "hostname", "metric", "value", "units")
    comp = CR(spark, sf).select("event_id", "ts", "hostname", "metric", "value", "units", "fqdd")
    return C.union_metrics([irc, pdu, comp]).select("event_id", "ts", "hostname", "metric", "value", "units", "fqdd")
