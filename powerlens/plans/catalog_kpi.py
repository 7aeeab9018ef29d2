"""Registered queries: windows, jobs, racks, components, sinks
(C6-C8, C11, T14, T15, K8-K20, U2, A5-A9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions.units import with_power_w
from ..operators import enrich as C
from ..operators import kpi
from ..operators import windows as W
from ..session import scratch_path
from ..sources import jobs as J
from ..sources import sinks as SK
from . import params as P
from . import sqlparts as S
from .catalog import CR, IR, RD, WIN, _all_heads, _head, _sql_pue_daily, q_pue, q_pue_daily
from .catalog_rows import _category_sql, _contains_sql, _inventory_sql
from .registry import query, rounded

R = lambda c, a=None: S.r(c, a or c)
RCOLS = ["event_id", "ts", "fqdd", "metric", "value", "units"]


def WIN_DF(spark, sf):
    return J.windows(spark, sf)


# ---------------------------------------------------------------- C6, T14, T15


def _win_heads() -> list[str]:
    return _all_heads() + [
        S.jobs_cte(),
        "windows AS (SELECT job_id AS window_id, hostname, start_ts, end_ts FROM jobs)",
        S.power_cte("compute_readings", "pw"),
        """m AS (SELECT w.window_id, w.start_ts, w.end_ts, r.* FROM windows w
              JOIN pw r ON r.hostname = w.hostname AND r.ts BETWEEN w.start_ts AND w.end_ts)""",
    ]


@query("window_readings", lambda: _head(*_win_heads()) + f"""
SELECT w.window_id AS rank, w.start_ts AS query_start_time, w.end_ts AS query_end_time, w.hostname,
  CAST(r.event_id AS DOUBLE) AS event_id, r.ts, r.fqdd, r.metric, r.value, r.units, round(r.power_w, 6) AS power_w
FROM windows w LEFT JOIN pw r ON r.hostname = w.hostname AND r.ts BETWEEN w.start_ts AND w.end_ts""")
def q_window_readings(spark, sf):
    # rounded once for each reading, not for each window that holds it
    out = W.window_readings(rounded(with_power_w(CR(spark, sf))), WIN_DF(spark, sf))
    # event_id is null on the row kept for an empty window; presented as double on
    # both sides so both engines hand the same float column to the comparison
    out = out.withColumn("event_id", F.col("event_id").cast("double"))
    return out.select("rank", "query_start_time", "query_end_time", "hostname", *RCOLS, "power_w")


def _guard_sql(short: bool = False) -> str:
    inner = "" if short else (
        " WHEN (gb > 3600 OR ga > 3600) AND qd > 0 AND dd > qd * 2 THEN false")
    return f"""gd AS (SELECT *, CASE WHEN gb > {K.GUARD_EDGE_GAP_SECONDS} OR ga > {K.GUARD_EDGE_GAP_SECONDS} THEN false{inner} ELSE true END AS use_b
      FROM (SELECT window_id, hostname, metric, fqdd, start_ts, end_ts,
              greatest((min(us) - epoch_us(start_ts)) / 1e6, 0.0) AS gb, greatest((epoch_us(end_ts) - max(us)) / 1e6, 0.0) AS ga,
              (epoch_us(end_ts) - epoch_us(start_ts)) / 1e6 AS qd, (max(us) - min(us)) / 1e6 AS dd
            FROM m GROUP BY window_id, hostname, metric, fqdd, start_ts, end_ts) x)"""


@query("boundary_guard", lambda: _head(*_win_heads(), _guard_sql()) + f"""
SELECT window_id, hostname, metric, fqdd, start_ts, end_ts, {R('gb', 'gap_before_s')}, {R('ga', 'gap_after_s')}, use_b AS use_boundaries FROM gd""")
def q_boundary_guard(spark, sf):
    return rounded(W.boundary_guard(CR(spark, sf), WIN_DF(spark, sf)))


def _window_energy_sql() -> str:
    keys = "window_id, hostname, metric, fqdd"
    return _head(
        *_win_heads(),
        _guard_sql(),
        """mm AS (SELECT m.*, gd.use_b FROM m JOIN gd ON m.window_id = gd.window_id AND m.hostname = gd.hostname
              AND m.metric = gd.metric AND m.fqdd IS NOT DISTINCT FROM gd.fqdd)""",
        S.pairs_cte("mm", "pr", keys),
        f"tr AS (SELECT {keys}, sum((p0 + p1) / 2.0 * ((t1_us - t0_us) / 1e6)) AS trap_j FROM pr GROUP BY {keys})",
        f"""ed AS (SELECT {keys}, start_ts, end_ts, bool_and(use_b) AS use_b, first(power_w ORDER BY us, event_id) AS first_p,
              last(power_w ORDER BY us, event_id) AS last_p, min(us) AS first_us, max(us) AS last_us, count(*) AS n_rows
            FROM mm GROUP BY {keys}, start_ts, end_ts)""",
        f"""we AS (SELECT d.window_id, d.hostname, d.metric, d.fqdd, d.start_ts, d.end_ts, d.use_b, d.n_rows,
              ((CASE WHEN d.use_b AND d.first_us > epoch_us(d.start_ts) THEN d.first_p * (d.first_us - epoch_us(d.start_ts)) / 1e6 ELSE 0.0 END)
               + coalesce(t.trap_j, 0.0)
               + (CASE WHEN d.use_b AND d.last_us < epoch_us(d.end_ts) THEN d.last_p * (epoch_us(d.end_ts) - d.last_us) / 1e6 ELSE 0.0 END)) / 3600000.0 AS e
            FROM ed d LEFT JOIN tr t ON d.window_id = t.window_id AND d.hostname = t.hostname AND d.metric = t.metric
              AND d.fqdd IS NOT DISTINCT FROM t.fqdd)""",
    )


@query("window_energy", lambda: _window_energy_sql() + f"""
SELECT window_id, hostname, metric, fqdd, start_ts, end_ts, use_b AS use_boundaries, {R('e', 'energy_kwh')}, n_rows FROM we""")
def q_window_energy(spark, sf):
    return rounded(W.window_energy(CR(spark, sf), WIN_DF(spark, sf)))


@query("window_energy_totals", lambda: _window_energy_sql() + f"""
SELECT metric, {R('sum(e)', 'total_kwh')}, {R('avg(e)', 'mean_kwh')}, {R('min(e)', 'min_kwh')}, {R('max(e)', 'max_kwh')},
  count(*) AS n_windows FROM we GROUP BY metric""")
def q_window_energy_totals(spark, sf):
    return rounded(W.window_energy_totals(W.window_energy(CR(spark, sf), WIN_DF(spark, sf))))


# ---------------------------------------------------------------- jobs


def _job_heads() -> list[str]:
    return _all_heads() + [
        S.jobs_cte(),
        f"""jh AS (SELECT job_id, job_user, hostname, start_ts, end_ts,
              unnest(CASE WHEN starts_with(hostname, 'rpg') THEN [{S.q(K.H100_METRICS)}]
                          ELSE [{S.q(K.ZEN4_METRICS)}] END) AS metric
            FROM (SELECT job_id, job_user, start_ts, end_ts, trim(unnest(string_split(nodelist, ','))) AS hostname FROM jobs) x
            WHERE starts_with(hostname, 'rpg') OR starts_with(hostname, 'rpc'))""",
        S.power_cte("compute_readings", "pw"),
        """jr AS (SELECT j.job_id, j.job_user, j.start_ts, j.end_ts, r.* FROM jh j
              JOIN pw r ON r.hostname = j.hostname AND r.metric = j.metric AND r.ts BETWEEN j.start_ts AND j.end_ts)""",
        """ser AS (SELECT job_id, hostname, metric, CASE WHEN metric = 'PowerConsumption' THEN fqdd END AS dev, start_ts, end_ts,
              ts, us, sum(power_w) AS power_w, min(event_id) AS event_id FROM jr GROUP BY ALL)""",
        S.pairs_cte("ser", "pr", "job_id, hostname, metric, dev"),
        "tr AS (SELECT job_id, hostname, metric, dev, sum((p0 + p1) / 2.0 * ((t1_us - t0_us) / 1e6)) AS trap_j FROM pr GROUP BY ALL)",
        """ed AS (SELECT job_id, hostname, metric, dev, start_ts, end_ts, first(power_w ORDER BY us, event_id) AS first_p,
              last(power_w ORDER BY us, event_id) AS last_p, min(us) AS first_us, max(us) AS last_us FROM ser
            GROUP BY job_id, hostname, metric, dev, start_ts, end_ts)""",
        """det AS (SELECT d.job_id, d.hostname, d.metric, d.dev AS fqdd,
              ((CASE WHEN d.first_us > epoch_us(d.start_ts) THEN d.first_p * (d.first_us - epoch_us(d.start_ts)) / 1e6 ELSE 0.0 END)
               + coalesce(t.trap_j, 0.0)
               + (CASE WHEN d.last_us < epoch_us(d.end_ts) THEN d.last_p * (epoch_us(d.end_ts) - d.last_us) / 1e6 ELSE 0.0 END)) / 3600000.0 AS e
            FROM ed d LEFT JOIN tr t ON d.job_id = t.job_id AND d.hostname = t.hostname AND d.metric = t.metric
              AND d.dev IS NOT DISTINCT FROM t.dev)""",
        "je AS (SELECT job_id, metric, sum(e) AS e FROM det GROUP BY job_id, metric)",
        """h1 AS (SELECT job_id, max(CAST(starts_with(trim(h), 'rpg') AS INTEGER)) AS is_h100
            FROM (SELECT job_id, unnest(string_split(nodelist, ',')) AS h FROM jobs) x GROUP BY job_id)""",
        f"""pv AS (SELECT je.job_id, {', '.join(f"coalesce(sum(CASE WHEN metric = '{m}' THEN e END), 0.0) AS {m}" for m in K.H100_METRICS)},
              max(h1.is_h100) AS is_h100 FROM je LEFT JOIN h1 ON je.job_id = h1.job_id GROUP BY je.job_id)""",
        """sg0 AS (SELECT job_id, is_h100, SystemInputPower AS inp, TotalCPUPower AS cpu, TotalMemoryPower AS mem, TotalStoragePower AS sto,
              TotalFanPower AS fan, greatest(0.0, SystemInputPower - SystemOutputPower) AS psu,
              CASE WHEN is_h100 = 1 THEN PowerConsumption ELSE 0.0 END AS gpu FROM pv)""",
        """sg AS (SELECT job_id, seg, v FROM (
              SELECT job_id, inp, [('CPU', cpu), ('Memory', mem), ('Storage', sto), ('Fan', fan), ('PSU loss', psu),
                ('Others', greatest(0.0, inp - (cpu + mem + sto + fan + psu + gpu))), ('GPU', gpu)] AS l FROM sg0) a,
              LATERAL (SELECT unnest(l) AS t) b(t), LATERAL (SELECT t[1] AS seg, t[2] AS v) c WHERE inp > 0 AND v > 0)""",
    ]


@query("job_readings", lambda: _head(*_job_heads()) + """
SELECT job_id, job_user, start_ts, end_ts, event_id, ts, hostname, fqdd, metric, value, units FROM jr""")
def q_job_readings(spark, sf):
    r = W.job_readings(CR(spark, sf), J.jobs(spark, sf))
    return r.select("job_id", "job_user", "start_ts", "end_ts", "event_id", "ts", "hostname", "fqdd", "metric", "value", "units")


@query("job_energy", lambda: _head(*_job_heads()) + f"\nSELECT job_id, metric, {R('e', 'energy_kwh')} FROM je")
def q_job_energy(spark, sf):
    return rounded(W.job_energy(CR(spark, sf), J.jobs(spark, sf)).select("job_id", "metric", "energy_kwh"))


@query("job_segments", lambda: _head(*_job_heads()) + f"\nSELECT job_id, seg AS segment, {R('v', 'energy_kwh')} FROM sg")
def q_job_segments(spark, sf):
    return rounded(W.job_segments(CR(spark, sf), J.jobs(spark, sf)))


def _summary_sql() -> str:
    return _head(*_job_heads()) + f""",
summ AS (
  SELECT job_id, concat('Energy_', metric) AS label, e AS energy_kwh, CAST(NULL AS VARCHAR) AS fqdd FROM je WHERE metric IN ({S.q(K.ZEN4_METRICS)})
  UNION ALL SELECT je.job_id, 'Energy_GPU_total', e, NULL FROM je JOIN h1 ON je.job_id = h1.job_id WHERE metric = 'PowerConsumption' AND is_h100 = 1
  UNION ALL SELECT job_id, CASE WHEN seg = 'PSU loss' THEN 'Energy_PSU_loss' ELSE 'Energy_Others' END, v, NULL FROM sg WHERE seg IN ('PSU loss', 'Others')
  UNION ALL SELECT job_id, concat('Energy_GPU_fqdd_', fqdd), sum(e), fqdd FROM det WHERE metric = 'PowerConsumption' AND fqdd IS NOT NULL GROUP BY job_id, fqdd)"""


@query("job_energy_summary", lambda: _summary_sql() + f"\nSELECT job_id, label, {R('energy_kwh')}, fqdd FROM summ")
def q_job_energy_summary(spark, sf):
    return rounded(W.job_energy_summary(CR(spark, sf), J.jobs(spark, sf)))


@query("append_summary_rows", lambda: _summary_sql() + f"""
SELECT job_id, ts, hostname, metric, fqdd, value, units, CAST(NULL AS VARCHAR) AS label, CAST(NULL AS DOUBLE) AS energy_kwh FROM jr
UNION ALL SELECT job_id, NULL, NULL, NULL, fqdd, NULL, NULL, label, {R('energy_kwh')} FROM summ""")
def q_append_summary_rows(spark, sf):
    """Raw job rows and summary rows in one frame (typed nulls)."""
    rd, jb = CR(spark, sf), J.jobs(spark, sf)
    # raw values are rounded once for each reading, not for each job that holds it
    raw = W.job_readings(rounded(rd), jb).select("job_id", "ts", "hostname", "metric", "fqdd", "value", "units")
    summ = rounded(W.job_energy_summary(rd, jb))
    out = raw.unionByName(summ, allowMissingColumns=True)
    return out.select("job_id", "ts", "hostname", "metric", "fqdd", "value", "units", "label", "energy_kwh")


# ---------------------------------------------------------------- racks


def _rack_info_sql() -> str:
    rows = ", ".join(f"({r}, {('NULL' if r not in K.RACK_TO_IRC else repr(K.RACK_TO_IRC[r]))}, '{t}', {kw})"
                     for r, (t, kw) in K.RACK_ESTIMATES.items())
    return f"(SELECT CAST(rack AS INTEGER) AS rack, irc_node, analysis_type, CAST(kw AS DOUBLE) AS estimated_kw FROM (VALUES {rows}) v(rack, irc_node, analysis_type, kw))"


def _rack_validation_sql() -> str:
    hours = f"(({S.us(P.END)} - {S.us(P.START)}) / 3.6e9)"
    return _head(
        *_all_heads(),
        f"inv AS {_inventory_sql()}",
        f"ri AS {_rack_info_sql()}",
        S.power_cte("readings", "pw", f"lower(metric) IN ('systeminputpower', 'pdu') AND {WIN}"),
        *S.boundary_energy_ctes("pw", "hostname, metric, fqdd", P.START, P.END),
        """per AS (SELECT i.rack,
              sum(CASE WHEN i.node_type = 'compute' THEN e.energy_kwh ELSE 0.0 END) AS c,
              sum(CASE WHEN i.node_type = 'pdu' THEN e.energy_kwh ELSE 0.0 END) AS p,
              count(DISTINCT CASE WHEN i.node_type = 'compute' THEN e.hostname END) AS cn,
              count(DISTINCT CASE WHEN i.node_type = 'pdu' THEN e.hostname END) AS pn
            FROM b_e e JOIN inv i ON e.hostname = i.hostname GROUP BY i.rack)""",
        f"""v AS (SELECT ri.rack, ri.analysis_type, coalesce(cn, 0) AS compute_nodes, coalesce(pn, 0) AS pdu_nodes,
              coalesce(c, 0.0) AS c, coalesce(p, 0.0) AS p, ri.estimated_kw * {hours} AS x
            FROM ri LEFT JOIN per ON ri.rack = per.rack)""",
        """vv AS (SELECT *, c - p AS raw, c + x - p AS adj,
              CASE WHEN p > 0 THEN (c - p) / p * 100.0 END AS raw_pct, CASE WHEN p > 0 THEN (c + x - p) / p * 100.0 END AS adj_pct FROM v)""",
        """vz AS (SELECT *, CASE WHEN analysis_type = 'accurate' THEN raw_pct ELSE adj_pct END AS used FROM vv)""",
    )


def _verdict_sql(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL THEN NULL WHEN abs({c}) < 10.0 THEN 'GOOD' WHEN abs({c}) < 20.0 THEN 'ACCEPTABLE' "
            f"ELSE 'NEEDS INVESTIGATION' END")


@query("rack_validation", lambda: _rack_validation_sql() + f"""
SELECT rack, analysis_type, compute_nodes, pdu_nodes, {R('c', 'compute_kwh')}, {R('p', 'pdu_kwh')}, {R('x', 'estimated_kwh')},
  {R('raw', 'raw_difference_kwh')}, {R('raw_pct', 'raw_difference_pct')}, {R('adj', 'adjusted_difference_kwh')},
  {R('adj_pct', 'adjusted_difference_pct')}, {_verdict_sql('used')} AS verdict FROM vz""")
def q_rack_validation(spark, sf):
    return rounded(kpi.rack_validation(spark, RD(spark, sf), P.START, P.END))


@query("rack_verdict", lambda: _rack_validation_sql() + f"""
SELECT rack, analysis_type, {R('used', 'difference_pct')}, {_verdict_sql('used')} AS verdict FROM vz""")
def q_rack_verdict(spark, sf):
    v = kpi.rack_validation(spark, RD(spark, sf), P.START, P.END)
    used = F.when(F.col("analysis_type") == "accurate", F.col("raw_difference_pct")).otherwise(F.col("adjusted_difference_pct"))
    return rounded(v.select("rack", "analysis_type", used.alias("difference_pct"), kpi.rack_verdict(used).alias("verdict")))


@query("rack_power_comparison", lambda: _rack_validation_sql() + f"""
, rows AS (
  SELECT rack, 'SystemInputPower (Compute Nodes)' AS power_source, c AS t, c / p * 100.0 AS pct FROM vz WHERE c > 0 AND p > 0
  UNION ALL SELECT rack, 'Estimated Switch/Unmeasured Components', x, x / p * 100.0 FROM vz WHERE c > 0 AND p > 0 AND x > 0
  UNION ALL SELECT rack, 'Total Compute + Estimated', c + x, (c + x) / p * 100.0 FROM vz WHERE c > 0 AND p > 0 AND x > 0
  UNION ALL SELECT rack, 'PDU Nodes', p, 100.0 FROM vz WHERE c > 0 AND p > 0)
SELECT rack, power_source, {R('t', 'total_energy_kwh')}, {R('pct', 'percentage_of_pdu')} FROM rows""")
def q_rack_power_comparison(spark, sf):
    return rounded(kpi.rack_power_comparison(spark, RD(spark, sf), P.START, P.END))


@query("estimated_energy", lambda: _head(S.infra_cte(), f"ri AS {_rack_info_sql()}") + f"""
, sp AS (SELECT CAST(split_part(hostname, '-', 2) AS INTEGER) AS rack, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 AS h
         FROM infra_readings WHERE node_type = 'pdu' GROUP BY 1)
SELECT ri.rack, analysis_type, {R('estimated_kw')}, {R('h', 'hours')}, {R('estimated_kw * h', 'estimated_kwh')} FROM ri JOIN sp ON ri.rack = sp.rack""")
def q_estimated_energy(spark, sf):
    return rounded(kpi.estimated_energy_observed(spark, IR(spark, sf)))


@query("spine_join", lambda: _head(
    S.infra_cte(),
    S.power_cte("infra_readings", "pw", f"node_type = 'pdu' AND {WIN}"),
    S.dedupe_cte("pw", "dd", "hostname, metric, fqdd"),
    S.pairs_cte("dd", "pr", "hostname, metric, fqdd"),
    f"kept AS (SELECT * FROM pr WHERE t1_us > t0_us AND (t1_us - t0_us) / 1e6 <= {P.MAX_GAP})",
    S.pieces_cte("kept", "pc", "hostname, metric, fqdd"),
    "d AS (SELECT CAST(split_part(hostname, '-', 2) AS INTEGER) AS rack, date, sum(piece_j) / 3600000.0 AS e FROM pc GROUP BY 1, 2)",
    f"racks AS (SELECT DISTINCT rack FROM {_inventory_sql()} i)",
) + f"""
SELECT s.date, r.rack, {R('coalesce(d.e, 0.0)', 'pdu_energy_kwh')} FROM racks r CROSS JOIN {S.spine()} s
LEFT JOIN d ON d.rack = r.rack AND d.date = s.date""")
def q_spine_join(spark, sf):
    """Full date x rack grid of daily PDU energy, missing cells 0.0."""
    from ..functions.nodes import rack_of
    from ..operators import energy as E
    from ..sources import dimensions as D

    pdu = IR(spark, sf).where(F.col("node_type") == "pdu")
    daily = E.energy_daily(pdu, list(E.SERIES), P.MAX_GAP, P.START, P.END)
    per = daily.groupBy(rack_of("hostname").alias("rack"), "date").agg(F.sum("energy_kwh").alias("e"))
    days = F.explode(F.sequence(F.to_date(F.lit(P.START).cast("timestamp_ntz")), F.to_date(F.lit(P.END).cast("timestamp_ntz"))))
    grid = D.inventory(spark).select("rack").distinct().select("rack", days.alias("day")).select(
        F.date_format("day", "yyyy-MM-dd").alias("date"), "rack"
    )
    out = grid.join(per, ["rack", "date"], "left")
    return rounded(out.select("date", "rack", F.coalesce("e", F.lit(0.0)).alias("pdu_energy_kwh")))


# ---------------------------------------------------------------- components


def _comp_heads() -> list[str]:
    return _all_heads() + [
        S.power_cte("compute_readings", "pw", WIN),
        *S.per_fqdd_ctes("pw", P.START, P.END),
        f"me AS (SELECT hostname, metric, energy_kwh, {_category_sql()} AS category FROM f_all WHERE fqdd = 'TOTAL')",
        """ct AS (SELECT hostname,
              coalesce(max(CASE WHEN metric = 'TotalCPUPower' THEN energy_kwh END), sum(CASE WHEN category = 'CPU' THEN energy_kwh END), 0.0) AS cpu,
              coalesce(max(CASE WHEN metric = 'TotalMemoryPower' THEN energy_kwh END), sum(CASE WHEN category = 'MEMORY' THEN energy_kwh END), 0.0) AS memory,
              coalesce(max(CASE WHEN metric = 'TotalFanPower' THEN energy_kwh END), sum(CASE WHEN category = 'FAN' THEN energy_kwh END), 0.0) AS fan,
              coalesce(max(CASE WHEN metric = 'TotalStoragePower' THEN energy_kwh END), sum(CASE WHEN category = 'STORAGE' THEN energy_kwh END), 0.0) AS storage,
              coalesce(max(CASE WHEN metric = 'SystemOutputPower' THEN energy_kwh END), 0.0) AS system_output,
              CASE WHEN NOT starts_with(hostname, 'rpc-') THEN coalesce(sum(CASE WHEN metric = 'PowerConsumption' THEN energy_kwh END), 0.0) END AS gpu_total
            FROM me GROUP BY hostname)""",
    ]


@query("component_breakdown", lambda: _head(*_comp_heads()) + f"""
, rows AS (
  SELECT hostname, 'CPU' AS component, cpu AS e, 0 AS order_idx FROM ct
  UNION ALL SELECT hostname, 'MEMORY', memory, 1 FROM ct
  UNION ALL SELECT hostname, 'GPU Total', gpu_total, 3 FROM ct WHERE gpu_total IS NOT NULL
  UNION ALL SELECT hostname, 'FAN', fan, 4 FROM ct
  UNION ALL SELECT hostname, 'STORAGE', storage, 5 FROM ct
  UNION ALL SELECT hostname, 'SystemOutputPower', system_output, 6 FROM ct
  UNION ALL SELECT hostname, concat('GPU (fqdd=', string_split(fqdd, '_')[-1], ')'), energy_kwh, 2 FROM f_all
    WHERE metric = 'PowerConsumption' AND fqdd <> 'TOTAL' AND NOT starts_with(hostname, 'rpc-'))
SELECT hostname, component, {R('e', 'energy_kwh')}, CAST(order_idx AS INTEGER) AS order_idx FROM rows""")
def q_component_breakdown(spark, sf):
    return rounded(kpi.component_breakdown(CR(spark, sf), P.START, P.END))


@query("component_share", lambda: _head(*_comp_heads()) + f"""
, rows AS (
  SELECT hostname, 'GPU Total' AS component, gpu_total AS e FROM ct WHERE gpu_total IS NOT NULL UNION ALL SELECT hostname, 'CPU', cpu FROM ct
  UNION ALL SELECT hostname, 'MEMORY', memory FROM ct UNION ALL SELECT hostname, 'FAN', fan FROM ct
  UNION ALL SELECT hostname, 'STORAGE', storage FROM ct
  UNION ALL SELECT hostname, 'Other', greatest(system_output - (cpu + coalesce(gpu_total, 0.0) + memory + fan + storage), 0.0) FROM ct)
SELECT hostname, component, {R('e', 'energy_kwh')} FROM rows""")
def q_component_share(spark, sf):
    return rounded(kpi.component_share(CR(spark, sf), P.START, P.END))


@query("components_vs_system", lambda: _head(*_comp_heads()) + f"""
, v AS (SELECT hostname, system_output AS o, cpu + memory + coalesce(gpu_total, 0.0) + fan + storage AS t FROM ct)
SELECT hostname, {R('o', 'energy1_kwh')}, {R('t', 'energy2_kwh')}, {R('abs(o - t)', 'difference_kwh')},
  {R('abs(o - t) / o * 100.0', 'difference_percent')},
  CASE WHEN abs(o - t) / o * 100.0 < {K.SYSTEM_MATCH_PCT} THEN 'MATCHES' ELSE 'MISMATCH' END AS relationship
FROM v WHERE o > 0 AND t > 0""")
def q_components_vs_system(spark, sf):
    return rounded(kpi.components_vs_system(CR(spark, sf), P.START, P.END))


@query("cpu_fqdd_share", lambda: _head(*_all_heads(), S.power_cte("compute_readings", "pw",
       f"metric IN ({S.q(K.METRIC_CATEGORIES['CPU'])}) AND fqdd IS NOT NULL AND {WIN}"),
       *S.per_fqdd_ctes("pw", P.START, P.END)) + f"\nSELECT hostname, metric, fqdd, {R('energy_kwh')} FROM f_all WHERE fqdd <> 'TOTAL'")
def q_cpu_fqdd_share(spark, sf):
    return rounded(kpi.cpu_fqdd_share(CR(spark, sf), P.START, P.END))


@query("component_share_contains", lambda: _head(*_comp_heads()) + f"""
, g AS (SELECT hostname, energy_kwh AS e, {_contains_sql()} AS grp FROM me
        WHERE energy_kwh > 0 AND lower(metric) NOT IN ({S.q(K.EXCLUDED_METRICS)})),
p AS (SELECT hostname, {', '.join(f"coalesce(sum(CASE WHEN grp = '{c}' THEN e END), 0.0) AS {c}" for c in K.CONTAINS_ORDER)},
        coalesce(sum(CASE WHEN grp = 'Other' THEN e END), 0.0) AS oth,
        coalesce(max(CASE WHEN grp = 'SystemOutput' THEN e END), 0.0) AS o FROM g GROUP BY hostname),
rows AS ({' UNION ALL '.join(f"SELECT hostname, '{c}' AS component, {c} AS e FROM p" for c in K.CONTAINS_ORDER)}
  UNION ALL SELECT hostname, 'Other', CASE WHEN o > 0 THEN greatest(o - ({' + '.join(K.CONTAINS_ORDER)}), 0.0) ELSE oth END FROM p)
SELECT hostname, component, {R('e', 'energy_kwh')} FROM rows WHERE e > 0""")
def q_component_share_contains(spark, sf):
    return rounded(kpi.component_share_contains(CR(spark, sf), P.START, P.END))


def _pairs_sql(where: str) -> str:
    return _head(*_comp_heads()) + f"""
, x AS (SELECT * FROM me WHERE {where})
SELECT a.hostname, a.category, a.metric AS metric_1, b.metric AS metric_2, a.energy_kwh AS e1, b.energy_kwh AS e2
FROM x a JOIN x b ON a.hostname = b.hostname AND a.category = b.category AND a.metric < b.metric"""


@query("metric_pairs", lambda: _pairs_sql("category IS NOT NULL").replace(
    "a.energy_kwh AS e1, b.energy_kwh AS e2", "round(a.energy_kwh, 6) AS energy_1, round(b.energy_kwh, 6) AS energy_2"))
def q_metric_pairs(spark, sf):
    me = kpi.metric_energy(CR(spark, sf), P.START, P.END).where(F.col("category").isNotNull())
    return rounded(C.metric_pairs(me, "category"))


@query("metric_relationships", lambda: "SELECT hostname, category, metric_1, metric_2, " + f"""
  {R('e1', 'energy1_kwh')}, {R('e2', 'energy2_kwh')}, {R('abs(e1 - e2)', 'difference_kwh')},
  {R('abs(e1 - e2) / greatest(e1, e2) * 100.0', 'difference_percent')},
  CASE WHEN abs(e1 - e2) / greatest(e1, e2) * 100.0 < {K.RELATION_IDENTICAL_PCT} THEN 'IDENTICAL' ELSE 'DIFFERENT' END AS relationship
FROM (""" + _pairs_sql("category IN ('CPU', 'MEMORY', 'SYSTEM') AND energy_kwh > 0") + ") q")
def q_metric_relationships(spark, sf):
    return rounded(kpi.metric_relationships(CR(spark, sf), P.START, P.END))


# ---------------------------------------------------------------- sinks


def _scratch(spark, name: str) -> str:
    import uuid

    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:8]}")


@query("read_window_table", lambda: _head(S.jobs_cte()) + """
SELECT job_id AS window_id, hostname, date_trunc('minute', start_ts) AS start_ts, date_trunc('minute', end_ts) AS end_ts FROM jobs""")
def q_read_window_table(spark, sf):
    """A5: the job windows written as a CSV window table (M/d/yy H:mm times,
    as exported by spreadsheet tools), then read back and parsed."""
    j = J.windows(spark, sf)
    csv = j.select(
        F.col("window_id").alias("Rank"),
        F.col("hostname").alias("Hostname"),
        F.date_format("start_ts", "M/d/yy H:mm").alias("Start time"),
        F.date_format("end_ts", "M/d/yy H:mm").alias("End time"),
    )
    path = _scratch(spark, "windows-csv")
    SK.write_csv(csv, path)
    return SK.read_window_table(spark, path)


@query("write_csv", _sql_pue_daily)
def q_write_csv(spark, sf):
    """Daily PUE written as CSV and read back."""
    path = _scratch(spark, "pue-daily-csv")
    SK.write_csv(q_pue_daily(spark, sf), path)
    return spark.read.option("header", True).schema("date string, irc_energy_kwh double, pdu_energy_kwh double, pue double").csv(path)


@query("write_json", lambda: __import__("powerlens.plans.catalog", fromlist=["x"])._sql_pue())
def q_write_json(spark, sf):
    """Cluster PUE written as JSON lines and read back."""
    df = q_pue(spark, sf)
    path = _scratch(spark, "pue-json")
    SK.write_json(df, path)
    return spark.read.schema(df.schema).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path).select(*df.columns)


@query("write_report", lambda: f"""WITH daily AS ({_sql_pue_daily()}), {S.infra_cte()},
r AS (SELECT 'pue_daily' AS dataset, date AS key, pdu_energy_kwh AS value FROM daily
      UNION ALL SELECT 'pdu_readings', CAST(event_id AS VARCHAR), value FROM infra_readings WHERE node_type = 'pdu')
SELECT dataset, count(*) OVER (PARTITION BY dataset) AS rows_written, key, {R('value')} FROM r""")
def q_write_report(spark, sf):
    """Report of three datasets (one empty, skipped) written as one Parquet
    directory each; the count of the writing job and every row's key and value read back."""
    from functools import reduce

    from ..operators import stats as ST
    ir = IR(spark, sf)
    sets = {
        "pue_daily": rounded(kpi.pue_daily(spark, ir, P.START, P.END, P.MAX_GAP)),
        "pdu_readings": ir.where(F.col("node_type") == "pdu"),
        "unit_mismatches": ST.check_metric_units(ir),
    }
    shown = {"pue_daily": ("date", "pdu_energy_kwh"), "pdu_readings": ("event_id", "value"), "unit_mismatches": ("metric", "hostname")}
    counts: dict[str, int] = {}
    written = SK.write_report(sets, _scratch(spark, "report"), counts=counts)
    parts = [
        spark.read.parquet(path).select(
            F.lit(name).alias("dataset"), F.lit(counts[name]).cast("bigint").alias("rows_written"),
            F.col(shown[name][0]).cast("string").alias("key"), F.col(shown[name][1]).try_cast("double").alias("value"))
        for name, path in written]
    return rounded(reduce(lambda a, b: a.unionByName(b), parts))


@query("write_job_outputs", lambda: _summary_sql() + f"""
SELECT 'raw' AS dataset, job_id, job_user, strftime(start_ts, '%Y-%m-%d') AS job_day, metric AS item, fqdd,
  CAST(event_id AS DOUBLE) AS event_id, {R('value')} FROM jr
UNION ALL SELECT 'summary', s.job_id, j.job_user, strftime(j.start_ts, '%Y-%m-%d'), s.label, s.fqdd, NULL, {R('s.energy_kwh', 'value')}
FROM summ s JOIN jobs j ON s.job_id = j.job_id""")
def q_write_job_outputs(spark, sf):
    """Two batches of jobs that share ten days, so the second replaces those; raw rows and summaries read back."""
    rd, jb = CR(spark, sf), J.jobs(spark, sf)
    day = F.to_date("start_ts")
    path = _scratch(spark, "jobs")
    for batch in (jb.where(day <= "2024-01-20"), jb.where(day >= "2024-01-11")):
        raw = W.job_readings(rd, batch).withColumn("job_day", day)
        users = batch.select("job_id", "job_user", day.alias("job_day"))
        SK.write_job_outputs(raw, W.job_energy_summary(rd, batch).join(users, "job_id"), path)
    null = F.lit(None).cast("bigint")
    keys = ["job_id", "job_user", F.date_format("job_day", "yyyy-MM-dd").alias("job_day")]
    raw = SK.read_job_outputs(spark, path, "raw").select(
        F.lit("raw").alias("dataset"), *keys, F.col("metric").alias("item"), "fqdd", "event_id", "value")
    summary = SK.read_job_outputs(spark, path, "summary").select(
        F.lit("summary").alias("dataset"), *keys, F.col("label").alias("item"), "fqdd", null.alias("event_id"), F.col("energy_kwh").alias("value"))
    return rounded(raw.unionByName(summary)).withColumn("event_id", F.col("event_id").cast("double"))  # ids are whole: not rounded
