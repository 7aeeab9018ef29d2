"""The registered queries: one per operator of the inventory.

Each takes ``(spark, sf_dir)``, reads the driver tables through the adapters
in ``powerlens.sources`` and returns a DataFrame whose columns match the
DuckDB oracle of the same name (``oracle_sql``).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import energy as E
from ..operators import kpi
from ..sources import telemetry as T
from . import params as P
from . import sqlparts as S
from .registry import query, rounded

INFRA_W = f"{S.ts(P.START)} <= ts AND ts <= {S.ts(P.END)}"


def _head(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes)


# ---------------------------------------------------------------- K4 pue_daily


def _pue_inputs_sql() -> str:
    irc = f"node_type = 'irc' AND metric IN ({S.q(K.IRC_POWER_METRICS)}) AND hostname IN ({S.q(K.IRC_NODES)})"
    pdu = f"node_type = 'pdu' AND metric IN ({S.q(K.PDU_POWER_METRICS)}) AND hostname IN ({S.q(K.pdu_nodes())})"
    return f"(({irc}) OR ({pdu}))"


def _sql_pue_daily() -> str:
    keys = "hostname, metric, fqdd, node_type"
    return _head(
        S.infra_cte(),
        S.power_cte("infra_readings", "pw", f"{_pue_inputs_sql()} AND {INFRA_W}"),
        S.dedupe_cte("pw", "dd", keys),
        S.pairs_cte("dd", "pr", keys),
        f"kept AS (SELECT * FROM pr WHERE t1_us > t0_us AND (t1_us - t0_us) / 1e6 <= {P.MAX_GAP})",
        S.pieces_cte("kept", "pc", keys),
        """perday AS (SELECT date,
            sum(CASE WHEN node_type = 'irc' THEN piece_j ELSE 0.0 END) / 3600000.0 AS irc,
            sum(CASE WHEN node_type = 'pdu' THEN piece_j ELSE 0.0 END) / 3600000.0 AS pdu
          FROM pc GROUP BY date)""",
    ) + f"""
SELECT s.date, {S.r('coalesce(irc, 0.0)', 'irc_energy_kwh')}, {S.r('coalesce(pdu, 0.0)', 'pdu_energy_kwh')},
  {S.r(S.pue_expr('coalesce(irc, 0.0)', 'coalesce(pdu, 0.0)'), 'pue')}
FROM {S.spine()} s LEFT JOIN perday p ON s.date = p.date"""


@query("pue_daily", _sql_pue_daily)
def q_pue_daily(spark, sf_dir):
    r = T.infra_readings(spark, sf_dir)
    return rounded(kpi.pue_daily(spark, r, P.START, P.END, P.MAX_GAP))


# ---------------------------------------------------------------- helpers

WIN = f"ts BETWEEN {S.ts(P.START)} AND {S.ts(P.END)}"
SERIES = "hostname, metric, fqdd"


def IR(spark, sf):
    return T.infra_readings(spark, sf)


def CR(spark, sf):
    return T.compute_readings(spark, sf)


def RD(spark, sf):
    return T.readings(spark, sf)


def _all_heads() -> list[str]:
    return [S.infra_cte(), S.compute_cte(), S.readings_cte()]


# ---------------------------------------------------------------- T1-T13


def _sql_power_intervals(cum: bool = False) -> str:
    base = _head(
        *_all_heads(),
        S.power_cte("compute_readings", "pw"),
        f"""x AS (SELECT event_id, ts, hostname, fqdd, metric, value, units, power_w,
              (us - lag(us) OVER w) / 1e6 AS time_diff_seconds,
              (power_w + lag(power_w) OVER w) / 2.0 AS avg_power_w
            FROM pw WINDOW w AS (PARTITION BY {SERIES} ORDER BY us, event_id))""",
        "y AS (SELECT *, avg_power_w * time_diff_seconds / 3600000.0 AS energy_interval_kwh FROM x)",
    )
    cols = ["event_id", "ts", "hostname", "fqdd", "metric", "value", "units"]
    dbl = ["power_w", "time_diff_seconds", "avg_power_w", "energy_interval_kwh"]
    if cum:
        return base + f""",
z AS (SELECT *, sum(coalesce(energy_interval_kwh, 0.0)) OVER (PARTITION BY {SERIES} ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative_energy_kwh FROM y)
SELECT {', '.join(cols)}, {', '.join(S.r(c, c) for c in dbl + ['cumulative_energy_kwh'])} FROM z"""
    return base + f"\nSELECT {', '.join(cols)}, {', '.join(S.r(c, c) for c in dbl)} FROM y"


def _processed(spark, sf, cum: bool):
    f = E.cumulative_energy if cum else E.power_intervals
    x = f(CR(spark, sf), list(E.SERIES))
    cols = ["event_id", "ts", "hostname", "fqdd", "metric", "value", "units", "power_w", "time_diff_seconds",
            "avg_power_w", "energy_interval_kwh"] + (["cumulative_energy_kwh"] if cum else [])
    return x.select(*cols)


@query("power_intervals", lambda: _sql_power_intervals(False))
def q_power_intervals(spark, sf):
    return rounded(_processed(spark, sf, False))


@query("cumulative_energy", lambda: _sql_power_intervals(True))
def q_cumulative_energy(spark, sf):
    return rounded(_processed(spark, sf, True))


@query("lag_interval", lambda: _head(
    *_all_heads(),
    f"""x AS (SELECT event_id, hostname, fqdd, metric, ts,
          lag(ts) OVER w AS prev_ts, lag(value) OVER w AS prev_value
        FROM compute_readings WINDOW w AS (PARTITION BY {SERIES} ORDER BY ts, event_id))""") + "\nSELECT * FROM x")
def q_lag_interval(spark, sf):
    """Previous reading time and raw value per row (bucketed lag + border stitch)."""
    y = E.with_previous(CR(spark, sf).withColumn("power_w", F.col("value")))
    return y.select(
        "event_id", "hostname", "fqdd", "metric", "ts",
        F.timestamp_micros(F.col("prev_us")).cast("timestamp_ntz").alias("prev_ts"),
        F.col("prev_p").alias("prev_value"),
    )


def _sql_boundary(clamp: bool) -> str:
    ctes = _all_heads() + [S.power_cte("readings", "pw", WIN)] + S.boundary_energy_ctes("pw", SERIES, P.START, P.END)
    e = "greatest(energy_kwh, 0.0)" if clamp else "energy_kwh"
    return _head(*ctes) + f"\nSELECT {SERIES}, {S.r(e, 'energy_kwh')}, n_rows FROM b_e"


@query("energy_boundary", lambda: _sql_boundary(False))
def q_energy_boundary(spark, sf):
    r = RD(spark, sf).where(F.col("ts").between(F.lit(P.START).cast("timestamp_ntz"), F.lit(P.END).cast("timestamp_ntz")))
    return rounded(E.energy_boundary(r, list(E.SERIES), P.START, P.END).select(*E.SERIES, "energy_kwh", "n_rows"))


@query("energy_hold", lambda: _sql_boundary(True))
def q_energy_hold(spark, sf):
    r = RD(spark, sf).where(F.col("ts").between(F.lit(P.START).cast("timestamp_ntz"), F.lit(P.END).cast("timestamp_ntz")))
    return rounded(E.energy_hold(r, list(E.SERIES), P.START, P.END).select(*E.SERIES, "energy_kwh", "n_rows"))


def _sql_gap(extra: str = "") -> str:
    ctes = _all_heads() + [S.power_cte("readings", "pw", WIN)] + S.gap_energy_ctes("pw", SERIES, P.MAX_GAP)
    return _head(*ctes) + f"\nSELECT {SERIES}, {S.r('energy_kwh', 'energy_kwh')}{extra} FROM g_e"


@query("energy_gap", _sql_gap)
def q_energy_gap(spark, sf):
    return rounded(E.energy_gap(RD(spark, sf), list(E.SERIES), P.MAX_GAP, P.START, P.END))


@query("energy_units", lambda: _sql_gap(", round(energy_kwh * 3600000.0 + 1e-09, 3) AS energy_j, round(energy_kwh * 1000.0, 6) AS energy_wh"))
def q_energy_units(spark, sf):
    from ..functions.units import kwh_to_joules, kwh_to_wh

    e = E.energy_gap(RD(spark, sf), list(E.SERIES), P.MAX_GAP, P.START, P.END)
    out = e.select(*E.SERIES, "energy_kwh", kwh_to_joules("energy_kwh").alias("energy_j"), kwh_to_wh("energy_kwh").alias("energy_wh"))
    return rounded(out, coarse=("energy_j",))


def _hours_sql() -> str:
    return f"(({S.us(P.END)} - {S.us(P.START)}) / 3.6e9)"


@query("avg_power_from_energy", lambda: _sql_gap(
    f", round(CASE WHEN {_hours_sql()} > 0 THEN energy_kwh / {_hours_sql()} ELSE 0.0 END, 6) AS avg_power_kw"))
def q_avg_power_from_energy(spark, sf):
    e = E.energy_gap(RD(spark, sf), list(E.SERIES), P.MAX_GAP, P.START, P.END)
    h = kpi.duration_hours(P.START, P.END)
    return rounded(e.select(*E.SERIES, "energy_kwh", E.avg_power_from_energy("energy_kwh", h).alias("avg_power_kw")))


def _sql_daily() -> str:
    ctes = _all_heads() + [
        S.power_cte("readings", "pw", WIN),
        S.dedupe_cte("pw", "dd", SERIES),
        S.pairs_cte("dd", "pr", SERIES),
        f"kept AS (SELECT * FROM pr WHERE t1_us > t0_us AND (t1_us - t0_us) / 1e6 <= {P.MAX_GAP})",
        S.pieces_cte("kept", "pc", SERIES),
    ]
    return _head(*ctes) + f"\nSELECT {SERIES}, date, {S.r('sum(piece_j) / 3600000.0', 'energy_kwh')} FROM pc GROUP BY {SERIES}, date"


@query("energy_daily", _sql_daily)
def q_energy_daily(spark, sf):
    return rounded(E.energy_daily(RD(spark, sf), list(E.SERIES), P.MAX_GAP, P.START, P.END).select(*E.SERIES, "date", "energy_kwh"))


@query("energy_simple", lambda: _head(*_all_heads(), S.power_cte("readings", "pw")) + f"""
SELECT {SERIES}, {S.r('avg(power_w) * (max(us) - min(us)) / 1e6 / 3600000.0', 'energy_kwh')}, count(*) AS n_rows
FROM pw GROUP BY {SERIES}""")
def q_energy_simple(spark, sf):
    return rounded(E.energy_simple(RD(spark, sf)))


@query("energy_per_fqdd", lambda: _head(
    *_all_heads(), S.power_cte("compute_readings", "pw", f"fqdd IS NOT NULL AND {WIN}"),
    *S.per_fqdd_ctes("pw", P.START, P.END)) + f"\nSELECT hostname, metric, fqdd, {S.r('energy_kwh', 'energy_kwh')} FROM f_all")
def q_energy_per_fqdd(spark, sf):
    r = CR(spark, sf).where(F.col("fqdd").isNotNull() & F.col("ts").between(F.lit(P.START).cast("timestamp_ntz"), F.lit(P.END).cast("timestamp_ntz")))
    return rounded(E.energy_per_fqdd(r, P.START, P.END).select("hostname", "metric", "fqdd", "energy_kwh"))


@query("total_series", lambda: _head(*_all_heads(), S.power_cte("compute_readings", "pw", "fqdd IS NOT NULL")) + """
SELECT hostname, metric, 'TOTAL' AS fqdd, ts, round(sum(power_w), 6) AS power_w, min(event_id) AS event_id
FROM pw GROUP BY hostname, metric, ts""")
def q_total_series(spark, sf):
    t = E.total_series(CR(spark, sf).where(F.col("fqdd").isNotNull()))
    return rounded(t.select("hostname", "metric", "fqdd", "ts", "power_w", "event_id"))


@query("mean_series", lambda: _head(*_all_heads(), S.power_cte("readings", "pw")) + """
SELECT metric, ts, round(avg(power_w), 6) AS mean_power_w, count(*) AS n_hosts FROM pw GROUP BY metric, ts""")
def q_mean_series(spark, sf):
    return rounded(E.mean_series(RD(spark, sf)))


# ---------------------------------------------------------------- K1-K7 infra KPIs


def _sql_node_breakdown() -> str:
    keys = "hostname, metric, fqdd, node_type"
    grid = " UNION ALL ".join(
        [f"SELECT '{h}' AS hostname, 'irc' AS node_type, '{m}' AS metric" for h in K.IRC_NODES for m in K.IRC_POWER_METRICS]
        + [f"SELECT '{h}' AS hostname, 'pdu' AS node_type, 'pdu' AS metric" for h in K.pdu_nodes()]
    )
    return _head(
        S.infra_cte(),
        S.power_cte("infra_readings", "pw", f"{_pue_inputs_sql()} AND {INFRA_W}"),
        *S.gap_energy_ctes("pw", keys, P.MAX_GAP),
        f"grid AS ({grid})",
        """nb AS (SELECT g.hostname, g.node_type, g.metric, coalesce(e.energy_kwh, 0.0) AS energy_kwh
              FROM grid g LEFT JOIN g_e e ON g.hostname = e.hostname AND g.metric = e.metric)""",
    )


@query("pue_node_breakdown", lambda: _sql_node_breakdown() + f"\nSELECT hostname, node_type, metric, {S.r('energy_kwh', 'energy_kwh')} FROM nb")
def q_pue_node_breakdown(spark, sf):
    return rounded(kpi.pue_node_breakdown(spark, IR(spark, sf), P.START, P.END, P.MAX_GAP))


@query("inventory_left_join", lambda: _sql_node_breakdown() + f"\nSELECT hostname, node_type, metric, {S.r('energy_kwh', 'energy_kwh')} FROM nb")
def q_inventory_left_join(spark, sf):
    """Every listed infra node x metric reported, 0.0 when silent."""
    return rounded(kpi.pue_node_breakdown(spark, IR(spark, sf), P.START, P.END, P.MAX_GAP))


def _band_sql(p: str) -> str:
    return (f"CASE WHEN {p} IS NULL THEN 'unavailable' WHEN {p} = 0.0 THEN 'down' WHEN {p} = 1.0 THEN 'irc_down' "
            f"WHEN {p} < 1.2 THEN 'excellent' WHEN {p} < 1.5 THEN 'good' WHEN {p} < 2.0 THEN 'average' ELSE 'poor' END")


def _sql_pue() -> str:
    h = _hours_sql()
    pue = S.pue_expr("irc", "pdu")
    return _sql_node_breakdown() + f""",
t AS (SELECT sum(CASE WHEN node_type = 'irc' THEN energy_kwh ELSE 0.0 END) AS irc,
             sum(CASE WHEN node_type = 'pdu' THEN energy_kwh ELSE 0.0 END) AS pdu FROM nb),
u AS (SELECT *, {pue} AS pue FROM t)
SELECT {S.ts(P.START)} AS start_ts, {S.ts(P.END)} AS end_ts, {S.r(h, 'duration_hours')},
  {S.r('irc', 'irc_energy_kwh')}, {S.r('pdu', 'pdu_energy_kwh')}, {S.r('irc + pdu', 'total_energy_kwh')},
  {S.r('pue', 'pue')},
  {S.r(f'CASE WHEN {h} > 0 THEN irc / {h} ELSE 0.0 END', 'avg_irc_power_kw')},
  {S.r(f'CASE WHEN {h} > 0 THEN pdu / {h} ELSE 0.0 END', 'avg_pdu_power_kw')},
  {S.r(f'CASE WHEN {h} > 0 THEN (irc + pdu) / {h} ELSE 0.0 END', 'avg_total_power_kw')},
  CAST({len(K.IRC_NODES)} AS BIGINT) AS irc_node_count, CAST({len(K.pdu_nodes())} AS BIGINT) AS pdu_node_count,
  CASE WHEN pue IS NULL THEN 'error' ELSE 'success' END AS status, {_band_sql('pue')} AS band
FROM u"""


@query("pue", _sql_pue)
def q_pue(spark, sf):
    return rounded(kpi.pue(spark, IR(spark, sf), P.START, P.END, P.MAX_GAP))


def _sql_pue_band() -> str:
    return _sql_pue_daily().replace(
        f"SELECT s.date, {S.r('coalesce(irc, 0.0)', 'irc_energy_kwh')}",
        f"SELECT s.date, {_band_sql(S.pue_expr('coalesce(irc, 0.0)', 'coalesce(pdu, 0.0)'))} AS band, {S.r('coalesce(irc, 0.0)', 'irc_energy_kwh')}",
    )


@query("pue_band", _sql_pue_band)
def q_pue_band(spark, sf):
    d = kpi.pue_daily(spark, IR(spark, sf), P.START, P.END, P.MAX_GAP)
    return rounded(d.withColumn("band", kpi.pue_band(F.col("pue"))))


def _cop_sql_cols(src: str) -> str:
    comp, fan, cool = "coalesce(comp, 0.0)", "coalesce(fan, 0.0)", "coalesce(cool, 0.0)"
    return (f"{S.r(comp, 'compressor_power_kwh')}, {S.r(fan, 'condenser_fan_power_kwh')}, {S.r(cool, 'cool_demand_kwh')}, "
            f"{S.r(f'CASE WHEN {comp} + {fan} > 0 THEN {cool} / ({comp} + {fan}) END', 'cop')}")


def _racks_sql() -> str:
    return " UNION ALL ".join(f"SELECT {r} AS rack, '{h}' AS irc_node" for r, h in K.RACK_TO_IRC.items())


def _sql_rack_cop_base() -> str:
    irc_hosts = S.q(K.RACK_TO_IRC.values())
    return _head(
        S.infra_cte(),
        S.power_cte("infra_readings", "pw", f"hostname IN ({irc_hosts}) AND metric IN ({S.q(K.COP_METRICS)}) AND {INFRA_W}"),
        *S.gap_energy_ctes("pw", "hostname, metric", P.MAX_GAP),
        f"racks AS ({_racks_sql()})",
        """cop AS (SELECT r.rack, r.irc_node,
              max(CASE WHEN e.metric = 'CompressorPower' THEN e.energy_kwh END) AS comp,
              max(CASE WHEN e.metric = 'CondenserFanPower' THEN e.energy_kwh END) AS fan,
              max(CASE WHEN e.metric = 'CoolDemand' THEN e.energy_kwh END) AS cool
            FROM racks r LEFT JOIN g_e e ON r.irc_node = e.hostname GROUP BY r.rack, r.irc_node)""",
    )


@query("rack_cop", lambda: _sql_rack_cop_base() + f"\nSELECT rack, irc_node, {_cop_sql_cols('cop')} FROM cop")
def q_rack_cop(spark, sf):
    return rounded(kpi.rack_cop(spark, IR(spark, sf), P.START, P.END, P.MAX_GAP))


@query("rack_irc_join", lambda: _sql_rack_cop_base() + f"\nSELECT rack, irc_node, {_cop_sql_cols('cop')} FROM cop")
def q_rack_irc_join(spark, sf):
    """Rack -> IRC host lookup feeding the COP energies."""
    return rounded(kpi.rack_cop(spark, IR(spark, sf), P.START, P.END, P.MAX_GAP))


@query("rack_cop_summary", lambda: _sql_rack_cop_base() + f""",
c2 AS (SELECT CASE WHEN coalesce(comp, 0.0) + coalesce(fan, 0.0) > 0
                   THEN coalesce(cool, 0.0) / (coalesce(comp, 0.0) + coalesce(fan, 0.0)) END AS c FROM cop)
SELECT count(*) AS total_racks, count(c) AS racks_with_data, {S.r('avg(c)', 'avg_cop')}, {S.r(_hours_sql(), 'duration_hours')} FROM c2""")
def q_rack_cop_summary(spark, sf):
    return rounded(kpi.rack_cop_summary(spark, IR(spark, sf), P.START, P.END, P.MAX_GAP))


def _sql_rack_cop_daily() -> str:
    irc_hosts = S.q(K.RACK_TO_IRC.values())
    keys = "hostname, metric"
    return _head(
        S.infra_cte(),
        S.power_cte("infra_readings", "pw", f"hostname IN ({irc_hosts}) AND metric IN ({S.q(K.COP_METRICS)}) AND {INFRA_W}"),
        S.pairs_cte("pw", "pr", keys),
        f"kept AS (SELECT * FROM pr WHERE t1_us > t0_us AND (t1_us - t0_us) / 1e6 <= {P.MAX_GAP})",
        S.pieces_cte("kept", "pc", keys),
        "d AS (SELECT hostname, metric, date, sum(piece_j) / 3600000.0 AS e FROM pc GROUP BY hostname, metric, date)",
        f"racks AS ({_racks_sql()})",
        f"""cop AS (SELECT s.date, r.rack, r.irc_node,
              max(CASE WHEN d.metric = 'CompressorPower' THEN d.e END) AS comp,
              max(CASE WHEN d.metric = 'CondenserFanPower' THEN d.e END) AS fan,
              max(CASE WHEN d.metric = 'CoolDemand' THEN d.e END) AS cool
            FROM racks r CROSS JOIN {S.spine()} s
            LEFT JOIN d ON d.hostname = r.irc_node AND d.date = s.date GROUP BY s.date, r.rack, r.irc_node)""",
    ) + f"\nSELECT date, rack, irc_node, {_cop_sql_cols('cop')} FROM cop"


@query("rack_cop_daily", _sql_rack_cop_daily)
def q_rack_cop_daily(spark, sf):
    return rounded(kpi.rack_cop_daily(spark, IR(spark, sf), P.START, P.END, P.MAX_GAP / 60.0))
