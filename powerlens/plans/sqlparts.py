"""DuckDB SQL fragments shared by the oracle queries.

The adapter CTEs are the SQL text of the telemetry/jobs derivations in
``powerlens.sources`` (FIXTURES.md section 3); every oracle starts with them.
"""

from __future__ import annotations

from ..constants import IRC_NODES, pdu_nodes
from ..sources.telemetry import _COMPUTE_SLOTS
from . import params as P

HOSTS = IRC_NODES + pdu_nodes()


def q(items) -> str:
    return ", ".join(f"'{x}'" for x in items)


def ts(t) -> str:
    return f"TIMESTAMP '{t}'"


def infra_cte() -> str:
    return f"""infra_readings AS (
  SELECT event_id, ts, user_id AS nodeid,
    ([{q(HOSTS)}])[CAST(user_id % 30 AS INT) + 1] AS hostname,
    CASE WHEN user_id % 30 < 6 THEN 'irc' ELSE 'pdu' END AS node_type,
    CAST(NULL AS VARCHAR) AS fqdd,
    CASE WHEN user_id % 30 >= 6 THEN 'pdu'
         WHEN event_type = 'click' THEN 'CompressorPower'
         WHEN event_type = 'error' THEN 'CondenserFanPower'
         WHEN event_type = 'purchase' THEN 'CoolDemand'
         WHEN event_type = 'signup' THEN 'CoolOutput'
         ELSE 'TotalSensibleCoolingPower' END AS metric,
    CASE WHEN user_id % 30 < 6 AND event_type <> 'error' THEN value / 1000.0 ELSE value END AS value,
    CASE WHEN user_id % 30 < 6 AND event_type <> 'error' THEN 'kW' ELSE 'W' END AS units
  FROM events)"""


def compute_host(i: str) -> str:
    parts = [f"WHEN {i} < {hi} THEN concat('{p}', CAST({i} - {lo} + 1 AS VARCHAR))" for lo, hi, p in _COMPUTE_SLOTS]
    return "CASE " + " ".join(parts) + " END"


def compute_cte() -> str:
    return f"""compute_readings AS (
  WITH e AS (
    SELECT event_id, ts, user_id, event_type, value AS v, (user_id * 37) % 118 AS i,
           CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k
    FROM events),
  m AS (SELECT *, CASE
      WHEN event_type = 'click' AND k % 2 = 0 THEN 'TotalCPUPower'
      WHEN event_type = 'click' THEN 'CPUPower'
      WHEN event_type = 'error' AND k % 2 = 0 THEN 'TotalFanPower'
      WHEN event_type = 'error' THEN 'TotalStoragePower'
      WHEN event_type = 'purchase' AND k % 2 = 0 THEN 'SystemInputPower'
      WHEN event_type = 'purchase' THEN 'SystemOutputPower'
      WHEN event_type = 'signup' AND k % 2 = 0 THEN 'PowerConsumption'
      WHEN event_type = 'signup' THEN 'DRAMPwr'
      WHEN k % 2 = 0 THEN 'TotalMemoryPower'
      ELSE 'SystemPowerConsumption' END AS metric FROM e)
  SELECT event_id, ts, user_id AS nodeid, {compute_host('i')} AS hostname, 'compute' AS node_type,
    CASE WHEN metric IN ('PowerConsumption', 'CPUPower') THEN concat('dev.', CAST(k % 4 + 1 AS VARCHAR)) END AS fqdd,
    metric,
    CASE WHEN metric = 'PowerConsumption' THEN v * 1000.0
         WHEN metric = 'SystemPowerConsumption' THEN v / 1000.0 ELSE v END AS value,
    CASE WHEN metric = 'PowerConsumption' THEN 'mW'
         WHEN metric = 'SystemPowerConsumption' THEN 'kW' ELSE 'W' END AS units
  FROM m)"""


def readings_cte() -> str:
    return "readings AS (SELECT * FROM infra_readings UNION ALL SELECT * FROM compute_readings)"


def jobs_cte() -> str:
    i = "((o_custkey * 37) % 118)"
    s0 = "((o_orderkey * 7919) % 2500000)"
    s1 = f"({s0} + (o_orderkey % 48 + 1) * 3600)"
    base = "TIMESTAMP '2024-01-01 00:00:00'"
    return f"""jobs AS (
  SELECT o_orderkey AS job_id, concat('user', CAST(o_custkey % 20 AS VARCHAR)) AS job_user,
    {compute_host(i)} AS hostname,
    concat({compute_host(i)}, ',', {compute_host(f'(({i} + 1) % 118)')}) AS nodelist,
    {base} + to_seconds(CAST({s0} AS BIGINT)) AS start_ts,
    {base} + to_seconds(CAST({s1} AS BIGINT)) AS end_ts
  FROM orders)"""


def watts(v="value", u="units") -> str:
    return f"CASE WHEN lower({u}) = 'mw' THEN {v} / 1000.0 WHEN lower({u}) = 'kw' THEN {v} * 1000.0 ELSE {v} END"


def power_cte(src: str, name: str, where: str = "TRUE") -> str:
    return f"{name} AS (SELECT *, {watts()} AS power_w, epoch_us(ts) AS us FROM {src} WHERE {where})"


def pairs_cte(src: str, name: str, keys: str) -> str:
    """Consecutive pairs per series ordered by (ts, event_id)."""
    return f"""{name} AS (
  SELECT * FROM (
    SELECT {keys}, lag(us) OVER w AS t0_us, lag(power_w) OVER w AS p0, us AS t1_us, power_w AS p1
    FROM {src} WINDOW w AS (PARTITION BY {keys} ORDER BY us, event_id)) x
  WHERE t0_us IS NOT NULL)"""


def dedupe_cte(src: str, name: str, keys: str) -> str:
    return f"""{name} AS (SELECT * FROM {src}
  QUALIFY row_number() OVER (PARTITION BY {keys}, ts ORDER BY event_id) = 1)"""


def pieces_cte(src: str, name: str, keys: str) -> str:
    """Split pairs at UTC midnight (D8: an interval ending at midnight stays on the earlier day)."""
    return f"""{name} AS (
  SELECT {keys}, strftime(day, '%Y-%m-%d') AS date,
    (p0 + (p1 - p0) / CAST(t1_us - t0_us AS DOUBLE) * (a - t0_us)
     + p0 + (p1 - p0) / CAST(t1_us - t0_us AS DOUBLE) * (b - t0_us)) / 2.0 * ((b - a) / 1e6) AS piece_j
  FROM (
    SELECT *, greatest(t0_us, epoch_us(day)) AS a, least(t1_us, epoch_us(day) + 86400000000) AS b
    FROM (SELECT *, unnest(generate_series(CAST(CAST(make_timestamp(t0_us) AS DATE) AS TIMESTAMP),
                                           CAST(CAST(make_timestamp(t1_us - 1) AS DATE) AS TIMESTAMP),
                                           INTERVAL 1 DAY)) AS day
          FROM {src}) y) z)"""


def spine(start=P.START, end=P.END) -> str:
    return f"""(SELECT strftime(d, '%Y-%m-%d') AS date
   FROM generate_series(CAST(CAST({ts(start)} AS DATE) AS TIMESTAMP), CAST(CAST({ts(end)} AS DATE) AS TIMESTAMP), INTERVAL 1 DAY) t(d))"""


def pue_expr(irc: str, pdu: str) -> str:
    return (
        f"CASE WHEN {pdu} = 0 THEN CASE WHEN {irc} = 0 THEN 0.0 ELSE CAST(NULL AS DOUBLE) END "
        f"WHEN {irc} = 0 THEN 1.0 ELSE ({irc} + {pdu}) / {pdu} END"
    )


def r(x: str, alias: str) -> str:
    return f"round({x}, {P.ROUND}) AS {alias}"


def us(t) -> str:
    return f"epoch_us({ts(t)})"


def boundary_energy_ctes(src: str, keys: str, start, end, prefix: str = "b") -> list[str]:
    """T3 closed form in SQL: lead + trapezoid + tail per series -> {prefix}_e(keys, energy_kwh, n_rows)."""
    s_us = "NULL" if start is None else us(start)
    e_us = "NULL" if end is None else us(end)
    return [
        pairs_cte(src, f"{prefix}_pr", keys),
        f"""{prefix}_tr AS (SELECT {keys}, sum((p0 + p1) / 2.0 * ((t1_us - t0_us) / 1e6)) AS trap_j
            FROM {prefix}_pr GROUP BY {keys})""",
        f"""{prefix}_ed AS (SELECT {keys}, first(power_w ORDER BY us, event_id) AS first_p,
              last(power_w ORDER BY us, event_id) AS last_p, min(us) AS first_us, max(us) AS last_us,
              count(*) AS n_rows, {s_us} AS s_us, {e_us} AS e_us
            FROM {src} GROUP BY {keys})""",
        f"""{prefix}_e AS (SELECT {', '.join('d.' + k.strip() for k in keys.split(','))},
              ((CASE WHEN d.s_us IS NOT NULL AND d.first_us > d.s_us THEN d.first_p * (d.first_us - d.s_us) / 1e6 ELSE 0.0 END)
               + coalesce(t.trap_j, 0.0)
               + (CASE WHEN d.e_us IS NOT NULL AND d.last_us < d.e_us THEN d.last_p * (d.e_us - d.last_us) / 1e6 ELSE 0.0 END))
              / 3600000.0 AS energy_kwh, d.n_rows
            FROM {prefix}_ed d LEFT JOIN {prefix}_tr t ON {' AND '.join(f'd.{k.strip()} IS NOT DISTINCT FROM t.{k.strip()}' for k in keys.split(','))})""",
    ]


def gap_energy_ctes(src: str, keys: str, max_gap, prefix: str = "g") -> list[str]:
    """T5 in SQL -> {prefix}_e(keys, energy_kwh)."""
    gap = str(float(max_gap))
    return [
        pairs_cte(src, f"{prefix}_pr", keys),
        f"""{prefix}_e AS (SELECT {keys}, sum((p0 + p1) / 2.0 * ((t1_us - t0_us) / 1e6)) / 3600000.0 AS energy_kwh
            FROM {prefix}_pr WHERE t1_us > t0_us AND (t1_us - t0_us) / 1e6 <= {gap} GROUP BY {keys})""",
    ]


def per_fqdd_ctes(src: str, start, end, prefix: str = "f") -> list[str]:
    """Device series (duplicate timestamps summed), T3 per device, TOTAL per (host, metric)
    -> {prefix}_all(hostname, metric, fqdd, energy_kwh)."""
    return [
        f"""{prefix}_dev AS (SELECT hostname, metric, fqdd, ts, us, sum(power_w) AS power_w, min(event_id) AS event_id
            FROM {src} GROUP BY hostname, metric, fqdd, ts, us)""",
        *boundary_energy_ctes(f"{prefix}_dev", "hostname, metric, fqdd", start, end, prefix=f"{prefix}b"),
        f"""{prefix}_all AS (SELECT hostname, metric, fqdd, energy_kwh FROM {prefix}b_e
            UNION ALL SELECT hostname, metric, 'TOTAL' AS fqdd, sum(energy_kwh) AS energy_kwh FROM {prefix}b_e GROUP BY hostname, metric)""",
    ]
