"""Host classification and host-list expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    CONTAINS_ORDER,
    DERIVED_METRICS,
    EXCLUDED_METRICS,
    IRC_NODES,
    METRIC_CATEGORIES,
    pdu_nodes,
)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def node_type(hostname="hostname") -> Column:
    """B10: 'irc' / 'pdu' for listed infrastructure hosts, else 'compute'."""
    h = _c(hostname)
    return F.when(h.isin(IRC_NODES), "irc").when(h.isin(pdu_nodes()), "pdu").otherwise("compute")


def node_database(hostname="hostname") -> Column:
    """Database of a host: infra for IRC/PDU, zen4 for rpc-, else h100."""
    h = _c(hostname)
    return (
        F.when(h.isin(IRC_NODES + pdu_nodes()), "infra")
        .when(h.startswith("rpg-"), "h100")
        .when(h.startswith("rpc-"), "zen4")
        .otherwise("h100")
    )


def node_schema(hostname="hostname") -> Column:
    """Schema of a host: irc / pdu / idrac."""
    h = _c(hostname)
    return F.when(h.isin(IRC_NODES), "irc").when(h.isin(pdu_nodes()), "pdu").otherwise("idrac")


def known_host(hostname="hostname") -> Column:
    """B10 strict variant: true when the host has a known type or prefix."""
    h = _c(hostname)
    return h.isin(IRC_NODES + pdu_nodes()) | h.startswith("rpg-") | h.startswith("rpc-")


def rack_of(hostname="hostname") -> Column:
    """Rack number = second dash-separated part of the host name."""
    return F.get(F.split(_c(hostname), "-"), 1).try_cast("int")


def is_excluded(metric="metric") -> Column:
    """Metrics that are not consumption (headroom)."""
    return F.lower(_c(metric)).isin(EXCLUDED_METRICS)


def is_derived(metric="metric") -> Column:
    """B9."""
    return F.lower(_c(metric)).isin(DERIVED_METRICS)


def metric_category(metric="metric") -> Column:
    """List membership -> CPU / MEMORY / GPU / FAN / STORAGE / SYSTEM, else null."""
    m = _c(metric)
    expr = None
    for cat, members in METRIC_CATEGORIES.items():
        expr = (F.when if expr is None else expr.when)(m.isin(members), cat)
    return expr


def metric_category_contains(metric="metric") -> Column:
    """Substring grouping for chart data.

    SYSTEMOUTPUT names -> 'SystemOutput'; other system metrics -> 'Other' and
    never GPU (D24); then CPU, MEMORY, GPU, FAN, STORAGE by substring in that
    order; the rest -> 'Other'.
    """
    u = F.upper(_c(metric))
    expr = F.when(u.contains("SYSTEMOUTPUT"), "SystemOutput")
    sys_hit = None
    for s in METRIC_CATEGORIES["SYSTEM"]:
        t = u.contains(s.upper())
        sys_hit = t if sys_hit is None else (sys_hit | t)
    expr = expr.when(sys_hit, "Other")
    for cat in CONTAINS_ORDER:
        hit = None
        for s in METRIC_CATEGORIES[cat]:
            t = u.contains(s.upper())
            hit = t if hit is None else (hit | t)
        expr = expr.when(hit, cat)
    return expr.otherwise("Other")


HOST_PATTERN = r"^(?:[^\[\],]+|\[\s*\d+(?:-\d+)?(?:\s*,\s*\d+(?:-\d+)?)*\s*\])+$"


def _numbers(body: Column) -> Column:
    """Names in a bracket group such as ``1-3,07``: array of strings, zero padding of the low bound kept."""

    def one(part: Column) -> Column:
        ends = F.split(F.trim(part), "-")
        lo, hi = ends.getItem(0), F.coalesce(F.get(ends, 1), ends.getItem(0))
        low, high = lo.cast("bigint"), hi.cast("bigint")
        up = F.when(low <= high, F.sequence(low, high)).otherwise(
            F.raise_error(F.concat(F.lit("reversed range in a node list: "), part)))
        pad = F.when(lo.startswith("0"), F.length(lo)).otherwise(1)
        return F.transform(up, lambda n: F.lpad(n.cast("string"), F.greatest(pad, F.length(n.cast("string"))), F.lit("0")))

    return F.flatten(F.transform(F.split(body, ","), one))


def _hosts(item: Column) -> Column:
    """All hosts of one pattern: a fold over its (text, bracket group) parts, however many."""
    texts = F.regexp_extract_all(item, F.lit(r"([^\[\]]*)(?:\[([^\]]*)\])?"), F.lit(1))
    bodies = F.regexp_extract_all(item, F.lit(r"([^\[\]]*)(?:\[([^\]]*)\])?"), F.lit(2))
    parts = F.arrays_zip(texts.alias("text"), bodies.alias("body"))

    def grow(done: Column, part: Column) -> Column:
        tails = F.when(part["body"] == "", F.array(F.lit(""))).otherwise(_numbers(part["body"]))
        return F.flatten(F.transform(done, lambda d: F.transform(tails, lambda t: F.concat(d, part["text"], t))))

    hosts = F.aggregate(parts, F.array(F.lit("")), grow)
    return F.when(item.rlike(HOST_PATTERN), hosts).otherwise(
        F.raise_error(F.concat(F.lit("node list can't be read: "), item)))


def explode_nodelist(df, nodelist="nodelist", out="hostname"):
    """Expand a scheduler node list into one row per host.

    Handles comma lists and bracket ranges, e.g. ``rpc-91-[1-3,7],rpg-93-2``
    -> rpc-91-1, rpc-91-2, rpc-91-3, rpc-91-7, rpg-93-2; any number of groups
    in one pattern expands to their product (``a[1-2]b[3-4]`` -> a1b3, a1b4,
    a2b3, a2b4).  Column expressions only.  A pattern that can't be read and a
    reversed range raise an error; null and empty lists give no row.
    """
    c = _c(nodelist)
    plain = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    items = F.filter(F.transform(F.split(c, r",(?![^\[]*\])"), lambda x: F.trim(x)), lambda x: x != "")
    # a list without brackets is its parts; only the others need the fold over bracket groups
    hosts = F.when(F.contains(c, F.lit("[")) | F.contains(c, F.lit("]")), F.flatten(F.transform(items, _hosts))).otherwise(plain)
    return df.withColumn(out, F.explode(hosts))


def check_known_hosts(df, hostname="hostname", examples: int = 10):
    """B10 strict variant: raise when the frame holds hosts of unknown type.

    One distinct-host query; at most ``examples`` names reach the driver for
    the message.  Returns ``df`` with ``node_type`` added when all are known.
    """
    bad = df.where(~known_host(hostname)).select(_c(hostname).alias("h")).distinct().limit(examples).collect()
    if bad:
        raise ValueError(f"unknown host type: {sorted(r['h'] for r in bad)}")
    return df.withColumn("node_type", node_type(hostname))
