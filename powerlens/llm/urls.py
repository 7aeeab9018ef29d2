"""URL filters with empirical-Bayes host reputation (operator 8).

A page's verdict is that of the longest rule (host, path) that fits its url.
Pages with a rule's verdict are the labelled outcomes (allow: good, block: bad);
pages without one get the verdict of their host's reputation.

Reputation: labelled outcomes are counted for each host, and summed to its
registered domain and suffix.  At every level the share of good pages has a
beta prior whose mean is the posterior mean of the level above (the suffix's:
the overall share) and whose strength comes from the level's own spread, by the
beta-binomial moments.  The host's posterior is Beta; a page is blocked when
even the upper bound of the posterior, mean + z standard deviations, stays under
``least_good``.  Hosts without labelled pages have their domain's prior.

Defined results: a url that is null or has no ``://`` has an empty host and path;
without any labelled page all reputations are open, so pages are allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_RULES = 1000  # rules are one expression
LEAST_RHO, MOST_RHO = 1e-4, 0.999
Z = 1.645
LEAST_GOOD = 0.5


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parts(url):
    """Columns (host, path) of a url column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matched(rules: list[Rule], host, path):
    """Columns (rule text, verdict) of the longest rule that fits; block wins a tie."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    texts, verdicts = [], []
    for r in sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.verdict != "block", r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        texts.append(F.when(fits, F.lit(r.text)))
        verdicts.append(F.when(fits, F.lit(r.verdict)))
    none = F.lit(None).cast("string")
    return F.coalesce(*texts, none), F.coalesce(*verdicts, none)


def _strength(level: DataFrame) -> float:
    """Prior strength (a + b) of a level: rows ``n``, ``good``, ``mean`` (the prior's)."""
    room = F.col("mean") * (1 - F.col("mean"))
    spread, expected, weight = level.where(F.col("n") > 0).agg(
        F.sum(F.pow(F.col("good") / F.col("n") - F.col("mean"), F.lit(2)) * F.col("n")),
        F.sum(room),
        F.sum(room * (F.col("n") - 1)),
    ).first()
    rho = (spread - expected) / weight if weight else LEAST_RHO
    rho = min(MOST_RHO, max(LEAST_RHO, rho))
    return (1 - rho) / rho


def reputations(outcomes: DataFrame, z: float = Z) -> DataFrame:
    """Posterior of every host.  ``outcomes``: ``host``, ``good`` (1, 0 or null: not
    labelled).  Returns host, n, good, mean and upper (bound)."""
    counts = outcomes.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    hosts = stored(
        counts.withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1)), "hosts")
    total = hosts.agg(F.sum("n"), F.sum("good")).first()
    overall = (total[1] / total[0]) if total[0] else 0.5
    overall = min(1 - 1e-6, max(1e-6, overall))

    above = None
    for key, parent in (("suffix", None), ("domain", "suffix"), ("host", "domain")):
        keys = {"suffix": ["suffix"], "domain": ["domain", "suffix"], "host": ["host", "domain"]}[key]
        level = hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
        level = level.withColumn("mean", F.lit(overall)) if above is None else level.join(above, parent)
        level = stored(level, "reputation")
        k = F.lit(_strength(level))
        a = F.col("good") + k * F.col("mean")
        b = F.col("n") - F.col("good") + k * (1 - F.col("mean"))
        mean = a / (a + b)
        if key != "host":
            above = level.select(key, mean.alias("mean"))
        else:
            sd = F.sqrt(mean * (1 - mean) / (a + b + 1))
            return level.select("host", "n", "good", mean.alias("mean"), F.least(F.lit(1.0), mean + F.lit(z) * sd).alias("upper"))


def judge(
    pages: DataFrame, rules: list[Rule], url: str = "url", page_id: str = "page_id", z: float = Z, least_good: float = LEAST_GOOD
) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` (null: none fits) and ``verdict`` of every page."""
    host, path = parts(column(url))
    rows = pages.select(column(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = matched(rules, F.col("host"), F.col("path"))
    rows = stored(rows.withColumns({"rule": rule, "own": verdict}), "judged")  # read for the counts and for the result
    good = F.when(F.col("own").isNotNull(), (F.col("own") == "allow").cast("int"))
    known = reputations(rows.select("host", good.alias("good")), z)
    method = F.when(F.col("upper") < least_good, "block").otherwise("allow")
    return rows.join(known.select("host", method.alias("method")), "host").select(
        "page_id", "host", "path", "rule", F.coalesce("own", "method").alias("verdict"))


def oracle(rules: list[Rule], z: float = Z, least_good: float = LEAST_GOOD) -> str:
    """DuckDB SQL for ``judge`` over ``pages``."""
    listed = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in rules)

    def strength(level: str) -> str:
        return f"""SELECT (1 - rho) / rho AS k FROM (SELECT least({MOST_RHO}, greatest({LEAST_RHO}, CASE WHEN coalesce(w, 0) = 0 THEN {LEAST_RHO}
            ELSE (s - e) / w END)) AS rho FROM (SELECT sum(n * pow(good / n - mean, 2)) AS s, sum(mean * (1 - mean)) AS e,
            sum(mean * (1 - mean) * (n - 1)) AS w FROM {level} WHERE n > 0))"""

    return f"""
    WITH rules(r_host, r_path, r_verdict) AS (VALUES {listed}),
    cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    p AS (SELECT row_number() OVER () AS row_id, page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
        regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    fits AS (SELECT row_id, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(r_verdict, length(r_host || r_path)) AS own
        FROM p JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY row_id),
    j AS (SELECT p.*, rule, own FROM p LEFT JOIN fits USING (row_id)),
    h AS (SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix,
        count(own)::DOUBLE AS n, coalesce(sum((own = 'allow')::INT), 0)::DOUBLE AS good FROM j GROUP BY host),
    t AS (SELECT CASE WHEN coalesce(sum(n), 0) = 0 THEN 0.5::DOUBLE ELSE least(1 - 1e-6, greatest(1e-6, sum(good) / sum(n))) END AS m FROM h),
    s0 AS (SELECT suffix, sum(n) AS n, sum(good) AS good, max(m) AS mean FROM h, t GROUP BY suffix),
    s1 AS (SELECT suffix, (good + k * mean) / (n + k) AS mean FROM s0, ({strength('s0')})),
    d0 AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good, max(mean) AS mean FROM h JOIN s1 USING (suffix) GROUP BY domain, suffix),
    d1 AS (SELECT domain, (good + k * mean) / (n + k) AS mean FROM d0, ({strength('d0')})),
    h0 AS (SELECT host, n, good, mean FROM h JOIN d1 USING (domain)),
    h1 AS (SELECT host, good + k * mean AS a, n - good + k * (1 - mean) AS b FROM h0, ({strength('h0')})),
    v AS (SELECT host, CASE WHEN least(1.0, a / (a + b) + {z} * sqrt(a * b / ((a + b) * (a + b)) / (a + b + 1))) < {least_good} THEN 'block' ELSE 'allow' END AS method FROM h1)
    SELECT page_id, host, path, rule, coalesce(own, method) AS verdict FROM j JOIN v USING (host)"""
