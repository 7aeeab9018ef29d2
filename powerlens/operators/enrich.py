"""Dimension joins and series merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def defs_by_lower_id(defs: DataFrame) -> DataFrame:
    """Definitions keyed by ``lower(metric_id)``, one row per key."""
    w = Window.partitionBy("_mkey").orderBy("metric_id")
    return (
        defs.withColumn("_mkey", F.lower("metric_id"))
        .withColumn("_rn", F.row_number().over(w))
        .where("_rn = 1")
        .drop("_rn")
    )


def enrich_compute(facts: DataFrame, nodes: DataFrame, source: DataFrame, fqdd: DataFrame, defs: DataFrame) -> DataFrame:
    """C1 (+C3): facts LEFT JOIN nodes, source, fqdd, definitions (unit).

    All dimensions come from the caller and are joined without a hint: AQE
    broadcasts one at run time only when its measured size is small.
    """
    d = defs_by_lower_id(defs).select("_mkey", "units")
    return (
        facts.join(nodes, "nodeid", "left")
        .join(source.select(F.col("id").alias("source"), F.col("source").alias("source_name")), "source", "left")
        .join(fqdd.select(F.col("id").alias("fqdd"), F.col("fqdd").alias("fqdd_name")), "fqdd", "left")
        .join(d, F.lower(F.col("metric")) == F.col("_mkey"), "left")
        .select(
            "event_id",
            "ts",
            "hostname",
            F.col("source_name").alias("source"),
            F.col("fqdd_name").alias("fqdd"),
            "metric",
            "value",
            "units",
        )
    )


def enrich_infra(facts: DataFrame, nodes: DataFrame, defs: DataFrame) -> DataFrame:
    """INNER JOIN nodes (unknown ids dropped), LEFT JOIN definitions."""
    d = defs_by_lower_id(defs).select("_mkey", "units")
    return (
        facts.join(nodes, "nodeid", "inner")
        .join(d, F.lower(F.col("metric")) == F.col("_mkey"), "left")
        .select("event_id", "ts", "hostname", "metric", "value", "units")
    )


def merge_series(frames: list[DataFrame], on=("ts", "hostname")) -> DataFrame:
    """N-way full outer join on ``on``; inputs that are None or have no value
    column are skipped (no job looks into them), and colliding value columns of
    later frames get a ``_y`` suffix, repeated until the name is free."""
    on = list(on)
    frames = [f for f in frames if f is not None and set(f.columns) - set(on)]
    if not frames:
        raise ValueError("no frames to merge")

    def step(acc: DataFrame, nxt: DataFrame) -> DataFrame:
        taken, names = set(acc.columns), {}
        for c in nxt.columns:
            if c in on:
                continue
            names[c] = c
            while names[c] in taken:
                names[c] += "_y"
            taken.add(names[c])
        return acc.join(nxt.select(*on, *[F.col(c).alias(n) for c, n in names.items()]), on, "full")

    return reduce(step, frames)


def missing_metrics(expected: DataFrame, seen: DataFrame, keys=("metric",)) -> DataFrame:
    """Expected metrics that produced no rows (left anti join)."""
    return expected.join(seen.select(*keys).distinct(), list(keys), "left_anti")


def metric_pairs(energies: DataFrame, group_col: str = "category") -> DataFrame:
    """C11: all unordered metric pairs inside a group (m1 < m2).

    ``energies`` holds one row per (host, group, metric); pairs are built per
    host and group by an equi self-join plus the ``<`` residual; groups hold a
    handful of metrics (the category lists), so the output is bounded by
    that list size, not by the data.
    """
    a = energies.select("hostname", group_col, F.col("metric").alias("metric_1"), F.col("energy_kwh").alias("energy_1"))
    b = energies.select("hostname", group_col, F.col("metric").alias("metric_2"), F.col("energy_kwh").alias("energy_2"))
    return a.join(b, ["hostname", group_col]).where(F.col("metric_1") < F.col("metric_2"))


def union_metrics(frames: list[DataFrame]) -> DataFrame:
    """Concatenation of differently shaped frames by name."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)
