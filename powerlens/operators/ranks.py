"""Exact percentiles of many series in two passes.

Pass 1: a range histogram for each series.  ``value_bin`` is a fixed, order-keeping
map of numbers to bins (``BINS_PER_OCTAVE`` for each doubling), so no minimum or
maximum is needed first, and the histogram is one hash aggregate with
map-side combination: at most one row for each bin that a series uses, however many
readings it has.  Running counts over a series' bins tell which bin holds the wanted rank.

Pass 2: only the values of these bins are counted and put in order; every other
row is dropped where it is read.  The rank's place in its bin gives the exact value,
interpolated between the two neighbours as ``percentile`` does.  What lies beyond the
value is the histogram's sums of the other bins plus the part of the bin itself.

The chosen bins (two or fewer for each series and percentile) are written to the shared folder
between the passes, so Spark knows their size and broadcasts them only under its threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

BINS_PER_OCTAVE = 1024
TOP = 1 << 40  # beyond the bin of any finite number


def value_bin(v: Column) -> Column:
    """Bin of a number: never falls when the number grows; null for null, the last bin for NaN."""
    # the least double is 2^-1074; infinity comes after all finite ones, log2(0) is null
    size = F.least(F.coalesce(F.log2(F.abs(v)), F.lit(0.0)), F.lit(1100.0)) + 1100.0
    return F.when(F.isnan(v), TOP).otherwise(F.floor(F.signum(v) * size * BINS_PER_OCTAVE))


def histogram(rows: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """(``keys``, ``bin``, ``n``, ``s``): count and sum of each bin of each series."""
    v = F.col(value)
    return rows.where(v.isNotNull()).groupBy(*keys, value_bin(v).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("s"))


def percentiles(rows: DataFrame, keys: Sequence[str], quantiles: dict[str, float], value: str = "v", beyond: bool = False) -> DataFrame:
    """One row per series with a value: ``keys`` and each percentile under its name in ``quantiles``.

    ``keys`` must not be null.  ``beyond`` adds for each name ``<name>_n_le, <name>_s_le, <name>_n_ge,
    <name>_s_ge``: count and sum of the values up to it and from it on."""
    keys = list(keys)
    if own_names := {"bin", "n", "s", "v", "c", "total", "before", "upto", "last"} & {*keys, *quantiles}:
        raise ValueError(f"rename {sorted(own_names)}")
    downwards = Window.partitionBy(*keys).orderBy(F.desc("bin"))
    in_series, whole = Window.partitionBy(*keys).orderBy("bin"), Window.partitionBy(*keys)
    so_far = in_series.rowsBetween(Window.unboundedPreceding, 0)
    no_sum = F.lit(None).cast("double")
    x = histogram(rows, keys, value).withColumns({
        "upto": F.sum("n").over(so_far), "total": F.sum("n").over(whole),
        "s_upto": F.sum("s").over(so_far) if beyond else no_sum,
        "s_from": F.sum("s").over(downwards.rowsBetween(Window.unboundedPreceding, 0)) if beyond else no_sum})
    place = {name: (F.col("total") - 1) * F.lit(float(q)) for name, q in quantiles.items()}
    ranks = {name: (F.floor(p), F.ceil(p)) for name, p in place.items()}
    before = F.col("upto") - F.col("n")

    def holds(rank: Column) -> Column:
        return (before <= rank) & (rank < F.col("upto"))

    wanted = F.lit(False)
    for lo, hi in ranks.values():
        wanted = wanted | holds(lo) | holds(hi)
    chosen = stored(x.where(wanted).select(
        *keys, "bin", "total", before.alias("before"), F.col("n").alias("bin_n"),
        (F.col("s_upto") - F.col("s")).alias("s_before"), (F.col("s_from") - F.col("s")).alias("s_after")), "chosen-bins")
    v = F.col(value)
    held = rows.where(v.isNotNull()).withColumn("bin", value_bin(v)).join(chosen, [*keys, "bin"])
    const = ("total", "before", "bin_n", "s_before", "s_after")
    held = held.groupBy(*keys, "bin", v.alias("v")).agg(F.count(F.lit(1)).alias("c"), *[F.min(k).alias(k) for k in const])
    in_bin = Window.partitionBy(*keys, "bin").orderBy("v")
    held = held.withColumn("last", F.col("before") + F.sum("c").over(in_bin.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    first = F.col("last") - F.col("c") + 1

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank <= F.col("last")), F.col("v"))).over(whole)

    held = held.withColumns({f"{name}_{side}": at(r) for name, pair in ranks.items() for side, r in zip(("lo", "hi"), pair)})
    out = {}
    for name, (lo, hi) in ranks.items():
        p, a, b = place[name], F.col(f"{name}_lo"), F.col(f"{name}_hi")
        out[name] = F.when((lo == hi) | (a == b), a).otherwise((hi - p) * a + (p - lo) * b)
    held = held.withColumns(out)
    aggs = [F.max(name).alias(name) for name in quantiles]
    for name, (lo, hi) in ranks.items() if beyond else ():
        q, c, vc = F.col(name), F.col("c"), F.col("v") * F.col("c")
        # the lowest of this percentile's bins starts at ``before``, the highest ends at ``before + bin_n``
        own = F.when((F.col("before") + F.col("bin_n") > lo) & (F.col("before") <= hi), True).otherwise(False)
        low, high = own & (F.col("before") <= lo), own & (F.col("before") + F.col("bin_n") > hi)
        aggs += [
            (F.max(F.when(low, F.col("before"))) + F.sum(F.when(own & (F.col("v") <= q), c).otherwise(0))).alias(f"{name}_n_le"),
            (F.max(F.when(low, F.col("s_before"))) + F.sum(F.when(own & (F.col("v") <= q), vc).otherwise(0.0))).alias(f"{name}_s_le"),
            (F.max(F.when(high, F.col("total") - F.col("before") - F.col("bin_n")))
             + F.sum(F.when(own & (F.col("v") >= q), c).otherwise(0))).alias(f"{name}_n_ge"),
            (F.max(F.when(high, F.col("s_after"))) + F.sum(F.when(own & (F.col("v") >= q), vc).otherwise(0.0))).alias(f"{name}_s_ge"),
        ]
    return held.groupBy(*keys).agg(*aggs)
