"""Energy integration over irregular power samples.

Every operator works on all series at once; a series is identified by
``keys`` (default ``hostname, metric, fqdd``) and ordered by ``(ts, event_id)``.

Scale design
------------
The consecutive-pair step (``lag``) is the only order-dependent part.  A
window partitioned by the series alone would put a whole series into one task,
and one series may hold a large share of all rows.  So the window is
partitioned by ``(series, time bucket)`` (default one UTC day) and the pair
that crosses a bucket border is rebuilt from a per-bucket summary (first and
last reading, row count and in-bucket energy of every bucket: a hash
aggregate on the window's own partitioning).  The summary has one row per
series-bucket, so its window over the buckets of a series is tiny.

* totals (T3, T5: ``_series_totals``) need no join at all;
* pairs (T6: ``intervals``) are the in-bucket pairs plus one border pair per
  bucket;
* per-row outputs (T1, T2: ``_walk``) join the bucket offsets back on non-null
  surrogate keys, so the rows keep their partitioning;
* window energies (T14, K17) are as-of lookups of the windows' bounds (module
  ``asof``).

Both branches of a plan read the same projected columns below the shuffle,
so Spark reuses one exchange of the readings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import JOULES_PER_KWH
from ..functions.times import epoch_micros, within
from ..functions.units import with_power_w

SERIES = ("hostname", "metric", "fqdd")
SENTINEL = "\u0001"  # stands for a null key inside surrogate (non-null) partition keys
DAY_SECONDS = 86400
US = 1_000_000.0


def _lit_ts(t) -> Column:
    if t is None:
        return F.lit(None).cast("timestamp_ntz")
    if isinstance(t, Column):
        return t.cast("timestamp_ntz")
    return F.lit(str(t)).cast("timestamp_ntz")


def _keys(keys) -> list[str]:
    return list(keys) if keys is not None else list(SERIES)


def prepare(df: DataFrame, power: str = "power_w") -> DataFrame:
    """Add ``power_w`` (per-row unit) and ``_us`` (epoch micros) if missing."""
    if power not in df.columns:
        df = with_power_w(df, out=power)
    if "_us" not in df.columns:
        df = df.withColumn("_us", epoch_micros(F.col("ts")))
    if "event_id" not in df.columns:
        df = df.withColumn("event_id", F.lit(0).cast("bigint"))
    return df


def dedupe_timestamps(df: DataFrame, keys=None) -> DataFrame:
    """Q2: keep the first row (lowest ``event_id``) per series and timestamp.

    ``row_number`` over (series, timestamp): partitions are as fine as the
    timestamps, so a long series is spread over many tasks.
    """
    keys = _keys(keys)
    w = Window.partitionBy(*keys, "ts").orderBy("event_id")
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def _bucketed(df: DataFrame, keys: list[str], bucket_seconds: int) -> DataFrame:
    return df.withColumn("_b", F.floor(F.col("_us") / F.lit(int(bucket_seconds * US))))


def _bucket_pairs(df: DataFrame, keys: list[str], power: str, bucket_seconds: int, dedupe: bool):
    """In-bucket consecutive pairs and the per-bucket summary (first/last
    reading, row count), both from one sort of (series, bucket).

    Both branches read exactly the same projected columns, so the shuffle of
    the readings is planned once and reused (ReuseExchange)."""
    base = _bucketed(prepare(df, power), keys, bucket_seconds).select(
        *keys, "_b", F.col("_us").alias("t1_us"), F.col(power).alias("p1"), "event_id"
    )
    w = Window.partitionBy(*keys, "_b").orderBy("t1_us", "event_id")
    if dedupe:
        # equal timestamps are adjacent in the sort; keep the lowest event id.
        # The filter keeps the ordering, so the second window needs no new sort.
        base = (
            base.withColumn("_keep", F.coalesce(F.lag("t1_us").over(w) != F.col("t1_us"), F.lit(True)))
            .where(F.col("_keep"))
            .drop("_keep")
        )
    x = base.select(
        *keys,
        "_b",
        F.lag("t1_us").over(w).alias("t0_us"),
        F.lag("p1").over(w).alias("p0"),
        "t1_us",
        "p1",
        F.row_number().over(w).alias("_rn"),
    )
    inner = x.where(F.col("t0_us").isNotNull()).drop("_b", "_rn")
    # primitive (value, long ordinal) buffers: a HashAggregate on the window's partitioning
    o = F.col("_rn")
    summ = x.groupBy(*keys, "_b").agg(
        F.min("t1_us").alias("f_us"),
        F.min_by("p1", o).alias("f_p"),
        F.max("t1_us").alias("l_us"),
        F.max_by("p1", o).alias("l_p"),
        F.count(F.lit(1)).alias("n"),
    )
    return inner, summ


def intervals(
    df: DataFrame,
    keys=None,
    power: str = "power_w",
    bucket_seconds: int = DAY_SECONDS,
    dedupe: bool = False,
) -> DataFrame:
    """All consecutive reading pairs of every series.

    Returns ``keys + t0_us, p0, t1_us, p1, dt`` (dt in seconds).  Pairs with
    equal timestamps are kept (dt = 0) unless ``dedupe``; callers decide what
    to skip.
    """
    keys = _keys(keys)
    inner, summ = _bucket_pairs(df, keys, power, bucket_seconds, dedupe)
    wb = Window.partitionBy(*keys).orderBy("_b")
    border = summ.select(
        *keys,
        F.lag("l_us").over(wb).alias("t0_us"),
        F.lag("l_p").over(wb).alias("p0"),
        F.col("f_us").alias("t1_us"),
        F.col("f_p").alias("p1"),
    ).where(F.col("t0_us").isNotNull())
    pairs = inner.unionByName(border).withColumn("dt", (F.col("t1_us") - F.col("t0_us")) / US)
    return pairs


def _series_totals(
    df: DataFrame,
    keys: list[str],
    bucket_seconds: int = DAY_SECONDS,
    max_gap: Column | None = None,
    power: str = "power_w",
    sum_duplicates: bool = False,
) -> DataFrame:
    """Per series: trapezoid joules (``_trap_j``), kept-pair count, first and
    last reading and row count, without materialising the pairs.

    ``sum_duplicates`` first sums the readings of a series at one instant
    (devices of a host): the rows are hash-partitioned by (series, bucket)
    once, and that sum and the window below both use this partitioning.

    One sort of (series, bucket) gives each in-bucket pair's energy; the
    per-bucket summary (hash aggregate on that partitioning) sums them; a
    window over the few buckets of each series adds the border pairs; the
    final per-series aggregate runs on the same partitioning.  ``max_gap``
    (a column) keeps only pairs with 0 < dt <= max_gap (T5); without it all
    pairs count (T3).
    """
    df = _bucketed(prepare(df, power), keys, bucket_seconds)
    if sum_duplicates:
        extra = [F.first(c).alias(c) for c in ("_max_gap",) if c in df.columns and c not in keys]
        df = (
            df.repartition(*keys, "_b")
            .groupBy(*keys, "_b", "_us")
            .agg(F.sum(power).alias(power), F.min("event_id").alias("event_id"), *extra)
        )
    w = Window.partitionBy(*keys, "_b").orderBy("_us", "event_id")
    pu, pp = F.lag("_us").over(w), F.lag(power).over(w)
    x = df.withColumn("_pu", pu).withColumn("_pp", pp).withColumn("_rn", F.row_number().over(w))
    dt = (F.col("_us") - F.col("_pu")) / US
    ok = F.col("_pu").isNotNull()
    if max_gap is not None:
        ok = ok & (dt > 0) & (dt <= max_gap)
    x = x.withColumn("_ok", ok).withColumn("_e", F.when(F.col("_ok"), (F.col(power) + F.col("_pp")) / 2.0 * dt).otherwise(0.0))
    summ = x.groupBy(*keys, "_b").agg(
        F.min("_us").alias("_fu"),
        F.min_by(power, "_rn").alias("_fp"),
        F.max("_us").alias("_lu"),
        F.max_by(power, "_rn").alias("_lp"),
        F.sum("_e").alias("_t"),
        F.count_if("_ok").alias("_k"),
        F.count(F.lit(1)).alias("_n"),
    )
    wb = Window.partitionBy(*keys).orderBy("_b")
    bu, bp = F.lag("_lu").over(wb), F.lag("_lp").over(wb)
    summ = summ.withColumn("_bu", bu).withColumn("_bp", bp)
    bdt = (F.col("_fu") - F.col("_bu")) / US
    bok = F.col("_bu").isNotNull()
    if max_gap is not None:
        bok = bok & (bdt > 0) & (bdt <= max_gap)
    summ = summ.withColumn("_bok", bok).withColumn(
        "_be", F.when(F.col("_bok"), (F.col("_bp") + F.col("_fp")) / 2.0 * bdt).otherwise(0.0)
    )
    return summ.groupBy(*keys).agg(
        F.min("_fu").alias("first_us"),
        F.min_by("_fp", "_b").alias("first_p"),
        F.max("_lu").alias("last_us"),
        F.max_by("_lp", "_b").alias("last_p"),
        F.sum("_n").alias("n_rows"),
        (F.sum("_k") + F.count_if("_bok")).alias("n_pairs"),
        F.sum(F.col("_t") + F.col("_be")).alias("_trap_j"),
    )


def _walk(
    df: DataFrame,
    keys=None,
    power: str = "power_w",
    bucket_seconds: int = DAY_SECONDS,
) -> DataFrame:
    """Per row: previous reading of the series (``prev_us``, ``prev_p``),
    trapezoid joules from the series start (``_cum_j``) and a unique
    order-preserving ordinal (``_ord``).

    Plan: one exchange + sort of (series, bucket) computes lag, row number
    and the running sum in the bucket; a per-bucket summary (hash aggregate on
    the same partitioning) gives first/last reading and bucket total; a small
    window over the buckets of each series gives the border pair and the
    energy of all earlier buckets; one equi-join on non-null surrogate keys
    brings both back to the rows.
    """
    keys = _keys(keys)
    df = _bucketed(prepare(df, power), keys, bucket_seconds)
    sk = [f"_k{i}" for i in range(len(keys))]
    for name, k in zip(sk, keys):
        df = df.withColumn(name, F.coalesce(F.col(k).cast("string"), F.lit(SENTINEL)))
    w = Window.partitionBy(*sk, "_b").orderBy("_us", "event_id")
    x = (
        df.withColumn("_pu", F.lag("_us").over(w))
        .withColumn("_pp", F.lag(power).over(w))
        .withColumn("_rn", F.row_number().over(w))
    )
    x = x.withColumn(
        "_e", F.when(F.col("_pu").isNotNull(), (F.col(power) + F.col("_pp")) / 2.0 * ((F.col("_us") - F.col("_pu")) / US)).otherwise(0.0)
    ).withColumn("_run", F.sum("_e").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    summ = x.groupBy(*sk, "_b").agg(
        F.min("_us").alias("_fu"),
        F.min_by(power, "_rn").alias("_fp"),
        F.max("_us").alias("_lu"),
        F.max_by(power, "_rn").alias("_lp"),
        F.sum("_e").alias("_t"),
    )
    wb = Window.partitionBy(*sk).orderBy("_b")
    bu, bp = F.lag("_lu").over(wb), F.lag("_lp").over(wb)
    summ = summ.withColumn("_bu", bu).withColumn("_bp", bp)
    summ = summ.withColumn(
        "_border", F.when(F.col("_bu").isNotNull(), (F.col("_bp") + F.col("_fp")) / 2.0 * ((F.col("_fu") - F.col("_bu")) / US)).otherwise(0.0)
    )
    summ = summ.withColumn(
        "_off", F.sum(F.col("_t") + F.col("_border")).over(wb.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_t")
    ).select(*sk, "_b", "_bu", "_bp", "_off")
    y = x.join(summ, [*sk, "_b"], "left")
    head = F.col("_pu").isNull()
    y = (
        y.withColumn("prev_us", F.when(head, F.col("_bu")).otherwise(F.col("_pu")))
        .withColumn("prev_p", F.when(head, F.col("_bp")).otherwise(F.col("_pp")))
        .withColumn("_cum_j", F.col("_off") + F.col("_run"))
        .withColumn("_ord", F.col("_b") * F.lit(4294967296) + F.col("_rn"))
    )
    return y.drop(*sk, "_pu", "_pp", "_rn", "_e", "_run", "_bu", "_bp", "_off")


def with_previous(
    df: DataFrame,
    keys=None,
    power: str = "power_w",
    bucket_seconds: int = DAY_SECONDS,
) -> DataFrame:
    """Every row with the previous reading of its series (``prev_us``, ``prev_p``).

    Rows inside a bucket take ``lag``; the first row of a bucket takes the
    last row of the preceding non-empty bucket from the bucket summary.
    """
    return _walk(df, keys, power, bucket_seconds).drop("_cum_j")


def series_index(df: DataFrame, keys=None, bucket_seconds: int = DAY_SECONDS) -> DataFrame:
    """Every row with ``_idx``: its 0-based position in its series by (ts, event_id).

    Row number inside each (series, bucket) plus the number of rows in all
    earlier buckets of the series (a running sum over the small per-bucket
    counts), so no window spans a whole series.  The counts come back by an
    equi-join on non-null surrogate keys, which keeps the rows' partitioning.
    """
    keys = _keys(keys)
    df = _bucketed(prepare(df), keys, bucket_seconds)
    sk = [f"_k{i}" for i in range(len(keys))]
    for name, k in zip(sk, keys):
        df = df.withColumn(name, F.coalesce(F.col(k).cast("string"), F.lit(SENTINEL)))
    w = Window.partitionBy(*sk, "_b").orderBy("_us", "event_id")
    x = df.withColumn("_rn", F.row_number().over(w) - 1)
    cnt = x.groupBy(*sk, "_b").agg(F.count(F.lit(1)).alias("_n"))
    wb = Window.partitionBy(*sk).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cnt = cnt.select(*sk, "_b", F.coalesce(F.sum("_n").over(wb), F.lit(0)).alias("_off"))
    return x.join(cnt, [*sk, "_b"], "left").withColumn("_idx", F.col("_off") + F.col("_rn")).drop(*sk, "_off", "_rn")


def power_intervals(df: DataFrame, keys=None, bucket_seconds: int = DAY_SECONDS, _walked: DataFrame | None = None) -> DataFrame:
    """``time_diff_seconds``, ``avg_power_w``, ``energy_interval_kwh`` per row.

    The first row of each series has nulls (positional meaning, D2).
    """
    x = _walked if _walked is not None else _walk(df, keys, bucket_seconds=bucket_seconds)
    dt = (F.col("_us") - F.col("prev_us")) / US
    avg = (F.col("power_w") + F.col("prev_p")) / 2.0
    return (
        x.withColumn("time_diff_seconds", dt)
        .withColumn("avg_power_w", avg)
        .withColumn("energy_interval_kwh", avg * dt / JOULES_PER_KWH)
        .drop("prev_us", "prev_p")
    )


def cumulative_energy(df: DataFrame, keys=None, bucket_seconds: int = DAY_SECONDS) -> DataFrame:
    """Running kWh from 0.0 at the first row of each series.

    Running sum inside each bucket plus the energy of all earlier buckets and
    the border pair (from the small per-bucket summary), so no window spans a
    whole series.
    """
    x = power_intervals(df, _walked=_walk(df, keys, bucket_seconds=bucket_seconds))
    return x.withColumn("cumulative_energy_kwh", F.col("_cum_j") / JOULES_PER_KWH).drop("_cum_j")


# --------------------------------------------------------------------------
# Boundary-extended trapezoid, closed form


def boundary_parts(df: DataFrame, keys=None, bucket_seconds: int = DAY_SECONDS, sum_duplicates: bool = False) -> DataFrame:
    """Per series: trapezoid joules over all consecutive pairs plus the first
    and last reading (time and power) and the row count.  T3/T14/T15 are
    column arithmetic on this one frame (see ``_series_totals``)."""
    return _series_totals(df, _keys(keys), bucket_seconds, sum_duplicates=sum_duplicates).drop("n_pairs")


def boundary_kwh(start_us: Column, end_us: Column) -> Column:
    """T3 closed form over ``boundary_parts`` columns; null bounds = no extension."""
    lead = F.when(
        start_us.isNotNull() & (F.col("first_us") > start_us), F.col("first_p") * (F.col("first_us") - start_us) / US
    ).otherwise(0.0)
    tail = F.when(
        end_us.isNotNull() & (F.col("last_us") < end_us), F.col("last_p") * (end_us - F.col("last_us")) / US
    ).otherwise(0.0)
    return (lead + F.col("_trap_j") + tail) / JOULES_PER_KWH


def energy_boundary(
    df: DataFrame,
    keys=None,
    start=None,
    end=None,
    bucket_seconds: int = DAY_SECONDS,
    sum_duplicates: bool = False,
) -> DataFrame:
    """Trapezoid with synthetic boundary rows at the query bounds.

    Closed form per series: first power x (first - start) when the data start
    after ``start``, + trapezoid over all consecutive pairs, + last power x
    (end - last) when the data end before ``end``.  A single reading with both
    bounds gives p x (end - start) (D3); one reading without bounds gives 0.
    ``start``/``end`` are literals, or Columns of ``df`` that are constant per
    series (per-window bounds, T14).  Returns ``keys + energy_kwh, n_rows``.
    """
    keys = _keys(keys)
    df = prepare(df)
    if isinstance(start, Column) or isinstance(end, Column):
        # per-row bounds: they become part of the series key
        bound_cols = []
        for name, b in (("_start_us", start), ("_end_us", end)):
            df = df.withColumn(name, F.lit(None).cast("bigint") if b is None else epoch_micros(_lit_ts(b)))
            bound_cols.append(name)
        parts = boundary_parts(df, keys + bound_cols, bucket_seconds, sum_duplicates)
        e = boundary_kwh(F.col("_start_us"), F.col("_end_us"))
        return parts.select(*keys, e.alias("energy_kwh"), "n_rows", *bound_cols)
    # literal bounds: constants applied after the per-series aggregate
    s_us = F.lit(None).cast("bigint") if start is None else epoch_micros(_lit_ts(start))
    e_us = F.lit(None).cast("bigint") if end is None else epoch_micros(_lit_ts(end))
    parts = boundary_parts(df, keys, bucket_seconds, sum_duplicates)
    return parts.select(*keys, boundary_kwh(s_us, e_us).alias("energy_kwh"), "n_rows", s_us.alias("_start_us"), e_us.alias("_end_us"))


def energy_hold(df: DataFrame, keys=None, start=None, end=None) -> DataFrame:
    """T4: closed-form hold-first/hold-last energy, clamped at 0 (D3)."""
    r = energy_boundary(df, keys, start, end)
    return r.withColumn("energy_kwh", F.greatest(F.col("energy_kwh"), F.lit(0.0)))


# --------------------------------------------------------------------------
# Gap-limited trapezoid, total and per UTC day


def _gap_limit(df: DataFrame, max_gap_seconds) -> DataFrame:
    """Attach ``_max_gap``: a number, or 4 x cadence of the host's node type."""
    if max_gap_seconds is None:
        from ..constants import COMPUTE_SENSING_SECONDS, GAP_FACTOR, IRC_SENSING_SECONDS, PDU_SENSING_SECONDS

        nt = F.col("node_type")
        g = (
            F.when(nt == "irc", float(GAP_FACTOR * IRC_SENSING_SECONDS))
            .when(nt == "pdu", float(GAP_FACTOR * PDU_SENSING_SECONDS))
            .otherwise(float(GAP_FACTOR * COMPUTE_SENSING_SECONDS))
        )
        return df.withColumn("_max_gap", g)
    return df.withColumn("_max_gap", F.lit(float(max_gap_seconds)))


def kept_intervals(df: DataFrame, keys=None, max_gap_seconds=None, start=None, end=None, dedupe=False) -> DataFrame:
    """Intervals of T5/T6: readings clipped to [start, end], optional dedupe,
    then only pairs with 0 < dt <= max gap (strict ``>`` skips)."""
    keys = _keys(keys)
    df = _gap_limit(within(df, start, end), max_gap_seconds)
    pairs = intervals(df, keys + ["_max_gap"], dedupe=dedupe)
    return pairs.where((F.col("dt") > 0) & (F.col("dt") <= F.col("_max_gap")))


def energy_gap(df: DataFrame, keys=None, max_gap_seconds=None, start=None, end=None) -> DataFrame:
    """T5: trapezoid skipping intervals longer than the gap limit (and
    non-increasing time).

    Returns ``keys + energy_kwh`` for series with at least one kept interval.
    """
    keys = _keys(keys)
    df = _gap_limit(within(df, start, end), max_gap_seconds)
    t = _series_totals(df, keys + ["_max_gap"], max_gap=F.col("_max_gap"))
    return t.where(F.col("n_pairs") > 0).select(*keys, (F.col("_trap_j") / JOULES_PER_KWH).alias("energy_kwh"))


def day_pieces(pairs: DataFrame) -> DataFrame:
    """Split each interval at UTC midnights with linear interpolation.

    One output row per (interval, day touched): ``day`` (date) and ``piece_j``.
    An interval ending exactly at midnight belongs to the earlier day (D8).
    """
    t0 = F.timestamp_micros(F.col("t0_us")).cast("timestamp_ntz")
    t1m = F.timestamp_micros(F.col("t1_us") - 1).cast("timestamp_ntz")
    x = pairs.withColumn("day", F.explode(F.sequence(F.to_date(t0), F.to_date(t1m))))
    day_us = epoch_micros(F.col("day").cast("timestamp_ntz"))
    a = F.greatest(F.col("t0_us"), day_us)
    b = F.least(F.col("t1_us"), day_us + F.lit(DAY_SECONDS * 1_000_000))
    span = (F.col("t1_us") - F.col("t0_us")).cast("double")
    slope = (F.col("p1") - F.col("p0")) / span
    pa = F.col("p0") + slope * (a - F.col("t0_us"))
    pb = F.col("p0") + slope * (b - F.col("t0_us"))
    return x.withColumn("piece_j", (pa + pb) / 2.0 * ((b - a) / US))


def energy_daily(
    df: DataFrame,
    keys=None,
    max_gap_seconds=None,
    start=None,
    end=None,
    dedupe: bool = True,
) -> DataFrame:
    """Gap-limited trapezoid per series and UTC day (``date`` string)."""
    keys = _keys(keys)
    pairs = kept_intervals(df, keys, max_gap_seconds, start, end, dedupe=dedupe)
    return (
        day_pieces(pairs)
        .groupBy(*keys, "day")
        .agg((F.sum("piece_j") / JOULES_PER_KWH).alias("energy_kwh"))
        .withColumn("date", F.date_format("day", "yyyy-MM-dd"))
        .drop("day")
    )


# --------------------------------------------------------------------------
# T7-T13


def energy_simple(df: DataFrame, keys=None) -> DataFrame:
    """Mean power x span of the series (hours) -> kWh."""
    keys = _keys(keys)
    df = prepare(df)
    return df.groupBy(*keys).agg(
        (F.avg("power_w") * (F.max("_us") - F.min("_us")) / US / JOULES_PER_KWH).alias("energy_kwh"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def avg_power_from_energy(energy_kwh, hours) -> Column:
    """kWh / hours (= kW), 0 when the duration is not positive."""
    e = F.col(energy_kwh) if isinstance(energy_kwh, str) else energy_kwh
    h = F.col(hours) if isinstance(hours, str) else hours
    return F.when(h > 0, e / h).otherwise(F.lit(0.0))


def total_series(df: DataFrame, keys=("hostname", "metric"), device: str = "fqdd") -> DataFrame:
    """Sum over devices at each timestamp, labelled ``TOTAL``.

    Output has the input's columns: power summed (in watts), the device column
    set to 'TOTAL', ``event_id`` the smallest of the timestamp.
    """
    df = prepare(df)
    keys = list(keys)
    return (
        df.groupBy(*keys, "ts", "_us")
        .agg(F.sum("power_w").alias("power_w"), F.min("event_id").alias("event_id"))
        .withColumn(device, F.lit("TOTAL"))
    )


def energy_per_fqdd(df: DataFrame, start=None, end=None, keys=("hostname", "metric")) -> DataFrame:
    """Energy per device (duplicate timestamps of a device summed first),
    plus a ``TOTAL`` row per (host, metric) = sum of the device energies.

    Both come from one aggregate over grouping sets; ``is_total`` tells the total from a
    device of that name."""
    keys = list(keys)
    per_dev = energy_boundary(df, keys + ["fqdd"], start, end, sum_duplicates=True).select(*keys, "fqdd", "energy_kwh")
    names = [F.col(k) for k in keys]
    both = per_dev.groupingSets([[*names, F.col("fqdd")], names], *keys, "fqdd").agg(
        F.sum("energy_kwh").alias("energy_kwh"), (F.grouping("fqdd") == 1).alias("is_total"))
    return both.select(*keys, F.when(F.col("is_total"), "TOTAL").otherwise(F.col("fqdd")).alias("fqdd"), "energy_kwh", "is_total")


def mean_series(df: DataFrame) -> DataFrame:
    """Mean power per metric and timestamp (chart data)."""
    df = prepare(df)
    return df.groupBy("metric", "ts").agg(F.avg("power_w").alias("mean_power_w"), F.count(F.lit(1)).alias("n_hosts"))
