"""Mixing sources to target weights (operator 1).

Temperature mixing: source i with n_i tokens gets the weight n_i^a / sum n^a.
The exponent a is the largest (closest to the natural shares) for which

* the entropy of the weights reaches ``target_entropy`` (a share of log K), and
* no source is repeated more often than ``max_repeats`` allows.

Both fall as a rises, so each is bisected; one pass over the table of sources
evaluates several exponents at a time.  The weights are then tokens to spend:
``budget`` in all, or without one as many as make the largest source pass once,
so that every row comes at least once.

Budgets are realised as block permutations.  A source's rows are dealt by hash
to blocks of about ``block_tokens``; each pass takes the blocks in an order of
its own (a hash of seed, pass and block), and the rows inside a block too.
Whole passes take everything, the last one stops at the row that reaches the
budget.  ``position`` is the share of the source's budget spent before the row:
ordering by it interleaves the sources, any stretch in the target weights.

Defined results: a null source is a source of its own; sources without any
token (empty or null texts only) have no weight and come once, at position 0;
an empty table gives an empty schedule.  Repeated rows count and come each by
itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, free_name, stored

BLOCK_TOKENS = 200_000
POINTS = 15  # exponents evaluated in one pass over the sources
BUCKETS = 64  # first level of the running sums over a source's blocks


def word_count(text: Column) -> Column:
    """Words of a text: runs of characters that are no white space."""
    bare = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(bare == "", 0).otherwise(F.length(bare) - F.length(F.replace(bare, F.lit(" "))) + 1).cast("long")


def weights(sources: DataFrame, exponents: list[float], largest: float) -> list[tuple[float, float]]:
    """For each exponent: sum of (n / largest)^a, and the entropy of the weights."""
    x = F.col("tokens") / F.lit(largest)
    aggs = []
    for a in exponents:
        p = F.pow(x, F.lit(a))
        aggs += [F.sum(p), F.sum(p * F.log(x))]
    row = sources.agg(*aggs).first()
    return [(row[2 * k], math.log(row[2 * k]) - a * row[2 * k + 1] / row[2 * k]) for k, a in enumerate(exponents)]


def exponent(sources: DataFrame, target_entropy: float, max_repeats: float, budget: int | None) -> tuple[float, float]:
    """Exponent and budget in tokens.  ``sources``: ``tokens`` > 0."""
    k, total, least, largest = sources.agg(F.count(F.lit(1)), F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    if not k:
        return 1.0, 0.0
    if budget is not None:
        budget = min(budget, max_repeats * total)  # all that the repeats allow

    def good(a: float, z: float, entropy: float) -> tuple[bool, bool]:
        spend = budget if budget is not None else z * largest
        repeats = spend * (least / largest) ** a / z / least
        return entropy >= target_entropy * math.log(k) - 1e-9, repeats <= max_repeats * (1 + 1e-9)

    def bisect(holds_above: bool, which: int) -> float:
        """The end of the exponents in [0, 1] for which a condition holds (holds_above: it holds from there up)."""
        low, high = 0.0, 1.0
        for _ in range(8):
            grid = [low + (high - low) * i / (POINTS + 1) for i in range(1, POINTS + 1)]
            holds = [good(a, *w)[which] for a, w in zip(grid, weights(sources, grid, largest), strict=True)]
            edges = [low, *grid, high]
            turn = holds.index(True) if holds_above and True in holds else holds.index(False) if not holds_above and False in holds else POINTS
            low, high = edges[turn], edges[turn + 1]
        return high if holds_above else low

    (z0, h0), (z1, h1) = weights(sources, [0.0, 1.0], largest)
    a = 1.0 if good(1.0, z1, h1)[0] else bisect(False, 0)
    if not good(0.0, z0, h0)[1]:  # the limit on repeats is the stronger
        a = max(a, bisect(True, 1))
    z = weights(sources, [a], largest)[0][0]
    return a, float(budget) if budget is not None else z * largest


def schedule(
    df: DataFrame,
    target_entropy: float,
    max_repeats: float,
    budget: int | None = None,
    seed: int = 0,
    block_tokens: int = BLOCK_TOKENS,
    source: str = "source",
    doc_id: str = "doc_id",
    text: str = "text",
    tokens: Column | None = None,
) -> DataFrame:
    """One row for each time a row of ``df`` is taken: ``doc_id``, ``source``, ``pass``,
    ``block``, ``n_tokens``, ``position`` (0 to 1) and ``row_key`` (digest of id, source and text)."""
    if not 0 <= target_entropy <= 1 or max_repeats < 1:
        raise ValueError("target_entropy from 0 to 1 and max_repeats >= 1 are needed")
    rows = df.select(
        column(doc_id).alias("doc_id"), column(source).alias("source"),
        (word_count(column(text)) if tokens is None else tokens.cast("long")).alias("n_tokens"),
        row_key(column(doc_id), column(source), column(text)).alias("row_key"),
    )
    rows = stored(rows, "mix-rows")  # narrow: no text
    name = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null"))
    rows = rows.withColumn("name", name)
    sources = stored(rows.groupBy("name").agg(F.sum("n_tokens").cast("double").alias("tokens")), "mix-sources")
    live = sources.where(F.col("tokens") > 0)
    a, spend = exponent(live, target_entropy, max_repeats, budget)
    z = live.agg(F.sum(F.pow("tokens", F.lit(a)))).first()[0] or 1.0
    plan = sources.select(
        "name", "tokens",
        F.when(F.col("tokens") > 0, F.lit(spend) * F.pow("tokens", F.lit(a)) / F.lit(z)).otherwise(0.0).alias("budget"),
        F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(block_tokens))).cast("long").alias("blocks"),
    )
    # whole passes and what is left; sources without tokens come once
    whole = F.floor(F.col("budget") / F.col("tokens") + 1e-9).cast("long")
    plan = plan.withColumn("whole", F.when(F.col("tokens") > 0, whole).otherwise(1))
    plan = plan.withColumn("left", F.greatest(F.lit(0.0), F.col("budget") - F.col("whole") * F.col("tokens")))
    plan = stored(plan.withColumn("left", F.when(F.col("left") > 1e-6 * F.col("tokens"), F.col("left")).otherwise(0.0)), "mix-plan")

    dealt = rows.join(plan, "name").withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "row_key"), F.col("blocks")))
    dealt = dealt.select("doc_id", "source", "n_tokens", "row_key", "name", "block")
    passes = F.sequence(F.lit(0), F.col("whole") - F.when(F.col("left") > 0, 0).otherwise(1))
    blocks = dealt.groupBy("name", "block").agg(F.sum("n_tokens").alias("block_size")).join(plan, "name")
    blocks = blocks.where((F.col("whole") > 0) | (F.col("left") > 0)).withColumn("pass", F.explode(passes))
    blocks = blocks.withColumn("rank", F.xxhash64(F.lit(seed), "pass", "name", "block"))
    blocks = stored(blocks.withColumn("bucket", F.shiftright("rank", 58)), "mix-blocks")  # 64 ranges of the rank
    firsts = blocks.groupBy("name", "pass", "bucket").agg(F.sum("block_size").alias("bucket_size"))
    up_to = Window.partitionBy("name", "pass").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(up_to), F.lit(0)))
    inside = Window.partitionBy("name", "pass", "bucket").orderBy("rank", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.join(firsts.drop("bucket_size"), ["name", "pass", "bucket"])
    blocks = blocks.withColumn("start", F.col("bucket_start") + F.coalesce(F.sum("block_size").over(inside), F.lit(0)))
    # of the last, partial pass only blocks that begin within the budget
    partial = F.col("pass") >= F.col("whole")
    blocks = blocks.where(~partial | (F.col("start") < F.col("left")))
    blocks = blocks.select("name", "block", "pass", "start", "tokens", "budget", F.when(partial, F.col("left")).alias("stop"))
    taken = dealt.join(blocks, ["name", "block"])
    within = Window.partitionBy("name", "block", "pass").orderBy(
        F.xxhash64(F.lit(seed), "pass", "row_key"), "row_key").rowsBetween(Window.unboundedPreceding, -1)
    taken = taken.withColumn("before", F.col("start") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    taken = taken.where(F.col("stop").isNull() | (F.col("before") < F.col("stop")))
    at = F.when(F.col("budget") > 0, (F.col("pass") * F.col("tokens") + F.col("before")) / F.col("budget")).otherwise(0.0)
    return taken.select("doc_id", "source", F.col("pass").cast("int").alias("pass"), "block", "n_tokens", at.alias("position"), "row_key")


def row_key(doc_id: Column, source: Column, text: Column) -> Column:
    parts = [F.coalesce(F.concat(F.lit("s"), c.cast("string")), F.lit("null")) for c in (doc_id, source)]
    return F.md5(F.concat_ws("|", *parts, text).cast("binary"))


def mixed(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The rows of ``df``, each as often as the schedule takes it; columns as before.

    Rows alike in id, source and text share their turns as evenly as can be."""
    key, times = free_name(df, "row_key"), free_name(df, "times")
    planned = schedule(df, doc_id=doc_id, source=source, text=text, **options)
    turns = planned.groupBy(F.col("row_key").alias(key)).agg(F.count(F.lit(1)).alias(times))
    rows = df.withColumn(key, row_key(column(doc_id), column(source), column(text))).join(turns, key)
    alike = Window.partitionBy(key)
    n, number = F.count(F.lit(1)).over(alike), F.row_number().over(alike.orderBy(key))
    own = F.floor(F.col(times) / n) + F.when(number <= F.col(times) % n, 1).otherwise(0)
    rows = rows.withColumn(times, own.cast("int")).where(column(times) > 0)
    return rows.withColumn(times, F.explode(F.sequence(F.lit(1), column(times)))).drop(key, times)
