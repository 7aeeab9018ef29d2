"""SimHash near-duplicates by multi-index hashing (operator 6).

Fingerprints: A-Z are lower-cased, words are parted by ASCII white space, and
every shingle of ``shingle`` words (repeats included; fewer words: the whole
sequence) is hashed with XXH64, seed 42.  A fingerprint bit is 1 if more than
half of the hashes have it.  A text without words has fingerprint zero.

Search: a fingerprint has two segments of 32 bits.  Of two fingerprints at most
``max_distance`` bits apart, one segment pair differs in at most half as many
bits, so each segment's Hamming ball of that radius is enumerated and looked up
in a table of the segments; every match is verified on all 64 bits.  Two balls
meet from both sides, so only the balls' points with no bit cleared are
enumerated for a single flip (the partner has that bit).

Exact copies share a fingerprint and are one row from the start.  A segment
value held by more than ``CROWD`` fingerprints is left out of the tables;
its fingerprints enumerate the ball of all 64 bits instead and look up whole
fingerprints, which costs a fixed number of rows for each, however many share
the segment.  No pair is lost either way.

Defined results: null text counts as empty; null ids are kept, and a component
without any id has a null ``component_id``; repeated ids each keep their row.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, components, free_name, small_batches, stored, without

CROWD = 1024
HASHES_AT_ONCE = 65_536


def fingerprint_of(text: str | None, shingle: int) -> int:
    """Signed 64-bit fingerprint of one text."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for first in range(0, n, HASHES_AT_ONCE):
        part = words[first:min(first + HASHES_AT_ONCE, n) + shingle - 1]
        rows = zip(*(part[k:] for k in range(min(shingle, len(part)))), strict=False)
        hashes = np.array([digest(b" ".join(r), 42) for r in rows], ">u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n).view(">u8")[0].astype(np.uint64).view(np.int64))


def with_fingerprint(df: DataFrame, shingle: int, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint as a long."""
    small_batches(df.sparkSession)

    @F.arrow_udf("bigint")
    def fingerprints(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(t, shingle) for t in texts.to_pylist()], pa.int64())

    return without(df, *([out] if out.lower() != text.lower() else [])).withColumn(out, fingerprints(column(text)))


def _masks(bits: int, radius: int) -> list[int]:
    """All flip masks of 1 to ``radius`` bits."""
    return [sum(1 << b for b in c) for r in range(1, radius + 1) for c in combinations(range(bits), r)]


def links(fingerprints: DataFrame, max_distance: int) -> DataFrame:
    """Pairs (``a``, ``b``), a < b, of distinct longs ``fp`` at most ``max_distance`` bits apart."""
    radius = max_distance // 2
    fp = F.col("fp")
    halves = F.array(
        F.struct(F.lit(0).alias("seg"), F.shiftrightunsigned(fp, 32).alias("key")),
        F.struct(F.lit(1).alias("seg"), fp.bitwiseAND(F.lit(0xFFFFFFFF)).alias("key")),
    )
    segments = fingerprints.select("fp", F.inline(halves))
    crowded = segments.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).select("seg", "key")
    crowded = stored(crowded, "crowded")
    tables = segments.join(crowded, ["seg", "key"], "left_anti")
    key = F.col("key")
    ball = [F.struct(key.alias("key"), F.lit(0).alias("flips"))]
    for m in _masks(32, radius):
        single = m & (m - 1) == 0
        hit = F.struct(key.bitwiseXOR(F.lit(m)).alias("key"), F.lit(1).alias("flips"))
        # of a pair one bit apart here, the one without the bit looks the other up
        ball.append(F.when(key.bitwiseAND(F.lit(m)) == 0, hit) if single else hit)
    probes = segments.select("seg", F.col("fp").alias("a"), F.explode(F.filter(F.array(*ball), lambda x: x.isNotNull())).alias("p"))
    probes = probes.select("seg", "a", F.col("p.key").alias("key"), F.col("p.flips").alias("flips"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    found = (
        probes.join(tables.withColumnRenamed("fp", "b"), ["seg", "key"])
        .where(((F.col("flips") > 0) | (F.col("a") < F.col("b"))) & (F.col("a") != F.col("b")) & (apart <= max_distance))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    )
    # fingerprints in crowded segments: their whole ball, looked up by the whole fingerprint
    many = segments.join(crowded, ["seg", "key"]).select("fp").distinct()
    near = many.select(fp.alias("a"), F.explode(_ball(fp, max_distance)).alias("b")).where(F.col("a") != F.col("b"))
    near = near.join(fingerprints.select(fp.alias("b")), "b")
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return found.unionByName(near).distinct()


def _ball(fp, max_distance: int):
    """Array of all 64-bit values within ``max_distance`` bits of ``fp``."""
    one = F.lit(1).cast("bigint")
    out = F.array(fp)
    for _ in range(max_distance):
        flipped = F.transform(out, lambda x: F.transform(
            F.sequence(F.lit(0), F.lit(63)), lambda b: x.bitwiseXOR(F.call_function("shiftleft", one, b))))
        out = F.array_distinct(F.concat(out, F.flatten(flipped)))
    return out


def classes(hashed: DataFrame, max_distance: int) -> DataFrame:
    """One row per distinct ``fp`` of ``hashed`` (``id``, ``fp``): ``root`` (any
    representative of its component) and ``component_id`` (smallest id of it)."""
    groups = stored(hashed.groupBy("fp").agg(F.min("id").alias("first")), "fingerprints")
    linked = components(links(groups.select("fp"), max_distance), "simhash-components")
    groups = groups.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
    groups = groups.select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = groups.groupBy("root").agg(F.min("first").alias("component_id"))
    return groups.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(
    df: DataFrame, shingle: int, max_distance: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``df``: ``doc_id``, ``fingerprint`` (16 hex digits) and
    ``component_id`` (the smallest id reachable over links, its own included)."""
    _check(shingle, max_distance)
    rows = df.select(column(doc_id).alias("id"), column(text).alias("text"))
    hashed = stored(with_fingerprint(rows, shingle, "text", "fp").select("id", "fp"), "simhash")
    return hashed.join(classes(hashed, max_distance).drop("root"), "fp").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, shingle: int, max_distance: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df``, one for each component: that with the smallest id (nulls
    last, ties by the text's digest; of rows alike in both any one)."""
    _check(shingle, max_distance)
    key = free_name(df, "row_key")
    digest = F.md5(F.concat_ws("|", F.coalesce(column(doc_id).cast("string"), F.lit("null")), column(text)).cast("binary"))
    rows = df.select(column(doc_id).alias("id"), column(text).alias("text"), digest.alias("key"))
    hashed = stored(with_fingerprint(rows, shingle, "text", "fp").select("id", "fp", "key"), "simhash")
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key")).alias("best")
    firsts = hashed.groupBy("fp").agg(best)  # before the join: hot fingerprints are one row from here on
    chosen = firsts.join(classes(hashed, max_distance), "fp").groupBy("root").agg(F.min("best").alias("best"))
    chosen = chosen.select(F.col("best.key").alias(key))
    return df.withColumn(key, digest).join(chosen, key, "left_semi").dropDuplicates([key]).drop(key)


def _check(shingle: int, max_distance: int) -> None:
    if shingle < 1 or not 0 <= max_distance <= 4:
        raise ValueError("shingle >= 1 and max_distance from 0 to 4 are needed")
