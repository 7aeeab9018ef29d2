"""Document fingerprints by invertible Bloom lookup sketches (operator 4).

DataFrame functions only.  A text's paragraphs (lines; longer ones are cut every
``WORDS`` words) are hashed to 64-bit digests.  A sketch has three sub-tables of
``WIDTH`` cells; each digest goes into one cell of each, which holds the number
of its digests, their exclusive or, and that of their check hashes.  The
fingerprint of a text is its sketch, written as hexadecimal digits.

Two versions are compared by subtracting their cells: what they share cancels.
Peeling then takes the digest of a cell with one digest left (count 1 or -1 and
a matching check hash) out of its other cells, until nothing is left; the
digests so recovered are the paragraphs that differ.  If cells are left over,
the sketch was too small: it is retried with four times the cells, by splitting
the digests on further hash bits into four sketches, and so on; only those that
failed go on.  Large texts begin with more sketches, so a row's work is bounded
by its own paragraphs and a sketch never holds many.

Likeness is shared / all paragraphs: (|A| + |B| - d) / (|A| + |B| + d) with d
recovered digests; two texts without paragraphs have likeness 1.

Defined results: null texts count as empty; of rows with equal ids the text's
hash decides the order, rows with a null id come last in descending order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, stored

WORDS = 24
WIDTH = 8  # cells of a sub-table, a power of two
TABLES = 3
ROUNDS = 10  # of peeling; more count as failure
FULL = 32  # digests of both versions in one sketch at the start, about
FIRST_SPLITS = 64  # most sketches that a row is dealt to at once
LEVELS = 32


def paragraphs(text: Column) -> Column:
    """Digests of a text's distinct paragraphs."""
    pieces = F.regexp_extract_all(text, F.lit(rf"(?:\S++[^\S\n]*+){{1,{WORDS}}}+"), F.lit(0))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(F.rtrim(p))))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _slot(check: Column, shift: Column) -> Column:
    """Cell, within a sub-table, of the digest with this check hash."""
    return F.call_function("shiftrightunsigned", check, shift).bitwiseAND(F.lit(WIDTH - 1).cast("bigint"))


def sketch(digests: Column, seed: Column) -> Column:
    """All cells, sub-table by sub-table: n (digests), k (their exclusive or), c (that of their checks)."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("c"))

    def cell(hashed: Column, at: Column) -> Column:
        shift, slot = F.floor(at / WIDTH).cast("int") * 8, at % WIDTH
        return F.aggregate(
            F.filter(hashed, lambda x: _slot(x["c"], shift) == slot), zero,
            lambda acc, x: F.struct((acc["n"] + 1).alias("n"), acc["k"].bitwiseXOR(x["k"]).alias("k"), acc["c"].bitwiseXOR(x["c"]).alias("c")))

    hashed = F.transform(digests, lambda d: F.struct(d.alias("k"), F.xxhash64(d, seed).alias("c")))
    return _let(hashed, lambda h: F.transform(F.sequence(F.lit(0), F.lit(TABLES * WIDTH - 1)), lambda at: cell(h, at)))


def subtracted(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(
        (x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["c"].bitwiseXOR(y["c"]).alias("c")))


def peeled(cells: Column, seed: Column) -> Column:
    """Digests recovered from subtracted cells: array of (n, k, c), n = 1 for those of
    the first version and -1 for the second's.  Null if cells are left over."""

    def take_out(state: Column, found: Column) -> Column:
        def cell(x: Column, at: Column) -> Column:
            shift, slot = F.floor(at / WIDTH).cast("int") * 8, at % WIDTH
            mine = F.filter(found, lambda p: _slot(p["c"], shift) == slot)
            return F.aggregate(mine, x, lambda acc, p: F.struct(
                (acc["n"] - p["n"]).alias("n"), acc["k"].bitwiseXOR(p["k"]).alias("k"), acc["c"].bitwiseXOR(p["c"]).alias("c")))

        return F.struct(F.transform(state["cells"], cell).alias("cells"), F.concat(state["found"], found).alias("found"),
                        (F.size(found) == 0).alias("done"))

    def peel(state: Column) -> Column:
        lone = F.filter(state["cells"], lambda x: (F.abs(x["n"]) == 1) & (F.xxhash64(x["k"], seed) == x["c"]))
        return _let(F.array_distinct(lone), lambda found: take_out(state, found))

    none = F.array().cast("array<struct<n:int,k:bigint,c:bigint>>")
    start = F.struct(cells.alias("cells"), none.alias("found"), F.lit(False).alias("done"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, _: F.when(s["done"], s).otherwise(peel(s)))
    return _let(end, lambda s: F.when(
        F.forall(s["cells"], lambda x: (x["n"] == 0) & (x["k"] == 0) & (x["c"] == 0)), s["found"]))


def written(cells: Column) -> Column:
    """A sketch as text: each cell's count, digests and checks in hexadecimal digits."""
    return F.array_join(F.transform(cells, lambda x: F.concat(
        F.lpad(F.hex(x["n"].cast("bigint")), 8, "0"), F.lpad(F.hex(x["k"]), 16, "0"), F.lpad(F.hex(x["c"]), 16, "0"))), "")


def _part(digests: Column, seed: Column, parts: Column, number: Column) -> Column:
    """The digests of one of ``parts`` (a power of two) sketches."""
    return F.filter(digests, lambda d: F.xxhash64(d, seed, F.lit(7)).bitwiseAND((parts - 1).cast("bigint")) == number)


def differences(pairs: DataFrame, start_full: int = FULL) -> DataFrame:
    """``key`` and ``differ``: how many digests are in just one of the arrays ``a`` and ``b``.

    One row per ``key`` of ``pairs``.  Every retry is written to the shared folder."""
    n = F.size("a") + F.size("b")
    wanted = F.pow(F.lit(4.0), F.greatest(F.lit(0.0), F.ceil(F.log(n / F.lit(float(start_full))) / F.log(F.lit(4.0))))).cast("int")
    parts = F.when(n <= start_full, 1).otherwise(F.least(F.lit(FIRST_SPLITS), wanted))
    todo, done = pairs.withColumns({c: F.coalesce(F.col(c), F.array().cast("array<bigint>")) for c in ("a", "b")}).withColumn("parts", parts), None
    for level in range(LEVELS):
        seed = F.lit(level)
        rows = todo.withColumn("number", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = rows.select("key", *[_part(F.col(c), seed, F.col("parts"), F.col("number")).alias(c) for c in ("a", "b")])
        found = peeled(subtracted(sketch(F.col("a"), seed), sketch(F.col("b"), seed)), seed)
        found = F.when(F.col("a") == F.col("b"), 0).otherwise(F.size(found))  # null where it failed
        kept = F.col("differ").isNull()
        rows = rows.withColumn("differ", found).select("key", "differ", *[F.when(kept, F.col(c)).alias(c) for c in ("a", "b")])
        rows = stored(rows, "peeled")
        part = rows.where(~kept).select("key", "differ")
        done = part if done is None else done.unionByName(part)
        todo = rows.where(kept).select("key", "a", "b", F.lit(4).alias("parts"))
        if todo.isEmpty():
            return done.groupBy("key").agg(F.sum("differ").cast("long").alias("differ"))
    raise RuntimeError(f"sketches not peeled after {LEVELS} sizes")


def likeness(n_a: Column, n_b: Column, differ: Column) -> Column:
    both = n_a + n_b
    return F.when(both == 0, 1.0).otherwise((both - differ) / (both + differ))


def with_next(docs: DataFrame, per_bucket: int) -> DataFrame:
    """Rows of ``doc_id``, ``text`` and other columns, with ``next``: the struct of all columns of the
    row that follows in descending order of the id (after the last: the first).

    The ids are cut into ranges at ids of the table itself; a row whose id is the largest
    of its range also goes to the range above, to be the last row's next one.  One
    shuffle of the rows, by range.
    """
    spark = docs.sparkSession
    buckets = max(1, min(per_bucket, 64 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    shares = [k / buckets for k in range(1, buckets + 1)]
    edges = docs.agg(F.percentile_approx("doc_id", shares, 20 * buckets)).first()[0]
    edges = sorted(set(edges or []))
    if not edges:
        edges = [0]
    step = max(1, int(len(edges) ** 0.5))
    coarse = edges[step - 1::step]  # two short searches instead of a long one
    fine = F.array(*[F.array(*map(F.lit, edges[k:k + step])) for k in range(0, len(edges), step)])
    group = F.size(F.filter(F.array(*map(F.lit, coarse)), lambda e: e < F.col("doc_id")))
    inside = F.size(F.filter(F.coalesce(F.get(fine, group), F.array().cast("array<bigint>")), lambda e: e < F.col("doc_id")))
    bucket = F.coalesce(F.when(F.col("doc_id").isNull(), 0).otherwise(group * step + inside), F.lit(0))
    edge = F.array_contains(F.coalesce(F.get(fine, group), F.array().cast("array<bigint>")), F.col("doc_id"))
    above = (F.col("bucket") + 1) % len(edges)
    places = F.when(F.coalesce(edge, F.lit(False)), F.array(
        F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest")), F.struct(above.alias("bucket"), F.lit(True).alias("guest")),
    )).otherwise(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"))))
    own = F.struct(*[column(c) for c in docs.columns])
    rows = docs.select(own.alias("own"), F.col("doc_id"), F.xxhash64("text").alias("tie"), bucket.alias("bucket"))
    rows = rows.select("own", "doc_id", "tie", F.inline(places))
    order = Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("doc_id"), "tie")
    # without any id there is no guest: then the first row follows the last one itself
    following = F.coalesce(F.lead("own").over(order), F.first("own").over(order))
    return rows.withColumn("next", following).where(~F.col("guest")).select("own.*", "next")


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and its edited text (its last third replaced by the
    beginning of the next document's), and their likenesses: ``doc_id``, ``n_chars``,
    ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``."""
    rows = docs.select(column(doc_id).cast("long").alias("doc_id"), F.coalesce(column(text), F.lit("")).alias("text"))
    rows = rows.withColumn("digests", paragraphs(F.col("text")))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(rows, 4 * partitions)
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next.text", F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "digests", F.col("next.digests").alias("next"), edited.alias("edited"))
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_chars", "digests", "next",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), paragraphs(F.col("edited")).alias("changed"))
    rows = stored(rows, "versions")
    pairs = rows.select(F.inline(F.array(*[
        F.struct(F.struct("row", F.lit(name).alias("with")).alias("key"), F.col("digests").alias("a"), F.col(name).alias("b"))
        for name in ("changed", "next")])))
    differ = differences(pairs).groupBy("key.row").agg(*[
        F.max(F.when(F.col("key.with") == name, F.col("differ"))).alias(f"differ_{name}") for name in ("changed", "next")])
    out = rows.join(differ, "row")
    zero = F.lit(0)
    return out.select(
        "doc_id", "n_chars", "edited_sha256",
        written(sketch(F.col("digests"), zero)).alias("fingerprint"), written(sketch(F.col("changed"), zero)).alias("edited_fingerprint"),
        likeness(F.size("digests"), F.size("changed"), F.col("differ_changed")).alias("near_edited"),
        likeness(F.size("digests"), F.size("next"), F.col("differ_next")).alias("near_next"))
