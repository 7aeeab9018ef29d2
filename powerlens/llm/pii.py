"""Personal data by information-theoretic sanitisation (operator 5).

Base entities (e-mail and IP addresses, card and phone numbers) are protected.
A term near an entity can give it away as well: over the whole corpus, the
pointwise mutual information of term and entity

    PMI(t; e) = log( c(t, e) N / (c(t) c(e)) )

is compared with the entity's own information IC(e) = log(N / c(e)); the ratio
is the share of the entity's information that the term discloses.  c counts
documents: all that have the term, the entity, or the term within
``WINDOW`` words of the entity.  In documents that hold the entity, near terms
that disclose ``GENERALISE_AT`` or more are generalised (replaced by what kind of
word they are), from ``REMOVE_AT`` on removed.  Copies of one text prove nothing: a
pair counts from ``LEAST_SUPPORT`` different surroundings on, or with two if chance
does not explain it.  With m surroundings of the entity, s of them with a term that a
share p of all documents has, chance gives that with a probability of at most
(e m p / s)^s (Chernoff's bound); times the number of pairs it must stay under
``CHANCE``, and the entity's surroundings must differ in half of their terms or more.

An entity seen once has evidence by its groups: an e-mail address its local part and
its domain, an IP address its first three numbers, a card number its issuer, a phone
number all but its last four digits.  What a term tells about a group (the same PMI,
held against chance in the same way, by entities and texts instead of surroundings) it tells about each member,
as a share of the member's information.  One document alone with an entity and a word
that nothing else has proves nothing.  Documents without an entity stay as they are.

Spans count code points, end exclusive.  Base spans follow the patterns below,
leftmost and non-overlapping for each kind; matches that fail a check are
dropped.  Every pattern takes time linear in the text.

Defined results: null texts have no spans and stay null when sanitised; rows
that repeat get equal results; overlapping spans are replaced together, under
the first one's name.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, free_name, small_batches, stored

KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("generalise", "remove")
WINDOW = 8  # words on either side, within REACH code points
REACH = 400
LEAST_SUPPORT = 3
CHANCE = 0.05  # expected number of pairs in the corpus that count by chance
GENERALISE_AT = 0.7
REMOVE_AT = 0.9
COUNTED_AT_ONCE = 100_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
ZONE = re.compile(r"[0-9+][\x20().0-9+-]{6,}+")  # holds whole every ip, card and phone
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NO_DIGIT = re.compile(r"[^0-9]+")
WORD = re.compile(r"[^\W_]+")

SPAN = "struct<kind:string,start:int,end:int>"
NEAR = "struct<entity:bigint,around:bigint,term:string,start:int,end:int>"
MEMBER = "struct<entity:bigint,unit:bigint>"


def luhn(digits: str) -> bool:
    doubled = (2 * int(d) for d in digits[-2::-2])
    return (sum(d - 9 if d > 9 else d for d in doubled) + sum(map(int, digits[-1::-2]))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    found = []
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, 0, domain.end()))
            free = domain.end()
        at = text.find("@", at + 1)
    for zone in ZONE.finditer(text):
        low, high = zone.span()
        for m in IP.finditer(text, low, high):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text, low, high):
            digits = NO_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text, low, high):
            if 9 <= len(NO_DIGIT.sub("", m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return [(start, end, KINDS[k]) for start, k, end in sorted(found)]


def _entity(kind: str, raw: str) -> tuple[int, str]:
    """Id and value of the entity that a span names."""
    value = raw.lower() if kind in ("email", "ip") else NO_DIGIT.sub("", raw)
    return xxhash.xxh64_intdigest(f"{kind}:{value}", 1) - 2**63, value


def groups(kind: str, value: str) -> list[str]:
    """The groups that an entity belongs to by its value."""
    if kind == "email":
        local, _, domain = value.partition("@")
        return [f"local:{local}", f"domain:{domain}"]
    return [f"{kind}:" + {"ip": value.rpartition(".")[0], "card": value[:6], "phone": value[:-4]}[kind]]


def near_terms(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str, int, int]]:
    """(entity, surroundings, term, start, end) of the words near each span."""
    taken = [(s, e) for s, e, _ in spans]
    out = []
    for start, end, kind in spans:
        entity, _ = _entity(kind, text[start:end])
        low, high = max(0, start - REACH), min(len(text), end + REACH)
        before = [m for m in WORD.finditer(text, low, start) if m.start() > low or low == 0][-WINDOW:]
        after = [m for m in WORD.finditer(text, end, high) if m.end() < high or high == len(text)][:WINDOW]
        words = [m for m in (*before, *after) if not any(s < m.end() and m.start() < e for s, e in _close(taken, m.start(), m.end()))]
        around = xxhash.xxh64_intdigest(" ".join(m.group().lower() for m in words), 2) - 2**63
        out += [(entity, around, m.group().lower(), m.start(), m.end()) for m in words]
    return out


def _close(taken: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """The spans that may meet start to end: few, by search in the sorted list."""
    at = bisect_left(taken, (end, 0))
    return taken[max(0, at - 2 * len(KINDS)):at]


def _digest(text) -> F.Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _scan(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, digest of the text, base spans, near terms, entities' groups; stored, without texts."""

    @F.arrow_udf(f"struct<spans:array<{SPAN}>,near:array<{NEAR}>,members:array<{MEMBER}>>")
    def find(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts.to_pylist():
            spans = base_spans(t) if t else []
            near = near_terms(t, spans) if spans else []
            named = {(k, *_entity(k, t[s:e])) for s, e, k in spans}
            rows.append({
                "spans": [{"kind": k, "start": s, "end": e} for s, e, k in spans],
                "near": [{"entity": i, "around": a, "term": w, "start": s, "end": e} for i, a, w, s, e in near],
                "members": [{"entity": i, "unit": xxhash.xxh64_intdigest(g, 4) - 2**63} for k, i, v in sorted(named) for g in groups(k, v)],
            })
        span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        term = pa.struct([("entity", pa.int64()), ("around", pa.int64()), ("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        member = pa.struct([("entity", pa.int64()), ("unit", pa.int64())])
        return pa.array(rows, pa.struct([("spans", pa.list_(span)), ("near", pa.list_(term)), ("members", pa.list_(member))]))

    rows = df.select(column(doc_id).alias("doc_id"), _digest(column(text)).alias("digest"), find(column(text)).alias("found"))
    return stored(rows.select("doc_id", "digest", "found.spans", "found.near", "found.members"), "pii")


def document_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``term``, ``n``: in how many rows of ``df`` a word (lower case) stands; counted in part by each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"term": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})
            seen.clear()
            return out

        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(set(WORD.findall(t.lower())) if t else ())
                if len(seen) >= COUNTED_AT_ONCE:
                    yield flush()
        yield flush()

    return df.select(column(text)).mapInArrow(count, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def disclosing(df: DataFrame, scanned: DataFrame, text: str = "text") -> DataFrame:
    """(``digest``, ``terms``): for each text with such terms, array of (kind, start, end)."""
    near = scanned.select("digest", F.explode("near").alias("x")).select("digest", "x.*")
    rows = scanned.agg(F.count(F.lit(1))).first()[0]
    # rows of one text count by their number: copies are pre-aggregated
    copies = scanned.where(F.size("near") > 0).groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
    texts = stored(near.distinct(), "near")
    # units: the entities themselves and their groups of two or more
    members = stored(scanned.select(F.explode("members").alias("x")).select("x.*").distinct(), "members")
    shared = members.groupBy("unit").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1).select("unit")
    members = stored(members.join(shared, "unit"), "groups")
    uses = texts.select("digest", "entity", "around", "term").distinct()
    uses = uses.select("digest", F.col("entity").alias("unit"), "around", "term", F.lit(False).alias("group")).unionByName(
        uses.join(members, "entity").select("digest", "unit", F.col("entity").alias("around"), "term", F.lit(True).alias("group")).distinct())
    uses = stored(uses, "uses")
    support = uses.select("unit", "group", "term", "around").distinct().groupBy("unit", "group", "term").agg(F.count(F.lit(1)).alias("support"))
    support = stored(support, "support")
    tests = support.count()
    spread = uses.select("unit", "around").distinct().groupBy("unit").agg(F.count(F.lit(1)).alias("arounds"))
    repeats = support.groupBy("unit").agg(F.avg((F.col("support") > 1).cast("int")).alias("alike"))
    held = support.where(F.col("support") >= 2)
    together = uses.join(held.select("unit", "term"), ["unit", "term"], "left_semi").select("digest", "unit", "term").distinct()
    together = together.join(copies, "digest").groupBy("unit", "term").agg(
        F.sum("copies").alias("both"), F.count(F.lit(1)).alias("texts"))
    units = uses.select("digest", "unit").distinct().join(copies, "digest").groupBy("unit").agg(F.sum("copies").alias("n_unit"))
    pairs = held.join(together, ["unit", "term"]).join(units.join(spread, "unit").join(repeats, "unit"), "unit")
    times = F.when(F.col("group"), F.least("support", "texts")).otherwise(F.col("support"))

    def counts_with(n: str):
        """Whether a pair counts if n documents have its term."""
        expected = F.col("arounds") * F.col(n) / F.lit(float(max(rows, 1))) / times
        by_chance = times * (1 + F.log(expected)) + F.lit(math.log(max(tests, 1)))
        proven = (expected < 1) & (by_chance <= math.log(CHANCE)) & (F.col("group") | (F.col("alike") <= 0.5))
        return proven | ~F.col("group") & (F.col("support") >= LEAST_SUPPORT)

    # a term has at least the documents where it stands near: what fails with these needs no count
    pairs = stored(pairs.where(counts_with("both")), "pairs")
    counts = document_counts(df, text).join(pairs.select("term").distinct(), "term", "left_semi")
    pairs = pairs.join(counts, "term").where(counts_with("n"))
    pmi = F.log(F.col("both") * F.lit(float(rows)) / (F.col("n") * F.col("n_unit")))
    pairs = stored(pairs.select("unit", "group", "term", pmi.alias("pmi")).where(F.col("pmi") > 0), "informative")
    own = pairs.where(~F.col("group")).select(F.col("unit").alias("entity"), "term", "pmi")
    pooled = pairs.where("group").join(members, "unit").select("entity", "term", "pmi")
    best = own.unionByName(pooled).groupBy("entity", "term").agg(F.max("pmi").alias("pmi"))
    entities = units.withColumnsRenamed({"unit": "entity", "n_unit": "n_entity"})
    ic = F.log(F.lit(float(max(rows, 1))) / F.col("n_entity"))
    share = F.when(ic > 0, F.col("pmi") / ic).otherwise(0.0)
    pairs = best.join(entities, "entity").select("entity", "term", share.alias("share")).where(F.col("share") >= GENERALISE_AT)
    hit = texts.join(pairs, ["entity", "term"]).groupBy("digest", "start", "end").agg(F.max("share").alias("share"))
    kind = F.when(F.col("share") >= REMOVE_AT, TERM_KINDS[1]).otherwise(TERM_KINDS[0])
    return stored(hit.groupBy("digest").agg(F.collect_list(F.struct(kind.alias("kind"), "start", "end")).alias("terms")), "terms")


def find(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: ``doc_id``, ``base`` and ``spans``, arrays of (kind,
    start, end) by start, then kind as listed (base kinds, then ``TERM_KINDS``)."""
    small_batches(df.sparkSession)
    scanned = _scan(df, doc_id, text)
    terms = disclosing(df, scanned, text)
    out = scanned.select("doc_id", "digest", "spans").join(terms, "digest", "left")
    order = F.array(*map(F.lit, KINDS + TERM_KINDS))
    both = F.concat("spans", F.coalesce("terms", F.array().cast(f"array<{SPAN}>")))
    ranked = F.array_sort(F.transform(both, lambda x: F.struct(
        x["start"].alias("start"), F.array_position(order, x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))
    ordered = F.transform(ranked, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return out.select("doc_id", F.col("spans").alias("base"), ordered.alias("spans"))


def replaced(text: str, extra: list[tuple[int, int, str]]) -> str:
    """The text with its base spans and ``extra`` spans (start, end, kind) replaced."""
    out, at, held = [], 0, None
    for start, end, kind in sorted([*base_spans(text), *extra], key=lambda x: (x[0], (KINDS + TERM_KINDS).index(x[2]))):
        if held and start < held[1]:
            held = (held[0], max(end, held[1]), held[2])
            continue
        if held:
            at = _write(out, text, at, held)
        held = (start, end, kind)
    if held:
        at = _write(out, text, at, held)
    return "".join([*out, text[at:]])


def _write(out: list[str], text: str, at: int, span: tuple[int, int, str]) -> int:
    start, end, kind = span
    out.append(text[at:start])
    if kind == "generalise":
        word = text[start:end]
        out.append("[NUMBER]" if word.isdigit() else "[NAME]" if word[0].isupper() else "[WORD]")
    elif kind != "remove":
        out.append(f"[{kind.upper()}]")
    return end


def sanitise(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with entities and disclosing terms replaced in ``text``; all rows and columns stay."""
    small_batches(df.sparkSession)
    terms = disclosing(df, _scan(df, doc_id, text), text)
    key, extra = free_name(df, "digest"), free_name(df, "terms")
    terms = terms.select(F.col("digest").alias(key), F.col("terms").alias(extra))

    @F.arrow_udf("string")
    def replace(texts: pa.Array, extras: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), extras.to_pylist(), strict=True)
        return pa.array([t and replaced(t, [(x["start"], x["end"], x["kind"]) for x in e or ()]) for t, e in rows], pa.string())

    joined = df.withColumn(key, _digest(column(text))).join(terms, key, "left")
    return joined.select(*[(replace(column(c), column(extra)).alias(c) if c.lower() == text.lower() else column(c)) for c in df.columns])
