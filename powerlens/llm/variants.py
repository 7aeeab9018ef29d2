"""Spelling variants grouped by search schemes over FM-indexes (operator 13).

Words: maximal runs of Latin letters, A-Z lower-cased, counted over whole texts;
``vocabulary`` keeps those long and frequent enough.

Near words differ by exactly one inserted, deleted or replaced code point.  One
error leaves the left or the right half of a word untouched, so the search scheme
has two searches: the right half is matched exactly and extended to the left with
one error, and the left half is matched exactly and extended to the right with
one error.  Each search is a walk over intervals of suffix ranks of the delimited
text ``|w1|w2|...|``; the one to the right walks the index of the reversed words,
which is the other direction of the bidirectional index (with one error and two
halves no search turns round, so the two intervals need not be kept in step).

Spark deals the work by the half that must match: a word is looked up only in
the shard of its own half, and indexed under every half that a near word can
have (two for each direction).  Each shard is a bounded group with an index of its
own.  A half that more words share than a shard holds is cut into pieces by the
indexed words' hash; its words are looked up in each piece.  A task hands on one
row per word (number of near words, the best one), never the pairs.

Defined results: null and empty texts have no words; a null id is written
``null`` in the hash that deals the planted typos; repeated rows count again; of
near words of the same count the smallest in code-point order is the form; an
empty table gives no words; the input may have any further columns, the result
has only its own.  Very long texts are read in pieces cut between words.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, small_batches, stored

LEAST_LENGTH = 5
LEAST_COUNT = 3
SHARD = 40_000  # indexed words in a shard, about
FLUSH = 200_000  # different words that a task counts before it hands them on
PIECE = 1 << 20  # letters of a text that are split at once
FEW = 32  # interval size up to which its letters are read one by one

# one byte per code point: letters stay, A-Z go to lower case, all else parts words
LETTERS = bytes(b if 97 <= b <= 122 or b >= 0xC0 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def runs(text: str | None) -> Counter:
    """How often each lower-cased run of letters occurs, as Latin-1 bytes."""
    flat = (text or "").encode("latin-1", "replace").translate(LETTERS)
    out: Counter = Counter()
    at = 0
    while at < len(flat):
        end = flat.find(b" ", at + PIECE)
        end = len(flat) if end < 0 else end
        out.update(flat[at:end].split())
        at = end
    return out


def typo(word: bytes, seed: int, every: int | None) -> bytes:
    """``word``, less the code point at hash % length where ``every`` divides the hash."""
    if not every:
        return word
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), seed)
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def vocabulary(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, typo_every: int | None = None,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(``word``, ``n``): the words of at least ``least_length`` code points that occur
    at least ``least_count`` times.  ``typo_every`` plants a deletion in the runs whose hash,
    with the document's id, it divides (all occurrences of the run in that document)."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def flush() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in total], pa.string())
            out = pa.RecordBatch.from_arrays([words, pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                seed = zlib.crc32(f"{'null' if i is None else i}:".encode())
                for w, k in runs(t.as_py()).items():
                    if len(w) >= least_length:
                        w = typo(w, seed, typo_every)
                        if len(w) >= least_length:
                            total[w] += k
                if len(total) > FLUSH:
                    yield flush()
        yield flush()

    parts = docs.select(column(doc_id).cast("string").alias("i"), column(text).alias("t")).mapInArrow(count, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class SuffixRanks:
    """FM-index of distinct words: intervals of suffix ranks of ``|w1|w2|...|``, extended to the left.

    Code 0 is the delimiter; ``bound(c, i)`` is the first rank of the suffixes that put letter c
    before the suffixes from rank i on (count of smaller letters plus c's before rank i)."""

    def __init__(self, words: list[str]):
        text = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), np.uint32)
        self.alphabet, codes = np.unique(text, return_inverse=True)
        self.n = n = len(text)
        rank, width, longest = codes.astype(np.int64), 1, max(map(len, words)) + 2
        while True:  # prefix doubling; no pattern reaches further than the longest word and its delimiters
            key = rank * n + np.roll(rank, -width) if width < longest else rank
            order = np.argsort(key, kind="stable")
            if width >= longest:
                break
            rank = np.zeros(n, np.int64)
            rank[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
            width *= 2
        self.before = codes[order - 1].astype(np.int64)  # the letter in front of each suffix
        self.steps = np.sort(self.before * (n + 1) + np.arange(n))
        starts = np.nonzero(codes == 0)[0]
        self.word_at = np.searchsorted(starts, order)  # for a suffix that begins with the delimiter: the word behind it
        self.n_words = len(words)

    def bound(self, letter: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.steps, letter * (self.n + 1) + at)

    def codes_of(self, words: list[str], width: int) -> np.ndarray:
        """The words' letters from the last to the first, a row each, then 0; letters that the index lacks are -1."""
        out = np.zeros((len(words), width), np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer("".join(w[::-1] for w in words).encode("utf-32-le"), np.uint32)
        at = np.searchsorted(self.alphabet, flat).clip(max=len(self.alphabet) - 1)
        row = np.repeat(np.arange(len(words)), sizes)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.where(self.alphabet[at] == flat, at, -1)
        return out

    def letters_in(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval number, letter) for every different letter, delimiters apart, in front of an interval's suffixes."""
        size = hi - lo
        few = np.nonzero(size <= FEW)[0]
        reps = size[few]
        at = np.repeat(lo[few] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
        sigma = len(self.alphabet)
        pairs = [np.repeat(few, reps) * sigma + self.before[at]]
        many = np.nonzero(size > FEW)[0]
        if len(many):
            which, letter = np.repeat(many, sigma), np.tile(np.arange(sigma), len(many))
            pairs.append((which * sigma + letter)[self.bound(letter, lo[which]) < self.bound(letter, hi[which])])
        found = np.unique(np.concatenate(pairs))
        found = found[found % sigma > 0]
        return found // sigma, found % sigma

    def one_error(self, words: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) numbers, each once: the indexed words that end with the last ``exact`` letters
        of the query and become it by one change further to the left."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        x = self.codes_of(words, int(sizes.max()) + 2)
        q = np.arange(len(words))
        lo, hi = np.zeros(len(words), np.int64), np.full(len(words), self.n_words + 1, np.int64)
        for k in range(int(exact.max())):  # the half that must match
            on = np.nonzero((exact > k) & (lo < hi))[0]
            c = x[on, k]
            lo[on], hi[on] = self.bound(c, lo[on]), self.bound(c, hi[on])
            hi[on[c < 0]] = lo[on[c < 0]]
        pos = exact.astype(np.int64).copy()
        found = []
        while True:  # the other half: every error at this place, then one exact step
            on = np.nonzero(lo < hi)[0]
            q, pos, lo, hi = q[on], pos[on], lo[on], hi[on]
            if not len(q):
                break
            which, letter = self.letters_in(lo, hi)
            new_lo, new_hi = self.bound(letter, lo[which]), self.bound(letter, hi[which])
            inside = pos[which] < sizes[q[which]]
            other = inside & (letter != x[q[which], pos[which]])
            skip = np.nonzero(pos < sizes[q])[0]
            found.append(self._finish(
                x, sizes,
                np.concatenate([q[which], q[which][other], q[skip]]),
                np.concatenate([pos[which], pos[which][other] + 1, pos[skip] + 1]),  # inserted, replaced, deleted
                np.concatenate([new_lo, new_lo[other], lo[skip]]),
                np.concatenate([new_hi, new_hi[other], hi[skip]]),
            ))
            q, pos, lo, hi = q[skip], pos[skip], lo[skip], hi[skip]
            c = x[q, pos]
            lo, hi = self.bound(c, lo), np.where(c < 0, 0, self.bound(c, hi))
            pos = pos + 1
        pairs = np.unique(np.concatenate([np.empty(0, np.int64), *found]))
        return pairs // self.n_words, pairs % self.n_words

    def _finish(self, x, sizes, q, pos, lo, hi) -> np.ndarray:
        """Numbers query * words + word for the states whose rest and delimiter match exactly."""
        out = []
        while len(q):
            c = x[q, pos]
            end = pos == sizes[q]
            lo, hi = self.bound(c, lo), np.where(c < 0, 0, self.bound(c, hi))
            alive = lo < hi
            done = alive & end
            out.append(q[done] * self.n_words + self.word_at[lo[done]])  # words are distinct: one rank each
            go = alive & ~end
            q, pos, lo, hi = q[go], pos[go] + 1, lo[go], hi[go]
        return np.concatenate([np.empty(0, np.int64), *out])


def _search(backwards: bool, rows: pa.Table) -> pa.Table:
    """One shard: each looked-up word with its number of near words here and the best of them."""
    asked = rows.filter(pa.compute.field("asked"))
    index = rows.filter(~pa.compute.field("asked"))
    names, first = np.unique(np.array(index["s"].to_pylist(), object), return_index=True) if len(index) else ([], [])
    empty = {"word": [], "n_near": [], "form_n": [], "form": []}
    if not len(names) or not len(asked):
        return pa.table(empty, OUT)
    names = names.tolist()
    n = index["n"].to_numpy()[first]
    words = asked["s"].to_pylist()
    exact = asked["exact"].to_numpy()
    qi, wi = SuffixRanks(names).one_error(words, exact)
    pieces, piece = asked["pieces"].to_numpy(), asked["piece"].to_numpy()
    keep = np.ones(len(qi), bool)
    cut = np.nonzero(pieces[qi] > 1)[0]  # a word that lies here under another half counts in its own piece only
    crc = np.fromiter((zlib.crc32(names[w].encode()) for w in wi[cut]), np.int64, len(cut))
    keep[cut] = crc % pieces[qi[cut]] == piece[qi[cut]]
    if backwards:  # found by the other search as well if the rest also matches
        rest = [w[:len(w) - k] for w, k in zip(words, exact.tolist())]
        keep &= np.fromiter((not names[w].startswith(rest[q]) for q, w in zip(qi, wi)), bool, len(qi))
    qi, wi = qi[keep], wi[keep]
    if not len(qi):
        return pa.table(empty, OUT)
    plain = [w[::-1] for w in names] if backwards else names
    place = np.empty(len(plain), np.int64)
    place[sorted(range(len(plain)), key=plain.__getitem__)] = np.arange(len(plain))
    order = np.lexsort((place[wi], -n[wi], qi))
    qi, wi = qi[order], wi[order]
    at = np.nonzero(np.concatenate([[True], qi[1:] != qi[:-1]]))[0]
    return pa.table({
        "word": [words[q][::-1] if backwards else words[q] for q in qi[at]],
        "n_near": np.diff(np.append(at, len(qi))),
        "form_n": n[wi[at]],
        "form": [plain[w] for w in wi[at]],
    }, OUT)


OUT = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """For each word of ``words`` (distinct ``word``, ``n``) that has near words: ``n_near``, and of
    the near word of largest n (ties: the smallest) ``form`` and ``form_n``."""
    n_words = words.count()
    shards = max(1, -(-4 * n_words // shard))
    length = F.length("word")
    left = F.floor(length / 2).cast("int")
    # a near word has length m from length - 1 to length + 1; its half is then one of these
    lengths = F.filter(F.array(length - 1, length, length + 1), lambda m: m > 0)
    ways = [
        (F.lit(False), F.col("word"), (length - left).cast("int"), F.transform(lengths, lambda m: F.ceil(m / 2).cast("int"))),
        (F.lit(True), F.reverse("word"), left, F.transform(lengths, lambda m: F.floor(m / 2).cast("int"))),
    ]
    both = words.select("n", F.inline(F.array(*[
        F.struct(b.alias("backwards"), s.alias("s"), k.alias("exact"), F.array_distinct(ks).alias("halves")) for b, s, k, ks in ways])))
    half = F.expr("CASE WHEN exact > 0 THEN right(s, exact) ELSE '' END")
    index = both.select("backwards", "s", "n", F.explode("halves").alias("exact")).withColumn("half", half)
    asked = both.select("backwards", "s", "n", "exact").withColumn("half", half)
    crowded = index.groupBy("backwards", "half").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > shard)
    crowded = stored(crowded.select("backwards", "half", F.ceil(F.col("c") / shard).cast("int").alias("pieces")), "crowded-halves")
    pieces = F.coalesce("pieces", F.lit(1)).alias("pieces")
    index = index.join(crowded, ["backwards", "half"], "left").select("*", F.lit(False).alias("asked")).withColumn("pieces", pieces)
    index = index.withColumn("piece", F.pmod(F.crc32(F.col("s").cast("binary")), F.col("pieces")).cast("int"))
    asked = asked.join(crowded, ["backwards", "half"], "left").select("*", F.lit(True).alias("asked")).withColumn("pieces", pieces)
    asked = asked.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    names = ["backwards", "s", "n", "exact", "asked", "pieces", "piece"]
    rows = index.select(*names, "half").unionByName(asked.select(*names, "half"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("half", "piece"), F.lit(shards)).cast("int")).drop("half")

    def search(key: tuple, table: pa.Table) -> pa.Table:
        return _search(key[1].as_py(), table)

    found = rows.groupBy("shard", "backwards").applyInArrow(search, "word string, n_near bigint, form_n bigint, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("minus"), F.col("form"))).alias("best")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return found.select("word", "n_near", (-F.col("best.minus")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """(``word``, ``root``): the end of each word's chain of forms (``word``, ``form``, no circle).

    Each round doubles how far a word sees along its chain; as counts at least double from a
    word to its form, a handful of rounds is enough."""
    seen = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        nexts = seen.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = seen.join(nexts, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = stored(step, "forms")
        seen = step.drop("moved")
        if step.where("moved").isEmpty():
            return seen


def group(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = 2,
    typo_every: int | None = None, shard: int = SHARD, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per word: ``word``, ``form`` (its near word of largest count, if that is at least
    ``times`` its own; ``times`` >= 2), ``root`` (the end of the chain of forms, itself without one),
    ``n``, ``n_near`` (0 if none), ``form_n``."""
    if times < 2:
        raise ValueError("times must be at least 2: equal counts could form circles")
    words = stored(vocabulary(docs, least_length, least_count, typo_every, doc_id, text), "words")
    strong = F.col("form_n") >= times * F.col("n")
    all_words = stored(
        words.join(near_words(words, shard), "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(strong, F.col("form")).alias("form"), F.when(strong, F.col("form_n")).alias("form_n")),
        "near-words")
    ends = roots(all_words.where(F.col("form").isNotNull()))
    return all_words.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
