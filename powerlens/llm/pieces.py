"""SentencePiece BPE encoding and decoding (operator 2).

Encoding is linear in the text.  For every prefix of a chunk there is exactly
one token that the BPE encoding of this prefix can end with; the *prefix
table* stores it.  The candidates are the pieces that an Aho-Corasick
automaton finds ending at the prefix, and a candidate is the right one when
the encoding of what stands before it ends with a token that is *compatible*:
BPE on the two tokens' joined text gives back just these two.  The ids are
then read from the table backwards.

Texts are cut into chunks where no merge can cross: before a run of the
word mark, and around line feeds; both conditions are checked against the
vocabulary when the model is loaded.  The ids of short words are kept in a
bounded cache in the Python worker.

Defined results: null and empty texts give no ids; no ids decode to an empty
text; a null id list decodes to an empty text.  Extra columns pass through; a
column that has an output's name is replaced.
"""

from __future__ import annotations

import functools
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, small_batches, without, word_ids

MARK = "▁"
CACHED_WORDS = 250_000
BATCH = 2048  # rows; a batch's words are encoded once
CACHED_PAIRS = 1_000_000
LONGEST_CACHED = 48


class PieceModel:
    """Vocabulary of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte = [0] * 256
        self.is_byte = [False] * sp.get_piece_size()
        self.shown: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.is_byte[i] = True
                self.shown.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i):
                self.shown.append(b"")
            elif sp.is_unknown(i):
                self.shown.append(" ⁇ ".encode())
            else:
                self.score[piece] = sp.get_score(i)
                self.id[piece] = i
                self.shown.append(piece.replace(MARK, " ").encode())
        self.marked = {i for p, i in self.id.items() if p[0] == MARK}
        if not any(self.byte) or any(MARK in p.lstrip(MARK) or "\n" in p for p in self.id):
            raise ValueError("a BPE model with byte fallback, the word mark only in front and no line feed in pieces is needed")
        self.id_pairs: dict[int | tuple[str, str], bool] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            if self.merge(p) == [p]:  # pieces that BPE can make
                self.automaton.add_word(p, (p, len(p), i))
        self.automaton.make_automaton()

    def merge(self, text: str) -> list[str]:
        """BPE by its definition, for the few characters of a pair: join the best-scored, then leftmost pair."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: tuple[str, int, int], right: tuple[str, int, int]) -> bool:
        key = left[2] << 20 | right[2] if left[2] >= 0 else (left[0], right[0])
        if len(self.id_pairs) >= CACHED_PAIRS:
            self.id_pairs.clear()
        known = self.id_pairs[key] = self.merge(left[0] + right[0]) == [left[0], right[0]]
        return known

    def lone(self, char: str) -> tuple[str, int, int]:
        """A character that no other piece ends with; id -1 if it is written as bytes."""
        return char, 1, self.id.get(char, -1)

    def encode_chunk(self, chunk: str) -> list[int]:
        last: list[tuple[str, int, int] | None] = [None] * (len(chunk) + 1)
        pairs = self.id_pairs
        for end, found in self.automaton.iter(chunk):  # by end; all matches of a prefix come before later ends
            here = end + 1
            if last[here] is None:
                before = here - found[1]
                if before:
                    left = last[before]
                    if left is None:
                        left = last[before] = self.lone(chunk[before - 1])
                    fits = pairs.get(left[2] << 20 | found[2] if left[2] >= 0 else (left[0], found[0]))
                    if fits or fits is None and self.compatible(left, found):
                        last[here] = found
                else:
                    last[here] = found
        ids: list[int] = []
        at = len(chunk)
        while at:
            piece, size, i = last[at] or self.lone(chunk[at - 1])
            at -= size
            if i >= 0:
                ids.append(i)
            else:
                ids.extend([self.byte[b] for b in reversed(piece.encode())])
        ids.reverse()
        return ids

    def encode_word(self, word: str) -> bytes:
        """Ids, as 32-bit numbers, of a word and the mark before it."""
        return array("i", [i for c in CHUNK.findall(MARK + word) for i in self.encode_chunk(c)]).tobytes()

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words, each with a mark before it."""
        young, old = self.young, self.old
        out = list(map(young.get, words))
        for k, ids in enumerate(out):
            if ids is None:
                w = words[k]
                ids = old.get(w)
                if ids is None:
                    ids = self.encode_word(w)
                if len(w) <= LONGEST_CACHED:
                    young[w] = ids
                out[k] = ids
        if len(young) >= CACHED_WORDS:  # what is not used until the next turn is forgotten
            self.old, self.young = young, {}
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of any whole text; runs of marks go with the word behind."""
        if not text:
            return np.empty(0, np.int32)
        words = [c[1:] for c in WORDS.findall(MARK + text.replace(" ", MARK))]
        return np.frombuffer(b"".join(self.encode_words(words)), np.int32)

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the texts' offsets in them."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, f"^ |  |{MARK}|^$")  # more than single spaces between words
        if not pc.any(odd).as_py():
            return word_ids(texts, self.encode_words)
        ids, at = word_ids(texts.filter(pc.invert(odd)), self.encode_words)
        parts, plain = [], 0
        for text, is_odd in zip(texts.to_pylist(), odd.to_pylist(), strict=True):
            if is_odd:
                parts.append(self.encode(text))
            else:
                parts.append(ids[at[plain]:at[plain + 1]])
                plain += 1
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    def decode(self, ids: list[int]) -> str:
        shown = self.shown
        raw = b"".join(map(shown.__getitem__, ids))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self._decode_broken(ids)
        first = next((i for i in ids if shown[i]), None)  # the mark that encoding put in front goes
        return text[1:] if first in self.marked else text

    def _decode_broken(self, ids: list[int]) -> str:
        """Byte pieces that are no UTF-8: one replacement character for each wrong byte."""
        out, run = [], b""
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                run += self.shown[i]
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[:n].decode())
                        run = run[n:]
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    run = run[1:]
            if i is not None:
                out.append(self.shown[i].decode())
        return "".join(out)


CHUNK = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
WORDS = re.compile(f"{MARK}+[^{MARK}]*")


@functools.cache
def load(path: str) -> PieceModel:
    """One model for each Python worker."""
    return PieceModel(path)


def encode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids`` (array<int>): the BPE ids of the whole ``text``, no begin or end ids."""
    small_batches(df.sparkSession, BATCH)

    @F.arrow_udf("array<int>")
    def to_ids(texts: pa.Array) -> pa.Array:
        values, at = load(model_path).encode_batch(texts)
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int32()))

    return without(df, *([ids] if ids.lower() != text.lower() else [])).withColumn(ids, to_ids(column(text)))


def decode(df: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add ``text``: the decoded ``ids``."""
    small_batches(df.sparkSession, BATCH)

    @F.arrow_udf("string")
    def to_text(lists: pa.Array) -> pa.Array:
        model = load(model_path)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_pylist()
        flat, out, at = lists.flatten().to_numpy(zero_copy_only=False).tolist(), [], 0
        for n in sizes:
            out.append(model.decode(flat[at:at + n]))
            at += n
        return pa.array(out, pa.string())

    return without(df, *([text] if text.lower() != ids.lower() else [])).withColumn(text, to_text(column(ids)))
