"""Token-id files with shuffled bit planes (operator 10).

A file holds the ids of a range of documents.  The ids are cut into blocks of
fixed size; each block is transposed into planes (bit planes, or byte planes),
every plane is compressed with zstandard by itself, and planes that are all
zero take no space.  An index at the end of the file has each block's place
and plane sizes and each document's id and length, so a reader can take any
block alone.

    magic | planes of block 0 | planes of block 1 | ... | index | index size (8 bytes) | magic
    index (zstandard, JSON): {"planes": "byte" | "bit", "blocks": [[place, ids, [plane sizes]]],
                              "docs": [[doc_id, ids]]}

Writing: documents are dealt to files by ranges of ``doc_id`` and sorted inside,
so the files in order of their number have all documents in ascending order
(null ids first, equal ids by the text's hash).  A task writes its file under a
name of its own and renames it when complete, so retries and lost executors
leave one whole file.  Tasks hold one block at a time.

Defined results: a null or empty text has only the end id; an empty table has
no files and an empty manifest.
"""

from __future__ import annotations

import functools
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, shared_path, small_batches, stored, word_ids

MAGIC = b"BITPLANE"
BLOCK_IDS = 65_536
CACHED_WORDS = 250_000
BATCH = 1024
MANIFEST = "file int, path string, n_docs bigint, n_ids bigint"


# ---- planes -----------------------------------------------------------------

def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """Transpose 32-bit ids: 4 byte planes or 32 bit planes; a plane of zeros is empty."""
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        rows = octets.T
    else:
        rows = np.packbits(np.unpackbits(octets, axis=1, bitorder="little").T, axis=1, bitorder="little")
    pack = zstandard.ZstdCompressor(level=3).compress
    return [pack(np.ascontiguousarray(r).tobytes()) if r.any() else b"" for r in rows]


def from_planes(packed: list[bytes], n: int, planes: str) -> np.ndarray:
    unpack = zstandard.ZstdDecompressor().decompress
    width = n if planes == "byte" else (n + 7) // 8
    rows = np.zeros((len(packed), width), np.uint8)
    for row, p in zip(rows, packed, strict=True):
        if p:
            row[:] = np.frombuffer(unpack(p, width), np.uint8)
    if planes == "byte":
        octets = rows.T
    else:
        octets = np.packbits(np.unpackbits(rows, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view("<u4").reshape(-1)


class Writer:
    """One file; holds at most one block of ids."""

    def __init__(self, out, planes: str, block_ids: int):
        self.out, self.planes, self.block_ids = out, planes, block_ids
        self.place, self.held, self.pending = len(MAGIC), 0, []
        self.blocks: list = []
        self.docs: list = []
        self.n_ids = 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.n_ids += len(ids)
        while len(ids):
            part = ids[: self.block_ids - self.held]
            ids = ids[len(part):]
            self.pending.append(part)
            self.held += len(part)
            if self.held == self.block_ids:
                self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        packed = to_planes(np.concatenate(self.pending), self.planes)
        self.blocks.append((self.place, self.held, [len(p) for p in packed]))
        for p in packed:
            self.out.write(p)
            self.place += len(p)
        self.held, self.pending = 0, []

    def close(self) -> None:
        self.flush()
        index = zstandard.ZstdCompressor(level=3).compress(
            json.dumps({"planes": self.planes, "blocks": self.blocks, "docs": self.docs}).encode())
        self.out.write(index)
        self.out.write(len(index).to_bytes(8, "little") + MAGIC)
        self.out.close()


def read_index(f) -> dict:
    end = f.size()
    tail = f.read_at(8 + len(MAGIC), end - 8 - len(MAGIC))
    if tail[8:] != MAGIC:
        raise ValueError("not a complete id file")
    size = int.from_bytes(tail[:8], "little")
    raw = f.read_at(size, end - 8 - len(MAGIC) - size)
    return json.loads(zstandard.ZstdDecompressor().decompressobj().decompress(raw))


def read_docs(f) -> Iterator[tuple[int | None, np.ndarray]]:
    """Documents of a file in its order, one block in memory (and a document's own ids)."""
    index = read_index(f)
    blocks = iter(index["blocks"])
    have = np.empty(0, np.uint32)
    for doc_id, n in index["docs"]:
        parts = []
        while n:
            if not len(have):
                place, count, sizes = next(blocks)
                packed = []
                for s in sizes:
                    packed.append(f.read_at(s, place) if s else b"")
                    place += s
                have = from_planes(packed, count, index["planes"])
            parts.append(have[:n])
            n -= len(parts[-1])
            have = have[len(parts[-1]):]
        yield doc_id, np.concatenate(parts) if parts else np.empty(0, np.uint32)


def _fs(path: str):
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


# ---- encoding ---------------------------------------------------------------

@functools.cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!#-&(-/:;=?@\[-`{-~"
#: Between a Latin-1 letter, which normalisation leaves alone but for case, and a mark ends a token.
BOUNDARY = f"([{LETTERS}])([{MARKS}])"
PLAIN = re.compile(f"[{LETTERS}]+|[{MARKS}]+")
PARTING = "0"  # a digit is a token by itself and is in no plain word


class WordEncoder:
    """Ids of whole texts.  Spaces and line feeds always part tokens and give none, and
    marks behind a letter begin a token; texts are cut there, and each word's ids
    are kept in a bounded cache.  New words of one kind of sign need no
    normalisation: many are encoded in one call, by the same model behind a plain
    split.  All other words are encoded by the tokenizer as they are."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        config = json.loads(self.tokenizer.to_str())
        config |= {"normalizer": None, "added_tokens": []}
        split = {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}
        config["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [split, config["pre_tokenizer"]["pretokenizers"][-1]]}
        self.model = type(self.tokenizer).from_str(json.dumps(config))
        self.special = [t["content"] for t in json.loads(self.tokenizer.to_str())["added_tokens"]]
        self.parting = self.tokenizer.encode(PARTING, add_special_tokens=False).ids
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _plain(self, words: list[str]) -> list[bytes]:
        """Encode many plain words in one call, parted by a token that they can't have."""
        ids = np.array(self.model.encode_batch_fast([f" {PARTING} ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.nonzero(ids == self.parting[0])[0].tolist()
        if len(self.parting) != 1 or len(ends) != len(words) - 1:
            raise ValueError("the tokenizer doesn't part words at white space and digits")
        return [ids[start:end].tobytes() for start, end in zip([0, *(e + 1 for e in ends)], [*ends, len(ids)], strict=True)]

    def encode_words(self, words: list[str]) -> list[bytes]:
        young, old = self.young, self.old
        out = list(map(young.get, words))
        plain, odd = [], []
        for k, ids in enumerate(out):
            if ids is None:
                w = words[k]
                known = old.get(w)
                if known is not None:
                    young[w] = out[k] = known
                elif PLAIN.fullmatch(w):
                    plain.append((w.lower(), k))
                else:
                    odd.append((w, k))
        if plain:
            plain.sort()
            alike = sorted({w for w, _ in plain})
            coded = dict(zip(alike, self._plain(alike), strict=True))
            for w, k in plain:
                young[words[k]] = out[k] = coded[w]
        if odd:
            for (w, k), e in zip(odd, self.tokenizer.encode_batch([w for w, _ in odd], add_special_tokens=False), strict=True):
                young[w] = out[k] = np.array(e.ids, "<u4").tobytes()
        if len(young) >= CACHED_WORDS:  # what is not used until the next turn is forgotten
            self.old, self.young = young, {}
        return out

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the texts' offsets in them."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        lower = pc.ascii_lower(texts)
        cut = pc.replace_substring_regex(lower, BOUNDARY, r"\1 \2")
        for s in self.special:  # these are tokens across such a boundary, in this case only
            cut = pc.if_else(pc.match_substring(lower, s), texts, cut)
        return word_ids(cut, self.encode_words)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch(pa.array([text], pa.string()))[0]


@functools.cache
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_ids(
    docs: DataFrame,
    tokenizer_path: str,
    path: str,
    end_id: int,
    doc_id: str = "doc_id",
    text: str = "text",
    planes: str = "byte",
    block_ids: int = BLOCK_IDS,
    files: int | None = None,
) -> DataFrame:
    """Encode every text, append ``end_id`` and write the files under ``path``.

    Returns the manifest: one row per file (``file``, ``path``, ``n_docs``,
    ``n_ids``), files numbered in ascending order of documents.
    """
    if planes not in ("byte", "bit"):
        raise ValueError("planes is byte or bit")
    spark = docs.sparkSession
    small_batches(spark, BATCH)
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(column(doc_id).cast("long").alias("doc_id"), column(text).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(files, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer = _encoder(tokenizer_path), None
        number = TaskContext.get().partitionId()
        end = np.array([end_id], np.int32)
        fs, folder = _fs(path)
        for batch in batches:
            ids, at = encoder.encode_batch(batch.column("text"))
            for k, d in enumerate(batch.column("doc_id").to_pylist()):
                if writer is None:
                    fs.create_dir(folder, recursive=True)
                    unfinished = f"{folder}/.{number:06d}-{uuid.uuid4().hex}"
                    writer = Writer(fs.open_output_stream(unfinished), planes, block_ids)
                writer.add(d, np.concatenate([ids[at[k]:at[k + 1]], end]))
        if writer is not None:
            writer.close()
            name = f"{folder}/{number:06d}.ids"
            fs.move(unfinished, name)
            yield pa.RecordBatch.from_pydict(
                {"file": pa.array([number], pa.int32()), "path": [f"{path.rstrip('/')}/{number:06d}.ids"],
                 "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_ids": pa.array([writer.n_ids], pa.int64())})

    return stored(rows.mapInArrow(write, MANIFEST), "manifest")


def read_ids(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Read the files: one row per document with ``doc_id``, ``start`` (ids of
    all documents before it), ``n_tokens`` and ``ids`` (binary, little-endian
    unsigned 32-bit)."""
    small_batches(spark)
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.withColumn("start", before.cast("long"))  # one row per file
    placed = placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                fs, name = _fs(f["path"])
                start, held, out = f["start"], 0, []
                with fs.open_input_file(name) as source:
                    for doc_id, ids in read_docs(source):
                        out.append((doc_id, start, len(ids), ids.astype("<u4").tobytes()))
                        start += len(ids)
                        held += len(ids)
                        if held >= 1_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                            held, out = 0, []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return placed.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def new_folder(spark: SparkSession) -> str:
    """A new folder for id files, as a URI, in the shared folder."""
    path = shared_path(spark, "ids")
    return path if "://" in path else f"file://{path}"
