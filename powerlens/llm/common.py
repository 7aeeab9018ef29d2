"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

BATCH_ROWS = 512
BATCH_BYTES = 16 * 2**20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches that Python tasks hold, in rows and, as texts may be long, in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def word_ids(texts: pa.Array, encode_words: Callable[[list[str]], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts whose words, parted by single spaces, are encoded each by itself.

    Each different word of the batch is encoded once (``encode_words`` gives 32-bit
    ids as bytes).  Returns all ids and the texts' offsets in them."""
    lists = pc.split_pattern(texts, " ")
    words = lists.flatten().dictionary_encode()
    if not len(words):
        return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    one = pa.ListArray.from_arrays(pa.array([0, len(words.dictionary)], pa.int32()), words.dictionary)
    coded = encode_words(pc.binary_join(one, " ")[0].as_py().split(" "))  # faster than one object at a time
    sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
    ids = np.frombuffer(b"".join(coded), np.int32)
    at = words.indices.to_numpy(zero_copy_only=False)
    n = sizes[at]
    ends = np.cumsum(n)
    shift = (np.cumsum(sizes) - sizes)[at] - (ends - n)  # from a word's place in the result to its place in ids
    out = ids[np.repeat(shift, n) + np.arange(ends[-1])]
    stops = np.concatenate([[0], ends])
    return out, stops[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage (a lost executor re-reads files instead of recomputing)
    and lets several readers share one computation.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a variant that no column of ``df`` has (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def column(name: str):
    """Reference a column whose name may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that the caller is about to add under these names."""
    drop = {n.lower() for n in names}
    return df.select(*[column(c) for c in df.columns if c.lower() not in drop])


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph.

    ``edges`` has two non-null long columns ``a`` and ``b``.  Returns
    (``node``, ``root``), root being the smallest node of the component; nodes
    without an edge to another node do not appear.  Alternating large-star and
    small-star rounds (each two shuffles with map-side minimum) until the edge
    set is stable; each round is written to the shared folder, so nothing is
    collected and lineage stays short.
    """
    cur = stored(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        name,
    )
    state = _digest(cur)
    for _ in range(rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        # small star: every edge of ``large`` points from the larger node down
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                )
            ).alias("e")
        )
        small = small.select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct()
        cur = stored(small, name)
        now = _digest(cur)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components not stable after {rounds} rounds")
    leaves = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(roots).distinct()


def _digest(edges: DataFrame) -> tuple:
    """Row count and order-free hashes of an edge set (one row to the driver)."""
    return tuple(
        edges.agg(
            F.count(F.lit(1)),
            F.bit_xor(F.xxhash64("u", "v")),
            F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")),
        ).first()
    )
