"""Near-duplicate vectors by PCA-ordered tiled comparison (operator 7).

All vectors are compared by cosine.  Equal vectors are one row from the start
(their count goes along).  The rest is rotated to principal axes, which keeps
every product, so that leading dimensions carry the most.  Vectors are dealt
to tiles of bounded size by their first coordinate; a pair of tiles whose first
coordinates are too far apart for any pair to reach the threshold is never
formed.  A task compares one pair of tiles in blocks: it adds up the leading
dimensions, bounds what is left by the product of the suffix norms, drops a
pair as soon as this cannot reach the threshold, and computes the cosine of
the survivors from the original vectors in double precision.

A task gives back, for each vector, how many vectors it is linked to and one
edge to a representative of its local component; pairs are never listed, so a
group of many near copies costs rows in proportion to its size.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different length link with nothing
(each length is compared by itself); a null id keeps its row and is never a
component's id unless no other is there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, components, small_batches, stored

TILE = 8192  # vectors of a tile, about
BLOCK = 1024
CUTS = (0.375, 0.625)  # shares of the dimensions after which pairs are dropped
DENSE = 0.02  # share of survivors from which a block is computed as a whole
SLACK = 1e-4  # above the rounding of the single-precision leading sums
JITTER = 1e-6  # parts vectors whose first coordinates are equal


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # no overflow in the squares
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def principal_axes(reps: DataFrame, dim: int) -> np.ndarray:
    """Orthonormal axes, by falling second moment over all vectors (dim x dim reaches the driver)."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            if b.num_rows:
                u = _unit(_matrix(b.column(0), dim))
                total += u.T @ u
        yield pa.RecordBatch.from_pydict({"r": pa.array(range(dim), pa.int32()), "v": pa.array(list(total))})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"r": [int(pdf["r"].iloc[0])], "v": [np.sum(np.stack(pdf["v"]), axis=0)]})

    rows = reps.select("vector").mapInArrow(moments, "r int, v array<double>").groupBy("r").applyInPandas(add, "r int, v array<double>")
    total = np.zeros((dim, dim))
    for row in rows.collect():
        total[row["r"]] = row["v"]
    return np.linalg.eigh(total)[1][:, ::-1].copy()


class _Forest:
    """Union-find over the positions of a tile pair, fed with arrays of links."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def flat(self) -> np.ndarray:
        while True:
            nxt = self.up[self.up]
            if np.array_equal(nxt, self.up):
                return self.up
            self.up = nxt

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        roots = self.flat()
        a, b = roots[i], roots[j]
        codes = np.unique((np.minimum(a, b) * len(roots) + np.maximum(a, b))[a != b])
        for code in codes.tolist():
            x, y = divmod(code, len(roots))
            while self.up[x] != x:
                x = self.up[x]
            while self.up[y] != y:
                y = self.up[y]
            self.up[max(x, y)] = min(x, y)


def compare(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of pairs of unit vectors with cosine >= ``threshold``; of one tile i < j only."""
    dim = a.shape[1]
    cuts = sorted({min(dim, max(1, round(c * dim))) for c in CUTS})
    ra, rb = a @ axes, b @ axes
    rest = [(np.sqrt((ra[:, c:] ** 2).sum(1)), np.sqrt((rb[:, c:] ** 2).sum(1))) for c in cuts]
    lead_a, lead_b = ra[:, : cuts[0]].astype(np.float32), rb[:, : cuts[0]].astype(np.float32)
    rest_a, rest_b = (r.astype(np.float32) for r in rest[0])
    for x in range(0, len(a), BLOCK):
        sx = slice(x, x + BLOCK)
        for y in range(x if same else 0, len(b), BLOCK):
            sy = slice(y, y + BLOCK)
            bound = lead_a[sx] @ lead_b[sy].T
            bound += np.multiply.outer(rest_a[sx], rest_b[sy])
            alive = bound >= threshold - SLACK
            if np.count_nonzero(alive) > DENSE * alive.size:
                i, j = np.nonzero(a[sx] @ b[sy].T >= threshold)
                i, j = i + x, j + y
            else:
                i, j = np.nonzero(alive)
                i, j = i + x, j + y
                for (na, nb), c in zip(rest[1:], cuts[1:], strict=True):
                    partial = np.einsum("ij,ij->i", ra[i, :c], rb[j, :c])
                    ok = partial + na[i] * nb[j] >= threshold - SLACK
                    i, j = i[ok], j[ok]
                ok = np.einsum("ij,ij->i", a[i], b[j]) >= threshold
                i, j = i[ok], j[ok]
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j


def _linked(reps: DataFrame, dim: int, threshold: float) -> DataFrame:
    """For the vectors of one length: (``node``, ``linked``, ``other``), see above."""
    spark = reps.sparkSession
    axes = principal_axes(reps, dim)
    first = axes[:, 0].copy()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unit = _unit(_matrix(b.column("vector"), dim)) if b.num_rows else np.empty((0, dim))
            node = b.column("node").to_numpy()
            spread = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            at = unit @ first + spread.astype(np.float64) / 2**24 * JITTER
            yield pa.RecordBatch.from_pydict(
                {"node": b.column("node"), "n": b.column("n"), "at": pa.array(at), "unit": pa.array([u.tobytes() for u in unit], pa.binary())})

    placed = stored(reps.select("node", "n", "vector").mapInArrow(place, "node bigint, n bigint, at double, unit binary"), "placed")
    tiles = max(1, -(-placed.count() // TILE))
    shares = [k / tiles for k in range(1, tiles)]
    edges = placed.agg(F.percentile_approx("at", shares, 100 * tiles)).first()[0] if shares else []
    tile = sum((F.when(F.col("at") > e, 1).otherwise(0) for e in edges), F.lit(0)) if len(edges) < 50 else F.size(
        F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col("at")))
    placed = placed.withColumn("tile", tile)
    spans = {r["tile"]: (r["lo"], r["hi"]) for r in placed.groupBy("tile").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).collect()}
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + 2 * JITTER  # no farther apart on any axis
    partners = {
        t: [f"{min(t, u)}-{max(t, u)}" for u in spans if max(spans[t][0], spans[u][0]) - min(spans[t][1], spans[u][1]) <= reach]
        for t in spans
    }
    pairs = spark.createDataFrame([(t, p) for t, p in partners.items()], "tile int, pairs array<string>")
    dealt = placed.join(F.broadcast(pairs), "tile").withColumn("pair", F.explode("pairs")).drop("pairs", "at")  # a row per tile

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        one, two = map(int, key[0].split("-"))
        parts = [pdf[pdf["tile"] == t] for t in dict.fromkeys((one, two))]
        unit = [np.frombuffer(b"".join(p["unit"]), np.float64).reshape(-1, dim) for p in parts]
        nodes = np.concatenate([p["node"].to_numpy() for p in parts])
        n = np.concatenate([p["n"].to_numpy() for p in parts])
        shift = 0 if one == two else len(parts[0])
        linked, forest = np.zeros(len(nodes), np.int64), _Forest(len(nodes))
        for i, j in compare(unit[0], unit[-1], axes, threshold, one == two):
            j = j + shift
            linked += np.bincount(i, n[j], len(nodes)).astype(np.int64)
            linked += np.bincount(j, n[i], len(nodes)).astype(np.int64)
            forest.link(i, j)
        hit = np.nonzero(linked)[0]
        return pd.DataFrame({"node": nodes[hit], "linked": linked[hit], "other": nodes[forest.flat()[hit]]})

    return dealt.groupBy("pair").applyInPandas(join, "node bigint, linked bigint, other bigint")


def near_duplicates(df: DataFrame, threshold: float, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links`` (other vectors linked directly),
    ``component_id`` (smallest id reachable, its own included) and ``kept``
    (its id is the component's)."""
    if not 0 < threshold <= 1:
        raise ValueError("a threshold over 0 and up to 1 is needed")
    spark = df.sparkSession
    small_batches(spark, 4096)
    rows = df.select(column(vec_id).alias("vec_id"), column(vector).alias("vector"))
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    valid = F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    reps = rows.where(valid).groupBy("vector").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
    reps = stored(reps.select(F.monotonically_increasing_id().alias("node"), "first", "n", "vector"), "vectors")
    found = None
    for (dim,) in reps.select(F.size("vector")).distinct().collect():
        part = _linked(reps.where(F.size("vector") == dim), dim, threshold)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "node bigint, linked bigint, other bigint")
    found = stored(found, "vector-links")
    linked = found.groupBy("node").agg(F.sum("linked").alias("linked"))
    roots = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")), "vector-components")
    full = reps.join(linked, "node", "left").join(roots, "node", "left")
    full = full.select("vector", "first", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("root", "node").alias("root"))
    least = full.groupBy("root").agg(F.min("first").alias("least"))
    full = full.join(least, "root").select("vector", "links", "least", F.lit(True).alias("known"))
    out = rows.join(full, "vector", "left")
    comp = F.when(F.col("known"), F.col("least")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"),
        F.coalesce(F.col("vec_id") == comp, F.lit(False)).alias("kept"))
