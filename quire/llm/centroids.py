"""Centroid clustering of integer vectors: distances by matrix products where doubles are exact, sums by tree aggregation."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import written

#: Vectors of a block, and of a step of the integer fallback.
BLOCK, STEP = 4096, 128
#: Integers of less than this magnitude are exact as doubles; sums and squares below the other fit 64 bits.
EXACT, LONG = 1 << 53, 1 << 63
#: Levels of the aggregation tree: partial sums meet in a few tasks before the driver.
DEPTH = 2


def whole(x: float, scale: int) -> int:
    """floor(scale * x) for a finite double, however large."""
    top, bottom = x.as_integer_ratio()
    return scale * top // bottom


def packed(vectors: Sequence[Sequence[int]] | np.ndarray) -> tuple[bool, bytes]:
    """Integer vectors as (False, 64-bit numbers), or (True, JSON) where one may pass 62 bits."""
    if isinstance(vectors, np.ndarray) and vectors.dtype == np.int64:
        return False, vectors.tobytes()
    return True, json.dumps([list(map(int, v)) for v in vectors]).encode()


def unpacked(wide: bool, data: bytes, size: int) -> np.ndarray:
    """Rows of `size` integers: of 64 bits, or Python's own where they are wide."""
    if wide:
        return np.array(json.loads(data), object).reshape(-1, size)
    return np.frombuffer(data, np.int64).reshape(-1, size)


def _largest(values: np.ndarray, axis: int | None = None):
    return np.abs(values).max(axis=axis, initial=0) if values.dtype == np.int64 else np.array(abs(values).max(axis=axis, initial=0))


def _products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """|x|^2 - 2 x.c + |c|^2 as doubles, for integers so small that every term and partial sum is exact."""
    x, c = x.astype(np.float64), c.astype(np.float64)
    return np.einsum("ij,ij->i", x, x)[:, None] - 2.0 * (x @ c.T) + np.einsum("ij,ij->i", c, c)


def assigned(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest of the centroids `c` (ties: the smaller) and the squared distance, for each row of `x`.

    All terms of the expansion stay within size * (max|x| + max|c|)^2. Rows for which that is below 2^53 go by one
    matrix product of doubles, which is then exact whatever the order of its sums. The others subtract
    integers: 64-bit ones while the bound is below 2^63, else Python's.
    """
    most, size = int(_largest(c)), x.shape[1]
    # the largest component with which a row's bound stays below each limit
    reach = [math.isqrt(limit // size) - most for limit in (EXACT, LONG)]
    far = _largest(x, 1)
    kinds = np.where(far < reach[0], 0, np.where(far < reach[1], 1, 2)).astype(int)
    cluster, distance = np.zeros(len(x), np.int64), np.zeros(len(x), object if (kinds == 2).any() else np.int64)
    if len(rows := np.flatnonzero(kinds == 0)):
        found = _products(x[rows].astype(np.int64), c.astype(np.int64))
        cluster[rows] = found.argmin(axis=1)
        distance[rows] = found.min(axis=1).astype(np.int64)
    for kind, number in ((1, np.int64), (2, object)):
        rows = np.flatnonzero(kinds == kind)
        for at in range(0, len(rows), STEP):
            part = rows[at : at + STEP]
            apart = x[part].astype(number)[:, None, :] - c.astype(number)[None, :, :]
            found = (apart * apart).sum(axis=2)
            cluster[part] = found.argmin(axis=1)
            distance[part] = found.min(axis=1)
    return cluster, distance


class Sums:
    """Counts, exact component sums and summed distances of each cluster over some blocks."""

    def __init__(self, clusters: int, size: int):
        self.count = np.zeros(clusters, np.int64)
        self.sums = np.zeros((clusters, size), object)
        self.distance = np.zeros(clusters, object)

    def add(self, x: np.ndarray, c: np.ndarray) -> Sums:
        cluster, distance = assigned(x, c)
        order = np.argsort(cluster, kind="stable")
        lead = np.flatnonzero(np.r_[True, np.diff(cluster[order]) > 0])
        own = cluster[order][lead]
        self.count += np.bincount(cluster, minlength=len(self.count))
        for values, sums in ((x, self.sums), (distance, self.distance)):
            narrow = values.dtype == np.int64 and int(_largest(values)) * len(x) < LONG
            part = values[order] if narrow else values[order].astype(object)
            sums[own] += np.add.reduceat(part, lead, axis=0).astype(object)
        return self

    def merge(self, other: Sums) -> Sums:
        self.count += other.count
        self.sums += other.sums
        self.distance += other.distance
        return self


def fitting(centroids: Sequence[Sequence[int]], size: int) -> np.ndarray:
    """Centroids as an array: of 64-bit integers where all are below 2^62."""
    wide = any(abs(v) >= LONG // 2 for c in centroids for v in c)
    return np.array(centroids, object if wide else np.int64).reshape(-1, size)


def _blocks(batches: Iterator[pa.RecordBatch], size: int, scale: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, hash, vector) of the right length as blocks of integers: vectors of doubles that stay exact, and the others apart."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            x = part["vector"].flatten().to_numpy().reshape(-1, size)
            sound = np.isfinite(x).all(axis=1)
            small = np.zeros(len(x), bool)
            small[sound] = (np.abs(x[sound]) < (LONG // 2) / scale).all(axis=1)
            exact = np.log2(scale) % 1 == 0  # else scale * x would be rounded before the floor
            for rows in (np.flatnonzero(small & exact), np.flatnonzero(sound & ~(small & exact))):
                if len(rows):
                    plain = bool(small[rows[0]] and exact)
                    vectors = np.floor(x[rows] * scale).astype(np.int64) if plain else [[whole(v, scale) for v in row] for row in x[rows].tolist()]
                    wide, data = packed(vectors)
                    picked = part.take(pa.array(rows))
                    ids = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), picked["vec_id"])
                    first = min(zip(picked["hash"].to_pylist(), unpacked(wide, data, size).tolist(), strict=True))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([picked["hash"].to_pylist()]), pa.array([wide]), pa.array([data], pa.binary()), pa.array([first[0]])], names=["ids", "hashes", "wide", "data", "first"])


def blocks(vectors: DataFrame, size: int, scale: int, salt: str, id_col: str, vector_col: str) -> DataFrame:
    """ids, hashes, wide, data, first (least hash): the kept vectors, a few thousand to a row."""
    x = F.col(vector_col).cast("array<double>")
    kept = vectors.where(F.size(x) == size).select(F.col(id_col).cast("long").alias("vec_id"), F.sha2(F.concat(F.lit(salt + ":"), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))).cast("binary"), 256).alias("hash"), F.transform(x, lambda v: F.coalesce(v, F.lit(math.nan))).alias("vector"))
    return written(kept.mapInArrow(lambda it: _blocks(it, size, scale), "ids array<long>, hashes array<string>, wide boolean, data binary, first string"), "centroid-blocks")


def first_centroids(table: DataFrame, count: int, size: int) -> list[list[int]]:
    """The `count` vectors of the least hashes in their order; of one hash (a repeated id) by components. `count` rows a block at most leave it."""

    def least(rows):
        best: list[tuple[str, list[int]]] = []
        for row in rows:
            found = list(zip(row.hashes, unpacked(row.wide, row.data, size), strict=True))
            if len(best) < count or row.first <= best[-1][0]:
                worst = best[-1][0] if len(best) == count else "g"
                best = sorted([*best, *((h, list(map(int, v))) for h, v in found if h <= worst)])[:count]
        return iter([best])

    best = table.rdd.mapPartitions(least).treeReduce(lambda a, b: sorted(a + b)[:count], DEPTH) if table.rdd.getNumPartitions() else []
    return [vector for _, vector in best]


def gathered(table: DataFrame, c: np.ndarray) -> Sums:
    """One pass over all blocks: every task sums its own, sums meet in a tree."""
    clusters, size = c.shape
    return table.select("wide", "data").rdd.treeAggregate(Sums(clusters, size), lambda sums, row: sums.add(unpacked(row.wide, row.data, size), c), Sums.merge, DEPTH)


def centroid_rounds(table: DataFrame, start: list[list[int]], rounds: int, size: int) -> np.ndarray:
    """The centroids after `rounds` of assigning every vector and taking the floor of each cluster's mean; an empty cluster's stays."""
    c = fitting(start, size)
    for _ in range(rounds if len(start) else 0):
        found = gathered(table, c)
        moved = [[s // int(n) for s in sums] if n else own for n, sums, own in zip(found.count, found.sums.tolist(), c.tolist(), strict=True)]
        c = fitting(moved, size)
    return c


def _placed(batches: Iterator[pa.RecordBatch], c: np.ndarray, sums: list[int | None], total: int | None, digests: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            x = unpacked(batch["wide"][k].as_py(), batch["data"][k].as_py(), c.shape[1])
            cluster, distance = assigned(x, c)
            ids = batch["ids"][k].values
            far = [d if d < LONG else None for d in distance.tolist()]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(cluster, pa.int32()), pa.array(far, pa.int64()), pa.array([sums[j] for j in cluster], pa.int64()), pa.array([total] * len(ids), pa.int64()), pa.array([digests[j] for j in cluster], pa.string())],
                names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
            )


def cluster(vectors: DataFrame, clusters: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, salt: str = "2", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector of exactly `size` finite components: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Components become the integers floor(scale * x), so all sums and distances are exact and no order of tasks
    changes a result. The first centroids are the `clusters` vectors with the least sha256 of `salt:id` (fewer
    where there are fewer vectors; a null id is written as nothing; vectors of one id go by components). Each of
    `rounds` assigns all vectors (squared distance, ties to the smaller number) and moves each centroid to the
    floor of its vectors' mean; an empty one stays. Distances and inertias that pass 63 bits are null.

    Vectors that are null, of another length, or hold null or non-finite components give no row; repeated rows
    are rows of their own, other columns are left out, and an empty table gives no rows. Vectors are written once as blocks
    of a few thousand; every pass reads those, and what meets on the driver are sums for each cluster.
    """
    table = blocks(vectors, size, scale, salt, id_col, vector_col)
    c = centroid_rounds(table, first_centroids(table, clusters, size), rounds, size)
    found = gathered(table, c) if len(c) else Sums(0, size)
    fits = [int(d) if d < LONG else None for d in found.distance.tolist()]
    whole_sum = sum(found.distance.tolist())
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    total = whole_sum if whole_sum < LONG else None
    return table.select("ids", "wide", "data").mapInArrow(lambda it: _placed(it, c, fits, total, digests), schema)
