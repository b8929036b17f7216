"""Centroid clustering of embeddings with partial-distance search.

Components become integers, so that every distance, sum and centroid is exact and
no result depends on how rows are dealt. Dimensions of high variance come first;
a centroid is abandoned as soon as its partial distance is strictly above the
best one, and survivors finish all dimensions: the nearest centroid is that of a
full search, ties included.

A round reads the stored integers once. A task reduces its rows to one row of
sums for each centroid; centroids, k rows of `dims` numbers, are all that the
driver ever holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as T

CLUSTERS = 8
ROUNDS = 10
DIMS = 64
SCALE = 1024
SEED = "3"
#: Dimensions that are added to a partial distance at once.
STEP = 8
#: Vectors that one vectorised step handles.
ROWS = 4096
#: Integers beyond this could make a squared distance, or a task's sum, leave 64 bits.
MOST = 1 << 27


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector has exactly dims components, none null or non-finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce((F.size(vector) == dims) & F.forall(vector, finite), F.lit(False))


def integers(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, x as double."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    made = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, dims)
    if made.size and np.abs(made).max() > MOST:
        raise ValueError(f"a component is beyond {MOST // scale}: its squared distances do not fit into 64 bits")
    return made.astype(np.int32)


def rows_of(column: pa.Array, dims: int) -> np.ndarray:
    """The integers of a column of packed vectors."""
    return T.texts(column).data.view(np.int32).reshape(-1, dims) if len(column) else np.empty((0, dims), np.int32)


def nearest(x: np.ndarray, centres: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, int]:
    """For each vector the nearest centre (ties: smaller number) and its squared distance; and how many components were compared.

    Both sides have their dimensions in the order in which they are compared.
    """
    n, k, dims = len(x), len(centres), x.shape[1]
    x = x.astype(np.int64)
    first = np.empty((n, k), np.int64)
    for j in range(k):
        gap = x[:, :step] - centres[j, :step]
        first[:, j] = np.einsum("ij,ij->i", gap, gap)
    best = first.argmin(axis=1)
    gap = x[:, step:] - centres[best, step:]
    least = first[np.arange(n), best] + np.einsum("ij,ij->i", gap, gap)
    seed, compared = best.copy(), n * (k * min(step, dims) + max(0, dims - step))
    for j in range(k):
        going = np.flatnonzero((seed != j) & (first[:, j] <= least))
        partial = first[going, j]
        for a in range(step, dims, step):
            gap = x[going, a : a + step] - centres[j, a : a + step]
            partial = partial + np.einsum("ij,ij->i", gap, gap)
            compared += gap.size
            stays = partial <= least[going]
            going, partial = going[stays], partial[stays]
        better = (partial < least[going]) | (j < best[going])
        best[going[better]], least[going[better]] = j, partial[better]
    return best, least, compared


def _quantised(df: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """Kept vectors: id, and the integers packed as 32-bit numbers."""
    kept = df.select(df[id_col].alias("id"), df[vec_col].alias("vector")).where(usable(F.col("vector"), dims))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = integers(batch.column(1), dims, scale)
            packed = pa.Array.from_buffers(pa.binary(), len(made), [None, pa.py_buffer((np.arange(len(made) + 1, dtype=np.int32) * 4 * dims).tobytes()), pa.py_buffer(made.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], names=["id", "packed"])

    return T.stored(kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, packed binary"), "vectors")


def _totals(packed: DataFrame, names: list[str], make) -> DataFrame:
    """make(packed vectors) for each task's rows, added up by `k` in tasks, then over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            made = make(batch.column(0))
            total = made if total is None else total + made
        if total is not None:
            keys = np.arange(len(total), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(np.ascontiguousarray(c)) for c in total.T)], names=["k", *names])

    kind = ", ".join(f"{n} bigint" for n in names)
    return packed.select("packed").mapInArrow(run, f"k int, {kind}").groupBy("k").agg(*[F.sum(F.col(n).cast("decimal(20,0)")).alias(n) for n in names])


def _order(packed: DataFrame, dims: int) -> np.ndarray:
    """Dimensions by falling variance over all vectors. Only speed depends on it, so sums are of values shifted to 16 bits at most."""
    names = [f"s{d}" for d in range(dims)]

    def make(column: pa.Array) -> np.ndarray:
        x = np.clip(rows_of(column, dims), -32768, 32767).astype(np.int64)
        return np.stack([np.full(dims, len(x)), x.sum(axis=0), (x * x).sum(axis=0)])

    got = {r["k"]: np.array([float(r[n]) for n in names]) for r in _totals(packed, names, make).collect()}
    if not got or not got[0][0]:
        return np.arange(dims)
    return np.argsort(-(got[2] / got[0] - (got[1] / got[0]) ** 2), kind="stable")


def _in_steps(column: pa.Array, centres: np.ndarray, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    x = rows_of(column, len(order))
    for a in range(0, len(x), ROWS):
        part = x[a : a + ROWS]
        yield part, *nearest(part[:, order], centres[:, order])[:2]


def _moved(packed: DataFrame, centres: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Each centre replaced by the exact floor of its vectors' mean; an empty one stays."""
    k, dims = centres.shape
    names = ["n", *(f"s{d}" for d in range(dims))]

    def make(column: pa.Array) -> np.ndarray:
        total = np.zeros((k, dims + 1), np.int64)
        for x, best, _ in _in_steps(column, centres, order):
            for j in np.unique(best):
                own = x[best == j]
                total[j, 0] += len(own)
                total[j, 1:] += own.sum(axis=0, dtype=np.int64)
        return total

    out = centres.copy()
    for r in _totals(packed, names, make).collect():
        if r["n"]:
            out[r["k"]] = [int(r[f"s{d}"]) // int(r["n"]) for d in range(dims)]
    return out


def cluster(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """One row per kept vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors with exactly `dims` components, none null or non-finite. The
    first centroids are the k kept vectors whose ids have the smallest SHA-256.

    Defined results: repeated ids and repeated vectors are vectors of their own
    (rows with one id follow one another by their integers); a null id hashes as an
    empty one; with fewer than k kept vectors there are as many centroids; without
    any, and with an empty table, the result is empty; other columns are ignored,
    whatever their names; a component beyond 2**27 / scale raises an error, as
    distances would leave 64 bits. Sums of distances beyond 64 bits raise one, too.
    """
    spark = df.sparkSession
    packed = _quantised(df, id_col, vec_col, dims, scale)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = packed.select(name.alias("h"), "packed").orderBy("h", "packed").limit(k).collect()
    centres = np.array([np.frombuffer(r["packed"], np.int32) for r in first], np.int64).reshape(-1, dims)
    order = _order(packed, dims)
    for _ in range(rounds if len(centres) else 0):
        centres = _moved(packed, centres, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(best, least) for _, best, least in _in_steps(batch.column(1), centres, order)]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([b for b, _ in found]).astype(np.int32)), pa.array(np.concatenate([d for _, d in found]))], names=["id", "cluster", "distance"])

    kind = packed.schema["id"].dataType.simpleString()
    assigned = T.stored(packed.mapInArrow(run, f"id {kind}, cluster int, distance bigint"), "assigned")
    T.discard(packed)
    sums = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}
    about = [(j, d, sum(sums.values()), hashlib.sha256(",".join(map(str, centres[j].tolist())).encode()).hexdigest()) for j, d in sums.items()]
    told = spark.createDataFrame(about, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(told), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
