"""Near copies among embeddings: lattice hashing, with cosine verified.

Unit vectors are projected at random onto blocks of eight dimensions, and each
block is decoded to the nearest point of the E8 lattice; a table's cell is the
points of its blocks. A vector is indexed in its own cell of each table and probes
the neighbouring cells whose points come nearest. Vectors of one label that meet
in a cell are compared by their cosine in double precision.

What is shuffled first are keys alone. Vectors follow only into cells in which
somebody else was indexed or probes, so a vector without neighbours is never
moved. Equal vectors are one class with a number. A pair is counted in the first
cell in which it meets, which both sides know from their keys: no pair is emitted,
only a sum for each vector and the edges of a forest for each group. A cell of
many vectors is dealt out as pairs of blocks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import groups
from . import textops as T
from .graph import components

THRESHOLD = 0.98
#: Tables; E8 blocks of a table; length that becomes 1 in the lattice; neighbouring cells that are probed.
TABLES, BLOCKS, WIDTH, PROBES = 4, 2, 1.5, 6
#: Slack of the first comparison, before the exact one.
SLACK = 1e-9

_SEED = 8128


def short_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two of eight coordinates +-1, or all +-1/2 with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    halves = np.array(list(itertools.product((0.5, -0.5), repeat=8)))
    return np.concatenate([np.array(out), halves[(halves < 0).sum(axis=1) % 2 == 0]])


_SHORT = short_vectors()


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points of even sum: rounding, and the coordinate that lies worst goes the other way where the sum is odd."""
    near = np.rint(x)
    gap = x - near
    odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
    worst = np.abs(gap[odd]).argmax(axis=1)
    near[odd, worst] += np.where(gap[odd, worst] >= 0, 1, -1)
    return near


def lattice_points(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: the better of the even points and the even points moved by one half."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1))[:, None], whole, half)


class Lattices:
    """Projections of vectors of some dimension, and their cells' keys."""

    def __init__(self, dims: int):
        pick = np.random.default_rng([_SEED, dims])
        self.project = pick.standard_normal((TABLES, dims, 8 * BLOCKS)) / WIDTH
        self.shift = pick.random((TABLES, 8 * BLOCKS))
        self.mult = pick.integers(1, 1 << 62, (TABLES, 8 * BLOCKS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def keys(self, unit: np.ndarray, label: np.ndarray) -> np.ndarray:
        """For each vector and table the key of its own cell, then of its neighbours, nearest first to be reached."""
        n, dims = unit.shape
        out = np.empty((n, TABLES, 1 + PROBES), np.uint64)
        twice = (2 * _SHORT).astype(np.int64).view(np.uint64)
        for t in range(TABLES):
            x = unit @ self.project[t] + self.shift[t]
            sums, costs, moves = np.zeros(n, np.uint64), [], []
            for b in range(BLOCKS):
                at = slice(8 * b, 8 * b + 8)
                point = lattice_points(x[:, at])
                sums += ((2 * point).astype(np.int64).view(np.uint64) * self.mult[t, at]).sum(axis=1, dtype=np.uint64)
                costs.append(2 - 2 * (x[:, at] - point) @ _SHORT.T)
                moves.append((twice * self.mult[t, at]).sum(axis=1, dtype=np.uint64))
            cost, move = np.concatenate(costs, axis=1), np.concatenate(moves)
            near = np.argpartition(cost, PROBES, axis=1)[:, :PROBES]
            out[:, t, 0] = sums
            out[:, t, 1:] = sums[:, None] + move[near]
            out[:, t] = T.mix(T.mix(out[:, t] + np.uint64(t)) ^ label[:, None].view(np.uint64) ^ np.uint64(dims))
        return out.view(np.int64)


_lattices: dict[int, Lattices] = {}


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square leaves a double."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors of a list column one after another, where each begins, and how many components it has."""
    dims = np.asarray(pa.compute.list_value_length(column)).astype(np.int64)
    flat, first = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(dims) - dims
    for d in np.unique(dims).tolist():
        own = first[dims == d][:, None] + np.arange(d)
        flat[own] = units(flat[own])
    return flat, first, dims


def _keyed(classes: DataFrame) -> DataFrame:
    """Classes with their cells' keys, table by table, the own one first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 1024):
                part = batch.slice(a, 1024)
                flat, first, dims = unit_rows(part.column(3))
                label = part.column(1).to_numpy(zero_copy_only=False)
                keys = np.empty((len(part), TABLES * (1 + PROBES)), np.int64)
                for d in np.unique(dims).tolist():
                    if d not in _lattices:
                        _lattices[d] = Lattices(d)
                    at = np.flatnonzero(dims == d)
                    keys[at] = _lattices[d].keys(flat[first[at][:, None] + np.arange(d)], np.ascontiguousarray(label[at])).reshape(len(at), -1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=["node", "lab", "n", "vector", "cells"])

    own = classes.select("node", "lab", "n", "vector")
    return own.mapInArrow(run, f"node bigint, lab bigint, n bigint, vector {own.schema['vector'].dataType.simpleString()}, cells array<bigint>")


class Group(groups.Members):
    """Members that meet in cells."""

    def __init__(self, batch: pa.RecordBatch):
        super().__init__(batch)
        self.node, self.lab, self.n, self.own = (self.take(x) for x in ("node", "lab", "n", "own"))
        self.flat, self.first, self.dims = unit_rows(self.column("vector"))
        self.cells = self.column("cells").flatten().to_numpy(zero_copy_only=False).reshape(len(self.node), TABLES, 1 + PROBES)

    def vectors(self, at: np.ndarray) -> np.ndarray:
        """Unit vectors, all of one dimension, of these members."""
        return self.flat[self.first[at][:, None] + np.arange(self.dims[at[0]])]

    def near(self, threshold: float):
        """For pairs(): whose cosine comes about to the threshold."""

        def of(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
            out = np.zeros((len(rows), len(others)), bool)
            for d in np.unique(self.dims[rows]):
                x, y = np.flatnonzero(self.dims[rows] == d), np.flatnonzero(self.dims[others] == d)
                out[np.ix_(x, y)] = self.vectors(rows[x]) @ self.vectors(others[y]).T >= threshold - SLACK
            return out

        return of


def _first_meeting(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The key by which pairs count, from both sides' cells (the first side is that of the smaller node): of the first table in which they meet, that of the first side's own cell if the other one is or probes there, else of the second's."""
    there = (y == x[:, :, :1]).any(axis=2)
    back = (x == y[:, :, :1]).any(axis=2)
    table = (there | back).argmax(axis=1)
    at = np.arange(len(x))
    return np.where(there[at, table], x[at, table, 0], y[at, table, 0])


def linked(g: Group, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Members (places) that are linked and whose links count here."""
    out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for i, j in g.pairs(g.near(threshold)):
        good = (g.lab[i] == g.lab[j]) & (g.node[i] != g.node[j]) & (g.own[i] | g.own[j]) & (g.dims[i] == g.dims[j]) & g.meet(i, j)
        i, j = i[good], j[good]
        swap = g.node[i] > g.node[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        for d in np.unique(g.dims[i]):
            x, y = i[g.dims[i] == d], j[g.dims[i] == d]
            near = np.einsum("ij,ij->i", g.vectors(x), g.vectors(y)) >= threshold
            x, y = x[near], y[near]
            if len(x):
                here = _first_meeting(g.cells[x], g.cells[y]) == g.key[x]
                out.append((x[here], y[here]))
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _told(g: Group, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """Per linked node the number of vectors linked here, and the edges of a forest."""
    names, place = np.unique(np.concatenate([g.node[x], g.node[y]]), return_inverse=True)
    i, j = place[: len(x)], place[len(x) :]
    count = np.zeros(len(names), np.int64)
    np.add.at(count, i, g.n[y])
    np.add.at(count, j, g.n[x])
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[root]), pa.array(count)], names=["a", "b", "n"])


def near_copies(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Two rows are linked if their labels are equal and not null and the cosine of
    their vectors, in double precision, is at least the threshold. n_links counts
    the other rows, component_id is the smallest id within reach, kept says whether
    that is the row's own.

    Defined results: null, empty or zero vectors, and vectors with null or
    non-finite components, link with nothing, nor do vectors of different lengths;
    rows with one id are vectors of their own; a null id is no name (a component of
    such rows alone is null; `kept` then compares null with null); an empty table
    gives an empty result; other columns are ignored, whatever their names.

    Equal vectors always link. Of other pairs the tables find nearly all (see the
    README); every link found is exact. The number of comparisons within a group of
    m near copies that differ is m * m / 2, in blocks.
    """
    vector = F.col("vector")
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    good = F.col("label").isNotNull() & (F.size(vector) > 0) & F.forall(vector, number) & F.exists(vector, lambda x: x != 0)
    rows = df.select(df[id_col].alias("id"), df[label_col].alias("label"), df[vec_col].alias("vector")).withColumn("fit", F.coalesce(good, F.lit(False)))
    classes = rows.where("fit").groupBy("label", "vector").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    classes = T.stored(classes.select(F.monotonically_increasing_id().alias("node"), F.xxhash64("label").alias("lab"), "n", "low", "label", "vector"), "classes")
    keyed = T.stored(_keyed(classes), "keyed")

    entries = keyed.select("node", F.posexplode("cells")).select("node", F.col("col").alias("key"), (F.col("pos") % (1 + PROBES) == 0).alias("own"))
    sizes = entries.groupBy("key").agg(F.sum(F.col("own").cast("bigint")).alias("indexed"), F.count("*").alias("size"))
    members = groups.dealt(entries, sizes.where("indexed > 0 and size > 1"), "node", groups.BLOCK).join(keyed, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups.whole(batches):
            g = Group(batch)
            x, y = linked(g, threshold)
            if len(x):
                yield _told(g, x, y)

    found = T.stored(groups.gathered(members, T.parts(df.sparkSession)).mapInArrow(run, "a bigint, b bigint, n bigint"), "found")
    T.discard(keyed)
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    named = components(found)
    joined = classes.select("node", "label", "vector", "n", "low").join(links, "node", "left").join(named, "node", "left")
    joined = T.stored(joined.withColumn("component", F.coalesce("component", "node")), "joined")
    T.discard(found, named, classes)
    lows = joined.groupBy("component").agg(F.min("low").alias("component_low"))
    of = joined.join(lows, "component").select("label", "vector", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "component_low")
    out = rows.where("fit").join(of, ["label", "vector"]).select("id", "links", "component_low")
    every = out.unionByName(rows.where("not fit").select("id", F.lit(0).cast("bigint").alias("links"), F.col("id").alias("component_low")))
    return every.select(F.col("id").alias(id_col), F.col("links").cast("bigint").alias("n_links"), F.col("component_low").alias("component_id"), F.col("id").eqNullSafe(F.col("component_low")).alias("kept"))
