"""Members of groups that may be large, compared within tasks.

A group of many members is dealt out as pairs of blocks: every two members meet in
exactly one task, no task holds more than two blocks, and only what is found is
put out, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a group in one block.
BLOCK = 512
#: Groups of fewer members are compared together, so many pairs at once.
SMALL, PAIRS = 24, 1 << 14
#: Rows of a larger group that are compared with its other members at once.
ROWS = 128


def dealt(members: DataFrame, sizes: DataFrame, member: str, block: int) -> DataFrame:
    """members (key, `member`, ..) of the groups in sizes (key, size), a row for each pair of blocks: with a <= b, and side, whether the row's own block is the larger one."""
    placed = members.join(sizes.select("key", F.ceil(F.col("size") / block).cast("int").alias("blocks")), "key")
    placed = placed.withColumn("block", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = [c for c in members.columns if c != "key"]
    return spread.select("key", *own, F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), (F.col("block") > F.col("other")).alias("side"))


def gathered(rows: DataFrame, n_parts: int) -> DataFrame:
    return rows.repartition(n_parts, "key", "a", "b").sortWithinPartitions("key", "a", "b")


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of whole groups (key, a, b), where they stand together but may go on in the next batch; what is held is a batch and the group at its end."""
    rest: pa.Table | None = None
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        ends = [np.asarray(table.column(c)) for c in ("key", "a", "b")]
        differs = np.logical_or.reduce([e != e[-1] for e in ends])
        cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if cut:
            yield table.slice(0, cut).combine_chunks().to_batches()[0]
        rest = table.slice(cut)
    if rest is not None and len(rest):
        yield rest.combine_chunks().to_batches()[0]


class Members:
    """Columns of a batch of whole groups."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch = batch
        self.key, self.a, self.b, self.side = (self.take(x) for x in ("key", "a", "b", "side"))
        new = (np.diff(self.key) != 0) | (np.diff(self.a) != 0) | (np.diff(self.b) != 0)
        self.edge = np.concatenate([[0], np.flatnonzero(new) + 1, [len(self.key)]])

    def column(self, name: str) -> pa.Array:
        return self.batch.column(self.batch.schema.get_field_index(name))

    def take(self, name: str) -> np.ndarray:
        return np.ascontiguousarray(self.column(name).to_numpy(zero_copy_only=False))

    def meet(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs of one group belong to this task: of one block, or of both sides of two."""
        return (self.a[i] == self.b[i]) | (self.side[i] != self.side[j])

    def pairs(self, near) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j) of one group's members, in chunks: all of small groups, of larger ones those that near(rows, others) leaves, a matrix."""
        some_i, some_j, waiting = [], [], 0
        for lo, hi in zip(self.edge[:-1].tolist(), self.edge[1:].tolist(), strict=True):
            size = hi - lo
            if size < 2:
                continue
            if size < SMALL:
                i, j = np.triu_indices(size, 1)
                some_i.append(i + lo)
                some_j.append(j + lo)
                waiting += len(i)
                if waiting >= PAIRS:
                    yield np.concatenate(some_i), np.concatenate(some_j)
                    some_i, some_j, waiting = [], [], 0
                continue
            for at in range(lo, hi, ROWS):
                rows, others = np.arange(at, min(at + ROWS, hi)), np.arange(at, hi)
                i, j = np.nonzero(near(rows, others))
                up = i < j
                i, j = i[up], j[up]
                for k in range(0, len(i), PAIRS):
                    yield at + i[k : k + PAIRS], at + j[k : k + PAIRS]
        if waiting:
            yield np.concatenate(some_i), np.concatenate(some_j)
