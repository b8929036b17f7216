"""Arrays as blobs: many numbers in one row of a shuffle.

A row (part, blob) carries all that a task has for one partition, so the JVM moves
a few large values instead of one row for each number; `repartitionById` brings
the blobs of a part together, and numpy sorts and groups them there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import textops as T

SCHEMA = "part int, blob binary"


def pack(kind: int, *arrays: np.ndarray) -> bytes:
    """A blob of this kind: byte sizes, then the arrays."""
    return b"".join([np.array([kind, *(x.nbytes for x in arrays)], np.int64).tobytes(), *(np.ascontiguousarray(x).tobytes() for x in arrays)])


def unpack(raw: bytes, kinds: dict[int, list]) -> tuple[int, list[np.ndarray]]:
    """Kind and arrays of a blob; kinds has the arrays' types."""
    kind = int(np.frombuffer(raw, np.int64, 1)[0])
    types = kinds[kind]
    sizes = np.frombuffer(raw, np.int64, len(types), 8)
    at, out = 8 * (len(types) + 1), []
    for n, k in zip(sizes.tolist(), types, strict=True):
        out.append(np.frombuffer(raw, k, n // np.dtype(k).itemsize, at))
        at += n
    return kind, out


def by_part(part: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places by part, in their order."""
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(n + 1))
    for p in np.flatnonzero(np.diff(cut)).tolist():
        yield p, order[cut[p] : cut[p + 1]]


def deal(kind: int, part: np.ndarray, n: int, *arrays: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(part, blob) of the arrays' rows."""
    for p, at in by_part(part, n):
        yield p, pack(kind, *(x[at] for x in arrays))


def by_row(n: int, row: np.ndarray) -> np.ndarray:
    """The part of each row, by its number's hash."""
    return (T.mix(row) % np.uint64(n)).astype(np.int64)


def low48(keys: np.ndarray) -> np.ndarray:
    """The lower 48 bits, as bytes; the part of a key stands for the rest."""
    return (keys & np.uint64((1 << 48) - 1)).view(np.uint8).reshape(-1, 8)[:, :6]


def from48(low: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(low) // 6, 8), np.uint8)
    wide[:, :6] = low.reshape(-1, 6)
    return wide.view(np.uint64).ravel()


def batch_of(made: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in made], pa.int32()), pa.array([b for _, b in made], pa.binary())], names=["part", "blob"])
