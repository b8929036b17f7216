"""Vectorised text primitives shared by the corpus operators.

Spark hands Arrow batches to Python workers; everything here works on the raw
UTF-8 bytes of many texts at once, in slices of bounded size, so that neither
memory nor the interpreter's per-row cost grows with a text's length.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles (a longer text is one step).
SLICE_BYTES = 1 << 19
#: Rows of text that Spark hands to a Python worker at once, and that its Parquet reader decodes at once; either side holds a batch.
BATCH_ROWS, READ_ROWS = 640, 512
#: Settings that decide how much text is held at once, with Spark's default, which alone is replaced, and what takes its place.
SMALL_BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", str(BATCH_ROWS)),
    "spark.sql.parquet.columnarReaderBatchSize": ("4096", str(READ_ROWS)),
}

#: Bits of the filter of sieves(): 8 MB, whatever the number of keys.
FILTER_BITS = 1 << 26

_MULT = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that end a word: ASCII white space, and everything ASCII but digits and lower-case letters.
SPACE_SEP = np.zeros(256, bool)
SPACE_SEP[[0x20, *range(0x09, 0x0E)]] = True
ALNUM_SEP = np.zeros(256, bool)
ALNUM_SEP[:0x30] = ALNUM_SEP[0x3A:0x61] = ALNUM_SEP[0x7B:0x80] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier modulo 2**64, and of its inverse."""
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, SLICE_BYTES + 4096)
        for key, base in (("p", _MULT), ("i", _INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps)
    return _powers["p"], _powers["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any range of values follows."""
    n = len(values)
    out = np.empty(n + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * powers(n)[0][:n], out=out[1:])
    return out


def byte_prefix(data: np.ndarray) -> np.ndarray:
    return prefix(_BYTE[data])


def range_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [start, end): equal ranges hash alike wherever they stand."""
    return mix((pre[end] - pre[start]) * powers(len(pre))[1][start] + (end - start).astype(np.uint64))


def ngrams(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the n-word windows that lie in one text."""
    if len(hashes) < n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.flatnonzero(doc[n - 1 :] == doc[: len(doc) - n + 1])
    return at, range_hash(prefix(hashes), at, at + n)


class Texts:
    """UTF-8 bytes of some texts: data, and offs with one entry more than there are texts."""

    __slots__ = ("data", "offs")

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs = data, offs

    def __len__(self) -> int:
        return len(self.offs) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes()


def texts(column: pa.Array) -> Texts:
    """The bytes of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"" if kind == pa.large_binary() else "")
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64, len(column) + 1, column.offset * 8) if offs is not None and offs.size else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return Texts(data, offs)


def slices(t: Texts, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """Consecutive rows [i, j) of about `most` bytes, with offsets from 0."""
    i, n = 0, len(t)
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(t.offs, t.offs[i] + most, "right")) - 1))
        a, b = t.offs[i], t.offs[j]
        yield i, j, Texts(t.data[a:b], t.offs[i : j + 1] - a)
        i = j


class Words:
    """Words of some texts in order: byte range, text number, and per-text first word number."""

    __slots__ = ("data", "doc", "end", "first", "start")

    def __init__(self, t: Texts, sep: np.ndarray, lower: bool):
        data = LOWER[t.data] if lower else t.data
        n = len(data)
        flag = np.zeros(n + 1, bool)
        np.logical_not(sep[data], out=flag[:n])
        edge = t.offs[(t.offs > 0) & (t.offs < n)]
        start = flag[:n].copy()
        start[1:] &= ~flag[: n - 1] if n else flag[:0]
        start[edge] = flag[edge]
        stop = flag[:n] & ~flag[1:]
        stop[edge - 1] = flag[edge - 1]
        self.data = data
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, t.offs)
        self.doc = np.repeat(np.arange(len(t)), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        return range_hash(byte_prefix(self.data), self.start, self.end)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which of the keys occur twice or more."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def covered(at: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in some range [at, at + width)."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, at, 1)
    np.add.at(delta, np.minimum(at + width, n), -1)
    return np.cumsum(delta[:n]) > 0


def give_back() -> None:
    """Returns memory that this process has freed, and the powers of the longest text, to the system."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], forget: Callable[[], None] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker forgets what it kept for the task (forget: a module's own part of it) and gives back what it no longer uses: workers live on, beside other stages' memory."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if forget is not None:
                forget()
            give_back()

    return whole


def per_row(df: DataFrame, columns: list[str], schema: str, make: Callable[[Texts], dict], keep: list[str], most: int = SLICE_BYTES, forget: Callable[[], None] | None = None) -> DataFrame:
    """One row out for each row in: `keep` as it is, and the columns that `make` computes from a slice of texts.

    `columns` is the text column, in a list. Nothing else is read from df. forget: as in tidy().
    """
    names = list(keep)
    kept = df.select(*[df[c] for c in names], df[columns[0]].alias(unused(df, "__text")[0]))
    head = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, t in slices(texts(batch.column(len(names))), most):
                made = make(t)
                own = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*own.columns[: len(names)], *(x if isinstance(x, pa.Array) else pa.array(x) for x in made.values())], names=[*names, *made])

    return kept.mapInArrow(tidy(run, forget), f"{head}, {schema}" if names else schema)


def filter_rows(df: DataFrame, text_col: str, good: Callable[[Texts], np.ndarray]) -> DataFrame:
    """The rows of df, with all their columns, whose texts are good."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, t in slices(texts(batch.column(at))):
                yield batch.slice(i, j - i).filter(pa.array(good(t)))

    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))  # whatever the columns are called
    return plain.mapInArrow(tidy(run), plain.schema).toDF(*df.columns)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has, whatever the case of its letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def sieves(df: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose key is among keys (one column) with few others, and the rest: only the former need a join, and a shuffle.

    Null keys are in the rest. The filter has FILTER_BITS bits, whatever the number of keys: at most FILTER_BITS / 64 rows are broadcast. The more keys there are
    the fuller it is; it then lets more rows through, and a join's result is the same.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bit = lambda c: (c % 64).cast("int")
    at, word, place = unused(df, "__at", "__word", "__slot")
    quoted = F.col(f"`{key}`")
    slots = keys.select(slot(F.col(keys.columns[0])).alias("__s")).where(F.col(keys.columns[0]).isNotNull())
    words = slots.groupBy(F.shiftright("__s", 6).alias(at)).agg(F.bit_or(F.expr("shiftleft(1L, cast(__s % 64 as int))")).alias(word))
    placed = df.withColumn(place, F.when(quoted.isNotNull(), slot(quoted))).join(F.broadcast(words), F.shiftright(place, 6) == F.col(at), "left")
    found = F.coalesce(F.getbit(word, bit(F.col(place))) == 1, F.lit(False))
    own = [F.col(f"`{c}`") for c in df.columns]
    return placed.where(found).select(*own), placed.where(~found).select(*own)


def sieve(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of df whose key is among keys (one column), and few others."""
    return sieves(df, key, keys)[0]


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset a local master (tests) gets one beside the warehouse; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """What was written there, and a lazy result may still read, goes when the application ends."""
    where, files = _files(spark, path)
    files.deleteOnExit(where)


def _files(spark: SparkSession, path: str):
    """A path and its file system, as Spark's JVM knows them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def settle(spark: SparkSession) -> None:
    """Small batches, unless the user has chosen a size: 10,000 texts in an Arrow batch and 4,096 in a reader's column, Spark's defaults, are too much for each task to hold."""
    for key, (default, small) in SMALL_BATCHES.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, small)


@contextlib.contextmanager
def storing(spark: SparkSession) -> Iterator[None]:
    """For jobs whose results are stored: their shuffle files go as soon as each job ends, and batches are small, as settle() says. The session is afterwards as it was."""
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = {key: spark.conf.get(key) for key in (cleanup, *SMALL_BATCHES)}
    spark.conf.set(cleanup, "true")
    settle(spark)
    try:
        yield
    finally:
        for key, value in was.items():
            spark.conf.set(key, value)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, and any executor may be lost afterwards."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with storing(spark):
        df.write.parquet(path)
    gone_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


@contextlib.contextmanager
def temporary() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Gives a function that takes note of stored frames, which are deleted in the end, whatever happens."""
    held: list[DataFrame] = []

    def note(df: DataFrame) -> DataFrame:
        held.append(df)
        return df

    try:
        yield note
    finally:
        discard(*held)


def discard(*frames: DataFrame) -> None:
    """Deletes what stored() wrote for these frames, through Spark's own file systems."""
    for df in frames:
        where, files = _files(df.sparkSession, df.stored_at)
        files.delete(where, True)


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
