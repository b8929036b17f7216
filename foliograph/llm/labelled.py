"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as T

#: Most labelled rows that a classifier is fitted on, and most characters of them: what the driver holds is bounded.
MAX_ROWS = 12_000
MAX_CHARS = 24_000_000


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo: which rows are held out."""
    return F.crc32(id_col.cast("string").cast("binary")) % modulus


def sample(df: DataFrame, labels: DataFrame, label_col: str, modulus: int, held_out: int, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> list[tuple[str, int]]:
    """(text, label) of at most max_rows labelled documents that are not held out, in a fixed order.

    Documents are taken by a hash of their id, each class up to half the bound; the
    ids are bounded and therefore broadcast, so that no other text is shuffled.

    Defined results: of rows with one id the smallest text counts, so that an id is
    one document however often it occurs; null texts are empty; an id with both
    labels counts for both; a text that does not fit into what is left of max_chars
    is passed over; null ids, other labels and ids without a row are not taken; with
    empty tables the sample is empty. The driver holds max_rows ids and lengths, and
    max_chars characters, at most.
    """
    half = max_rows // 2
    own = df.select(df[id_col].alias("__there"), F.coalesce(df[text_col], F.lit("")).alias("__text")).where("__there is not null")
    named = labels.select(labels[id_col].alias("__id"), labels[label_col].cast("int").alias("__label")).where(F.col("__id").isNotNull() & F.col("__label").isin(0, 1) & (remainder(F.col("__id"), modulus) != held_out)).distinct()
    named = named.join(own.select("__there"), F.col("__id") == F.col("__there"), "left_semi")  # ids alone meet: the bound is for labels that have a document
    order = [F.xxhash64("__id"), F.col("__id")]
    picked = None
    for value in (0, 1):
        some = named.where(F.col("__label") == value).orderBy(*order).limit(half)
        picked = some if picked is None else picked.unionByName(some)
    picked = picked.groupBy("__id").agg(F.min("__label").alias("low"), F.max("__label").alias("high"))
    rows = own.join(F.broadcast(picked), F.col("__there") == F.col("__id")).select("__id", "low", "high", "__text")
    texts = T.stored(rows.groupBy("__id", "low", "high").agg(F.min("__text").alias("__text")), "labelled")
    sizes = texts.select("__id", F.length("__text").alias("n")).collect()
    sizes.sort(key=lambda r: (hash_of(r[0]), r[0]))
    total, ids = 0, []
    for r in sizes:
        if total + r[1] <= max_chars:
            total += r[1]
            ids.append(r[0])
    wanted = df.sparkSession.createDataFrame([(i,) for i in ids], f"__want {labels.schema[id_col].dataType.simpleString()}")
    got = texts.join(F.broadcast(wanted), F.col("__id") == F.col("__want")).select("__id", "__text", "low", "high").collect()
    T.discard(texts)
    got.sort(key=lambda r: (hash_of(r[0]), r[0]))
    return [(r[1], label) for r in got for label in range(r[2], r[3] + 1)]


def hash_of(i: object) -> int:
    import zlib

    return zlib.crc32(str(i).encode()) * 2654435761 % (1 << 32)
