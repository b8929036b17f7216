"""Ranked lexical search with a two-level quantised index.

A document's postings are the query terms that it holds, their occurrences, and an
impact byte for each: the term's share of the score in steps of the term, rounded
upwards. Level one reads terms and bytes alone: sums of bytes times steps bound a
score from above, the same sums with one step less for each term from below, and
the k-th largest lower bound of an item is a score that its k-th document reaches.
Level two scores exactly, in integers, every document whose upper bound comes to
that, so the k best documents are those of a full evaluation, ties included.

The text is read once. Items are searched in blocks of bounded size; what travels
to all tasks is one block's vocabulary, weights and bounds. A task keeps the k best
of its own documents for each item, so that no item's candidates meet in one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as T

TOP = 20
#: Most term occurrences of the items of a block, on average (one item at least): 16 bytes each are broadcast.
BLOCK_TERMS = 1 << 20
#: Sums that one vectorised step holds.
CELLS = 1 << 20
#: Upper bound of (10**9 * tf) div (1000 * tf + 12 * m).
FULL = 1_000_000
#: An item's candidates are ranked in so many groups first.
SALT = 16


class Terms:
    """The items of a block by term: vocab sorted; items and multiplicities of term t from first[t] to first[t + 1]."""

    def __init__(self, item: np.ndarray, term: np.ndarray):
        pair, times = np.unique(np.stack([term, item.astype(np.uint64)]), axis=1, return_counts=True) if len(term) else (np.empty((2, 0), np.uint64), np.empty(0, np.int64))
        self.vocab, place = np.unique(pair[0], return_inverse=True)
        self.item, self.times = pair[1].astype(np.int64), times.astype(np.int64)
        self.first = np.searchsorted(place, np.arange(len(self.vocab) + 1))
        self.n_items = int(item.max()) + 1 if len(item) else 0


def words(column: pa.Array) -> Iterator[tuple[int, int, T.Words]]:
    for i, j, t in T.slices(T.texts(column)):
        yield i, j, T.Words(t, T.ALNUM_SEP, lower=True)


def packed(values: np.ndarray, offs: np.ndarray) -> pa.Array:
    """Ranges of an array as binary values."""
    size = values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer((offs.astype(np.int64) * size).tobytes()), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def _postings(docs: DataFrame, terms: Terms) -> DataFrame:
    """Per document: n terms in all, and the numbers and occurrences of the query terms that it holds."""
    shared = docs.sparkSession.sparkContext.broadcast(terms.vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        for batch in batches:
            for i, j, w in words(batch.column(1)):
                hashes = w.hashes()
                slot = np.minimum(np.searchsorted(vocab, hashes), max(0, len(vocab) - 1))
                hit = np.flatnonzero(vocab[slot] == hashes) if len(vocab) else np.empty(0, np.int64)
                pair, times = np.unique(w.doc[hit] * np.int64(max(1, len(vocab))) + slot[hit], return_counts=True)
                doc, term = np.divmod(pair, max(1, len(vocab)))
                offs = np.searchsorted(doc, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(w.first).astype(np.int64)), packed(term.astype(np.int32), offs), packed(times.astype(np.int32), offs)], names=["doc", "n", "terms", "tf"])

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInArrow(T.tidy(run), f"doc {kind}, n bigint, terms binary, tf binary")


def _frequencies(postings: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term: added up in tasks, then over all; the driver gets one number for each term of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(T.texts(batch.column(0)).data.view(np.int32), minlength=size)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "df"])

    out = np.zeros(size, np.int64)
    for r in postings.select("terms").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r["term"]] = r["df"]
    return out


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def shares(tf: np.ndarray, n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """(10**9 * tf) div (1000 * tf + 12 * m) of postings, with m from their documents' lengths."""
    m = 75 + (25 * n * n_docs) // max(1, total)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def steps(weights: np.ndarray) -> np.ndarray:
    """Per term the least step with which an impact fits into a byte."""
    return np.maximum(1, -(-weights * FULL // 255))


def _indexed(postings: DataFrame, weights: np.ndarray, n_docs: int, total: int) -> DataFrame:
    """Postings with their impact bytes."""
    shared = postings.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, step = shared.value, steps(shared.value)
        for batch in batches:
            t = T.texts(batch.column(2))
            term, tf = t.data.view(np.int32), T.texts(batch.column(3)).data.view(np.int32).astype(np.int64)
            offs = t.offs // 4
            n = np.repeat(np.asarray(batch.column(1)), np.diff(offs))
            byte = -(-(w[term] * shares(tf, n, n_docs, total)) // step[term])
            yield pa.RecordBatch.from_arrays([*batch.columns, packed(byte.astype(np.uint8), offs)], names=["doc", "n", "terms", "tf", "impacts"])

    return postings.mapInArrow(T.tidy(run), f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in postings.schema)}, impacts binary")


def _in_steps(offs: np.ndarray, n_items: int) -> Iterator[tuple[int, int]]:
    """Runs of documents whose sums, one for each item, fit into a step."""
    rows = max(1, CELLS // max(1, n_items))
    for a in range(0, len(offs) - 1, rows):
        yield a, min(a + rows, len(offs) - 1)


def _sums(terms: Terms, doc: np.ndarray, term: np.ndarray, value: np.ndarray, n_docs: int) -> np.ndarray:
    """Sums of the postings' values times multiplicity, by document and item (exact below 2**53)."""
    many = terms.first[term + 1] - terms.first[term]
    edge = np.cumsum(many) - many
    at = np.arange(int(many.sum())) - np.repeat(edge - terms.first[term], many)
    cell = np.repeat(doc * terms.n_items, many) + terms.item[at]
    return np.bincount(cell, np.repeat(value, many) * terms.times[at], minlength=n_docs * terms.n_items).reshape(n_docs, terms.n_items)


def _level_one(batch: pa.RecordBatch, terms: Terms, step: np.ndarray, less: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents [a, b), their bounds by item (`less` steps less for each term), and their postings: document, term."""
    t = T.texts(batch.column(batch.schema.get_field_index("terms")))
    term, offs = t.data.view(np.int32).astype(np.int64), t.offs // 4
    byte = T.texts(batch.column(batch.schema.get_field_index("impacts"))).data.astype(np.int64)
    for a, b in _in_steps(offs, terms.n_items):
        own = slice(offs[a], offs[b])
        doc = np.repeat(np.arange(b - a), np.diff(offs[a : b + 1]))
        value = np.maximum(byte[own] - less, 0) * step[term[own]] + less * (byte[own] > 0)
        yield a, b, _sums(terms, doc, term[own], value, b - a), doc, term[own]


def _kth_bounds(index: DataFrame, shared, weights: np.ndarray, top: int) -> np.ndarray:
    """Per item the k-th largest lower bound over all documents (at least 1, a score above 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, step = shared.value, steps(weights)
        best = np.zeros((terms.n_items, 0))
        for batch in batches:
            for _, _, low, _, _ in _level_one(batch, terms, step, 1):
                best = np.concatenate([best, low.T], axis=1)
                if best.shape[1] > top:
                    best = np.partition(best, best.shape[1] - top, axis=1)[:, -top:]
        item, at = np.nonzero(best > 0)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(best[item, at].astype(np.int64))], names=["item", "low"])

    lows = _best(index.select("terms", "impacts").mapInArrow(T.tidy(run), "item bigint, low bigint"), [F.desc("low")], top)
    out = np.ones(shared.value.n_items, np.int64)
    for r in lows.groupBy("item").agg(F.min("low").alias("low"), F.count("*").alias("n")).toLocalIterator():
        if r["n"] == top:
            out[r["item"]] = max(1, r["low"])
    return out


def _best(found: DataFrame, order: list, top: int) -> DataFrame:
    """The first `top` rows of each item with their rank: of a part of them at first, so that an item's rows are not sorted in one task."""
    part = found.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALT)))
    some = part.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= top)
    return some.drop("rank", "salt").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)


def _exact(index: DataFrame, shared, weights: np.ndarray, bounds: np.ndarray, n_docs: int, total: int, top: int) -> DataFrame:
    """Exact scores of the documents whose upper bounds reach the item's bound: of each task the best ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, step = shared.value, steps(weights)
        kept: pa.Table | None = None
        for batch in batches:
            tf = T.texts(batch.column(3)).data.view(np.int32).astype(np.int64)
            n, ids, at = np.asarray(batch.column(1)), batch.column(0), 0
            found = []
            for a, b, high, doc, term in _level_one(batch, terms, step, 0):
                own = slice(at, at + len(term))
                at += len(term)
                reach = high >= bounds
                some = reach.any(axis=1)[doc]
                if some.any():
                    share = shares(tf[own][some], n[a:b][doc[some]], n_docs, total)
                    score = _sums(terms, doc[some], term[some], weights[term[some]] * share, b - a)
                    d, i = np.nonzero(reach & (score > 0))
                    found.append((i, d + a, score[d, i].astype(np.int64)))
            if not found:
                continue
            item, d, score = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(item):
                more = pa.table({"item": pa.array(item), "doc": ids.take(pa.array(d)), "score": pa.array(score)})
                kept = _task_best(more if kept is None else pa.concat_tables([kept, more]), top)
        if kept is not None:
            yield from kept.to_batches()

    kind = index.schema["doc"].dataType.simpleString()
    return index.mapInArrow(T.tidy(run), f"item bigint, doc {kind}, score bigint")


def _task_best(found: pa.Table, top: int) -> pa.Table:
    """Per item the `top` rows by falling score, then id."""
    found = found.sort_by([("item", "ascending"), ("score", "descending"), ("doc", "ascending")]).combine_chunks()
    item = np.asarray(found["item"])
    first = np.searchsorted(item, item)
    return found.filter(pa.array(np.arange(len(item)) - first < top))


def _items(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """A row per item with its number and its terms' hashes, repeats included."""
    own = items.select(items[item_col].alias("item_id"), items[text_col].alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, w in words(batch.column(1)):
                lists = pa.LargeListArray.from_arrays(pa.array(w.first.astype(np.int64)), pa.array(w.hashes().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists.cast(pa.list_(pa.int64()))], names=["item_id", "hashes"])

    kind = own.schema["item_id"].dataType.simpleString()
    made = own.mapInArrow(run, f"item_id {kind}, hashes array<bigint>")
    return T.stored(made.withColumn("number", F.monotonically_increasing_id()), "items")


def search(df: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The `top` documents of highest score for each item: item_id, rank, doc_id, score.

    Defined results: null and empty texts have no terms, are not counted and are
    never found; every row of df is a document and every row of items an item,
    repeated ids and equal rows included; equal scores are ranked by id, null ids
    first, and rows of equal id and score in any order; items without terms, or
    whose terms no document holds, have no rows; empty tables give an empty result;
    other columns are ignored, whatever their names. Words are compared by 64-bit
    hashes.
    """
    spark = df.sparkSession
    docs = df.select(df[id_col].alias("doc"), df[text_col].alias("words"))
    own = _items(items, item_col, item_text_col)
    occurrences = own.agg(F.sum(F.size("hashes"))).first()[0] or 0
    n_blocks = max(1, -(-occurrences // block_terms))
    out = None
    for b in range(n_blocks):
        block = own.where((F.size("hashes") > 0) & (F.pmod(F.xxhash64("number"), F.lit(n_blocks)) == b)).select("number", "item_id", "hashes").collect()
        if not block:
            continue
        sizes = [len(r["hashes"]) for r in block]
        hashes = np.concatenate([np.array(r["hashes"], np.int64) for r in block]).view(np.uint64)
        terms = Terms(np.repeat(np.arange(len(block)), sizes), hashes)
        postings = T.stored(_postings(docs, terms), "postings")
        n_docs, total = postings.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.array([weight(n_docs, d) for d in _frequencies(postings, len(terms.vocab)).tolist()], np.int64)
        index = T.stored(_indexed(postings, weights, n_docs, total), "index")
        T.discard(postings)
        shared = spark.sparkContext.broadcast(terms)
        bounds = _kth_bounds(index, shared, weights, top)
        found = _best(_exact(index, shared, weights, bounds, n_docs, total, top), [F.desc("score"), F.asc("doc")], top)
        names = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(block)], f"item bigint, item_id {own.schema['item_id'].dataType.simpleString()}")
        done = T.stored(found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("doc").alias("doc_id"), "score"), "ranked")
        T.discard(index)
        out = done if out is None else out.unionByName(done)
    T.discard(own)
    if out is None:
        kind = docs.schema["doc"].dataType.simpleString()
        out = spark.createDataFrame([], f"item_id {items.schema[item_col].dataType.simpleString()}, rank int, doc_id {kind}, score bigint")
    return out.select(F.col("item_id").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score")
