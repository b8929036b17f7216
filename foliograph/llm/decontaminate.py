"""Benchmark decontamination: Wu-Manber search for many word patterns at once.

Patterns are the windows of benchmark items: `window` consecutive words, or a
whole shorter item. Patterns of one length form a group. In a group of length m
the shift table tells for each block of B words by how many places a window that
ends in it can be moved on at least before one of the patterns may end there: for
a block that no pattern holds m - B + 1, else the block's least distance from a
pattern's end. A window whose last block has shift 0 is looked up in the bucket of
its suffix hash, and what is found there is compared byte by byte. The windows of
a slice are dealt to lanes of `LANE` places, and all lanes move on together, each
by its own shifts.

Defined results: null and empty texts have no words and no hits, null and
wordless items are no pattern; equal windows of several items count for each of
them; repeated item rows count as one item, and rows of one item with different
texts as one item with all their windows; item ids may have any type, null ones
are left out; an empty benchmark hits nothing. A larger benchmark than
`max_patterns` words or `MAX_BYTES` is broadcast and searched in blocks of items,
whose hits are joined per row afterwards: rows are numbered and stored before, so
that every row keeps a result of its own, repeated ids and null ids too, at every
size of the benchmark.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import textops as T

WINDOW = 10
BLOCK = 2
MAX_PATTERNS, MAX_BYTES = 500_000, 16 << 20
#: Window starts that one lane of the search goes through.
LANE = 64

_WORD = T.ALNUM_SEP


class Group:
    """Patterns of one length: hashes of their words, and the items that each belongs to."""

    def __init__(self, size: int, rows: dict[bytes, set[int]]):
        self.size, self.block = size, min(BLOCK, size)
        keys = sorted(rows)
        words = [k.split(b" ") for k in keys]
        flat = np.frombuffer(b" ".join(keys), np.uint8)
        ends = np.array([len(x) for k in words for x in k], np.int64)
        start = np.cumsum(ends + 1) - ends - 1
        self.words = T.range_hash(T.byte_prefix(flat), start, start + ends).reshape(len(keys), size)
        self.bytes, self.start, self.length = flat, start.reshape(len(keys), size), ends.reshape(len(keys), size)
        self.items = [np.array(sorted(rows[k]), np.int64) for k in keys]
        last = size - self.block  # place of a pattern's last block
        one = np.arange(self.words.size).reshape(self.words.shape)[:, : last + 1].ravel()
        pre = T.prefix(self.words.ravel())
        found = T.range_hash(pre, one, one + self.block)
        order = np.lexsort((last - one % size, found))
        first = np.flatnonzero(np.append(True, found[order][1:] != found[order][:-1]))
        self.blocks, self.shift, self.most = found[order][first], (last - one % size)[order][first], last + 1  # shift table
        row = np.arange(0, self.words.size, size)
        full = T.range_hash(pre, row, row + size)
        self.order = np.argsort(full)
        self.suffix = full[self.order]  # buckets


def patterns(items: list[tuple[int, bytes]], window: int) -> list[Group]:
    """Groups by length; items are (number, text)."""
    by: dict[int, dict[bytes, set[int]]] = {}
    for number, text in items:
        w = T.Words(T.Texts(np.frombuffer(text, np.uint8), np.array([0, len(text)])), _WORD, lower=True)
        raw = w.data.tobytes()
        words = [raw[a:b] for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)]
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            by.setdefault(m, {}).setdefault(b" ".join(words[i : i + m]), set()).add(number)
    return [Group(m, rows) for m, rows in sorted(by.items())]


def _slots(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the keys stand in a sorted table, and which of them do."""
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, table[at] == keys


def _same_bytes(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of the ranges of two byte strings, of equal sizes over 0, are equal."""
    if not len(size):
        return np.empty(0, bool)
    edge = np.cumsum(size) - size
    step = np.arange(int(size.sum())) - np.repeat(edge, size)
    differ = a[np.repeat(a_start, size) + step] != b[np.repeat(b_start, size) + step]
    return np.add.reduceat(differ, edge) == 0


def search(groups: list[Group], w: T.Words) -> list[tuple[Group, np.ndarray, np.ndarray]]:
    """Occurrences in each group: first word's place, and number of the pattern."""
    words = w.hashes()
    pre = T.prefix(words)
    out = []
    for g in groups:
        windows = len(words) - g.size + 1
        if windows <= 0:
            continue
        place = np.arange(0, windows, LANE)
        end = np.minimum(place + LANE, windows)
        found = []
        while len(place):
            block = place + g.size - g.block
            slot, known = _slots(g.blocks, T.range_hash(pre, block, block + g.block))
            shift = np.where(known, g.shift[slot], g.most)
            found.append(place[shift == 0])
            place = place + np.maximum(shift, 1)
            going = place < end
            place, end = place[going], end[going]
        at = np.concatenate(found)
        at = at[w.doc[at] == w.doc[at + g.size - 1]]
        slot, hit = _slots(g.suffix, T.range_hash(pre, at, at + g.size))
        at, which = at[hit], g.order[slot[hit]]
        own = at[:, None] + np.arange(g.size)
        same = (w.end[own] - w.start[own] == g.length[which]).all(axis=1)
        at, which, own = at[same], which[same], own[same]
        if len(at):  # direct comparison
            same = _same_bytes(w.data, w.start[own].ravel(), g.bytes, g.start[which].ravel(), g.length[which].ravel()).reshape(own.shape).all(axis=1)
            at, which = at[same], which[same]
        order = np.argsort(at, kind="stable")
        out.append((g, at[order], which[order]))
    return out


def _slice(groups: list[Group], t: T.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]:
    """Words per text; hit words (places among all words); first word of each text; items per text."""
    w = T.Words(t, _WORD, lower=True)
    hit = np.zeros(len(w), bool)
    items: list[set[int]] = [set() for _ in range(len(t))]
    for g, at, which in search(groups, w):
        hit |= T.covered(at, g.size, len(w))
        for d, p in set(zip(w.doc[at].tolist(), which.tolist(), strict=True)):
            items[d].update(g.items[p].tolist())
    return np.diff(w.first), hit, w.first, [sorted(x) for x in items]


def _spans(hit: np.ndarray, first: np.ndarray) -> list[list[tuple[int, int]]]:
    """Per text the runs of hit words, counted from the text's first word."""
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        edge = np.flatnonzero(np.diff(hit[a:b].astype(np.int8), prepend=0, append=0)) if hit[a:b].any() else ()
        out.append(list(zip(map(int, edge[::2]), map(int, edge[1::2]), strict=True)))
    return out


def _schema(kind: str) -> str:
    return f"n_words bigint, n_hit bigint, items array<{kind}>, spans array<struct<first:bigint,past:bigint>>, contaminated boolean"


def _rows(n_words, n_hit, items, spans, kind: pa.DataType) -> dict:
    return {
        "n_words": pa.array(n_words, pa.int64()),
        "n_hit": pa.array(n_hit, pa.int64()),
        "items": pa.array(items, pa.list_(kind)),
        "spans": pa.array([[{"first": a, "past": b} for a, b in x] for x in spans], pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))),
        "contaminated": pa.array(np.asarray(n_hit) > 0),
    }


_built: dict[str, list[Group]] = {}


def _groups(name: str, block: list[tuple[object, bytes]], window: int) -> list[Group]:
    """The tables of a block, built once in each Python process."""
    if name not in _built:
        _built.clear()
        _built[name] = patterns([(number, text) for number, (_, text) in enumerate(block)], window)
    return _built[name]


def _find(df: DataFrame, block: list[tuple[object, bytes]], kind, keep: list[str], text_col: str, window: int) -> DataFrame:
    shared, name, arrow = df.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex, to_arrow_type(kind)

    def make(t: T.Texts) -> dict:
        ids = [i for i, _ in shared.value]
        n_words, hit, first, found = _slice(_groups(name, shared.value, window), t)
        spans = _spans(hit, first)
        return _rows(n_words, [sum(b - a for a, b in x) for x in spans], [sorted({ids[k] for k in x}) for x in found], spans, arrow)

    return T.per_row(df, [text_col], _schema(kind.simpleString()), make, keep)


def _blocks(items: DataFrame, item_col: str, text_col: str, most: int) -> Iterator[list[tuple[object, bytes]]]:
    """Items in blocks of at most `most` words and MAX_BYTES (one item at least); the driver holds one block."""
    block, n, size = [], 0, 0
    rows = items.where(F.col(text_col).isNotNull() & F.col(item_col).isNotNull()).select(F.col(item_col), F.col(text_col)).distinct()
    for item, text in rows.toLocalIterator():
        raw = text.encode()
        words = len(T.Words(T.Texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])), _WORD, lower=True))
        if block and (n + words > most or size + len(raw) > MAX_BYTES):
            yield block
            block, n, size = [], 0, 0
        block.append((item, raw))
        n, size = n + words, size + len(raw)
    yield block


def decontaminate(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """Per row of df: words, hit words, the item ids with occurring windows, spans of hit words, and whether any is hit."""
    of = items.schema[item_col].dataType
    blocks = _blocks(items, item_col, item_text_col, max_patterns)
    block, more = next(blocks), next(blocks, None)
    if more is None:
        return _find(df, block, of, [id_col], text_col, window)
    own = T.stored(df.select(F.monotonically_increasing_id().alias("__row"), df[id_col].alias("__id"), df[text_col].alias("__own")), "documents")
    every = _find(own, block, of, ["__row", "__id"], "__own", window)
    for block in chain([more], blocks):
        every = every.unionByName(_find(own, block, of, ["__row", "__id"], "__own", window))
    kept = every.groupBy("__row").agg(F.first("__id").alias(id_col), F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    kind, arrow = kept.schema[id_col].dataType.simpleString(), to_arrow_type(of)

    def merge(batches):
        for batch in batches:
            spans = []
            for row in batch.column(3).to_pylist():
                merged: list[list[int]] = []
                for x in sorted((s["first"], s["past"]) for s in row):
                    if merged and x[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x[1])
                    else:
                        merged.append(list(x))
                spans.append([tuple(x) for x in merged])
            made = _rows(batch.column(1), [sum(b - a for a, b in x) for x in spans], batch.column(2).to_pylist(), spans, arrow)
            yield pa.RecordBatch.from_arrays([batch.column(0), *made.values()], names=[id_col, *made])

    return kept.select(id_col, "n_words", "items", "spans").mapInArrow(T.tidy(merge), f"`{id_col}` {kind}, {_schema(of.simpleString())}")


def clean(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """The rows of df, all their columns, in which no window of any item occurs. Each block of items filters what the one before left."""
    for block in _blocks(items, item_col, item_text_col, max_patterns):
        shared, name = df.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def good(t: T.Texts, shared=shared, name=name) -> np.ndarray:
            w = T.Words(t, _WORD, lower=True)
            out = np.ones(len(t), bool)
            for _, place, _ in search(_groups(name, shared.value, window), w):
                out[w.doc[place]] = False
            return out

        df = T.filter_rows(df, text_col, good)
    return df


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of the contract: item lists become their number and a SHA-256."""
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(id_col, "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), "contaminated")


def sha(ids: list[int]) -> str:
    """What digest() gives for a list of item ids."""
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
