"""Cross-entropy difference of two matched n-gram models.

The target model is counted over the documents named as target, the background
model over all documents. Both are conditional bigram models over one
vocabulary, that of all documents, with the same smoothing; the background's
counts are scaled to the target's number of tokens. A document's own tokens are
left out of the counts that score it, in either model. With N tokens, V words
(one more than occur, for unseen ones), c(w) the count of a word, c(v, w) that of
a pair, and c(v .) the number of words that follow v,

    P(w)     = (c(w) + k) / (N + k V)
    P(w | v) = (c(v, w) + mu P(w)) / (c(v .) + mu),

so a pair that was never seen falls back to its word. The first word of a text
has P(w). The score is the mean of loss_target - loss_background over a
document's words, where loss = -log P: the lower, the more like the target.

1. Texts are stored in chunks of some megabytes, compressed, with their ids.
2. Each chunk sends its distinct words and pairs, with their counts inside it, to
   the parts of the key range: a key is one entry for each chunk that has it, how
   ever common it is.
3. A part adds up the counts of its keys and answers each chunk in the order in
   which that asked, so no key travels back.
4. A chunk and its answers meet, and its documents are scored.

What is shuffled grows with the text. Nothing is sampled, and nothing of the
corpus reaches the driver but three totals.

Defined results: null, empty and wordless texts have no tokens and score 0; each
row is a document of its own, repeated ids and equal rows too, and an exact copy
counts as another document; target ids that name no row, repeated or null ones
change nothing; with no target at all the target model has only what smoothing
gives; an empty table gives an empty result; other columns are ignored. Words are
what white space parts, with A-Z in lower case; words and pairs are compared by
64-bit hashes, all of whose bits are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .blobs import pack, unpack

K, MU = 1.0, 16.0
#: Text in a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 16 << 20

TEXT, COUNTS, ANSWER = range(3)
_B = np.uint8
_KINDS = {TEXT: [_B, _B, _B, _B], COUNTS: [_B] * 9, ANSWER: [_B] * 6}


def keys_of(t: T.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text and key of each word, and text and key of each pair of words."""
    w = T.Words(t, T.SPACE_SEP, lower=True)
    h = w.hashes()
    same = w.doc[1:] == w.doc[:-1]
    return w.doc, T.mix(h + np.uint64(1)), w.doc[1:][same], T.mix(h[:-1][same] * np.uint64(0x9E3779B97F4A7C15) + h[1:][same])


def squeeze(x: np.ndarray) -> np.ndarray:
    """Numbers as compressed planes of their bytes."""
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T)
    return np.frombuffer(zstandard.ZstdCompressor(level=1).compress(planes.tobytes()), np.uint8)


def swell(raw: np.ndarray, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw.tobytes()), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


# -- 1. chunks


def _chunks(bound: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        held: list[tuple[pa.RecordBatch, T.Texts]] = []
        size = turn = 0

        def close() -> pa.RecordBatch:
            ids = pa.Table.from_batches([b.select(["id"]) for b, _ in held]).combine_chunks().to_batches()[0]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, ids.schema) as out:
                out.write_batch(ids)
            flag = np.concatenate([np.array(b.column(2)).astype(np.uint8) for b, _ in held])
            length = np.concatenate([np.diff(t.offs) for _, t in held])
            text = zstandard.ZstdCompressor(level=3).compress(b"".join(t.data[t.offs[0] : t.offs[-1]].tobytes() for _, t in held))
            blob = pack(TEXT, np.frombuffer(sink.getvalue(), np.uint8), flag, length.view(np.uint8), np.frombuffer(text, np.uint8))
            return pa.RecordBatch.from_arrays([pa.array([(number << 24) + turn]), pa.array([-1], pa.int32()), pa.array([blob], pa.binary())], names=["chunk", "part", "blob"])

        for batch in batches:
            for i, j, t in T.slices(T.texts(batch.column(1))):
                if held and size + len(t.data) > bound:
                    yield close()
                    held, size, turn = [], 0, turn + 1
                held.append((batch.slice(i, j - i), t))
                size += len(t.data)
        if held:
            yield close()

    return run


class Chunk:
    """The texts of a chunk, which of them are target, and their ids."""

    def __init__(self, raw: bytes):
        ids, self.target, length, text = unpack(raw, _KINDS)[1]
        self.ids = pa.ipc.open_stream(pa.py_buffer(ids.tobytes())).read_all().combine_chunks().to_batches()[0].column(0)
        offs = np.zeros(len(length) // 8 + 1, np.int64)
        np.cumsum(length.view(np.int64), out=offs[1:])
        self.texts = T.Texts(np.frombuffer(zstandard.ZstdDecompressor().decompress(text.tobytes()), np.uint8), offs)

    def slices(self) -> Iterator[tuple[int, int, tuple]]:
        for i, j, t in T.slices(self.texts):
            yield i, j, keys_of(t)


# -- 2. what a chunk asks


def _tally(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found = np.sort(np.concatenate(keys)) if keys else np.empty(0, np.uint64)
    first = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else np.empty(0, np.int64)
    return found[first], np.diff(np.append(first, len(found))).astype(np.uint32)


def _among(table: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """How often each key of the table occurs among others that are all in it."""
    own, times = _tally(keys)
    out = np.zeros(len(table), np.uint32)
    out[np.searchsorted(table, own)] = times
    return out


def _edges(n_parts: int) -> np.ndarray:
    """The upper 16 bits at which the parts of the key range begin."""
    return np.array([-(-(p << 16) // n_parts) for p in range(n_parts + 1)], np.int64)


def _packed_keys(keys: np.ndarray, lo: int, hi: int) -> list[np.ndarray]:
    """Sorted keys as the numbers of those with the same upper 16 bits, and their lower 48 bits."""
    top = np.bincount((keys >> np.uint64(48)).astype(np.int64) - lo, minlength=hi - lo).astype(np.uint32)
    return [squeeze(top), np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :6].ravel()]


def _unpacked_keys(top: np.ndarray, low: np.ndarray, lo: int) -> np.ndarray:
    wide = np.zeros((len(low) // 6, 8), np.uint8)
    wide[:, :6] = low.reshape(-1, 6)
    count = swell(top, np.uint32)
    return wide.view(np.uint64).ravel() | np.repeat(np.arange(lo, lo + len(count)).astype(np.uint64) << np.uint64(48), count)


def _ask(n_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = _edges(n_parts)
        for batch in batches:
            for number, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                chunk = Chunk(raw.as_py())
                words: list[list[np.ndarray]] = [[], [], [], []]  # of all and of target texts; and at their ends
                pairs: list[list[np.ndarray]] = [[], []]
                for i, j, (doc, word, pair_doc, pair) in chunk.slices():
                    inside = chunk.target[i:j] > 0
                    last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
                    for k, some in enumerate((slice(None), inside[doc], last, last & inside[doc])):
                        words[k].append(word[some])
                    pairs[0].append(pair)
                    pairs[1].append(pair[inside[pair_doc]])
                table, every = _tally(words[0])
                counts = [every, *(_among(table, words[k]) for k in (1, 2, 3))]
                two, twice = _tally(pairs[0])
                times = [twice, _among(two, pairs[1])]
                cut, cut2 = (np.searchsorted(x >> np.uint64(48), edge.astype(np.uint64)) for x in (table, two))
                for p in range(n_parts):
                    a, b = slice(cut[p], cut[p + 1]), slice(cut2[p], cut2[p + 1])
                    if cut[p] == cut[p + 1] and cut2[p] == cut2[p + 1]:
                        continue
                    lo, hi = int(edge[p]), int(edge[p + 1])
                    blob = pack(COUNTS, *_packed_keys(table[a], lo, hi), *(squeeze(x[a]) for x in counts), *_packed_keys(two[b], lo, hi), squeeze(np.concatenate([x[b] for x in times])))
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([number]), pa.array([blob], pa.binary())], names=["part", "chunk", "blob"])

    return run


# -- 3. what a part answers


def _sums(keys: list[np.ndarray], counts: list[list[np.ndarray]]) -> tuple[int, list[np.ndarray], list[int]]:
    """Number of distinct keys; for each kind of count the sums by key, in the order of the entries; and their totals."""
    key = np.concatenate(keys)
    order = np.argsort(key)
    same = key[order]
    first = np.flatnonzero(np.append(True, same[1:] != same[:-1])) if len(same) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(same)))
    out, total = [], []
    for c in counts:
        c = np.concatenate(c).astype(np.int64)
        by = np.add.reduceat(c[order], first) if len(first) else c
        total.append(int(by.sum()))
        spread = np.empty(len(c), np.int64)
        spread[order] = np.repeat(by, size)
        out.append(spread)
    return len(first), out, total


def _add(n_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = _edges(n_parts)
        chunks: list[int] = []
        words, pairs, by_word, by_pair = [], [], [[], [], [], []], [[], []]
        part = 0
        for batch in batches:
            for p, number, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                x = unpack(raw.as_py(), _KINDS)[1]
                part, lo = p, int(edge[p])
                chunks.append(number)
                words.append(_unpacked_keys(x[0], x[1], lo))
                pairs.append(_unpacked_keys(x[6], x[7], lo))
                for k in range(4):
                    by_word[k].append(swell(x[2 + k], np.uint32))
                for k, c in enumerate(np.split(swell(x[8], np.uint32), 2)):
                    by_pair[k].append(c)
        if not chunks:
            return
        distinct, out, total = _sums(words, by_word)
        _, out2, _ = _sums(pairs, by_pair)
        nothing = pa.nulls(1, pa.binary())
        names = ["chunk", "part", "blob", "n_all", "n_target", "n_words"]
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([part], pa.int32()), nothing, *(pa.array([x]) for x in (total[0], total[1], distinct))], names=names)
        at = at2 = 0
        for number, a, b in zip(chunks, map(len, words), map(len, pairs), strict=True):
            blob = pack(ANSWER, *(squeeze(x[at : at + a]) for x in out), *(squeeze(x[at2 : at2 + b]) for x in out2))
            at, at2 = at + a, at2 + b
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([part], pa.int32()), pa.array([blob], pa.binary()), *(pa.nulls(1, pa.int64()) for _ in range(3))], names=names)

    return run


# -- 4. scores


def _own(doc: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """How often the text of each occurrence has that key."""
    _, which, times = np.unique(doc << 32 | slot, return_inverse=True, return_counts=True)
    return times[which]


def scored(chunk: Chunk, answers: list[list[np.ndarray]], totals: tuple[int, int, int], k: float, mu: float) -> tuple[np.ndarray, np.ndarray]:
    """Words and mean loss difference of each text of a chunk. answers: by part, in order."""
    n_all, n_target, n_words = totals
    every, target, last, last_target, two, two_target = (np.concatenate([swell(x[c], np.int64) for x in answers]) if answers else np.empty(0, np.int64) for c in range(6))
    found = list(chunk.slices())
    table, pairs = _tally([x[2][1] for x in found])[0], _tally([x[2][3] for x in found])[0]
    count, score = np.zeros(len(chunk.texts), np.int64), np.zeros(len(chunk.texts))
    rate = n_target / n_all if n_target else 1.0
    v = n_words + 1
    for i, j, (doc, word, pair_doc, pair) in found:
        if not len(doc):
            continue
        inside = chunk.target[i:j].astype(np.int64)
        n = np.bincount(doc, minlength=j - i)
        slot = np.searchsorted(table, word)
        own = _own(doc, slot)
        end = np.append(doc[1:] != doc[:-1], True)
        close = np.zeros(j - i, np.int64)
        close[doc[end]] = slot[end]
        follows = np.append(False, doc[1:] == doc[:-1])
        before, after = np.flatnonzero(follows) - 1, np.flatnonzero(follows)
        pair_slot = np.searchsorted(pairs, pair)
        pair_own = _own(pair_doc, pair_slot)
        as_history = own - (slot == close[doc])  # the last word of a text is followed by none
        logs = []
        for c, c_last, c2, scale, tokens, minus in ((target, last_target, two_target, 1.0, n_target, inside), (every, last, two, rate, n_all, np.ones(j - i, np.int64))):
            less = minus[doc]
            p = (scale * (c[slot] - less * own) + k) / (scale * (tokens - minus * n)[doc] + k * v)
            logs.append(p.copy())
            s = slot[before]
            history = c[s] - c_last[s] - less[before] * as_history[before]
            logs[-1][after] = (scale * (c2[pair_slot] - minus[pair_doc] * pair_own) + mu * p[after]) / (scale * history + mu)
        count[i:j] = n
        score[i:j] = np.bincount(doc, np.log(logs[1]) - np.log(logs[0]), j - i) / np.maximum(n, 1)
    return count, score


def _score(totals: tuple[int, int, int], k: float, mu: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, number, answers = None, None, []

        def close() -> pa.RecordBatch:
            n, score = scored(chunk, answers, totals, k, mu)
            return pa.RecordBatch.from_arrays([chunk.ids, pa.array(n), pa.array(score)], names=["id", "n_tokens", "score"])

        for batch in batches:
            for c, part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if c != number:
                    if chunk is not None:
                        yield close()
                    chunk, number, answers = None, c, []
                if part < 0:
                    chunk = Chunk(raw.as_py())
                else:
                    answers.append(unpack(raw.as_py(), _KINDS)[1])
        if chunk is not None:
            yield close()

    return run


def score(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: float = K, mu: float = MU, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row: id_col, n_tokens, score. target: one column, ids of the target documents."""
    spark = df.sparkSession
    n_parts = min(T.parts(spark), 1 << 16)
    named = target.select(F.col(target.columns[0]).alias("__target")).where("__target is not null").distinct()
    # only texts that a sieve takes for target texts are shuffled; they are merged at every size, as the ids of a corpus' target are too many to send to every task
    some, rest = T.sieves(df.select(df[id_col].alias("id"), df[text_col].alias("text")), "id", named)
    docs = some.join(named.hint("merge"), F.col("id") == F.col("__target"), "left").select("id", "text", F.col("__target").isNotNull().alias("target")).unionByName(rest.select("id", "text", F.lit(False).alias("target")))
    chunks = T.stored(docs.mapInArrow(T.tidy(_chunks(chunk_bytes)), "chunk bigint, part int, blob binary"), "chunks")
    asked = chunks.select("chunk", "blob").mapInArrow(T.tidy(_ask(n_parts)), "part int, chunk bigint, blob binary").repartitionById(n_parts, F.col("part"))
    counts = T.stored(asked.mapInArrow(T.tidy(_add(n_parts)), "chunk bigint, part int, blob binary, n_all bigint, n_target bigint, n_words bigint"), "counts")
    totals = tuple(x or 0 for x in counts.where("chunk is null").agg(F.sum("n_all"), F.sum("n_target"), F.sum("n_words")).first())
    answers = counts.where("chunk is not null").select("chunk", "part", "blob")
    home = ((F.shiftright("chunk", 24) + F.col("chunk") % (1 << 24) * 7919) % n_parts).cast("int")  # chunks are dealt evenly
    met = chunks.unionByName(answers).repartitionById(n_parts, home).sortWithinPartitions("chunk", "part")
    kind = docs.schema["id"].dataType.simpleString()
    out = T.stored(met.mapInArrow(T.tidy(_score(totals, k, mu)), f"id {kind}, n_tokens bigint, score double"), "scores")
    T.discard(chunks, counts)
    return out.withColumnRenamed("id", id_col)
