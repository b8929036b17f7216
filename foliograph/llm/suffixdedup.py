"""Removal of long repeated byte strings by a distributed merge sort of suffixes.

A string of `size` bytes (a window) is repeated if it starts at two or more
places. Windows of one or more sizes are decided together. The anchor of a window
is the place in the first half of its first `least` bytes (`least` being the
smallest of the sizes) whose 16-byte gram has the smallest hash; equal windows have
equal anchors at equal offsets, so only suffixes at anchors, about one in least / 4
places, need to be sorted.

1. Suffixes whose first least / 2 + 1 bytes occur once are left out by a fingerprint
   of those bytes, as no window with that anchor can be repeated.
2. Every task sorts the suffixes that remain (cut at the end of the longest
   window) and sends them as front-coded runs: common prefix with the one before,
   and the rest. Runs are dealt by the fingerprint, so equal prefixes meet.
3. Runs are merged by a loser tree whose nodes keep the common prefix with the
   last string put out: strings with different ones are ordered without looking
   at a byte, and equal ones are compared from there on. The merge gives the
   common prefixes of neighbours, which tell where suffixes agree far enough;
   with the bytes before the anchors they decide every window.

Suffixes that a task holds twice with the same bytes before them are decided
there and sent once. A prefix with more than `HOT` suffixes is not gathered: its
windows are dealt by 64-bit hashes of all their bytes, and what a task holds
twice is again sent once. The bytes before an anchor are compared by 64-bit
hashes. Texts that are equal as a whole are recognised beforehand, and one of
them stands for all.

Passages: a repeated passage is a run of bytes covered by repeated windows of
`PASSAGE_BYTES` bytes that holds more than `PASSAGE_WORDS` words. So many words are
seldom `SIZE` bytes long, but hardly ever fewer than `PASSAGE_BYTES`.

Defined results: null counts as an empty text; texts shorter than a size keep
everything of that size; of equal texts, with the same id or not, all lose what they repeat;
rows without an id take part like others; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .blobs import SCHEMA, batch_of, by_row, deal, pack, unpack

SIZE = 400
#: Repeated passages: bytes of their windows, and the words that they must exceed.
PASSAGE_BYTES, PASSAGE_WORDS = 240, 50
GRAM = 16
#: A prefix with more suffixes than this is decided by hashes of windows.
HOT = 512
#: Suffixes of the merged order that are decided at once.
PIECE = 1 << 14
#: A task sends a run when its suffixes reach this size.
RUN_BYTES = 10 << 20
LOCAL_BYTES = 8 << 20
#: Bytes of text whose anchors are sought at once: some fifteen arrays of 8 bytes for each of them.
STEP_BYTES = 1 << 18

#: Bits of a place in a slice: what a text may have in bytes, at most; the rest orders grams.
PLACE_BITS = 34

COPY, FIRST = -1, -2  # places that say: equal to an earlier text; the first of equal texts
_K = np.uint64(0x9E3779B97F4A7C15)


def anchors(t: T.Texts, pre: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, place, and largest and smallest distance from a window's start, of each anchor of these texts."""
    half, gram = size // 2, min(GRAM, size - size // 2)
    n = len(t.data)
    starts = n - size + 1
    none = np.empty(0, np.int64)
    if starts <= 0:
        return none, none, none, none
    m = starts + half - 1
    at = np.arange(m)
    key = T.range_hash(pre, at, at + gram)
    bits = np.uint64(PLACE_BITS)  # the same for every slice, as equal windows must choose alike wherever they stand
    key = (key >> bits << bits) | at.astype(np.uint64)  # leftmost of equal ones
    padded = np.full(-(-m // half) * half, np.uint64(2**64 - 1))
    padded[:m] = key
    block = padded.reshape(-1, half)
    left = np.minimum.accumulate(block, axis=1).ravel()
    right = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(right[:starts], left[half - 1 : half - 1 + starts])
    place = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    # windows inside one text
    length = np.diff(t.offs)
    long = np.flatnonzero(length >= size)
    count = length[long] - size + 1
    q = np.repeat(t.offs[:-1][long] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
    if not len(q):
        return none, none, none, none
    place = place[q]
    new = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    p = place[new]
    far = p - q[new]
    near = p - q[np.append(new[1:], len(q)) - 1]
    return np.searchsorted(t.offs, p, "right") - 1, p, far, near


RUN, WINDOW, STARTS, PREFIX, WHOLE, PLACES = range(6)
_KINDS = {
    RUN: [np.uint16, np.uint16, np.uint8, np.uint16, np.uint8, np.uint16, np.uint64, np.uint32, np.uint64],
    WINDOW: [np.uint64, np.uint64, np.uint32, np.uint8],
    STARTS: [np.uint64, np.uint32, np.uint32, np.uint8],
    PREFIX: [np.uint64, np.uint64, np.uint32, np.uint32],
    WHOLE: [np.uint64, np.uint64, np.uint32],
    PLACES: [np.uint64, np.int32, np.uint8],
}


def _runs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts keys, where each begins in it, and how often it occurs."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.empty(0, np.int64)
    return order, first, np.diff(np.append(first, len(k)))


# -- 1. which suffixes remain


def _fingerprints(n_parts: int, size: int):
    lead = size - size // 2 + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array(batch.column(0)).view(np.uint64)
            for i, j, block in T.slices(T.texts(batch.column(1)), LOCAL_BYTES):
                row, length = rows[i:j], np.diff(block.offs)
                keys, owner, place, whole = [], [], [], []
                for a, b, t in T.slices(block, STEP_BYTES):
                    pre = T.byte_prefix(t.data)
                    whole.append(T.range_hash(pre, t.offs[:-1], t.offs[1:]))
                    doc, p, _, _ = anchors(t, pre, size)
                    keys.append(T.range_hash(pre, p, p + lead))
                    owner.append(doc + a)
                    place.append(p - t.offs[doc])
                whole = np.concatenate(whole)
                # equal texts in this block: the first one stands for them
                made: list[tuple[int, bytes]] = []
                long = np.flatnonzero(length >= size)
                order, first, times = _runs_of(whole[long])
                lead_row = long[order[first]]
                stands = np.zeros(j - i, bool)
                stands[lead_row] = True
                copies = long[~stands[long]]
                made += deal(WHOLE, (whole[lead_row] % np.uint64(n_parts)).astype(np.int64), n_parts, whole[lead_row], row[lead_row], times.astype(np.uint32))
                if len(copies):
                    made += deal(PLACES, by_row(n_parts, row[copies]), n_parts, row[copies], np.full(len(copies), COPY, np.int32), np.zeros(len(copies), np.uint8))
                keys, owner, place = np.concatenate(keys), np.concatenate(owner), np.concatenate(place)
                mine = stands[owner]
                keys, owner, place = keys[mine], owner[mine], place[mine]
                order, first, times = _runs_of(keys)
                weight = np.ones(len(keys), np.uint32)
                sent = np.ones(len(keys), bool)
                hot = np.repeat(times > HOT, times)
                if hot.any():  # known to be hot for everyone: one is sent for all
                    head = order[first[times > HOT]]
                    sent[order[hot]] = False
                    rest = order[hot]
                    made += deal(PLACES, by_row(n_parts, row[owner[rest]]), n_parts, row[owner[rest]], place[rest].astype(np.int32), np.ones(len(rest), np.uint8))
                    sent[head] = True
                    weight[head] = times[times > HOT]
                at = np.flatnonzero(sent)
                made += deal(PREFIX, (keys[at] % np.uint64(n_parts)).astype(np.int64), n_parts, keys[at], row[owner[at]], place[at].astype(np.uint32), weight[at])
                if made:
                    yield batch_of(made)

    return run


def _remaining(n_parts: int):
    """One partition of fingerprints: the places that occur twice or more, dealt by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list[list[np.ndarray]]] = {PREFIX: [], WHOLE: [], PLACES: []}
        for batch in batches:
            for raw in batch.column(1):
                kind, x = unpack(raw.as_py(), _KINDS)
                got[kind].append(x)
        rows, places, flags = ([x[k] for x in got[PLACES]] for k in range(3))
        if got[PREFIX]:
            key, row, place, weight = (np.concatenate([x[k] for x in got[PREFIX]]) for k in range(4))
            order, first, _ = _runs_of(key)
            total = np.add.reduceat(weight[order].astype(np.int64), first)
            count = np.diff(np.append(first, len(order)))
            each = np.repeat(total, count)
            at = order[each > 1]
            rows.append(row[at])
            places.append(place[at].astype(np.int32))
            flags.append((each[each > 1] > HOT).astype(np.uint8))
        if got[WHOLE]:
            key, row, weight = (np.concatenate([x[k] for x in got[WHOLE]]) for k in range(3))
            order = np.lexsort((row, key))
            k = key[order]
            first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            total = np.add.reduceat(weight[order].astype(np.int64), first)
            code = np.full(len(order), COPY, np.int32)
            code[first] = FIRST
            at = np.repeat(total, np.diff(np.append(first, len(order)))) > 1
            rows.append(row[order][at])
            places.append(code[at])
            flags.append(np.zeros(int(at.sum()), np.uint8))
        if rows:
            row, place, flag = np.concatenate(rows), np.concatenate(places), np.concatenate(flags)
            if len(row):
                yield batch_of(list(deal(PLACES, by_row(n_parts, row), n_parts, row, place, flag)))

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, places, hot) of one partition."""
    found = [unpack(raw.as_py(), _KINDS)[1] for batch in batches for raw in batch.column(1)]
    if not found:
        return
    row, place, flag = (np.concatenate([x[k] for x in found]) for k in range(3))
    order = np.lexsort((place, row))
    row, place, flag = row[order], place[order], flag[order]
    once = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (place[1:] != place[:-1])))  # rows that are equal in all give their places twice
    flag = np.maximum.reduceat(flag, once)
    row, place = row[once], place[once]
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    cut = np.append(first, len(row)).tolist()
    blobs = [place[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]
    hots = [flag[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]
    for i in range(0, len(first), 4096):
        yield pa.RecordBatch.from_arrays([pa.array(row[first[i : i + 4096]].view(np.int64)), pa.array(blobs[i : i + 4096], pa.binary()), pa.array(hots[i : i + 4096], pa.binary())], names=["row", "places", "hot"])


# -- 2. sorted, front-coded runs


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which `known` bytes are known."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    differ = int.from_bytes(x) ^ int.from_bytes(y)
    return n - 1 - (differ.bit_length() - 1) // 8


class Suffixes:
    """Suffixes of one task, by part, until they are sent."""

    def __init__(self, n_parts: int, sizes: list[int]):
        self.n_parts, self.sizes, self.rows, self.bytes = n_parts, sizes, [], 0

    def add(self, part: int, after: bytes, before: bytes, near: int, row: int, place: int, key: int) -> None:
        self.rows.append((part, after, before, near, row, place, key))
        self.bytes += len(after) + len(before) + 160

    def flush(self) -> list[tuple[int, bytes]]:
        made: list[tuple[int, bytes]] = []
        done: list[tuple[int, int, int, int]] = []
        self.rows.sort(key=lambda r: r[:4])
        run: list[tuple[int, int, bytes, bytes, bool, tuple]] = []
        last = None
        part = -1

        def close() -> None:
            if run:
                made.append((part, _front_coded(run)))
                run.clear()

        def decided(r: tuple) -> None:
            _, after, before, near, row, place, _ = r
            for k, size in enumerate(self.sizes):
                close_by = max(near, size - len(after))  # a window ends where the suffix does, at the latest
                if close_by <= len(before):
                    done.append((row, place - len(before), place - close_by, k))

        for r in self.rows:
            if r[0] != part:
                close()
                part, last = r[0], None
            if last is not None and r[1:4] == last[0][1:4]:  # the same bytes on both sides: decided here
                if not last[1]:
                    last[1] = True
                    decided(last[0])
                decided(r)
                continue
            lcp = common(last[0][1], r[1]) if last is not None else 0
            same = last is not None and last[0][2] == r[2]
            run.append((lcp, len(r[1]), r[1][lcp:], b"" if same else r[2], same, r))
            last = [r, False]
        close()
        if done:
            row, lo, hi, which = zip(*done, strict=True)
            row = np.array(row, np.uint64)
            made += deal(STARTS, by_row(self.n_parts, row), self.n_parts, row, np.array(lo, np.uint32), np.array(hi, np.uint32), np.array(which, np.uint8))
        self.rows, self.bytes = [], 0
        return made


def _front_coded(run: list) -> bytes:
    rows = [x[5] for x in run]
    return pack(
        RUN,
        np.array([x[0] for x in run], np.uint16),
        np.array([x[1] for x in run], np.uint16),
        np.frombuffer(b"".join(x[2] for x in run), np.uint8),
        np.array([65535 if x[4] else len(x[3]) for x in run], np.uint16),
        np.frombuffer(b"".join(x[3] for x in run), np.uint8),
        np.array([r[3] for r in rows], np.uint16),
        np.array([r[4] for r in rows], np.uint64),
        np.array([r[5] for r in rows], np.uint32),
        np.array([r[6] for r in rows], np.uint64),
    )


def _send(n_parts: int, sizes: list[int]):
    least, most = sizes[0], sizes[-1]
    lead = least - least // 2 + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Suffixes(n_parts, sizes)
        for batch in batches:
            rows = np.array(batch.column(0)).view(np.uint64)
            places = [np.frombuffer(x.as_buffer(), np.int32) for x in batch.column(2)]
            hots = [np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column(3)]
            for i, j, t in T.slices(T.texts(batch.column(1)), STEP_BYTES):
                pre = T.byte_prefix(t.data)
                doc, p, far, near = anchors(t, pre, least)
                kept, hot = [np.empty(0, np.int64)], [np.empty(0, np.uint8)]
                for k, (x, f) in enumerate(zip(places[i:j], hots[i:j], strict=True)):
                    if COPY not in x[:2] or FIRST in x[:1]:
                        kept.append(x[x >= 0] + t.offs[k])
                        hot.append(f[x >= 0])
                kept, hot = np.concatenate(kept), np.concatenate(hot)
                slot = np.searchsorted(p, kept)
                slot[slot == len(p)] = 0
                good = p[slot] == kept if len(p) else np.zeros(len(kept), bool)
                slot, hot = slot[good], hot[good]
                raw = t.data.tobytes()
                key = T.range_hash(pre, p, p + lead)
                cold = slot[hot == 0]
                for d, a, f, c, k in zip(doc[cold].tolist(), p[cold].tolist(), far[cold].tolist(), near[cold].tolist(), key[cold].tolist(), strict=True):
                    held.add(k % n_parts, raw[a : min(a + most - c, int(t.offs[d + 1]))], raw[a - f : a], c, int(rows[i + d]), a - int(t.offs[d]), k)
                made: list[tuple[int, bytes]] = []
                warm = slot[hot > 0]
                if len(warm):
                    count = far[warm] - near[warm] + 1
                    which = np.repeat(np.arange(len(warm)), count)
                    q = np.repeat(p[warm] - far[warm] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
                    end = t.offs[1:][doc[warm]][which]
                    for w, size in enumerate(sizes):
                        fits = np.flatnonzero(q + size <= end)
                        own, of = q[fits], which[fits]
                        window = T.range_hash(pre, own, own + size)
                        row, place = rows[i + doc[warm]][of], (own - t.offs[doc[warm]][of]).astype(np.uint32)
                        order, first, times = _runs_of(window)
                        twice = order[np.repeat(times > 1, times)]
                        made += deal(STARTS, by_row(n_parts, row[twice]), n_parts, row[twice], place[twice], place[twice], np.full(len(twice), w, np.uint8))
                        one = order[first]
                        made += deal(WINDOW, (window[one] % np.uint64(n_parts)).astype(np.int64), n_parts, window[one], row[one], place[one], ((times > 1) + 2 * w).astype(np.uint8))
                if held.bytes > RUN_BYTES:
                    made += held.flush()
                if made:
                    yield batch_of(made)
        if held.rows and (made := held.flush()):
            yield batch_of(made)

    return run


# -- 3. merging runs, and deciding windows


class LoserTree:
    """Merges sorted runs of (string, common prefix with the one before in its run, payload).

    Every inner node keeps the run that lost there and its common prefix with the
    string that won, which is also the one with the last string put out. Two
    candidates with different common prefixes need no comparison: the longer one
    is smaller. With equal ones comparison begins after them.
    """

    def __init__(self, runs: list[Iterator[tuple[bytes, int, int]]]):
        self.k = max(1, len(runs))
        self.runs = runs
        self.head = [next(r, None) for r in runs] or [None]
        self.lcp = [0] * self.k  # of each run's head with the last string put out
        self.loser = [-1] * self.k
        winners = [*([-1] * self.k), *range(self.k)]
        for node in range(self.k - 1, 0, -1):
            winners[node], self.loser[node] = self._play(winners[2 * node], winners[2 * node + 1])
        self.top = winners[1] if self.k > 1 else 0

    def _play(self, a: int, b: int) -> tuple[int, int]:
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        h, g = self.lcp[a], self.lcp[b]
        if h != g:
            return (a, b) if h > g else (b, a)
        s, t = x[0], y[0]
        n = common(s, t, h)
        if n == len(s) or n < len(t) and s[n] < t[n]:
            self.lcp[b] = n
            return a, b
        self.lcp[a] = n
        return b, a

    def __iter__(self) -> Iterator[tuple[int, bytes, int]]:
        """(common prefix with the string before, string, payload) in order."""
        head, lcp, loser = self.head, self.lcp, self.loser
        while head[self.top] is not None:
            top = self.top
            s, _, payload = head[top]
            yield lcp[top], s, payload
            head[top] = after = next(self.runs[top], None)
            lcp[top] = after[1] if after is not None else 0
            node = (top + self.k) // 2
            while node:
                top, loser[node] = self._play(loser[node], top) if loser[node] < top else self._play(top, loser[node])
                node //= 2
            self.top = top


def _decode(x: list[np.ndarray]) -> Iterator[tuple[bytes, int, tuple[bytes, int, int, int]]]:
    """The suffixes of a run, each with its common prefix with the one before, and the bytes before it, the least distance, row and place. What is decoded is one suffix."""
    lcp, length, tails, ahead, heads, near, row, place = x[:8]
    s, at, before, gone = b"", 0, b"", 0
    for k in range(len(lcp)):
        h, n = int(lcp[k]), int(length[k])
        s = s[:h] + tails[at : at + n - h].tobytes()
        at += n - h
        m = int(ahead[k])
        if m != 65535:
            before = heads[gone : gone + m].tobytes()
            gone += m
        yield s, h, (before, int(near[k]), int(row[k]), int(place[k]))


def decide(runs: list[list[np.ndarray]], sizes: list[int], most: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size its number, and rows and places of the repeated windows among the suffixes of some runs, a piece of the merged order at a time.

    A piece ends where neighbours share less than any window's rest, so no two
    suffixes of different pieces can agree; it holds `most` suffixes and one such
    group more at most, and groups are bounded by HOT and the number of tasks.
    """
    most = most or PIECE
    lead = sizes[0] - sizes[0] // 2 + 1
    lcp: list[int] = []
    length: list[int] = []
    facts: list[tuple[bytes, int, int, int]] = []
    for h, s, fact in LoserTree([_decode(x) for x in runs]):
        if h < lead and len(lcp) >= most:
            yield from _decided(lcp, length, facts, sizes)
            lcp, length, facts = [], [], []
        lcp.append(h)
        length.append(len(s))
        facts.append(fact)
    if lcp:
        yield from _decided(lcp, length, facts, sizes)


def _decided(prefix: list[int], sizes_left: list[int], facts: list[tuple[bytes, int, int, int]], sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    lcp, length = np.array(prefix, np.int64), np.array(sizes_left, np.int64)
    lcp[0] = 0
    near, rows, place = (np.array([f[k] for f in facts], kind) for k, kind in ((1, np.int64), (2, np.uint64), (3, np.int64)))
    far = np.array([len(f[0]) for f in facts], np.int64)
    end = np.cumsum(far)
    pre = T.byte_prefix(np.frombuffer(b"".join(f[0] for f in facts), np.uint8))
    index = np.arange(len(lcp))
    for w, size in enumerate(sizes):
        out_row, out_place = [rows[:0]], [place[:0]]
        for gap in range(int(near.min()), min(sizes[0] // 2, int(far.max()) + 1)):
            own = np.flatnonzero((near <= gap) & (gap <= far) & (length >= size - gap))
            if len(own) < 2:
                continue
            # suffixes that agree in the window's rest lie side by side
            rest = np.maximum.accumulate(np.where(lcp < size - gap, index, 0))[own]
            key = T.mix(rest.astype(np.uint64) * _K + T.range_hash(pre, end[own] - gap, end[own]))
            twice = own[T.repeated(key)]
            out_row.append(rows[twice])
            out_place.append(place[twice] - gap)
        yield w, np.concatenate(out_row), np.concatenate(out_place)


def _starts(row: np.ndarray, place: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places as runs: row, first, last, and which size."""
    order = np.lexsort((place, row))
    row, place = row[order], place[order]
    new = np.append(True, (row[1:] != row[:-1]) | (place[1:] > place[:-1] + 1)) if len(row) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = place[np.append(first[1:], len(row)) - 1] if len(first) else place
    return row[first], place[first], last, np.full(len(first), which, np.uint8)


def _merge(n_parts: int, sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list[list[np.ndarray]]] = {RUN: [], WINDOW: [], STARTS: []}
        for batch in batches:
            for raw in batch.column(1):
                kind, x = unpack(raw.as_py(), _KINDS)
                got[kind].append(x)
        found = [(x[0], x[1].astype(np.int64), x[2].astype(np.int64), x[3]) for x in got[STARTS]]
        if got[RUN]:
            for w, row, place in decide(got[RUN], sizes):
                if len(row):
                    found.append(_starts(row, place, w))
            got[RUN].clear()
        if got[WINDOW]:
            key, row, place, many = (np.concatenate([x[k] for x in got[WINDOW]]) for k in range(4))
            order, first, times = _runs_of(key)
            twice = order[np.repeat((times > 1) | (np.bitwise_or.reduceat(many[order] & 1, first) > 0), times)]
            for w in range(len(sizes)):  # windows of different sizes have different hashes
                own = twice[many[twice] >> 1 == w]
                found.append(_starts(row[own], place[own].astype(np.int64), w))
        if found:
            row, lo, hi, which = (np.concatenate([x[k] for x in found]) for k in range(4))
            if len(row):
                yield batch_of(list(deal(STARTS, by_row(n_parts, row), n_parts, row, lo.astype(np.uint32), hi.astype(np.uint32), which.astype(np.uint8))))

    return run


def _spans(sizes: list[int]):
    """Rows (row, one list of spans for each size) of one partition: maximal covered ranges, as pairs of 64-bit integers."""

    def merged(lo: np.ndarray, hi: np.ndarray) -> bytes:
        order = np.argsort(lo, kind="stable")
        x, y = lo[order], np.maximum.accumulate(hi[order])
        start = np.flatnonzero(np.append(True, x[1:] > y[:-1])) if len(x) else np.empty(0, np.int64)
        return np.stack([x[start], y[np.append(start[1:], len(x)) - 1]], axis=1).tobytes() if len(x) else b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [unpack(raw.as_py(), _KINDS)[1] for batch in batches for raw in batch.column(1)]
        if not found:
            return
        row, lo, hi, which = (np.concatenate([x[k] for x in found]) for k in range(4))
        lo, hi = lo.astype(np.int64), hi.astype(np.int64) + np.array(sizes, np.int64)[which]
        order = np.lexsort((which, row))
        row, lo, hi, which = row[order], lo[order], hi[order], which[order]
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        cut = np.append(first, len(row)).tolist()
        blobs: list[list[bytes]] = [[] for _ in sizes]
        for a, b in zip(cut, cut[1:], strict=False):
            edge = np.searchsorted(which[a:b], np.arange(len(sizes) + 1)) + a
            for k in range(len(sizes)):
                blobs[k].append(merged(lo[edge[k] : edge[k + 1]], hi[edge[k] : edge[k + 1]]))
        for i in range(0, len(first), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(row[first[i : i + 4096]].view(np.int64)), *(pa.array(x[i : i + 4096], pa.binary()) for x in blobs)], names=["row", *(f"spans{k}" for k in range(len(sizes)))])

    return run


def _named(df: DataFrame, id_col: str, text_col: str):
    text = F.coalesce(df[text_col], F.lit(""))
    return text, F.xxhash64(df[id_col].cast("string"), text)


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: tuple[int, ...] = (SIZE,)) -> DataFrame:
    """(row, whole, spans0, spans1 ...) of the texts that repeat something: for each size, in rising order, the covered spans; whole: the text occurs twice. row is a hash of id and text."""
    spark = df.sparkSession
    n_parts = T.parts(spark)
    sizes = sorted(set(sizes))
    text, row = _named(df, id_col, text_col)
    docs = df.where(F.octet_length(text) >= sizes[0]).select(row.alias("row"), text.alias("text"))
    marks = docs.mapInArrow(T.tidy(_fingerprints(n_parts, sizes[0])), SCHEMA).repartitionById(n_parts, F.col("part")).mapInArrow(T.tidy(_remaining(n_parts)), SCHEMA)
    places = T.stored(marks.repartitionById(n_parts, F.col("part")).mapInArrow(T.tidy(_places), "row bigint, places binary, hot binary"), "places")
    some = T.sieve(docs, "row", places.select("row")).join(places.hint("merge"), "row").select("row", "text", "places", "hot")
    runs = some.mapInArrow(T.tidy(_send(n_parts, sizes)), SCHEMA).repartitionById(n_parts, F.col("part")).mapInArrow(T.tidy(_merge(n_parts, sizes)), SCHEMA)
    names = [f"spans{k}" for k in range(len(sizes))]
    spans = T.stored(runs.repartitionById(n_parts, F.col("part")).mapInArrow(T.tidy(_spans(sizes)), ", ".join(["row bigint", *(f"{n} binary" for n in names)])), "spans")
    little = lambda n: F.lit(np.array([n], np.int32).tobytes())
    head = F.substring(F.col("places"), 1, 4)
    whole = places.where((head == little(COPY)) | (head == little(FIRST))).select(F.col("row").alias("__w"))
    every = T.stored(spans.join(whole, F.col("row") == F.col("__w"), "full").select(F.coalesce("row", "__w").alias("row"), F.col("__w").isNotNull().alias("whole"), *names), "repeats")
    T.discard(places, spans)
    return every


def _applied(df: DataFrame, columns: list[str], schema: str, make, id_col: str, text_col: str, sizes: tuple[int, ...]) -> DataFrame:
    """Rows of df with what make(bytes, spans by size) gives; spans is an array of (start, end)."""
    sizes = tuple(sorted(set(sizes)))
    found = repeated_spans(df, id_col, text_col, sizes)
    names = [f"spans{k}" for k in range(len(sizes))]
    text, row = _named(df, id_col, text_col)
    own = [f"c{k}" for k in range(len(columns))]  # whatever the columns are called
    kept = df.select(*[df[f"`{c}`"].alias(o) for c, o in zip(columns, own, strict=True)], text.alias("text"), row.alias("name"))
    some, rest = T.sieves(kept, "name", found.select("row"))
    joined = some.join(found.hint("merge"), F.col("name") == F.col("row"), "left").select(*own, "text", "whole", *names)
    joined = joined.unionByName(rest.select(*own, "text", F.lit(None).cast("boolean").alias("whole"), *(F.lit(None).cast("binary").alias(n) for n in names)))
    n = len(columns)
    head = ", ".join(f"{o} {kept.schema[o].dataType.simpleString()}" for o in own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = T.texts(batch.column(n))
            made = []
            for k, all_ in enumerate(batch.column(n + 1)):
                raw = t.raw(k)
                cut = {}
                for size, blob in zip(sizes, (batch.column(n + 2 + w)[k] for w in range(len(sizes))), strict=True):
                    if all_.as_py():
                        cut[size] = np.array([[0, len(raw)]] if len(raw) >= size else [], np.int64).reshape(-1, 2)
                    else:
                        cut[size] = np.frombuffer(blob.as_buffer(), np.int64).reshape(-1, 2) if blob.is_valid else np.zeros((0, 2), np.int64)
                made.append(make(raw, cut))
            if made:
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(c) for c in zip(*made, strict=True))], names=[*own, *(x.split()[0] for x in schema.split(", "))])

    made = joined.mapInArrow(T.tidy(run), f"{head}, {schema}")
    return made.toDF(*columns, *made.columns[n:])


def kept_bytes(raw: bytes, spans: np.ndarray) -> bytes:
    at, out = 0, []
    for a, b in spans.tolist():
        out.append(raw[at:a])
        at = b
    out.append(raw[at:])
    return b"".join(out)


def passages(raw: bytes, spans: np.ndarray, words: int) -> tuple[int, np.ndarray]:
    """Words in the spans that hold more than so many of them, and those spans."""
    count = [len(raw[a:b].split()) for a, b in spans.tolist()]
    return sum(c for c in count if c > words), spans[np.array(count, np.int64) > words]


def joined_spans(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Spans that cover what either list covers."""
    out: list[list[int]] = []
    for x, y in sorted([*a.tolist(), *b.tolist()]):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return np.array(out, np.int64).reshape(-1, 2)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, passage: int = PASSAGE_BYTES, words: int = PASSAGE_WORDS) -> DataFrame:
    """Per row: n_bytes, n_removed, n_spans, kept_sha256 of the strings of `size` bytes, and n_passage_words: the words in repeated passages, which are told but not removed."""

    def make(raw: bytes, spans: dict[int, np.ndarray]) -> tuple:
        cut = spans[size]
        return len(raw), int((cut[:, 1] - cut[:, 0]).sum()), len(cut), hashlib.sha256(kept_bytes(raw, cut)).hexdigest(), passages(raw, spans[passage], words)[0]

    return _applied(df, [id_col], "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passage_words bigint", make, id_col, text_col, (size, passage))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, passage: int | None = None, words: int = PASSAGE_WORDS) -> DataFrame:
    """df with its repeated strings of `size` bytes cut out of the text, and with `passage` its repeated passages too; a character of which a part is cut out goes as a whole."""
    others = [c for c in df.columns if c != text_col]

    def make(raw: bytes, spans: dict[int, np.ndarray]) -> tuple:
        cut = spans[size] if passage is None else joined_spans(spans[size], passages(raw, spans[passage], words)[1])
        return (kept_bytes(raw, cut).decode("utf-8", "ignore"),)

    kept = T.unused(df, "__kept")[0]
    made = _applied(df, others, f"{kept} string", make, id_col, text_col, (size,) if passage is None else (size, passage))
    return made.select(*[F.col(kept).alias(text_col) if c == text_col else F.col(f"`{c}`") for c in df.columns])
