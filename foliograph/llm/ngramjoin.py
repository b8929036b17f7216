"""Exact similarity join of n-gram sets by partitioning the universe.

Two sets of sizes r >= s with a Jaccard similarity of p percent or more differ in
at most H = (100 - p)(r + s) / (100 + p) elements. The universe of hashed shingles
is cut into m segments, so both sets fall into m parts whose differences add up
to H at most. Sizes form bands; m belongs to the band of the smaller set. The
smaller set is indexed under all its parts, and, in the first m / 16 segments,
under all parts with one element deleted. The larger set probes its own band and
those below that may hold partners. It spends H + 1 units on segments: the first
unit on a segment finds equal parts, a second one also finds parts that differ by
one element, by probing with deletions and among deletions. By the pigeonhole
principle some segment differs by less than the units spent on it, whichever
segments are chosen; so each set chooses those that cost least, by how often a
part occurs among the texts read together. Empty and common parts are left out
that way, but nothing is capped: they are used where the units need them.

Texts with equal sets are first reduced to one. Parts that are shared by more
than two documents give candidate pairs with one of them (a star) instead of all
pairs; the members are kept. What the verified links leave in different
components is then compared pair by pair, where a part is shared across
components; by then it is known how many documents share each part, and every set
chooses its segments anew by these numbers. Hence no link between components is lost, and groups of copies cost
one comparison for each copy. Every candidate is verified on the whole sets.

Shingles, words and sets are 64-bit hashes of the words' bytes; equality is that
of the hashes.

Defined results: null, empty and wordless texts have an empty set and are linked
with nothing; a text of fewer words than a shingle has one shingle, all of it;
rows with one id are one document, linked through any of its texts; rows without
an id are returned with a null component; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph, groups
from . import textops as T
from .blobs import SCHEMA, batch_of, by_part, from48, low48, pack, unpack

WORDS = 5
PERCENT = 75
#: Bytes of text whose parts are compared with each other before the shuffle.
LOCAL_BYTES = 2 << 20
#: One in so many segments is also indexed with deletions.
DELETION_SHARE = 16
#: Segments beyond those that the largest partner needs, one in so many: room to leave common parts out.
SPARE_SHARE = 6
#: Bits that bound from below in how many elements two sets differ, and those that are left of them where all pairs of a block are looked at.
BITMAP, FOLDED = 2048, 512
#: Pairs that a task holds to put each out once.
HELD = 1 << 20
#: Partners that one copy of a text is compared with.
CHUNK = 64

INDEXED, PROBES, GATHERED, FIXED, MAYBE = 1, 2, 4, 8, 16
OFFSET = 32  # from this bit on: how many bands below its own the key belongs to
PAIR, MEMBER, FACT = 0, 1, 2

_K1, _K2, _K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_SALT = np.uint64(0xE7037ED1A0B428DB)
_LOW = np.uint64((1 << 48) - 1)


def shingle_sets(t: T.Texts, words: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = T.Words(t, T.SPACE_SEP, lower=True)
    h = w.hashes()
    pre = T.prefix(h)
    count = np.diff(w.first)
    at, key = T.ngrams(h, w.doc, words)
    edge = np.searchsorted(at, w.first)
    whole = T.range_hash(pre, w.first[:-1], w.first[1:]) if len(t) else key
    for d in range(len(t)):
        if count[d] >= words:
            yield np.unique(key[edge[d] : edge[d + 1]])
        else:
            yield whole[d : d + 1] if count[d] else key[:0]


class Band:
    """Sizes from lo to hi, and the segments for them."""

    def __init__(self, number: int, lo: int, hi: int, percent: int):
        self.number, self.lo, self.hi, self.percent = number, lo, hi, percent
        need = self.units(hi * 100 // percent)
        self.m = need + need // SPARE_SHARE
        self.deleted = -(-self.m // DELETION_SHARE)
        self.edges = np.array([-(-(j << 32) // self.m) << 32 for j in range(1, self.m)], np.uint64)
        self.salt = np.arange(self.m, dtype=np.uint64) * _K2 + np.uint64((number + 1) * int(_K3) % 2**64)

    def units(self, r: int) -> int:
        """What a set of size r must spend on this band."""
        return (100 - self.percent) * (r + min(r, self.hi)) // (100 + self.percent) + 1

    def parts(self, s: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bounds, sizes and content sums of the parts of a sorted set."""
        bounds = np.empty(self.m + 1, np.int64)
        bounds[0], bounds[-1] = 0, len(s)
        bounds[1:-1] = np.searchsorted(s, self.edges)
        return bounds, np.diff(bounds), sums[bounds[1:]] - sums[bounds[:-1]]

    def key(self, content: np.ndarray, size: np.ndarray, segment: np.ndarray | slice, deleted: bool) -> np.ndarray:
        return T.mix(content * _K1 + self.salt[segment] + size.astype(np.uint64) * np.uint64(2) + np.uint64(deleted))


class Bands:
    def __init__(self, percent: int):
        self.percent, self.all, self.starts = percent, [], []

    def number(self, n: int) -> int:
        while not self.all or self.all[-1].hi < n:
            lo = self.all[-1].hi + 1 if self.all else 1
            band = Band(len(self.all), lo, max(lo, lo * 100 // self.percent), self.percent)
            self.all.append(band)
            self.starts.append(lo)
        return bisect.bisect_right(self.starts, n) - 1

    def partners(self, n: int) -> range:
        """Bands with sizes of sets that a set of size n may be the larger partner of."""
        top = self.number(n)
        return range(self.number(max(1, -(-n * self.percent // 100))), top + 1)


def _deletions(band: Band, s_mix: np.ndarray, bounds: np.ndarray, size: np.ndarray, content: np.ndarray, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment, size and content of the parts of these segments with each element left out."""
    n = size[segments]
    seg = np.repeat(segments, n)
    at = np.repeat(bounds[segments] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    return seg, size[seg] - 1, content[seg] - s_mix[at]


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """For each set a row of 64-bit words whose bits tell which of BITMAP classes of elements are odd in number.

    Two sets differ in at least as many elements as their rows differ in bits.
    """
    out = np.zeros((len(sets), BITMAP // 64), np.int64)
    for k, s in enumerate(sets):
        odd = np.bincount((T.mix(s ^ _K3) % np.uint64(BITMAP)).astype(np.int64), minlength=BITMAP) & 1
        out[k] = np.packbits(odd.astype(np.uint8)).view(np.int64)
    return out


def entries(sets: list[np.ndarray], bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, set numbers and roles that index and probe all these sets; (set, offset, how many of its probes may be left out)."""
    own = []
    for s in sets:
        b = bands.all[bands.number(len(s))]
        mixed = T.mix(s)
        sums = np.zeros(len(s) + 1, np.uint64)
        np.cumsum(mixed, out=sums[1:])
        bounds, size, content = b.parts(s, sums)
        own.append((b, mixed, sums, bounds, size, content, b.key(content, size, slice(None), False)))
    every = np.sort(np.concatenate([x[-1] for x in own])) if own else np.empty(0, np.uint64)
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.empty(0, np.int64)
    table, times = every[first], np.diff(np.append(first, len(every)))
    keys, docs, roles, spare = [], [], [], []

    def add(d: int, k: np.ndarray, role: int | np.ndarray) -> None:
        keys.append(k)
        docs.append(np.full(len(k), d, np.int64))
        roles.append(np.broadcast_to(np.asarray(role, np.uint8), len(k)))

    for d, s in enumerate(sets):
        top = bands.number(len(s))
        for number in bands.partners(len(s)):
            b = bands.all[number]
            mine = number == top
            if mine:
                _, mixed, sums, bounds, size, content, exact = own[d]
            else:
                bounds, size, content = b.parts(s, own[d][2])
                exact = b.key(content, size, slice(None), False)
            slot = np.minimum(np.searchsorted(table, exact), len(table) - 1)
            often = np.where(table[slot] == exact, times[slot], 0) - mine
            cost = often.astype(float) + (size == 0) * 1e9 - np.minimum(size, 64) * 1e-3
            second = cost[: b.deleted] + 0.5 + (size[: b.deleted] < 2) * 1e9
            need = b.units(len(s))
            units = np.argsort(np.concatenate([cost, second]), kind="stable")[:need]
            one = units[units < b.m]
            two = units[units >= b.m] - b.m
            offset = (top - number) * OFFSET
            role = np.where(size > 0, MAYBE, 0)
            role[one] = PROBES
            role[two] = PROBES | FIXED
            spare.append((d, top - number, int((role > 0).sum()) + len(two) - need))
            role = (role + INDEXED * mine).astype(np.uint8)
            used = np.flatnonzero(role)
            add(d, exact[used], role[used] + np.uint8(offset))
            if mine:
                seg, n, c = _deletions(b, mixed, bounds, size, content, np.arange(b.deleted))
                add(d, b.key(c, n, seg, True), INDEXED)
            if len(two):
                add(d, b.key(content[two], size[two], two, True), PROBES + FIXED + offset)
                seg, n, c = _deletions(b, own[d][1], bounds, size, content, two)
                add(d, b.key(c, n, seg, False), PROBES + FIXED + offset)
    none = np.empty(0, np.uint64)
    spare = np.array(spare, np.int64).reshape(-1, 3)
    return (np.concatenate(keys), np.concatenate(docs), np.concatenate(roles), spare) if keys else (none, none.astype(np.int64), none.astype(np.uint8), spare)


def grouped(keys: np.ndarray, ids: np.ndarray, roles: np.ndarray):
    """Sorted by key then id, one entry for each (key, id); where each key begins; the union of each key's roles."""
    order = np.lexsort((ids, keys))
    keys, ids, roles = keys[order], ids[order], roles[order]
    if not len(keys):
        return keys, ids, roles, np.zeros(0, np.int64), roles
    new = np.append(True, (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1]))
    start = np.flatnonzero(new)
    roles = np.bitwise_or.reduceat(roles, start)
    keys, ids = keys[start], ids[start]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys, ids, roles, first, np.bitwise_or.reduceat(roles, first)


def centres(ids: np.ndarray, roles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each key the place of the smallest id that probes, else of the smallest."""
    n = len(ids)
    place = np.where(roles & PROBES, np.arange(n), np.arange(n) + n)
    return np.minimum.reduceat(place, first) % n if n else first


def local(keys: np.ndarray, ids: np.ndarray, roles: np.ndarray):
    """Reduces keys that several of these documents share to one entry each; gives the entries, star pairs and members."""
    keys, ids, roles, first, union = grouped(keys, ids, roles)
    count = np.diff(np.append(first, len(keys)))
    centre = centres(ids, roles, first)
    many = count > 1
    out = (keys[centre], ids[centre], np.where(many, union | GATHERED, roles[centre]).astype(np.uint8))
    inside = np.repeat(many, count)
    linked = np.repeat(many & (union & 3 == 3), count)
    hub = np.repeat(ids[centre], count)
    away = linked & (hub != ids)
    return out, (ids[away], hub[away]), (keys[inside], ids[inside], roles[inside])


ENTRY, SPARE, BITS = 3, 4, 5
_KINDS = {ENTRY: [np.uint8, np.int64, np.uint32, np.uint8], PAIR: [np.int64, np.int64], MEMBER: [np.uint64, np.int64, np.uint8], FACT: [np.int64, np.uint8, np.int64, np.uint64, np.uint64], SPARE: [np.int64, np.int64, np.int64], BITS: [np.int64, np.int64]}


def _index(n_parts: int, words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        turn = 0
        for batch in batches:
            all_ids = batch.column(0)
            known = np.array(all_ids.is_valid())
            all_ids = np.array(all_ids.fill_null(0), np.int64)
            for i, j, block in T.slices(T.texts(batch.column(1)), LOCAL_BYTES):
                sets: list[np.ndarray] = []
                for _, _, t in T.slices(block):
                    sets.extend(shingle_sets(t, words))
                size = np.array([len(s) for s in sets], np.int64)
                one = np.array([s.sum() for s in sets], np.uint64) if sets else np.empty(0, np.uint64)
                two = np.array([T.mix(s ^ _SALT).sum() for s in sets], np.uint64)
                ids, valid = all_ids[i:j], known[i:j]
                _, distinct = np.unique(np.stack([one, two, size.astype(np.uint64)]), axis=1, return_index=True)
                distinct = np.sort(distinct)
                distinct = distinct[(size[distinct] > 0)]
                # the first row of equal sets may lack an id; then the set is taken from another row by its facts only if that has one
                kept = distinct[valid[distinct]]
                lost = distinct[~valid[distinct]]
                if len(lost):
                    seen = {(int(one[k]), int(two[k])) for k in lost}
                    extra: dict[tuple[int, int], int] = {}
                    for k in np.flatnonzero(valid & (size > 0)).tolist():
                        f = (int(one[k]), int(two[k]))
                        if f in seen:
                            extra.setdefault(f, k)
                    kept = np.sort(np.concatenate([kept, np.array(sorted(extra.values()), np.int64)]))
                keys, docs, roles, spare = entries([sets[k] for k in kept.tolist()], bands)
                entry, pairs, members = local(keys, ids[kept][docs] if len(kept) else docs, roles)
                out_part, out_blob = [], []
                order = np.argsort(entry[1], kind="stable")  # by document again, so that ids are stored once each
                k, d, r = (x[order] for x in entry)
                part = (k >> np.uint64(40)).astype(np.int64) % n_parts
                for p, at in by_part(part, n_parts):
                    new = np.flatnonzero(np.append(True, d[at][1:] != d[at][:-1]))
                    out_part.append(p)
                    out_blob.append(pack(ENTRY, low48(k[at]), d[at][new], np.diff(np.append(new, len(at))).astype(np.uint32), r[at]))
                if len(pairs[0]):
                    both = np.unique(np.stack([np.minimum(*pairs), np.maximum(*pairs)]), axis=1)
                    out_part.append(turn % n_parts)
                    out_blob.append(pack(PAIR, both[0], both[1]))
                if len(members[0]):
                    out_part.append((turn + 1) % n_parts)
                    out_blob.append(pack(MEMBER, *members))
                out_part.append((turn + 2) % n_parts)
                out_blob.append(pack(FACT, ids, valid.astype(np.uint8), size, one, two))
                out_part.append((turn + 3) % n_parts)
                out_blob.append(pack(SPARE, ids[kept][spare[:, 0]] if len(kept) else spare[:, 0], spare[:, 1], spare[:, 2]))
                out_part.append((turn + 4) % n_parts)
                out_blob.append(pack(BITS, ids[kept], parities([sets[k] for k in kept.tolist()])))
                turn += 5
                yield batch_of(list(zip(out_part, out_blob, strict=True)))

    return run


_ROWS = "kind int, a bigint, b bigint, x bigint, y bigint, bits array<bigint>"


def _rows(kind: int, a: np.ndarray, b: np.ndarray, x: np.ndarray | None = None, y: np.ndarray | None = None, valid: np.ndarray | None = None, bits: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    zero = np.zeros(len(a), np.int64)
    for i in range(0, len(a), 1 << 18):
        cut = slice(i, i + (1 << 18))
        n = len(a[cut])
        words = pa.nulls(n, pa.list_(pa.int64())) if bits is None else pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bits.shape[1]), pa.array(bits[cut].ravel()))
        mask = None if valid is None else ~valid[cut].astype(bool)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int32)), pa.array(a[cut].astype(np.int64), mask=mask), pa.array(b[cut].astype(np.int64)), pa.array((zero if x is None else x.view(np.int64))[cut]), pa.array((zero if y is None else y.view(np.int64))[cut]), words],
            names=["kind", "a", "b", "x", "y", "bits"],
        )


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition of the index: star pairs of the keys that documents share, and the members of larger groups."""
    keys, ids, roles, pairs = [], [], [], []
    for batch in batches:
        for raw in batch.column(1):
            kind, x = unpack(raw.as_py(), _KINDS)
            if kind == ENTRY:
                low, doc, count, role = x
                keys.append(from48(low))
                ids.append(np.repeat(doc, count))
                roles.append(role)
            elif kind == PAIR:
                pairs.append(np.stack(x))
            elif kind == MEMBER:
                yield from _rows(MEMBER, x[1], x[2].astype(np.int64), x[0] & _LOW)
            elif kind == BITS:
                yield from _rows(BITS, x[0], np.zeros(len(x[0]), np.int64), bits=x[1].reshape(-1, BITMAP // 64))
            elif kind == SPARE:
                yield from _rows(SPARE, x[0], x[1], x[2])
            else:
                yield from _rows(FACT, x[0], x[2], x[3], x[4], x[1])
    if keys:
        k = np.concatenate(keys)
        keys.clear()
        order = np.argsort(k)
        k = k[order]
        same = k[1:] == k[:-1]
        shared = np.append(False, same) | np.append(same, False)
        order = order[shared]  # most keys belong to one document
        k, d, r, first, union = grouped(k[shared], np.concatenate(ids)[order], np.concatenate(roles)[order])
        count = np.diff(np.append(first, len(k)))
        centre = centres(d, r, first)
        good = (count > 1) & (union & 3 == 3)
        hub = np.repeat(d[centre], count)
        away = np.repeat(good, count) & (hub != d)
        pairs.append(np.stack([np.minimum(d[away], hub[away]), np.maximum(d[away], hub[away])]))
        done = good & (count == 2) & (union & GATHERED == 0)  # its only pair is a candidate already
        wanted = (count > 1) & (union & INDEXED > 0) & (union & (PROBES | MAYBE) > 0) & ~done
        more = np.repeat(wanted, count) & (r & GATHERED == 0)  # a gathered one is listed with the others of its task
        yield from _rows(MEMBER, d[more], r[more].astype(np.int64), k[more])
    if pairs:
        both = np.unique(np.concatenate(pairs, axis=1), axis=1)
        yield from _rows(PAIR, both[0], both[1])


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are as similar as asked."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < percent * len(large) or not len(small):
        return False
    at = np.searchsorted(large, small)
    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _verified(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as asked.

    The text of b goes to that of a; where a has many partners they are dealt to
    several groups, each with a copy of a. A task reads its groups in order, a
    first, and holds the set of one a at a time.
    """
    n_parts = T.parts(docs.sparkSession)
    crowd = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK).select(F.col("a").alias("crowded"), "n")
    dealt = pairs.join(crowd, F.col("a") == F.col("crowded"), "left").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.coalesce("n", F.lit(1)) / CHUNK)).cast("int").alias("chunk"))
    roles = T.stored(dealt.select("a", "chunk", F.col("b").alias("id"), F.lit(1).alias("role")).unionByName(dealt.select("a", "chunk", F.col("a").alias("id"), F.lit(0).alias("role")).distinct()), "roles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, centre = None, {}
        for batch in batches:
            a, chunk, role, b = (batch.column(k).to_numpy() for k in range(4))
            good = np.zeros(batch.num_rows, bool)
            for i, _, t in T.slices(T.texts(batch.column(4))):
                for k, s in enumerate(shingle_sets(t, words), i):
                    if (a[k], chunk[k]) != group:
                        group, centre = (a[k], chunk[k]), {}
                    if role[k]:
                        good[k] = any(alike(x, s, percent) for x in centre.values())
                    else:
                        centre[s.tobytes()] = s
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], names=["a", "b"])

    rows = T.sieve(docs, "__id", roles.select("id")).join(roles.hint("merge"), F.col("id") == F.col("__id")).select("a", "chunk", "role", "id", "__text")
    found = T.stored(rows.repartition(n_parts, "a", "chunk").sortWithinPartitions("a", "chunk", "role").mapInArrow(T.tidy(run), "a bigint, b bigint").distinct(), "links")
    T.discard(roles)
    return found


def _may_link(p: str, q: str, size: int, percent: int) -> Column:
    """Whether the sizes and bitmaps of two documents leave room for a link."""
    bit = lambda x, k: F.col(f"{x}.bits")[k]
    differ = sum((F.bit_count(bit(p, k).bitwiseXOR(bit(q, k))) for k in range(size // 64)), F.lit(0))
    sizes = (F.col(f"{q}.most") * 100 >= F.col(f"{p}.least") * percent) & (F.col(f"{p}.most") * 100 >= F.col(f"{q}.least") * percent)
    return sizes & F.coalesce(differ * (100 + percent) <= (F.col(f"{p}.most") + F.col(f"{q}.most")) * (100 - percent), F.lit(True))


def _across(members: DataFrame, spare: DataFrame, shapes: DataFrame, labels: DataFrame, percent: int, note: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs of one key whose documents are in different components and of sizes that allow a link.

    Now that it is known how many documents share each key, every document leaves
    out its most common ones, as many as the pigeonhole principle lets it. Keys of
    one component, or of one document, cost nothing and are never left out. A pair
    whose bitmaps show that it differs in too many elements is no candidate.
    """
    named = members.groupBy(F.col("x").alias("key"), F.col("a").alias("doc")).agg(F.bit_or("b").alias("role")).join(labels, F.col("doc") == labels.node, "left").select("key", "doc", "role", F.coalesce("component", "doc").alias("component"))
    asks = F.col("roles").bitwiseAND(INDEXED) > 0
    open_keys = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.bit_or("role").alias("roles"), F.count(F.lit(1)).alias("times")).where((F.col("low") != F.col("high")) & asks & (F.col("roles").bitwiseAND(PROBES | MAYBE) > 0)).select("key", "times")
    rows = note(T.stored(named.join(open_keys, "key"), "open"))
    role = F.col("role")
    probes = rows.where(role.bitwiseAND(PROBES | MAYBE) > 0).withColumn("offset", F.shiftright(role, 5))
    rank = F.row_number().over(Window.partitionBy("doc", "offset").orderBy(role.bitwiseAND(FIXED) > 0, F.col("times").desc(), "key"))
    kept = probes.withColumn("rank", rank).join(spare, ["doc", "offset"], "left").where((F.col("rank") > F.coalesce("spare", F.lit(0))) | (role.bitwiseAND(FIXED) > 0)).select("key", "doc", "component")
    asked = rows.where(role.bitwiseAND(INDEXED) > 0).select("key", "doc", "component", F.lit(False).alias("probes"))
    entries = kept.select("key", "doc", "component", F.lit(True).alias("probes")).unionByName(asked)
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.count_if("probes").alias("asking")).where("asking > 0 and size > asking")
    members = groups.dealt(entries, sizes, "doc", groups.BLOCK).join(shapes.select("rep", "least", "most", "bits"), F.col("doc") == F.col("rep")).drop("rep")
    found = groups.gathered(members, T.parts(members.sparkSession)).mapInArrow(T.tidy(_meet(percent)), "a bigint, b bigint").distinct()
    return T.stored(found, "across")


def _meet(percent: int):
    """Pairs of one key, in different components, for which sizes and bitmaps leave room: those of a key that is common to many are compared in blocks, bitmap by bitmap.

    Similar texts share many keys. So a task puts a pair out once, of the last HELD
    pairs, and the whole bitmaps decide here: folded ones, which pass long texts, only
    choose the pairs for which that is done.
    """

    def room(g: groups.Members, words: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        least, most = g.sizes
        fits = (most[j] * 100 >= least[i] * percent) & (most[i] * 100 >= least[j] * percent)
        differ = np.zeros(np.broadcast(i, j).shape, np.int64)
        for word in words:
            differ += np.bitwise_count(word[i] ^ word[j])
        return fits & (differ * (100 + percent) <= (most[i] + most[j]) * (100 - percent)) | ~(g.known[i] & g.known[j]) & fits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((2, 0), np.int64)
        for batch in groups.whole(batches):
            g = groups.Members(batch)
            doc, component, probes = g.take("doc"), g.take("component"), g.take("probes")
            g.sizes = g.take("least"), g.take("most")
            bits = g.column("bits")
            g.known = np.array(bits.is_valid())
            words = np.zeros((len(doc), BITMAP // 64), np.uint64)
            words[g.known] = bits.drop_null().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, BITMAP // 64)
            whole = np.ascontiguousarray(words.T)
            folded = np.bitwise_xor.reduce(whole.reshape(-1, FOLDED // 64, len(doc)), axis=0)  # classes that fall together are added modulo 2
            found = [held]
            for i, j in g.pairs(lambda x, y, g=g, folded=folded: room(g, folded, x[:, None], y[None, :])):
                good = (component[i] != component[j]) & (probes[i] != probes[j]) & g.meet(i, j)
                i, j = i[good], j[good]
                good = room(g, whole, i, j)
                found.append(np.stack([np.minimum(doc[i[good]], doc[j[good]]), np.maximum(doc[i[good]], doc[j[good]])]))
            held = np.unique(np.concatenate(found, axis=1), axis=1) if len(found) > 1 else held
            if held.shape[1] >= HELD:
                yield put_out(held)
                held = held[:, :0]
        yield put_out(held)

    def put_out(pairs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return run


def _plausible(pairs: DataFrame, shapes: DataFrame, percent: int) -> DataFrame:
    """The pairs that sizes and bitmaps leave room for."""
    p, q = shapes.alias("p"), shapes.alias("q")
    return pairs.alias("o").join(p, F.col("o.a") == F.col("p.rep")).join(q, (F.col("o.b") == F.col("q.rep")) & _may_link("p", "q", BITMAP, percent)).select("o.*")


def similarity_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row: id_col, n_shingles, component_id (the smallest id reachable by links of at least `percent` Jaccard similarity)."""
    with T.temporary() as note:
        return _classes(df, id_col, text_col, words, percent, note)


def _classes(df: DataFrame, id_col: str, text_col: str, words: int, percent: int, note: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What similarity_classes() gives, stored; everything else that is stored is noted, and goes afterwards."""
    spark = df.sparkSession
    docs = df.select(df[id_col].cast("bigint").alias("__id"), df[text_col].alias("__text"))
    n_parts = T.parts(spark)
    index = docs.mapInArrow(T.tidy(_index(n_parts, words, percent)), SCHEMA).repartitionById(n_parts, F.col("part"))
    found = note(T.stored(index.mapInArrow(T.tidy(_candidates), _ROWS), "candidates"))
    facts = found.where(f"kind = {FACT}").select("a", "b", "x", "y")
    filled = facts.where("a is not null and b > 0")
    # documents with equal sets stand for one another
    least = filled.groupBy("x", "y", "b").agg(F.min("a").alias("rep"))
    every = filled.join(least, ["x", "y", "b"]).select(F.col("a").alias("doc"), "rep").distinct()
    first = note(T.stored(every.groupBy("doc").agg(F.min("rep").alias("rep"), F.max("rep").alias("last")), "reps"))
    equal = every.join(first.select("doc", F.col("rep").alias("low")), "doc").where("rep != low").select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct()
    reps = first.select("doc", "rep")
    # of documents with several texts nothing is left out: their keys and sizes belong to different sets
    several = every.join(first.where("rep != last").select("doc"), "doc").select("rep").distinct().withColumn("several", F.lit(True))
    sizes = facts.where("a is not null").groupBy("a").agg(F.min("b").alias("least"), F.max("b").alias("most")).join(reps, F.col("a") == reps.doc).groupBy("rep").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    bits = found.where(f"kind = {BITS}").select("a", "bits").join(reps, F.col("a") == reps.doc).groupBy("rep").agg(F.first("bits").alias("bits")).join(several.select("rep"), "rep", "left_anti")
    shapes = note(T.stored(sizes.join(bits, "rep", "left"), "shapes"))

    def contracted(links: DataFrame) -> DataFrame:
        a, b = reps.select(F.col("doc").alias("a"), F.col("rep").alias("ra")), reps.select(F.col("doc").alias("b"), F.col("rep").alias("rb"))
        return links.join(a, "a").join(b, "b").groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(F.sum("times").alias("times")).where("a != b")

    # keys of one part give a pair once; how many parts do tells how alike the two are likely to be
    seen = found.where(f"kind = {PAIR}").groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"))
    pairs = note(T.stored(_plausible(contracted(seen), shapes, percent), "pairs"))
    # each document is first compared with its likeliest partner only
    first_choice = pairs.groupBy("b").agg(F.max_by("a", F.struct("times", -F.col("a"))).alias("a")).select("a", "b")
    links = note(T.stored(note(_verified(docs, first_choice, words, percent)).unionByName(equal), "links"))
    labels = note(graph.components(links))
    p, q = labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    apart = pairs.join(first_choice, ["a", "b"], "left_anti").join(p, "a", "left").join(q, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    second = note(_verified(docs, apart, words, percent))
    if not second.isEmpty():
        links = links.unionByName(second)
        labels = note(graph.components(links))
    # what is left: documents of different components that share a key
    spare = found.where(f"kind = {SPARE}").join(reps, F.col("a") == reps.doc).groupBy("rep", "b").agg(F.min("x").alias("least")).join(several, "rep", "left").select(F.col("rep").alias("doc"), F.col("b").cast("int").alias("offset"), F.when(F.col("several").isNull(), F.col("least")).otherwise(0).alias("spare"))
    named = found.where(f"kind = {MEMBER}").join(reps, F.col("a") == reps.doc).select(F.col("rep").alias("a"), "b", "x")
    across = note(_across(named, spare, shapes, labels, percent, note))
    left = note(T.stored(_plausible(across.join(pairs, ["a", "b"], "left_anti"), shapes, percent), "left"))
    if not left.isEmpty():
        third = note(_verified(docs, left, words, percent))
        if not third.isEmpty():
            labels = note(graph.components(links.unionByName(third)))
    kept = T.stored(facts.join(reps, facts.a == reps.doc, "left").select("a", "b", F.coalesce("rep", "a").alias("rep")).join(labels, F.col("rep") == labels.node, "left").select(F.col("a").alias(id_col), F.col("b").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id")), "classes")
    return kept
