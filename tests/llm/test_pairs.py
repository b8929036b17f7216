"""Operators on pairs of documents and on repeated passages, against brute force."""

import random
import re

import pytest

from foliograph.llm import graph, ngramjoin, textops

SF = "/root/testdata/sf0.01"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def shingles(text):
    ws = SPACED.findall(lower(text or ""))
    if len(ws) < 5:
        return {tuple(ws)} if ws else set()
    return {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)}


def brute_classes(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in sets if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    by = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            for g in s:
                by.setdefault(g, []).append(k)
    pairs = {(a, b) for v in by.values() for x, a in enumerate(v) for b in v[x + 1 :]}
    for a, b in pairs:
        (i, s), (j, t) = sets[a], sets[b]
        if 100 * len(s & t) >= 75 * len(s | t):
            x, y = find(i), find(j)
            up[max(x, y)] = min(x, y)
    return sorted(((i, len(s), find(i) if i is not None else None) for i, s in sets), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def near_copies(seed, n):
    pick = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [pick.choice(vocabulary) for _ in range(40)]
    out = []
    for i in range(n):
        kind = pick.random()
        if kind < 0.5 and out:
            ws = pick.choice(out)[1].split()
            for _ in range(pick.randint(0, max(1, len(ws) // 18))):
                if ws:
                    ws[pick.randrange(len(ws))] = pick.choice(vocabulary)
            if pick.random() < 0.3:
                ws = ws[: len(ws) * 9 // 10]
        else:
            ws = [pick.choice(vocabulary) for _ in range(pick.choice([1, 3, 5, 6, 9, 20, 60, 150, 300]))]
            if kind < 0.75:
                ws += passage
        out.append((i, " ".join(ws)))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_similarity_classes(spark, seed):
    rows = [*near_copies(seed, 260), (900, None), (901, ""), (902, " \n"), (903, "A b"), (904, "a B"), (905, "q r s t u"), (None, "q r s t u"), (None, None), (5, "q r s t u")]
    df = spark.createDataFrame([(i, t, 0, 1.5) for i, t in rows], "doc_id bigint, text string, n_shingles int, set double").repartition(4)
    assert got(ngramjoin.similarity_classes(df)) == brute_classes(rows)


def test_similarity_classes_small_blocks(spark, monkeypatch):
    """Small blocks, a copy of a centre for each partner, and a filter so full that it lets nearly all through."""
    monkeypatch.setattr(ngramjoin, "LOCAL_BYTES", 3000)
    monkeypatch.setattr(ngramjoin, "CHUNK", 1)
    monkeypatch.setattr(textops, "FILTER_BITS", 64)
    rows = near_copies(9, 300)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    want = brute_classes(rows)
    assert got(ngramjoin.similarity_classes(df)) == want


def test_similarity_classes_of_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(ngramjoin.similarity_classes(df)) == brute_classes([(r.doc_id, r.text) for r in df.collect()])


def test_similarity_classes_empty(spark):
    assert ngramjoin.similarity_classes(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_pigeonhole():
    """Whatever two sets within the bound are taken, one finds the other through some key."""
    import numpy as np

    pick = np.random.default_rng(4)
    for n in (1, 2, 3, 4, 7, 10, 33, 150, 700):
        for _ in range(12):
            base = np.unique(pick.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            other = base[pick.random(len(base)) > pick.choice([0, 0.05, 0.12])]
            add = pick.integers(0, 1 << 63, pick.integers(0, max(1, n // 7) + 1), dtype=np.uint64)
            other = np.unique(np.concatenate([other, add]))
            both = len(np.intersect1d(base, other))
            if not len(other) or 100 * both < 75 * (len(base) + len(other) - both):
                continue
            rows = ngramjoin.parities([base, other])
            assert sum(int(x ^ y).bit_count() if x ^ y >= 0 else int((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(rows[0].tolist(), rows[1].tolist(), strict=True)) <= len(base) + len(other) - 2 * both
            bands = ngramjoin.Bands(75)
            for s in (base, other):
                bands.number(len(s))
            keys, docs, roles, spare = ngramjoin.entries([base, other], bands)
            assert (spare[:, 2] >= 0).all()
            a = {(k, r) for k, d, r in zip(keys.tolist(), docs.tolist(), roles.tolist(), strict=True) if d == 0}
            b = {(k, r) for k, d, r in zip(keys.tolist(), docs.tolist(), roles.tolist(), strict=True) if d == 1}
            large, small = (a, b) if len(base) >= len(other) else (b, a)
            probes = {k for k, r in large if r & ngramjoin.PROBES}
            assert probes & {k for k, r in small if r & ngramjoin.INDEXED}


@pytest.mark.parametrize("bits", [64, 1 << 12])
def test_sieves(spark, monkeypatch, bits):
    monkeypatch.setattr(textops, "FILTER_BITS", bits)
    rows = [(k if k % 7 else None, f"t{k}") for k in range(400)]
    df = spark.createDataFrame(rows, "id bigint, text string").repartition(3)
    keys = spark.createDataFrame([(k,) for k in range(0, 400, 5)] + [(None,)], "other bigint")
    through, rest = (sorted((tuple(r) for r in x.collect()), key=repr) for x in textops.sieves(df, "id", keys))
    assert sorted(through + rest, key=repr) == sorted(rows, key=repr)
    assert {r for r in rows if r[0] is not None and r[0] % 5 == 0} <= set(through)
    assert {r for r in rows if r[0] is None} <= set(rest)
    assert textops.sieve(df, "id", keys.limit(0)).count() == 0


def test_components(spark):
    pick = random.Random(5)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(pick.randrange(200, 300), pick.randrange(200, 300)) for _ in range(60)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {x: find(x) for x in found}
    assert set(found) == {x for a, b in edges if a != b for x in (a, b)}
