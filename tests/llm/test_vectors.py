"""Operators on embeddings, against brute force."""

import hashlib
import math

import numpy as np
import pytest

from foliograph.llm import centroids, groups, latticededup

CHECK = "/root/testdata/check_s/embeddings.parquet"
ODD = "id bigint, packed binary, h string, k int, cluster int, label int, vec_id bigint, embedding array<float>, n bigint, node bigint, cells array<bigint>"


def frame(spark, rows):
    """Rows (vec_id, embedding, label) among columns whose names the operators use themselves."""
    return spark.createDataFrame([(7, b"x", "h", 1, 2, label, i, v, 5, 6, [1]) for i, v, label in rows], ODD).repartition(3)


def fits(v, dims=64):
    return v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)


def brute_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, _ in rows if fits(v)]
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    centres = [q for _, q in sorted(kept, key=lambda r: (name(r[0]), np.array(r[1], np.int32).tobytes()))[:k]]

    def assign():
        out = []
        for _, q in kept:
            d = [sum((a - b) ** 2 for a, b in zip(q, c, strict=True)) for c in centres]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds if centres else 0):
        best = assign()
        for j in range(len(centres)):
            own = [q for (_, q), (b, _) in zip(kept, best, strict=True) if b == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    best = assign() if centres else []
    by = {j: sum(d for b, d in best if b == j) for j in range(len(centres))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, b, d, by[b], sum(by.values()), digest[b]) for (i, _), (b, d) in zip(kept, best, strict=True)), key=repr)


def got_clusters(df):
    return sorted((tuple(r) for r in centroids.cluster(df).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


def vectors(seed, n):
    pick = np.random.default_rng(seed)
    return [(i, pick.normal(0, 0.3, 64).astype(np.float32).tolist(), int(pick.integers(0, 3))) for i in range(n)]


ODD_VECTORS = [(1000, None, 1), (1001, [], 1), (1002, [0.5] * 63, 1), (1003, [0.5] * 65, 1), (1004, [float("nan")] + [0.1] * 63, 1), (1005, [float("inf")] + [0.1] * 63, 1), (1006, [None] + [0.1] * 63, 1), (1007, [0.0] * 64, 1), (1008, [0.0] * 64, 1)]


def test_clusters(spark):
    rows = vectors(1, 150) + ODD_VECTORS
    rows += [(None, rows[0][1], 0), (3, rows[3][1], 0), (4, rows[9][1], 0)] + [(2000 + i, rows[5][1], 1) for i in range(60)]
    assert got_clusters(frame(spark, rows)) == brute_clusters(rows)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, n):
    rows = vectors(2, n)
    assert got_clusters(frame(spark, rows)) == brute_clusters(rows)


def test_too_large_component(spark):
    with pytest.raises(Exception, match="64 bits"):
        centroids.cluster(frame(spark, [(1, [1e9] * 64, 0)])).count()


def test_partial_distances():
    """Ties included, the centre is that of a full search; and most components are never compared."""
    pick = np.random.default_rng(3)
    x = (pick.integers(-3, 4, (500, 64)) * np.where(np.arange(64) < 8, 60, 1)).astype(np.int32)
    x[:200] = pick.integers(-1, 2, (200, 64))
    centres = np.concatenate([x[250:256], x[250:252]]).astype(np.int64)
    full = ((x[:, None].astype(np.int64) - centres) ** 2).sum(axis=2)
    best, least, compared = centroids.nearest(x, centres)
    assert (best == full.argmin(axis=1)).all() and (least == full.min(axis=1)).all()
    assert compared < 0.6 * full.size * 64


def unit(v):
    v = np.array(v, float)
    return v / np.sqrt((v * v).sum())


def brute_links(rows):
    """Linked pairs, as row numbers."""
    good = [k for k, (_, v, label) in enumerate(rows) if label is not None and v is not None and len(v) and fits(v, len(v)) and any(v)]
    us = {k: unit([np.float32(x) for x in rows[k][1]]) for k in good}
    return {(a, b) for x, a in enumerate(good) for b in good[x + 1 :] if rows[a][2] == rows[b][2] and len(us[a]) == len(us[b]) and us[a] @ us[b] >= 0.98}


def brute_copies(rows):
    pairs, up, n = brute_links(rows), list(range(len(rows))), [0] * len(rows)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        n[a] += 1
        n[b] += 1
        up[find(a)] = find(b)
    low = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((i, n[k], low.get(find(k)), i == low.get(find(k))) for k, (i, _, _) in enumerate(rows)), key=repr)


def got_copies(df):
    return sorted((tuple(r) for r in latticededup.near_copies(df).select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def near(seed, n, spread):
    pick = np.random.default_rng(seed)
    out = []
    for i in range(n):
        base = out[pick.integers(0, len(out))] if out and pick.random() < 0.6 else None
        v = pick.normal(0, 1, 64) if base is None else np.array(base[1]) + pick.normal(0, spread, 64)
        out.append((i, v.astype(np.float32).tolist(), int(pick.integers(0, 2)) if base is None or pick.random() < 0.1 else base[2]))
    return out


@pytest.mark.parametrize("block", [4, 512])
def test_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(groups, "BLOCK", block)
    rows = near(5, 240, 0.1) + ODD_VECTORS
    rows += [(3000, rows[0][1], None), (3001, (2 * np.array(rows[0][1])).tolist(), rows[0][2]), (3, rows[3][1], rows[3][2]), (None, rows[7][1], rows[7][2]), (3002, [1.0, 2.0], 0), (3003, [1.0, 2.01], 0), (None, [3.0], 0), (None, [4.0], 0)]
    rows += [(4000 + i, rows[11][1], rows[11][2]) for i in range(30)]
    assert got_copies(frame(spark, rows)) == brute_copies(rows)


def test_near_copies_empty(spark):
    assert got_copies(frame(spark, [])) == []


def test_recall_on_check_s(spark):
    """Links found are exact; at least 0.95 of all are found, of those that only just are links too."""
    table = spark.read.parquet(CHECK)
    rows = sorted((tuple(r) for r in table.select("vec_id", "embedding", "label").collect()), key=lambda r: r[0])
    us, labels = np.array([unit(v) for _, v, _ in rows]), np.array([label for _, _, label in rows])
    want = np.zeros(len(rows), int)
    for label in np.unique(labels):
        own = np.flatnonzero(labels == label)
        want[own] = (us[own] @ us[own].T >= 0.98).sum(axis=1) - 1
    found = {r.vec_id: r.n_links for r in latticededup.near_copies(table).collect()}
    have = np.array([found[i] for i, _, _ in rows])
    assert want.sum() > 10_000 and (have <= want).all()
    assert have.sum() >= 0.95 * want.sum()


def test_recall_at_the_threshold():
    pick = np.random.default_rng(6)
    a = pick.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = pick.normal(size=a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.98 * a + math.sqrt(1 - 0.98**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    label = np.zeros(len(a), np.int64)
    x, y = (latticededup.Lattices(64).keys(v, label) for v in (a, b))
    met = (x[:, :, :1] == y).any(axis=(1, 2)) | (y[:, :, :1] == x).any(axis=(1, 2))
    assert met.mean() >= 0.95


def test_lattice():
    assert len(latticededup.short_vectors()) == 240 and np.allclose((latticededup.short_vectors() ** 2).sum(axis=1), 2)
    x = np.random.default_rng(7).normal(0, 3, (2000, 8))
    point = latticededup.lattice_points(x)
    twice = (2 * point).astype(int)
    assert (twice == 2 * point).all() and ((twice % 2 == twice[:, :1] % 2).all()) and (twice.sum(axis=1) % 4 == 0).all()
    near = ((x[:, None] - point[:, None] - latticededup.short_vectors()) ** 2).sum(axis=2)
    assert (near >= ((x - point) ** 2).sum(axis=1)[:, None] - 1e-9).all()
