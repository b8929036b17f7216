"""Relations on tiles and outlines, against kernels and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliograph.operators import outlines as O
from foliograph.operators import pixels as P
from foliograph.operators import rasters as R

POINTS = "array<struct<x:double,y:double>>"


def tiles(spark, images):
    rows = [(k, y, x, int(v)) for k, a in enumerate(images) for y, line in enumerate(a) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, "k int, y int, x int, v int").repartition(3)


def images(df, n, size):
    out = np.zeros((n, size, size), np.uint8)
    for r in df.collect():
        out[r.k, r.y, r.x] = r.v
    return out


def test_equalised_and_doubled(spark):
    pick = np.random.default_rng(1)
    some = [pick.integers(0, 256, (8, 8)).astype(np.uint8), np.full((8, 8), 7, np.uint8), pick.integers(100, 104, (8, 8)).astype(np.uint8), np.repeat(np.arange(8, dtype=np.uint8)[None] * 30, 8, axis=0)]
    for grid, limit in ((1, 2.0), (2, 2.0), (4, 60.0), (2, 30.0)):
        got = images(R.equalised(tiles(spark, some), "k", 8, grid, limit), 4, 8)
        assert all((g == P.clahe(a, limit, grid)).all() for g, a in zip(got, some, strict=True)), (grid, limit)
    got = images(R.doubled(tiles(spark, some), "k", 8), 4, 16)
    assert all((g == P.double(a)).all() for g, a in zip(got, some, strict=True))


def test_components(spark):
    pick = np.random.default_rng(2)
    some = [pick.integers(0, 256, (20, 20)).astype(np.uint8) for _ in range(6)] + [np.zeros((20, 20), np.uint8), np.full((20, 20), 200, np.uint8)]
    spiral = np.zeros((20, 20), np.uint8)
    spiral[2:18, 2] = spiral[17, 2:18] = spiral[4:18, 17] = spiral[4, 5:18] = spiral[4:14, 5] = 150
    some.append(spiral)
    for low, high in ((100, 200), (180, 180), (140, 149)):
        got = sorted((r.k, r.x0, r.y0, r.x1, r.y1, r.n) for r in R.components(tiles(spark, some), "k", low, high).collect())
        want = []
        for k, a in enumerate(some):
            label = P.components(a > low)
            for j, (x, y, w, h) in enumerate(P.component_boxes(label).tolist(), 1):
                if (a[label == j] > high).any():
                    want.append((k, x, y, x + w, y + h, int((label == j).sum())))
        assert got == sorted(want)


def test_summed_areas(spark):
    pick = np.random.default_rng(3)
    a = pick.integers(0, 256, (8, 8))
    boxes = [(k, *pick.integers(-2, 6, 2).tolist(), *pick.integers(3, 12, 2).tolist()) for k in range(60)]
    found = R.check_box_places(tiles(spark, [a]), spark.createDataFrame([(0, *b) for b in boxes], "k int, b int, x0 int, y0 int, x1 int, y1 int"), "k", "b", 8)
    got = {r.b: r for r in found.collect()}
    for b, x0, y0, x1, y1 in boxes:
        x0, y0, x1, y1 = max(0, x0), max(0, y0), min(8, x1), min(8, y1)
        if x1 <= x0 or y1 <= y0:
            assert b not in got
            continue
        win = a[y0:y1, x0:x1]
        h, w = win.shape
        cy, cx = h // 2, w // 2
        mid = win[max(0, cy - 1) : cy + 2, max(0, cx - 1) : cx + 2].mean()
        sides = np.concatenate([win[0], win[-1], win[:, 0], win[:, -1]]).mean()
        dark = (win < 190).mean()
        r = got[b]
        assert (r.pixels, r.centre, r.sides, r.dark) == pytest.approx((win.size, mid, sides, dark))
        assert r.hit == bool(win.size >= 16 and ((mid > 180 and 0.03 <= dark <= 0.7) or (mid - sides >= 6 and mid >= 140)))


def points(spark, sets):
    return spark.createDataFrame([(k, [(float(x), float(y)) for x, y in p]) for k, p in enumerate(sets)], f"k int, p {POINTS}")


def test_hulls_and_rectangles(spark):
    pick = np.random.default_rng(4)
    sets = [pick.integers(0, 12, (n, 2)) for n in (1, 2, 3, 4, 7, 30, 80)] + [[(3, 3)] * 5, [(0, 0), (1, 1), (2, 2), (5, 5)], [(0, 0), (0, 4), (0, 2)], [(0, 0), (10, 0), (10, 10), (0, 10), (5, 0), (10, 5)]]
    rows = points(spark, sets).select("k", O.convex_hull(F.col("p")).alias("h"), O.smallest_rectangle(F.col("p")).alias("r")).collect()
    for k, hull, r in rows:
        p = np.array(sets[k], float)
        assert {(q.x, q.y) for q in hull} == {tuple(q) for q in P.hull(np.array(sets[k])).astype(float).tolist()} or len({tuple(q) for q in p.tolist()}) < 3 or np.linalg.matrix_rank(p - p[0]) < 2
        assert r.area == pytest.approx(P.polygon_area(P.smallest_rectangle(p)), abs=1e-9)
        along, across = p @ [r.ux, r.uy], p @ [-r.uy, r.ux]
        assert along.min() >= r.a0 - 1e-9 and along.max() <= r.a1 + 1e-9 and across.min() >= r.b0 - 1e-9 and across.max() <= r.b1 + 1e-9
    assert points(spark, [[]]).select(O.smallest_rectangle(F.col("p")).alias("r")).first().r is None


def test_simplified(spark):
    pick = np.random.default_rng(5)

    def brute(p, tolerance):
        keep = {0, len(p) - 1}

        def split(a, b):
            if b - a < 2:
                return
            d = p[b] - p[a]
            n = np.hypot(*d)
            far = [abs((q - p[a])[0] * d[1] - (q - p[a])[1] * d[0]) / n if n else np.hypot(*(q - p[a])) for q in p[a + 1 : b]]
            k = int(np.argmax(far))
            if far[k] > tolerance:
                keep.add(a + 1 + k)
                split(a, a + 1 + k)
                split(a + 1 + k, b)

        split(0, len(p) - 1)
        return sorted(keep)

    sets = [np.cumsum(pick.normal(0, 2, (n, 2)), axis=0) for n in (1, 2, 3, 9, 40)] + [np.array([(0, 0), (5, 5), (0, 0), (9, 0), (0, 0)], float), np.array([(k, k * k) for k in range(30)], float)]
    for tolerance in (0.5, 3.0):
        rows = points(spark, sets).select("k", O.simplified(F.col("p"), tolerance).alias("i")).collect()
        assert {r.k: r.i for r in rows} == {k: brute(p, tolerance) for k, p in enumerate(sets)}
    assert points(spark, [[]]).select(O.simplified(F.col("p"), 1.0).alias("i")).first().i == []


def test_homography(spark):
    pick = np.random.default_rng(6)
    quads = [np.array([[0, 0], [10, 0], [10, 7], [0, 7]], float) + pick.normal(0, 1, (4, 2)) for _ in range(20)]
    rows = spark.createDataFrame([(k, *q.ravel().tolist()) for k, q in enumerate(quads)] + [(99, *([1.0] * 8))], "k int, " + ", ".join(f"x{i} double, y{i} double" for i in range(4)))
    corners = [(F.col(f"x{i}"), F.col(f"y{i}")) for i in range(4)]
    got = {r.k: r.m for r in rows.select("k", O.homography(corners, 64, 48).alias("m")).collect()}
    assert got.pop(99) is None
    for k, m in got.items():
        want = P.homography(quads[k], np.array([[0, 0], [63, 0], [63, 47], [0, 47]]))
        assert np.allclose(np.array(tuple(m)).reshape(3, 3), want, atol=1e-6, rtol=1e-6)
