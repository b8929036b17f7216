"""Corner and polygon arithmetic on arrays of points, as expressions on a row.

Points are structs of doubles (x, y). An outline is the array of its vertices, and
bounded by the page that it is on; outlines of many pages are many rows. Sorting,
folding and interval splitting happen inside the row: nothing shuffles and nothing
calls Python.

Defined results: an outline without points has no hull, rectangle or vertices (null
or empty); repeated points count once in a hull; of equally good edges or vertices
the first wins; a mapping of corners that lie on one line is null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .profiles import let

Point = tuple[Column, Column]


def homography(corners: Sequence[Point], w: int, h: int) -> Column:
    """The matrix (m0 .. m8, row by row, m8 = 1) that maps four corners, clockwise from the top left, onto those of a canvas of w by h pixels.

    The unit square goes to the corners in closed form; its adjugate goes back. Null where the corners have no area.
    """
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = corners

    def scaled(m: Column) -> Column:
        a, b, c, d, e, f, g, k = (m[n] for n in "abcdefgk")
        rows = [e - f * k, c * k - b, b * f - c * e, f * g - d, a - c * g, c * d - a * f, d * k - e * g, b * g - a * k, a * e - b * d]
        sized = [v * s for v, s in zip(rows, [float(w - 1)] * 3 + [float(h - 1)] * 3 + [1.0] * 3, strict=True)]
        return let(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(sized)]), lambda v: F.when(v["v8"] != 0, F.struct(*[(v[f"v{i}"] / v["v8"]).alias(f"m{i}") for i in range(9)])))

    dx1, dx2, sx = x1 - x2, x3 - x2, x0 - x1 + x2 - x3
    dy1, dy2, sy = y1 - y2, y3 - y2, y0 - y1 + y2 - y3
    area = dx1 * dy2 - dx2 * dy1
    g, k = (sx * dy2 - dx2 * sy) / area, (dx1 * sy - sx * dy1) / area
    square = F.struct((x1 - x0 + g * x1).alias("a"), (x3 - x0 + k * x3).alias("b"), x0.alias("c"), (y1 - y0 + g * y1).alias("d"), (y3 - y0 + k * y3).alias("e"), y0.alias("f"), g.alias("g"), k.alias("k"))
    return F.when(area != 0, let(square, scaled))


def mapped(m: Column, x: Column, y: Column) -> Point:
    """A point under a matrix of homography()."""
    z = m["m6"] * x + m["m7"] * y + m["m8"]
    return (m["m0"] * x + m["m1"] * y + m["m2"]) / z, (m["m3"] * x + m["m4"] * y + m["m5"]) / z


def _cross(o: Column, a: Column, b: Column) -> Column:
    return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])


def _chain(points: Column, kind: str) -> Column:
    """Half a hull of points in sorted order: each one first drops those before it that it makes a turn the wrong way with."""

    def add(hull: Column, p: Column) -> Column:
        # hull is convex, so the vertices that go are those from the first on at which p no longer turns left
        n = F.size(hull)
        keeps = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (n > 1) & (_cross(F.get(hull, i - 1), F.get(hull, i), p) > 0))
        kept = F.when(n < 2, n).otherwise(F.coalesce(F.array_max(keeps), F.lit(0)) + 1)
        return F.concat(F.slice(hull, F.lit(1), kept), F.array(p))

    return F.aggregate(points, F.array().cast(kind), add)


def convex_hull(points: Column) -> Column:
    """Vertices of the convex hull, counter-clockwise in the usual axes from the leftmost, by two monotone chains; one point or two are their own."""
    kind = "array<struct<x:double,y:double>>"

    def both(p: Column) -> Column:
        lower, upper = _chain(p, kind), _chain(F.reverse(p), kind)
        return F.when(F.size(p) < 3, p).otherwise(let(F.struct(lower.alias("l"), upper.alias("u")), lambda s: F.concat(F.slice(s["l"], F.lit(1), F.size(s["l"]) - 1), F.slice(s["u"], F.lit(1), F.size(s["u"]) - 1))))

    return let(F.array_sort(F.array_distinct(points)), both)


def smallest_rectangle(points: Column) -> Column:
    """(area, ux, uy, a0, a1, b0, b1) of the smallest rectangle around the points: its direction, and where it reaches along it and across it. One side lies on a hull edge. Null without points; a line has area 0."""

    def around(hull: Column) -> Column:
        n = F.size(hull)

        def edge(p: Column, i: Column) -> Column:
            q = F.get(hull, F.pmod(i + 1, n))
            length = F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"]))
            unit = F.struct(F.when(length > 0, (q["x"] - p["x"]) / length).otherwise(1.0).alias("x"), F.when(length > 0, (q["y"] - p["y"]) / length).otherwise(0.0).alias("y"))

            def reach(u: Column) -> Column:
                along, across = F.transform(hull, lambda v: v["x"] * u["x"] + v["y"] * u["y"]), F.transform(hull, lambda v: v["y"] * u["x"] - v["x"] * u["y"])
                span = F.struct(F.array_min(along).alias("a0"), F.array_max(along).alias("a1"), F.array_min(across).alias("b0"), F.array_max(across).alias("b1"))
                return let(span, lambda s: F.struct(((s["a1"] - s["a0"]) * (s["b1"] - s["b0"])).alias("area"), i.alias("edge"), u["x"].alias("ux"), u["y"].alias("uy"), s["a0"].alias("a0"), s["a1"].alias("a1"), s["b0"].alias("b0"), s["b1"].alias("b1")))

            return let(unit, reach)

        return F.array_min(F.transform(hull, edge))

    best = let(convex_hull(points), around)
    return let(best, lambda b: F.when(b.isNotNull(), F.struct(*[b[n].alias(n) for n in ("area", "ux", "uy", "a0", "a1", "b0", "b1")])))


def simplified(points: Column, tolerance: Column | float) -> Column:
    """Places of the vertices of an open line that stay: the ends, and in every interval the first vertex that lies farthest from the chord, if that is beyond the tolerance.

    All intervals are split at once, round by round, until none has to be; a line of n vertices takes n - 2 rounds at most.
    """
    span = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    n = F.size(points)

    def split(s: Column) -> Column:
        def by(ends: Column) -> Column:
            p, q = ends["p"], ends["q"]
            dx, dy = q["x"] - p["x"], q["y"] - p["y"]
            length = F.sqrt(dx * dx + dy * dy)

            def away(v: Column, i: Column) -> Column:
                area, gap = F.abs((v["x"] - p["x"]) * dy - (v["y"] - p["y"]) * dx), F.sqrt((v["x"] - p["x"]) * (v["x"] - p["x"]) + (v["y"] - p["y"]) * (v["y"] - p["y"]))
                return F.struct(F.when(length > 0, area / length).otherwise(gap).alias("d"), (-(s["a"] + 1 + i)).alias("at"))

            inner = F.transform(F.slice(points, s["a"] + 2, F.greatest(s["b"] - s["a"] - 1, F.lit(0))), away)
            return let(F.array_max(inner), lambda far: F.when(far["d"] > tolerance, F.array(span(s["a"], -far["at"]), span(-far["at"], s["b"]))).otherwise(F.array(s)))

        return let(F.struct(F.get(points, s["a"]).alias("p"), F.get(points, s["b"]).alias("q")), by)

    def turn(state: Column, _: Column) -> Column:
        # an interval that cannot be split stays, so a state that stays as long as it was is done
        def next_(spans: Column) -> Column:
            return F.struct(spans.alias("spans"), (F.size(spans) == F.size(state["spans"])).alias("done"))

        return F.when(state["done"], state).otherwise(let(F.flatten(F.transform(state["spans"], split)), next_))

    start = F.struct(F.array(span(F.lit(0), n - 1)).alias("spans"), F.lit(False).alias("done"))
    spans = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), start, turn, lambda s: s["spans"])
    return F.when(n > 1, F.concat(F.transform(spans, lambda s: s["a"]), F.array((n - 1).cast("int")))).when(n == 1, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
