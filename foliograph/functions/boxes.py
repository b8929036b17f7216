"""Box and corner arithmetic as column expressions.

Rounding is half to even (`rint`), boxes are half open, and all of it stays in
whole-stage code generation.

Defined results: a null corner makes the result null; empty boxes have no overlap
with anything; of equal corner sums the first point wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = Sequence[Column]


def half_even(c: Column) -> Column:
    return F.rint(c).cast("int")


def clamp(c: Column, lo: Column | float, hi: Column | float) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.least(F.greatest(c, as_col(lo)), as_col(hi))


def valid_box(b: Box, positive: bool = True) -> Column:
    """Inside the closed unit square and, for fields, of positive extent."""
    inside = F.lit(True)
    for c in b:
        inside = inside & (c >= 0) & (c <= 1)
    return inside & (b[2] > b[0]) & (b[3] > b[1]) if positive else inside


def to_pixels(b: Box, w: int, h: int, pad: Column | float = 0.0) -> list[Column]:
    """Relative box to pixels, widened by pad on every side."""
    pad = pad if isinstance(pad, Column) else F.lit(pad)
    return [half_even((b[0] - pad) * w), half_even((b[1] - pad) * h), half_even((b[2] + pad) * w), half_even((b[3] + pad) * h)]


def to_relative(b: Box, w: int, h: int) -> list[Column]:
    """Pixel box to relative, clamped; an empty side becomes one pixel if there is room."""
    x0, y0, x1, y1 = (clamp(c / F.lit(float(d)), 0.0, 1.0) for c, d in zip(b, (w, h, w, h), strict=True))
    return [x0, y0, F.when(x1 <= x0, F.least(F.lit(1.0), x0 + 1.0 / w)).otherwise(x1), F.when(y1 <= y0, F.least(F.lit(1.0), y0 + 1.0 / h)).otherwise(y1)]


def clip_box(b: Box, w: int, h: int) -> list[Column]:
    """Inside the canvas and at least one pixel each way."""
    x0, y0 = clamp(b[0], 0, w - 1), clamp(b[1], 0, h - 1)
    return [x0, y0, F.greatest(x0 + 1, F.least(b[2], F.lit(w))), F.greatest(y0 + 1, F.least(b[3], F.lit(h)))]


def bin_of(x: Column, cuts: Column) -> Column:
    """How many cuts are strictly below x."""
    return F.size(F.filter(cuts, lambda c: c < x))


def intersection_over_union(a: Box, b: Box) -> Column:
    """Areas and union count as 1 at least."""
    zero, one = F.lit(0), F.lit(1)
    inter = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda r: F.greatest(one, (r[2] - r[0]) * (r[3] - r[1]))
    return inter / F.greatest(one, area(a) + area(b) - inter)


def ordered_corners(points: Sequence[tuple[Column, Column]]) -> list[tuple[Column, Column]]:
    """Top left, top right, bottom right, bottom left of four points; the first point wins ties."""

    def extreme(key, smallest: bool) -> Column:
        rows = F.array(*[F.struct((key(x, y) if smallest else -key(x, y)).alias("k"), F.lit(i).alias("i"), x.alias("x"), y.alias("y")) for i, (x, y) in enumerate(points)])
        return F.array_min(rows)

    add, diff = (lambda x, y: x + y), (lambda x, y: y - x)
    picked = [extreme(add, True), extreme(diff, True), extreme(add, False), extreme(diff, False)]
    return [(p["x"], p["y"]) for p in picked]


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.sqrt((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]))


def quad_size(corners: Sequence[tuple[Column, Column]]) -> tuple[Column, Column]:
    """Mean lengths of opposite edges: width, height."""
    tl, tr, br, bl = corners
    return (distance(tr, tl) + distance(br, bl)) * 0.5, (distance(bl, tl) + distance(br, tr)) * 0.5


def turned(corners: Sequence[tuple[Column, Column]], k: int) -> list[tuple[Column, Column]]:
    """Corner list after k quarter turns clockwise."""
    k %= 4
    return [corners[(i - k) % 4] for i in range(4)]


def is_full_frame(points: Sequence[tuple[Column, Column]], w: int, h: int, margin: float = 0.02) -> Column:
    """More than 70 % of the points near an edge, on both axes."""
    near = lambda values, size: sum((((v < margin * size) | (v > size - 1 - margin * size)).cast("int") for v in values), F.lit(0)) / F.lit(len(points))
    return (near([x for x, _ in points], w) > 0.7) & (near([y for _, y in points], h) > 0.7)


def document_id(explicit: Column, path: Column) -> Column:
    """Explicit id, else the file's stem (a dot file keeps its name), else 'page'."""
    name = F.regexp_extract(path, r"([^/]+)/*$", 1)
    stem = F.when(name.rlike(r"^\.*[^.].*\.[^.]+$") & ~name.rlike(r"^\.[^.]*$"), F.regexp_replace(name, r"\.[^.]+$", "")).otherwise(name)
    return F.coalesce(explicit, F.when(F.length(stem) > 0, stem), F.lit("page"))


def fused_confidence(warp: Column, align: Column, snap: Column, grid: Column) -> Column:
    """Weighted sum of the stages' confidences; a missing snap falls back to the grid score, then to one half."""
    half = F.lit(0.5)
    return clamp(0.4 * F.coalesce(warp, half) + 0.3 * F.coalesce(align, half) + 0.3 * F.coalesce(snap, grid, half), 0.0, 1.0)
