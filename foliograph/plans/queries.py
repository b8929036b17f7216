"""Queries of the form operators, each with the SQL that checks it.

Sums of floats depend on their order, so results are rounded before comparison.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..operators import matching as M
from ..operators import outlines as O
from ..operators import pages as K
from ..operators import profiles as Q
from ..operators import rasters as R
from ..operators import signals as S
from ..sources import drawn as D
from ..sources import fixtures as X
from . import normalize as N
from . import scans as C

W, H = X.WIDTH, X.HEIGHT
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def both(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"


COR = M.corners


def as_cols(cols, names=("x0", "y0", "x1", "y1")):
    return [c.alias(n) for c, n in zip(cols, names, strict=True)]


# -- template predicates and projections


@query(both(X.SQL_FIELDS) + """SELECT pos, (a >= 0 AND a <= 1 AND b >= 0 AND b <= 1 AND c >= 0 AND c <= 1 AND d >= 0 AND d <= 1 AND c > a AND d > b) AS field_ok,
  (a >= 0 AND a <= 1 AND b >= 0 AND b <= 1 AND c >= 0 AND c <= 1 AND d >= 0 AND d <= 1) AS landmark_ok
FROM (SELECT pos, x0 - (CASE WHEN pos % 11 = 0 THEN 0.2 ELSE 0 END)::DOUBLE AS a, y0 AS b, x1 - (CASE WHEN pos % 7 = 0 THEN 0.05 ELSE 0 END)::DOUBLE AS c, y1 + (CASE WHEN pos % 13 = 0 THEN 0.6 ELSE 0 END)::DOUBLE AS d FROM fields)""")
def bbox_validation(spark, sf):
    p = F.col("pos")
    off = lambda m, v: F.when(p % m == 0, v).otherwise(0.0)
    box = [F.col("x0") - off(11, 0.2), F.col("y0"), F.col("x1") - off(7, 0.05), F.col("y1") + off(13, 0.6)]
    return X.template_fields(spark, sf).select("pos", B.valid_box(box).alias("field_ok"), B.valid_box(box, False).alias("landmark_ok"))


@query(both(X.SQL_FIELDS) + f"""SELECT pos, field_id, round_even((x0 - pad) * {W}, 0)::INT AS x0, round_even((y0 - pad) * {H}, 0)::INT AS y0, round_even((x1 + pad) * {W}, 0)::INT AS x1, round_even((y1 + pad) * {H}, 0)::INT AS y1 FROM fields""")
def pixel_bbox(spark, sf):
    return X.template_fields(spark, sf).select("pos", "field_id", *as_cols(B.to_pixels(COR(), W, H, F.col("pad"))))


_CLIP = f"""least(greatest({{a}}, 0), {{w}} - 1)"""


@query(both(X.SQL_DETECTIONS) + f"""SELECT page, idx, a::INT AS x0, b::INT AS y0, greatest(a + 1, least(x1 - 300, {W}))::INT AS x1, greatest(b + 1, least(y1 + 300, {H}))::INT AS y1
FROM (SELECT *, least(greatest(x0 - 300, 0), {W} - 1) AS a, least(greatest(y0 + 300, 0), {H} - 1) AS b FROM det)""")
def clip_bbox(spark, sf):
    box = [F.col("x0") - 300, F.col("y0") + 300, F.col("x1") - 300, F.col("y1") + 300]
    return X.detections(spark, sf).select("page", "idx", *[c.cast("int").alias(n) for c, n in zip(B.clip_box(box, W, H), ("x0", "y0", "x1", "y1"), strict=True)])


_REL = f"""SELECT {{keys}}, round(a, 9) AS x0, round(b, 9) AS y0, round(CASE WHEN c <= a THEN least(1.0, a + 1.0 / {W}) ELSE c END, 9)::DOUBLE AS x1, round(CASE WHEN d <= b THEN least(1.0, b + 1.0 / {H}) ELSE d END, 9)::DOUBLE AS y1
FROM (SELECT *, least(1.0, greatest(0.0, {{x0}} / {W}.0::DOUBLE))::DOUBLE AS a, least(1.0, greatest(0.0, {{y0}} / {H}.0::DOUBLE))::DOUBLE AS b, least(1.0, greatest(0.0, {{x1}} / {W}.0::DOUBLE))::DOUBLE AS c, least(1.0, greatest(0.0, {{y1}} / {H}.0::DOUBLE))::DOUBLE AS d FROM {{t}})"""


@query(both(X.SQL_DETECTIONS) + _REL.format(keys="page, idx", t="det", x0="(x0 - 400)", y0="(y0 + 300)", x1="(x1 - 400)", y1="(y1 + 300)"))
def px_to_rel(spark, sf):
    box = [F.col("x0") - 400, F.col("y0") + 300, F.col("x1") - 400, F.col("y1") + 300]
    return X.detections(spark, sf).select("page", "idx", *[F.round(c, 9).alias(n) for c, n in zip(B.to_relative(box, W, H), ("x0", "y0", "x1", "y1"), strict=True)])


ORDER = ["f132", "f130", "f124", "f5", "nowhere", "f130", "f126"]


@query(both(X.SQL_FIELDS) + f"""SELECT (g - 1)::INT AS place, field_id, field_type FROM (SELECT unnest({ORDER}) AS field_id, unnest(range(1, {len(ORDER) + 1})) AS g) JOIN fields USING (field_id)""")
def handwriting_order_lookup(spark, sf):
    return M.ordered_fields(X.template_fields(spark, sf), ORDER)


@query(both(X.SQL_FIELDS) + "SELECT field_type, count(*) AS n FROM fields GROUP BY field_type")
def field_split_counts(spark, sf):
    return X.template_fields(spark, sf).groupBy("field_type").agg(F.count(F.lit(1)).alias("n"))


_CUTS = "cuts AS (SELECT quantile_cont(0.5 * (x0 + x1), [0.25, 0.5, 0.75]) AS q FROM fields WHERE field_type = 'checkbox')"


@query(both(X.SQL_FIELDS, _CUTS) + "SELECT round(q[1], 9) AS q1, round(q[2], 9) AS q2, round(q[3], 9) AS q3 FROM cuts")
def checkbox_column_cuts(spark, sf):
    return M.column_cuts(X.template_fields(spark, sf)).select(*[F.round(F.col("cuts")[k], 9).alias(f"q{k + 1}") for k in range(3)])


_COL = "((q[1] < 0.5 * (x0 + x1))::INT + (q[2] < 0.5 * (x0 + x1))::INT + (q[3] < 0.5 * (x0 + x1))::INT)"


@query(both(X.SQL_FIELDS, _CUTS) + f"SELECT pos, {_COL} AS col FROM fields, cuts")
def checkbox_column_index(spark, sf):
    f = X.template_fields(spark, sf)
    return f.join(F.broadcast(M.column_cuts(f))).select("pos", B.bin_of(0.5 * (F.col("x0") + F.col("x1")), F.col("cuts")).alias("col"))


SHIFTS = [(0, -5.5), (1, 0.4), (2, 12.5)]


@query(both(X.SQL_FIELDS, _CUTS, "sh(col, shift) AS (VALUES (0, -5.5::DOUBLE), (1, 0.4::DOUBLE), (2, 12.5::DOUBLE))") + f"""SELECT pos, col, px0 AS x0, (CASE WHEN dy = 0 THEN py0 ELSE greatest(0, py0 + dy) END)::INT AS y0, px1 AS x1, (CASE WHEN dy = 0 THEN py1 ELSE least({H}, py1 + dy) END)::INT AS y1
FROM (SELECT *, round_even(coalesce(shift, 0.0), 0)::INT AS dy FROM (SELECT pos, px0, py0, px1, py1, {_COL} AS col FROM fields, cuts WHERE field_type = 'checkbox') LEFT JOIN sh USING (col))""")
def column_shift_apply(spark, sf):
    f = X.template_fields(spark, sf)
    px = f.select("pos", *as_cols(B.to_pixels(COR(), W, H)))
    return M.column_shifted(px, f, spark.createDataFrame(SHIFTS, "col int, shift double"), H)


# -- corners of pages

_MIX = "(o * 7919) % 4"


def shuffled_points() -> list[tuple]:
    """The four corners, listed from another one on for each page."""
    k = (F.col("page") * 7919) % 4
    pts = [(F.col(f"x{i}"), F.col(f"y{i}")) for i in range(4)]
    return [tuple(F.element_at(F.array(*[p[a] for p in pts]), ((k + i) % 4 + 1).cast("int")) for a in (0, 1)) for i in range(4)]


_POINTS = """pts AS (SELECT page, i, [x0, x1, x2, x3][((page * 7919) % 4 + i) % 4 + 1] AS x, [y0, y1, y2, y3][((page * 7919) % 4 + i) % 4 + 1] AS y FROM quad, (SELECT unnest([0, 1, 2, 3]) AS i)),
ord AS (SELECT page, list({'x': x, 'y': y} ORDER BY x + y, i)[1] AS tl, list({'x': x, 'y': y} ORDER BY y - x, i)[1] AS tr, list({'x': x, 'y': y} ORDER BY x + y DESC, i)[1] AS br, list({'x': x, 'y': y} ORDER BY y - x DESC, i)[1] AS bl FROM pts GROUP BY page)"""


@query(both(X.SQL_QUADS, _POINTS) + "SELECT page, tl.x AS tlx, tl.y AS tly, tr.x AS trx, tr.y AS try_, br.x AS brx, br.y AS bry, bl.x AS blx, bl.y AS bly FROM ord")
def order_quad(spark, sf):
    c = B.ordered_corners(shuffled_points())
    return X.quads(spark, sf).select("page", *[v.alias(n) for p, names in zip(c, (("tlx", "tly"), ("trx", "try_"), ("brx", "bry"), ("blx", "bly")), strict=True) for v, n in zip(p, names, strict=True)])


_LEN = "sqrt(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y))"
_WIDTH = f"({_LEN.format(a='tr', b='tl')} + {_LEN.format(a='br', b='bl')}) * 0.5"
_HEIGHT = f"({_LEN.format(a='bl', b='tl')} + {_LEN.format(a='br', b='tr')}) * 0.5"


@query(both(X.SQL_QUADS, _POINTS) + f"SELECT page, round({_WIDTH}, 6) AS width, round({_HEIGHT}, 6) AS height, ({_WIDTH}) / greatest({_HEIGHT}, 1.0) < 1.0 AS turned FROM ord")
def quad_size_aspect(spark, sf):
    w, h = B.quad_size(B.ordered_corners(shuffled_points()))
    return X.quads(spark, sf).select("page", F.round(w, 6).alias("width"), F.round(h, 6).alias("height"), (w / F.greatest(h, F.lit(1.0)) < 1.0).alias("turned"))


@query(both(X.SQL_QUADS) + """SELECT page, (nx / 4.0 > 0.7 AND ny / 4.0 > 0.7) AS full_frame FROM (SELECT page, (x0 < 100)::INT + (x0 > 1899)::INT + (x1 < 100)::INT + (x1 > 1899)::INT + (x2 < 100)::INT + (x2 > 1899)::INT + (x3 < 100)::INT + (x3 > 1899)::INT AS nx,
  (y0 < 86)::INT + (y0 > 1633)::INT + (y1 < 86)::INT + (y1 > 1633)::INT + (y2 < 86)::INT + (y2 > 1633)::INT + (y3 < 86)::INT + (y3 > 1633)::INT AS ny FROM quad)""")
def full_frame_flag(spark, sf):
    return X.quads(spark, sf).select("page", B.is_full_frame([(F.col(f"x{i}"), F.col(f"y{i}")) for i in range(4)], 2000, 1720, 0.05).alias("full_frame"))


# -- matching

_IOU = "(greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0)))::DOUBLE / greatest(1, greatest(1, ({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0)) + greatest(1, ({b}.x1 - {b}.x0) * ({b}.y1 - {b}.y0)) - greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0)))"


@query(both(X.SQL_DETECTIONS) + f"SELECT a.page, a.idx AS i, b.idx AS j, round({_IOU.format(a='a', b='b')}, 6) AS iou FROM det a JOIN det b ON a.page = b.page AND a.idx < b.idx AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1")
def iou_pairs(spark, sf):
    d = X.detections(spark, sf)
    cell = lambda c: F.floor(F.col(c) / 32)
    spread = lambda df: df.withColumn("u", F.explode(F.sequence(cell("x0"), cell("x1")))).withColumn("v", F.explode(F.sequence(cell("y0"), cell("y1"))))
    a, b = spread(d).alias("a"), spread(d).alias("b")
    box = lambda t: [F.col(f"{t}.{n}") for n in ("x0", "y0", "x1", "y1")]
    p, q = box("a"), box("b")
    meet = (F.col("a.idx") < F.col("b.idx")) & (p[0] < q[2]) & (q[0] < p[2]) & (p[1] < q[3]) & (q[1] < p[3])
    # of the cells that two boxes share, the one with the corner of their overlap counts
    first = (F.col("a.u") == F.floor(F.greatest(p[0], q[0]) / 32)) & (F.col("a.v") == F.floor(F.greatest(p[1], q[1]) / 32))
    return a.join(b, (F.col("a.page") == F.col("b.page")) & (F.col("a.u") == F.col("b.u")) & (F.col("a.v") == F.col("b.v")) & meet & first).select(F.col("a.page").alias("page"), F.col("a.idx").alias("i"), F.col("b.idx").alias("j"), F.round(B.intersection_over_union(p, q), 6).alias("iou"))


@query(both(X.SQL_DETECTIONS, "srt AS (SELECT page, list({'idx': idx, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1} ORDER BY (x1 - x0) * (y1 - y0), idx DESC) AS l FROM det GROUP BY page)", f"""nms AS (
  SELECT page, l, 1 AS k, [l[1]] AS kept FROM srt
  UNION ALL
  SELECT page, l, k + 1, CASE WHEN len(list_filter(kept, lambda a: {_IOU.format(a='a', b='l[k + 1]')} >= 0.4)) > 0 THEN kept ELSE list_append(kept, l[k + 1]) END FROM nms WHERE k < len(l))""", recursive=True) + "SELECT page, b.idx AS idx, b.x0 AS x0, b.y0 AS y0, b.x1 AS x1, b.y1 AS y1 FROM (SELECT page, unnest(kept) AS b FROM nms WHERE k = len(l))")
def nms_smallest_first(spark, sf):
    return M.suppress(X.detections(spark, sf))


@query(both(X.SQL_DETECTIONS) + f"SELECT page, idx FROM det WHERE x1 - x0 >= 15 AND y1 - y0 >= 15 AND x1 - x0 <= 32 AND y1 - y0 <= 32 AND (x1 - x0)::DOUBLE / greatest(y1 - y0, 1) >= 0.95 AND (x1 - x0)::DOUBLE / greatest(y1 - y0, 1) <= 1.1 AND y0 >= {int(0.2 * H)} AND y0 <= {int(0.9 * H)}")
def contour_box_filter(spark, sf):
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    ratio = w / F.greatest(h, F.lit(1))
    return X.detections(spark, sf).where(w.between(15, 32) & h.between(15, 32) & ratio.between(0.95, 1.1) & F.col("y0").between(int(0.2 * H), int(0.9 * H))).select("page", "idx")


_BOXES = "box AS (SELECT pos, (px0 + px1) / 2.0::DOUBLE AS cx, (py0 + py1) / 2.0::DOUBLE AS cy FROM fields WHERE field_type = 'checkbox')"
_NEAR = """near AS (SELECT page, pos, idx, d, px - cx AS dx, py - cy AS dy FROM (
  SELECT page, pos, idx, d, px, py, cx, cy, row_number() OVER (PARTITION BY page, pos ORDER BY d, idx) AS r FROM (
    SELECT page, pos, idx, px, py, cx, cy, sqrt((px - cx) * (px - cx) + (py - cy) * (py - cy)) AS d FROM (SELECT page, idx, (x0 + x1) / 2.0::DOUBLE AS px, (y0 + y1) / 2.0::DOUBLE AS py FROM det {open}) JOIN box ON abs(px - cx) < 64 AND abs(py - cy) < 64) WHERE d < 64) WHERE r = 1)"""


@query(both(X.SQL_FIELDS, X.SQL_DETECTIONS, _BOXES, _NEAR.format(open="")) + "SELECT page, pos, idx, round(d, 6) AS d, dx, dy FROM near")
def nearest_detection(spark, sf):
    found = M.nearest(X.template_fields(spark, sf), X.detections(spark, sf), W, H)
    return found.select("page", "pos", "idx", F.round("d", 6).alias("d"), "dx", "dy")


_SHIFT = f"""cnt AS (SELECT page, count(*) AS n_detected FROM det GROUP BY page),
shift AS (SELECT page, n_detected, coalesce(k, 0) AS n_offset_hits, least(greatest(coalesce(mx, 0.0), -{W} * 0.06), {W} * 0.06)::DOUBLE AS dx, least(greatest(coalesce(my, 0.0), -{H} * 0.06), {H} * 0.06)::DOUBLE AS dy
  FROM cnt LEFT JOIN (SELECT page, count(*) AS k, median(dx) AS mx, median(dy) AS my FROM near GROUP BY page) USING (page) WHERE {{gate}})"""


@query(both(X.SQL_FIELDS, X.SQL_DETECTIONS, _BOXES, _NEAR.format(open=""), _SHIFT.format(gate="true")) + "SELECT page, n_detected, n_offset_hits, dx, dy FROM shift")
def global_shift(spark, sf):
    f, d = X.template_fields(spark, sf), X.detections(spark, sf)
    return M.global_shift(M.nearest(f, d, W, H), M.page_counts(d), W, H)


_SNAP = f"""base AS (SELECT pos, field_id, field_type, pad, px0, py0, px1, py1 FROM fields),
mv0 AS (SELECT page, pos, field_id, field_type, pad, least(1.0, greatest(0.0, (px0 + round_even(dx, 0)) / {W}.0))::DOUBLE AS a, least(1.0, greatest(0.0, (py0 + round_even(dy, 0)) / {H}.0))::DOUBLE AS b,
  least(1.0, greatest(0.0, (px1 + round_even(dx, 0)) / {W}.0))::DOUBLE AS c, least(1.0, greatest(0.0, (py1 + round_even(dy, 0)) / {H}.0))::DOUBLE AS d FROM shift, base),
mv AS (SELECT page, pos, field_id, field_type, pad, a AS x0, b AS y0, CASE WHEN c <= a THEN least(1.0, a + 1.0 / {W}) ELSE c END AS x1, CASE WHEN d <= b THEN least(1.0, b + 1.0 / {H}) ELSE d END AS y1 FROM mv0),
mc AS (SELECT page, pos, (round_even(x0 * {W}, 0) + round_even(x1 * {W}, 0)) / 2.0 AS cx, (round_even(y0 * {H}, 0) + round_even(y1 * {H}, 0)) / 2.0 AS cy FROM mv WHERE field_type = 'checkbox'),
dc AS (SELECT page, idx, (x0 + x1) / 2.0 AS px, (y0 + y1) / 2.0 AS py FROM det),
cand AS (SELECT page, pos, list(idx ORDER BY d, idx) AS l FROM (SELECT page, pos, idx, sqrt((px - cx) * (px - cx) + (py - cy) * (py - cy)) AS d FROM mc JOIN dc USING (page) WHERE abs(px - cx) <= 28) WHERE d < 30 GROUP BY page, pos),
asked AS (SELECT page, pos, coalesce(l, []) AS l FROM mc LEFT JOIN cand USING (page, pos)),
snap AS (
  SELECT page, -1 AS pos, []::INT[] AS used, NULL::INT AS idx FROM shift
  UNION ALL
  SELECT s.page, s.pos + 1, CASE WHEN len(list_filter(a.l, lambda x: NOT list_contains(s.used, x))) = 0 THEN s.used ELSE list_append(s.used, list_filter(a.l, lambda x: NOT list_contains(s.used, x))[1]) END, list_filter(a.l, lambda x: NOT list_contains(s.used, x))[1]
  FROM snap s JOIN asked a ON a.page = s.page AND a.pos = s.pos + 1)"""


@query(both(X.SQL_FIELDS, X.SQL_DETECTIONS, _BOXES, _NEAR.format(open=""), _SHIFT.format(gate="true"), _SNAP, recursive=True) + "SELECT page, pos, idx FROM snap WHERE idx IS NOT NULL")
def snap_greedy(spark, sf):
    f, d = X.template_fields(spark, sf), X.detections(spark, sf)
    shift = M.global_shift(M.nearest(f, d, W, H), M.page_counts(d), W, H)
    return M.greedy_snap(M.moved_fields(f, shift, W, H), d, W, H)


_SUMMARY = """SELECT page, c.n_detected, coalesce(k, 0) AS n_snapped, CASE WHEN c.n_detected >= 30 THEN n_offset_hits END AS n_offset_hits, CASE WHEN c.n_detected >= 30 THEN round_even(dx, 2) ELSE 0.0 END::DOUBLE AS dx,
  CASE WHEN c.n_detected >= 30 THEN round_even(dy, 2) ELSE 0.0 END::DOUBLE AS dy, CASE WHEN c.n_detected >= 30 THEN 'global-shift-then-snap' ELSE 'frozen' END AS method,
  CASE WHEN c.n_detected >= 30 THEN least(1.0, greatest(0.0, coalesce(k, 0)::DOUBLE / greatest((SELECT count(*) FROM box), 1)))::DOUBLE END AS confidence
FROM cnt c LEFT JOIN shift USING (page) LEFT JOIN (SELECT page, count(idx) AS k FROM snap GROUP BY page) USING (page)"""
_OPEN = "WHERE page IN (SELECT page FROM det GROUP BY page HAVING count(*) >= 30)"
_GATED = _SHIFT.format(gate="n_detected >= 30")


@query(both(X.SQL_FIELDS, X.SQL_DETECTIONS, _BOXES, _NEAR.format(open=_OPEN), _GATED, _SNAP, recursive=True) + _SUMMARY)
def snap_summary(spark, sf):
    return M.snap_overlay(X.template_fields(spark, sf), X.detections(spark, sf), W, H)[1]


@query(both(X.SQL_FIELDS, X.SQL_GATE, _BOXES, _NEAR.format(open=_OPEN), _GATED, _SNAP, recursive=True) + _SUMMARY)
def snap_frozen_gate(spark, sf):
    return M.snap_overlay(X.template_fields(spark, sf), X.detections(spark, sf, halved=True), W, H)[1]


@query(both(X.SQL_FIELDS, X.SQL_DETECTIONS, _BOXES, _NEAR.format(open=_OPEN), _GATED, _SNAP, f"""got AS (SELECT s.page, s.pos, det.x0 AS dx0, det.y0 AS dy0, det.x1 AS dx1, det.y1 AS dy1 FROM snap s JOIN det ON det.page = s.page AND det.idx = s.idx),
gr0 AS (SELECT page, pos, least(1.0, greatest(0.0, dx0 / {W}.0))::DOUBLE AS a, least(1.0, greatest(0.0, dy0 / {H}.0))::DOUBLE AS b, least(1.0, greatest(0.0, dx1 / {W}.0))::DOUBLE AS c, least(1.0, greatest(0.0, dy1 / {H}.0))::DOUBLE AS d FROM got)""", recursive=True) + """SELECT page, pos, field_id, field_type, round(coalesce(a, x0), 9) AS x0, round(coalesce(b, y0), 9) AS y0, round(coalesce(c, x1), 9)::DOUBLE AS x1, round(coalesce(d, y1), 9)::DOUBLE AS y1, a IS NOT NULL AS snapped FROM mv LEFT JOIN gr0 USING (page, pos)
UNION ALL SELECT page, pos, field_id, field_type, round(x0, 9), round(y0, 9), round(x1, 9), round(y1, 9), false FROM fields, (SELECT page FROM cnt WHERE n_detected < 30)""")
def snapped_fields(spark, sf):
    got = M.snap_overlay(X.template_fields(spark, sf), X.detections(spark, sf), W, H)[0]
    return got.select("page", "pos", "field_id", "field_type", *[F.round(c, 9).alias(c) for c in ("x0", "y0", "x1", "y1")], "snapped")


@query(both(X.SQL_SCORES) + """, rev AS (SELECT user_id AS page, (event_id % 2)::INT AS revision, count(*) FILTER (s > 0.1) AS n_snapped, count(*) FILTER (s > 0.2) AS n_offset_hits FROM score GROUP BY ALL)
SELECT page, list(revision ORDER BY n_snapped + 0.5 * n_offset_hits DESC, revision DESC)[1] AS revision, max(n_snapped + 0.5 * n_offset_hits)::DOUBLE AS score FROM rev GROUP BY page""")
def revision_pick(spark, sf):
    s = X.scores(spark, sf)
    rows = s.groupBy(F.col("user_id").alias("page"), (F.col("event_id") % 2).cast("int").alias("revision")).agg(F.count_if(F.col("s") > 0.1).alias("n_snapped"), F.count_if(F.col("s") > 0.2).alias("n_offset_hits"))
    got = M.pick_revision(rows)
    return got.select("page", "revision", F.col("score").cast("double").alias("score"))


@query(both(X.SQL_SCORES) + """, part_ AS (SELECT user_id AS page, avg(s) FILTER (event_id % 4 = 0) AS w, avg(s) FILTER (event_id % 4 = 1 AND user_id % 3 > 0) AS a, avg(s) FILTER (event_id % 4 = 2 AND user_id % 5 > 1) AS n, avg(s) FILTER (event_id % 4 = 3 AND user_id % 7 > 1) AS g FROM score GROUP BY user_id)
SELECT page, round(least(1.0, greatest(0.0, 0.4 * coalesce(w, 0.5) + 0.3 * coalesce(a, 0.5) + 0.3 * coalesce(n, g, 0.5))), 6)::DOUBLE AS confidence FROM part_""")
def confidence_fusion(spark, sf):
    e, u, s = F.col("event_id"), F.col("user_id"), F.col("s")
    rows = X.scores(spark, sf).groupBy(u.alias("page")).agg(F.avg(F.when(e % 4 == 0, s)).alias("w"), F.avg(F.when((e % 4 == 1) & (u % 3 > 0), s)).alias("a"), F.avg(F.when((e % 4 == 2) & (u % 5 > 1), s)).alias("n"), F.avg(F.when((e % 4 == 3) & (u % 7 > 1), s)).alias("g"))
    return rows.select("page", F.round(B.fused_confidence(F.col("w"), F.col("a"), F.col("n"), F.col("g")), 6).alias("confidence"))


# -- tiles

_MIRROR = "CASE WHEN {c} < 0 THEN -({c}) WHEN {c} > 7 THEN 14 - ({c}) ELSE {c} END"


def _sten(name: str, weights: dict, border: str = "mirror") -> str:
    vals = ", ".join(f"({a}, {b}, {w}::DOUBLE)" for (a, b), w in weights.items())
    at = (lambda c: _MIRROR.format(c=c)) if border == "mirror" else (lambda c: f"least(greatest({c}, 0), 7)")
    return f"{name} AS (SELECT t.vec_id, t.y, t.x, sum(n.v * k.w) AS s FROM tile t, (VALUES {vals}) k(dy, dx, w), tile n WHERE n.vec_id = t.vec_id AND n.y = {at('t.y + k.dy')} AND n.x = {at('t.x + k.dx')} GROUP BY t.vec_id, t.y, t.x)"


@query(both(X.SQL_TILES, _sten("lap", S.LAPLACE)) + """SELECT vec_id, round(blur * (1 - glare), 6) AS quality, round(blur, 6) AS blur, round(glare, 6) AS glare FROM (SELECT vec_id, least(1.0, greatest(0.0, var_pop(s) / 250.0))::DOUBLE AS blur FROM lap GROUP BY vec_id) JOIN (SELECT vec_id, avg((v >= 250)::INT::DOUBLE) AS glare FROM tile GROUP BY vec_id) USING (vec_id)""")
def quality_metrics(spark, sf):
    return S.quality(X.tiles(spark, sf), "vec_id", 8)


@query(both(X.SQL_TILES) + "SELECT vec_id, round(quantile_cont(v::DOUBLE, 0.92), 6) AS paper FROM tile GROUP BY vec_id")
def paper_percentile(spark, sf):
    return X.tiles(spark, sf).groupBy("vec_id").agg(F.round(F.percentile("v", F.lit(0.92)), 6).alias("paper"))


_HIST = "hist AS (SELECT vec_id, v, n, sum(n) OVER (PARTITION BY vec_id ORDER BY v)::BIGINT AS below FROM (SELECT vec_id, v, count(*) AS n FROM tile GROUP BY vec_id, v))"


@query(both(X.SQL_TILES, _HIST) + "SELECT vec_id, v, n, below FROM hist")
def histogram_cdf(spark, sf):
    return S.histogram(X.tiles(spark, sf), "vec_id")


@query(both(X.SQL_TILES, _HIST) + """SELECT vec_id, list(v ORDER BY b DESC, v)[1] AS level FROM (SELECT vec_id, v, CASE WHEN total > below THEN round(below * (total - below) * (mass / below::DOUBLE - (am - mass) / (total - below)::DOUBLE) * (mass / below::DOUBLE - (am - mass) / (total - below)::DOUBLE) / (total * total), 6) ELSE 0.0 END AS b
FROM (SELECT vec_id, v, below, sum(v * n) OVER (PARTITION BY vec_id ORDER BY v)::BIGINT AS mass, sum(n) OVER (PARTITION BY vec_id)::BIGINT AS total, sum(v * n) OVER (PARTITION BY vec_id)::BIGINT AS am FROM hist)) GROUP BY vec_id""")
def otsu_threshold(spark, sf):
    return S.otsu(X.tiles(spark, sf), "vec_id")


@query(both(X.SQL_TILES) + "SELECT vec_id, y, avg((v < 128)::INT::DOUBLE) AS ink FROM tile GROUP BY vec_id, y")
def row_projection(spark, sf):
    return X.tiles(spark, sf).groupBy("vec_id", "y").agg(F.avg((F.col("v") < 128).cast("double")).alias("ink"))


@query(both(X.SQL_TILES, _sten("sob", S.SOBEL_Y)) + "SELECT vec_id, y, round(avg(abs(s)), 6) AS energy FROM sob GROUP BY vec_id, y")
def sobel_energy(spark, sf):
    return S.stencil(X.tiles(spark, sf), "vec_id", 8, S.SOBEL_Y).groupBy("vec_id", "y").agg(F.round(F.avg(F.abs("s")), 6).alias("energy"))


_NINE = ", ".join(f"({a}, {b})" for a in (-1, 0, 1) for b in (-1, 0, 1))
_EDGE = f"(VALUES {_NINE}) k(dy, dx), {{t}} n WHERE n.vec_id = t.vec_id AND n.y = least(greatest(t.y + k.dy, 0), 7) AND n.x = least(greatest(t.x + k.dx, 0), 7) GROUP BY t.vec_id, t.y, t.x"


@query(both(X.SQL_TILES, f"wide AS (SELECT t.vec_id, t.y, t.x, max(n.v) AS v FROM tile t, {_EDGE.format(t='tile')})") + f"SELECT t.vec_id, t.y, t.x, min(n.v) AS v FROM wide t, {_EDGE.format(t='wide')}")
def morph_close(spark, sf):
    return S.morph_close(X.tile_rows(spark, sf), "vec_id", 8)


@query(both(X.SQL_TILES, _sten("mean9", {(a, b): 1.0 for a in (-1, 0, 1) for b in (-1, 0, 1)})) + "SELECT vec_id, y, x, least(255.0, round_even(v * 255.0::DOUBLE / greatest(1.0, round_even(s / 9, 0)), 0))::INT AS v FROM tile JOIN mean9 USING (vec_id, y, x)")
def background_divide_tile(spark, sf):
    return S.box_divide(X.tiles(spark, sf), "vec_id", 8)


PATCH = [(y, x, 40 if y == 1 else 255) for y in range(3) for x in range(3)]


@query(both(X.SQL_TILES, f"patch(y, x, p) AS (VALUES {', '.join(map(str, PATCH))})", """sums AS (SELECT t.vec_id, dy, dx, sum(t.v * p)::DOUBLE AS vp, sum(t.v)::DOUBLE AS sv, sum(p)::DOUBLE AS sp, sum(t.v * t.v)::DOUBLE AS vv, sum(p * p)::DOUBLE AS pp FROM tile t, patch, (SELECT unnest(range(6)) AS dy), (SELECT unnest(range(6)) AS dx) WHERE t.y = patch.y + dy AND t.x = patch.x + dx GROUP BY t.vec_id, dy, dx)""",
  """sc AS (SELECT vec_id, dy, dx, CASE WHEN den > 0 THEN round(num / den, 6) ELSE 0.0 END AS score FROM (SELECT vec_id, dy, dx, vp - sv * sp / 9 AS num, sqrt((vv - sv * sv / 9) * (pp - sp * sp / 9)) AS den FROM sums))""") + "SELECT vec_id, dy::INT AS dy, dx::INT AS dx, score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, dy, dx) AS r FROM sc) WHERE r = 1")
def ncc_match(spark, sf):
    return S.correlation(X.tiles(spark, sf), "vec_id", 8, spark.createDataFrame(PATCH, "y int, x int, p int"), 3)


@query(both(X.SQL_TILES) + """SELECT vec_id, (centre > 180 AND dark BETWEEN 0.03 AND 0.70) OR (centre - border >= 6.0 AND centre >= 140) AS hit FROM (SELECT vec_id, avg(v) FILTER (y BETWEEN 3 AND 5 AND x BETWEEN 3 AND 5) AS centre,
  sum(v * ((y = 0)::INT + (y = 7)::INT + (x = 0)::INT + (x = 7)::INT)) / sum((y = 0)::INT + (y = 7)::INT + (x = 0)::INT + (x = 7)::INT) AS border, avg((v < 190)::INT::DOUBLE) AS dark FROM tile GROUP BY vec_id)""")
def grid_score(spark, sf):
    return S.check_box_score(X.tiles(spark, sf), "vec_id", 8)


@query(both(X.SQL_TILES) + "SELECT vec_id, y, x, v FROM tile WHERE y >= vec_id % 3 AND y < vec_id % 3 + 4 AND x >= vec_id % 4 AND x < least(8, vec_id % 4 + 6)")
def crop_pixels(spark, sf):
    k = F.col("vec_id")
    return X.tiles(spark, sf).where((F.col("y") >= k % 3) & (F.col("y") < k % 3 + 4) & (F.col("x") >= k % 4) & (F.col("x") < F.least(F.lit(8), k % 4 + 6)))


# -- profiles


def _smooth(k: int) -> str:
    return f"sm AS (SELECT vec_id, i, v, round(sum(v) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN {k // 2} PRECEDING AND {(k - 1) // 2} FOLLOWING) / {k}, 9) AS s FROM prof)"


@query(both(X.SQL_PROFILES, _smooth(5)) + "SELECT vec_id, i, s FROM sm")
def moving_average_same(spark, sf):
    return S.smoothed(X.profiles(spark, sf), "vec_id", 5).select("vec_id", "i", "s")


@query(both(X.SQL_PROFILES, "en AS (SELECT vec_id, i, round(sum(abs(v)) OVER w / 9, 9) AS e, count(*) OVER w AS n FROM prof WINDOW w AS (PARTITION BY vec_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING))") + "SELECT vec_id, (list(i ORDER BY e DESC, i)[1] - 20)::INT AS dy, round(least(1.0, max(e) / (avg(e) + 1e-6) / 3.0), 6)::DOUBLE AS score FROM en WHERE n = 9 GROUP BY vec_id")
def band_shift(spark, sf):
    return S.band_shift(X.profiles(spark, sf), "vec_id", 9, 20)


@query(both(X.SQL_PROFILES, _smooth(4)) + "SELECT vec_id, i, s FROM (SELECT *, lag(s) OVER w AS b, lead(s) OVER w AS a FROM sm WINDOW w AS (PARTITION BY vec_id ORDER BY i)) WHERE s > 0.04 AND s >= b AND s >= a")
def local_maxima(spark, sf):
    return S.local_maxima(X.profiles(spark, sf), "vec_id", 4, 0.04).select("vec_id", "i", "s")


@query(both(X.SQL_PROFILES, _smooth(5), """pk AS (SELECT vec_id, 0 AS k, list(s ORDER BY i) AS work, []::INT[] AS peaks FROM sm GROUP BY vec_id
  UNION ALL
  SELECT vec_id, k + 1, list_transform(work, lambda v, j: CASE WHEN j - 1 >= list_position(work, list_max(work)) - 1 - 8 AND j - 1 < list_position(work, list_max(work)) - 1 + 8 THEN 0.0 ELSE v END), list_append(peaks, list_position(work, list_max(work)) - 1) FROM pk WHERE k < 4)""", recursive=True) + "SELECT vec_id, p[1] AS p0, p[2] AS p1, p[3] AS p2, p[4] AS p3 FROM (SELECT vec_id, list_sort(peaks) AS p FROM pk WHERE k = 4)")
def topk_suppressed_peaks(spark, sf):
    got = S.suppressed_peaks(X.profiles(spark, sf), "vec_id", 5, 4, 8)
    return got.select("vec_id", *[F.col("peaks")[k].alias(f"p{k}") for k in range(4)])


MASK = [j for c in (10, 25, 40, 55) for j in range(c - 2, c + 3)]


@query(both(X.SQL_PROFILES, "ink AS (SELECT vec_id, i, (v > 0.1)::INT::DOUBLE AS v FROM prof)") + f"""SELECT vec_id, list(lag ORDER BY score DESC, lag)[1]::INT AS lag, max(score) AS score FROM (SELECT vec_id, lag, sum(v) AS score FROM ink, (SELECT unnest({MASK}) AS j), (SELECT unnest(range(-12, 13)) AS lag) WHERE i = ((j - lag) % 64 + 64) % 64 GROUP BY vec_id, lag) GROUP BY vec_id""")
def circular_lag_shift(spark, sf):
    ink = X.profiles(spark, sf).select("vec_id", "i", (F.col("v") > 0.1).cast("double").alias("v"))
    return S.circular_lag(ink, spark.createDataFrame([(j, 1.0) for j in MASK], "j int, m double"), "vec_id", 64, 12)


@query(both(X.SQL_PROFILES) + """SELECT vec_id, round(0.4 * least(er, 3.0) / 3.0 + 0.3 * least(dr, 3.0) / 3.0 + 0.3 * (1.0 - abs(least(pk, 8) - 4) / 4.0), 6)::DOUBLE AS score FROM (SELECT vec_id, avg(abs(v)) FILTER (i < 16) / (avg(abs(v)) FILTER (i >= 48) + 1e-6) AS er, (1.0 - avg(v) FILTER (i < 16)) / (1.0 - avg(v) FILTER (i >= 48) + 1e-6) AS dr, count(*) FILTER (v > 0.2) AS pk FROM prof GROUP BY vec_id)""")
def header_score_fuse(spark, sf):
    v, top, low = F.col("v"), F.col("i") < 16, F.col("i") >= 48
    mean = lambda c, e: F.avg(F.when(c, e))
    rows = X.profiles(spark, sf).groupBy("vec_id").agg((mean(top, F.abs(v)) / (mean(low, F.abs(v)) + 1e-6)).alias("er"), ((1.0 - mean(top, v)) / (1.0 - mean(low, v) + 1e-6)).alias("dr"), F.count_if(v > 0.2).alias("pk"))
    return rows.select("vec_id", F.round(S.header_score(F.col("er"), F.col("dr"), F.col("pk")), 6).alias("score"))


# -- documents


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'd' || page_id WHEN page_id % 5 = 1 THEN 'page' WHEN page_id % 5 = 2 THEN 'scan' || page_id ELSE 'a.b' || page_id END AS document_id FROM pages")
def document_id(spark, sf):
    k = F.col("page_id").cast("string")
    explicit = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("d"), k))
    path = F.when(F.col("page_id") % 5 == 1, F.lit("")).when(F.col("page_id") % 5 == 2, F.concat(F.lit("s3://x/in.d/scan"), k, F.lit(".jpg"))).otherwise(F.concat(F.lit("/data/a.b"), k, F.lit(".png")))
    return X.table(spark, sf, "pages").select("page_id", B.document_id(explicit, path).alias("document_id"))


@query(both(X.SQL_FIELDS, X.SQL_DETECTIONS) + "SELECT page, field_type, n, n_detected FROM (SELECT page, count(*) AS n_detected FROM det GROUP BY page), (SELECT field_type, count(*) AS n FROM fields GROUP BY field_type)")
def document_summary(spark, sf):
    n = X.template_fields(spark, sf).groupBy("field_type").agg(F.count(F.lit(1)).alias("n"))
    return M.page_counts(X.detections(spark, sf)).join(F.broadcast(n)).select("page", "field_type", "n", "n_detected")


@query(both(X.SQL_FIELDS, X.SQL_DETECTIONS) + "SELECT 'template' AS kind, pos::BIGINT AS id, px0 AS x0, py0 AS y0, px1 AS x1, py1 AS y1 FROM fields UNION ALL SELECT 'detected', event_id, x0, y0, x1, y1 FROM det")
def bbox_union_all(spark, sf):
    f = X.template_fields(spark, sf).select(F.lit("template").alias("kind"), F.col("pos").cast("bigint").alias("id"), *as_cols(B.to_pixels(COR(), W, H)))
    return f.unionByName(X.detections(spark, sf).select(F.lit("detected").alias("kind"), F.col("event_id").alias("id"), "x0", "y0", "x1", "y1"))


# -- whole pages. Scans are drawn pixel by pixel, so SQL says what has to be measured on them; of photographs SQL says what was drawn, and each query whether that was found


#: Drawn pages in one task at most, on average: an image has up to 4 MB, and each of the kernels' steps holds a task's pages as one batch.
TASK_PAGES = 8
#: Pixels by which a measured place may differ from the one drawn.
NEAR = 6


def _dealt(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.table(spark, sf, "pages").select("page_id", "html")
    return rows.repartition(max(1, -(-rows.count() // TASK_PAGES)))


def drawn(spark: SparkSession, sf: str) -> DataFrame:
    """A photographed form for each row of pages, in as many tasks as they need."""
    return D.drawn_pages(_dealt(spark, sf), "page_id", "html")


def scanned(spark: SparkSession, sf: str) -> DataFrame:
    """A scanned form for each row of pages, in as many tasks as they need."""
    return D.scanned_pages(_dealt(spark, sf), "page_id", "html")


def _scan_sql(*ctes: str) -> str:
    """The tables of a scan, up to the fields' moved boxes, and more."""
    resized = (c.replace(str(W), str(C.W)).replace(str(H), str(C.H)) for c in (_BOXES, _NEAR.format(open=_OPEN), _GATED, _SNAP))
    return both(C.PAGES, C.HEADERS, C.SHIFTS, C.FITS, C.FIELDS, *resized, *ctes, recursive=True)


_SURE = "0.6::DOUBLE * 0.35::DOUBLE + 0.4::DOUBLE * ht.score"
_KEPT = f"CASE WHEN c.n_detected >= 30 THEN least(1.0, greatest(0.0, coalesce(k, 0)::DOUBLE / {C.N_BOXES})) END::DOUBLE"


@query(_scan_sql() + f"""SELECT pg.document_id, 'scan' AS template_id, 'full-frame' AS warp_method, ht.degrees AS orientation_degrees, round(ht.score, 6) AS orientation_score, round({_SURE}, 6) AS warp_confidence, ac.ax AS tx, ac.ay AS ty, round(ac.trust, 6) AS landmark_score, round(ac.fit, 6) AS grid_score,
  ac.s[1] AS shift0, ac.s[2] AS shift1, ac.s[3] AS shift2, ac.s[4] AS shift3, round(ac.confidence, 6) AS align_confidence, c.n_detected::INT AS n_detected, coalesce(k, 0)::INT AS n_snapped, CASE WHEN c.n_detected >= 30 THEN n_offset_hits END::INT AS n_offset_hits,
  CASE WHEN c.n_detected >= 30 THEN round_even(shift.dx, 2) ELSE 0.0 END::DOUBLE AS snap_dx, CASE WHEN c.n_detected >= 30 THEN round_even(shift.dy, 2) ELSE 0.0 END::DOUBLE AS snap_dy, CASE WHEN c.n_detected >= 30 THEN 'global-shift-then-snap' ELSE 'frozen' END AS snap_method, round({_KEPT}, 6) AS snap_confidence,
  round(least(1.0, greatest(0.0, 0.4::DOUBLE * ({_SURE}) + 0.3::DOUBLE * ac.confidence + 0.3::DOUBLE * coalesce({_KEPT}, ac.fit))), 6)::DOUBLE AS alignment_confidence, {C.N_BOXES}::BIGINT AS n_checkbox, 9::BIGINT AS n_handwriting
FROM pg JOIN ht USING (page) JOIN ac USING (page) JOIN cnt c USING (page) LEFT JOIN shift USING (page) LEFT JOIN (SELECT page, count(idx) AS k FROM snap GROUP BY page) USING (page)""")
def normalize_synthetic(spark, sf):
    """What is measured and decided on each scan."""
    docs = N.normalize(scanned(spark, sf), [D.scan_template()])
    six = lambda c: F.round(c, 6).alias(c)
    n = lambda test, name: F.size(F.filter("fields", test)).cast("bigint").alias(name)
    return docs.select(
        "document_id", "template_id", "warp_method", "orientation_degrees", six("orientation_score"), six("warp_confidence"), (F.col("tx") + 0.0).alias("tx"), (F.col("ty") + 0.0).alias("ty"), six("landmark_score"), six("grid_score"),
        *[F.col("column_shifts")[k].alias(f"shift{k}") for k in range(4)], six("align_confidence"), "n_detected", "n_snapped", "n_offset_hits", "snap_dx", "snap_dy", "snap_method", six("snap_confidence"), six("alignment_confidence"),
        n(lambda f: f["field_type"] == "checkbox", "n_checkbox"), n(lambda f: f["field_type"] != "checkbox", "n_handwriting"),
    )


@query(_scan_sql(C.CROPS) + "SELECT pg.document_id, field_id, field_type, x0, y0, x1, y1, coalesce(dark.n, 0) AS n_dark FROM crop JOIN pg USING (page) LEFT JOIN dark USING (page, field_id)")
def field_crops_synthetic(spark, sf):
    """Each field's box on each scan as it was found, and the dark pixels in its crop."""
    crops = N.field_crops(N.normalize(scanned(spark, sf), [D.scan_template()]))
    return with_dark_pixels(crops.select("document_id", "field_id", "field_type", "x0", "y0", "x1", "y1", "raw"))


def with_dark_pixels(crops: DataFrame) -> DataFrame:
    """Crops with the number of dark pixels in place of the pixels."""
    kept = crops.schema.fields[:-1]

    def run(batches):
        for batch in batches:
            counts = [int((np.frombuffer(v.as_buffer(), np.uint8)[::3] < 190).sum()) for v in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*(f.name for f in kept), "n_dark"])

    return crops.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", n_dark bigint")


DRAWN_DEGREES = "CASE WHEN page_id % 2 = 1 THEN 180 ELSE 0 END"


@query("""
WITH seen AS (
  SELECT page_id, corner, page_id % 2 = 1 AS turned, 0.08 + 0.01 * (page_id % 3) AS tilt, CASE WHEN page_id % 2 = 1 THEN (corner + 2) % 4 ELSE corner END AS k
  FROM pages, range(4) t(corner)
), flat AS (
  SELECT *, 1024 * (CASE k WHEN 0 THEN tilt - 0.5 WHEN 1 THEN 0.5 - tilt WHEN 2 THEN 0.5 ELSE -0.5 END) AS a, 860 * (CASE WHEN k < 2 THEN -0.5 ELSE 0.5 END) AS b FROM seen
), placed AS (
  SELECT *, a * cos(0.008) - b * sin(0.008) + 1024 * 0.62 AS x, a * sin(0.008) + b * cos(0.008) + 860 * 0.62 AS y FROM flat
)
SELECT 'page' || page_id AS document_id, corner::INT AS corner, 'page-quad' AS method,
  round(CASE WHEN turned THEN 1268 - x ELSE x END)::BIGINT AS x, round(CASE WHEN turned THEN 1065 - y ELSE y END)::BIGINT AS y, true AS near
FROM placed
""")
def detect_quad_synthetic(spark, sf):
    """The corners of each photographed sheet as drawn, and whether they were found there."""

    def outline(r):
        quad, method, _ = K.detect_quad(N.picture(r["data"], r["height"], r["width"], r["channels"]))
        number = int(r["document_id"].removeprefix("page"))
        true = D.corners(D.W, D.H, D.tilt_of(number))
        if number % 2:
            true = np.roll([r["width"] - 1, r["height"] - 1] - true, 2, axis=0)
        return {"method": method, "corners": [{"corner": k, "x": round(t[0]), "y": round(t[1]), "near": bool(np.abs(t - q).max() <= NEAR)} for k, (t, q) in enumerate(zip(true, quad, strict=True))]}

    found = N.measured(drawn(spark, sf), "method string, corners array<struct<corner:int,x:bigint,y:bigint,near:boolean>>", outline, ["document_id", "height", "width", "channels", "data"], ["height", "width", "channels", "data"])
    return found.select("document_id", "method", F.explode("corners").alias("c")).select("document_id", "c.corner", "method", "c.x", "c.y", "c.near")


@query("SELECT 'page' || page_id AS document_id, 124::BIGINT AS n_fields, true AS enough FROM pages")
def detect_checkboxes_synthetic(spark, sf):
    """Whether at least 95 of 100 drawn check boxes have a detection near their centre on the rectified photograph."""
    t = D.template()
    found = N.check_boxes(N.upright(N.rectified(drawn(spark, sf), [t]), [t], held=True), [t], keep=False)
    centre = lambda b: M.centre([b[n] for n in ("x0", "y0", "x1", "y1")])

    def hit(f):
        fx, fy = centre(f)
        return F.exists("boxes", lambda b: (F.abs(centre(b)[0] - fx) <= NEAR) & (F.abs(centre(b)[1] - fy) <= NEAR))

    n = F.size(F.filter("there", hit))
    there = Q.in_pixels(Q.template_array(t["fields"]), D.W, D.H)
    return found.withColumn("there", there).select("document_id", F.size("there").cast("bigint").alias("n_fields"), (n / F.size("there") >= 0.95).alias("enough"))


@query(f"SELECT 'page' || page_id AS document_id, 1024 AS width, 860 AS height, 'page-quad' AS method, {DRAWN_DEGREES} AS degrees FROM pages")
def warp_synthetic(spark, sf):
    """Size of each photograph's canvas, how its outline was found, and its direction."""
    t = D.template()
    found = N.upright(N.rectified(drawn(spark, sf), [t]), [t])
    own = F.octet_length("canvas") == D.W * D.H * 3
    return found.select("document_id", F.when(own, D.W).alias("width"), F.when(own, D.H).alias("height"), F.col("warp_method").alias("method"), F.col("turns")[0]["degrees"].alias("degrees"))


# -- outlines: mappings, rectangles, fewer vertices


_TARGET = {"c0x": 0, "c0y": 0, "c1x": W - 1, "c1y": 0, "c2x": W - 1, "c2y": H - 1, "c3x": 0, "c3y": H - 1, "middle_x": (W - 1) / 2, "middle_y": (H - 1) / 2}


@query(both(X.SQL_QUADS) + f"""SELECT page, round(a / k, 6) AS m0, round(b / k, 6) AS m1, round(c / k, 6) AS m2, round(d / k, 6) AS m3, round(e / k, 6) AS m4, round(f / k, 6) AS m5, round(1000 * g / k, 6) AS m6, round(1000 * h / k, 6) AS m7, {", ".join(f"{v}::DOUBLE AS {n}" for n, v in _TARGET.items())}
FROM (SELECT page, {W - 1} * (q11 * q22 - q12 * q21) AS a, {W - 1} * (q02 * q21 - q01 * q22) AS b, {W - 1} * (q01 * q12 - q02 * q11) AS c, {H - 1} * (q12 * q20 - q10 * q22) AS d, {H - 1} * (q00 * q22 - q02 * q20) AS e, {H - 1} * (q02 * q10 - q00 * q12) AS f, q10 * q21 - q11 * q20 AS g, q01 * q20 - q00 * q21 AS h, q00 * q11 - q01 * q10 AS k
  FROM (SELECT page, x1 * z1 - x0 AS q00, x3 * z3 - x0 AS q01, x0 AS q02, y1 * z1 - y0 AS q10, y3 * z3 - y0 AS q11, y0 AS q12, z1 - 1 AS q20, z3 - 1 AS q21, 1.0::DOUBLE AS q22
    FROM (SELECT *, ((x0 - x2) * (y3 - y2) - (y0 - y2) * (x3 - x2)) / ((x1 - x2) * (y3 - y2) - (y1 - y2) * (x3 - x2)) AS z1, ((x1 - x2) * (y0 - y2) - (y1 - y2) * (x0 - x2)) / ((x1 - x2) * (y3 - y2) - (y1 - y2) * (x3 - x2)) AS z3 FROM quad)))""")
def homography(spark, sf):
    """The mapping of each outline onto the canvas, and where it sends the corners and the point where the diagonals meet."""
    corners = [(F.col(f"x{k}"), F.col(f"y{k}")) for k in range(4)]
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = corners
    t = ((x1 - x0) * (y3 - y1) - (y1 - y0) * (x3 - x1)) / ((x2 - x0) * (y3 - y1) - (y2 - y0) * (x3 - x1))
    points = {**{f"c{k}": p for k, p in enumerate(corners)}, "middle_": (x0 + t * (x2 - x0), y0 + t * (y2 - y0))}
    rows = X.quads(spark, sf).withColumn("m", O.homography(corners, W, H))
    near = lambda c, n: (F.round(c, 6) + 0.0).alias(n)
    return rows.select("page", *[near(F.col(f"m.m{k}") * (1000 if k > 5 else 1), f"m{k}") for k in range(8)], *[near(c, f"{n}{axis}") for n, p in points.items() for c, axis in zip(O.mapped(F.col("m"), *p), "xy", strict=True)])


SQL_POINTS = "pts AS MATERIALIZED (SELECT DISTINCT user_id AS page, (event_id * 37 % 101)::DOUBLE AS x, ((event_id * 53 + user_id) % 89)::DOUBLE AS y FROM events)"


@query(both(SQL_POINTS, "dirs AS (SELECT DISTINCT a.page, (b.x - a.x) / sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS ux, (b.y - a.y) / sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS uy FROM pts a JOIN pts b ON a.page = b.page AND (a.x, a.y) < (b.x, b.y))") + """SELECT page, round(coalesce(min(area), 0.0), 6) AS area FROM (SELECT DISTINCT page FROM pts) LEFT JOIN (SELECT page, (max(x * ux + y * uy) - min(x * ux + y * uy)) * (max(y * ux - x * uy) - min(y * ux - x * uy)) AS area FROM dirs JOIN pts USING (page) GROUP BY page, ux, uy) USING (page) GROUP BY page""")
def min_area_rectangle(spark, sf):
    """The least area of a rectangle around each page's points: SQL tries the direction of every two of them."""
    e, u = F.col("event_id"), F.col("user_id")
    points = X.table(spark, sf, "events").groupBy(u.alias("page")).agg(F.collect_set(F.struct((e * 37 % 101).cast("double").alias("x"), ((e * 53 + u) % 89).cast("double").alias("y"))).alias("p"))
    return points.select("page", F.round(O.smallest_rectangle(F.col("p"))["area"], 6).alias("area"))


TOLERANCE = 1.5


@query(both(X.SQL_PROFILES, "pts AS (SELECT vec_id, i, i::DOUBLE AS x, 20 * v AS y FROM prof)", f"""iv AS (SELECT DISTINCT vec_id, 0 AS a, 63 AS b FROM pts
  UNION ALL
  SELECT vec_id, unnest([a, far]) AS a, unnest([far, b]) AS b FROM (
    SELECT vec_id, a, b, list(i ORDER BY d DESC, i)[1] AS far, max(d) AS d FROM (
      SELECT iv.vec_id, iv.a, iv.b, m.i, abs((m.x - p.x) * (q.y - p.y) - (m.y - p.y) * (q.x - p.x)) / sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) AS d
      FROM iv JOIN pts p ON p.vec_id = iv.vec_id AND p.i = iv.a JOIN pts q ON q.vec_id = iv.vec_id AND q.i = iv.b JOIN pts m ON m.vec_id = iv.vec_id AND m.i > iv.a AND m.i < iv.b) GROUP BY vec_id, a, b) WHERE d > {TOLERANCE})""", recursive=True) + "SELECT DISTINCT vec_id, a::INT AS i FROM iv UNION SELECT vec_id, b::INT FROM iv")
def simplified_outline(spark, sf):
    """The vertices that stay of each signal, drawn as a line."""
    lines = X.profiles(spark, sf).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("p"))
    points = F.transform("p", lambda r: F.struct(r["i"].cast("double").alias("x"), (20 * r["v"]).alias("y")))
    return lines.select("vec_id", points.alias("p")).select("vec_id", F.explode(O.simplified(F.col("p"), TOLERANCE)).alias("i"))


# -- tiles as rasters


_PLACES = "place AS (SELECT vec_id, b, (vec_id + 3 * b) % 5 - 1 AS x0, (2 * vec_id + b) % 4 AS y0, (vec_id + 3 * b) % 5 + 3 + (vec_id + b) % 3 AS x1, (2 * vec_id + b) % 4 + 4 + (vec_id // 3 + b) % 3 AS y1 FROM embeddings, range(4) t(b))"


@query(both(X.SQL_TILES, _PLACES, """cut AS (SELECT vec_id, b, greatest(0, x0) AS x0, greatest(0, y0) AS y0, least(8, x1) AS x1, least(8, y1) AS y1 FROM place)""") + """SELECT vec_id, b::INT AS box, pixels::INT AS pixels, round(centre, 6) AS centre, round(sides, 6) AS sides, round(dark, 6) AS dark, pixels >= 16 AND ((centre > 180 AND dark >= 0.03 AND dark <= 0.70) OR (centre - sides >= 6.0 AND centre >= 140)) AS hit
FROM (SELECT vec_id, b, count(*) AS pixels, avg(v) FILTER (abs(x - (x0 + (x1 - x0) // 2)) <= 1 AND abs(y - (y0 + (y1 - y0) // 2)) <= 1) AS centre, avg((v < 190)::INT::DOUBLE) AS dark,
  sum(v * ((x = x0)::INT + (x = x1 - 1)::INT + (y = y0)::INT + (y = y1 - 1)::INT)) / sum((x = x0)::INT + (x = x1 - 1)::INT + (y = y0)::INT + (y = y1 - 1)::INT)::DOUBLE AS sides FROM cut JOIN tile USING (vec_id) WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY vec_id, b)""")
def summed_area_grid(spark, sf):
    """Four places on each tile, measured by lookups in summed-area tables; SQL reads their pixels."""
    v, b = F.col("vec_id"), F.col("box")
    x0, y0 = (v + 3 * b) % 5 - 1, (2 * v + b) % 4
    spots = X.table(spark, sf, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("box"))
    boxes = spots.select("vec_id", "box", *[c.cast("int").alias(n) for c, n in ((x0, "x0"), (y0, "y0"), (x0 + 4 + (v + b) % 3, "x1"), (y0 + 4 + (F.floor(v / 3) + b) % 3, "y1"))])
    found = R.check_box_places(X.tiles(spark, sf), boxes, "vec_id", "box", 8)
    return found.select("vec_id", "box", "pixels", *[F.round(c, 6).alias(c) for c in ("centre", "sides", "dark")], "hit")


@query(both(X.SQL_TILES, """h AS (SELECT vec_id, y // 4 AS py, x // 4 AS px, v, count(*) AS n FROM tile GROUP BY ALL),
ex AS (SELECT vec_id, py, px, sum(greatest(n - 1, 0))::BIGINT AS excess FROM h GROUP BY ALL),
full_ AS (SELECT vec_id, py, px, l.v, least(coalesce(n, 0), 1) + excess // 256 + CASE WHEN excess % 256 > 0 AND l.v % greatest(256 // (excess % 256), 1) = 0 AND l.v // greatest(256 // (excess % 256), 1) < excess % 256 THEN 1 ELSE 0 END AS n FROM ex JOIN (SELECT unnest(range(256))::INT AS v) l ON true LEFT JOIN h USING (vec_id, py, px, v)),
lut AS MATERIALIZED (SELECT vec_id, py, px, v, least(255, greatest(0, round_even(sum(n) OVER (PARTITION BY vec_id, py, px ORDER BY v)::DOUBLE * (255.0::DOUBLE / 16), 0))) AS t FROM full_),
tap AS (SELECT i, a, greatest(0, least(1, floor(i / 4.0 - 0.5)::INT + a)) AS p, CASE WHEN a = 1 THEN i / 4.0::DOUBLE - 0.5 - floor(i / 4.0::DOUBLE - 0.5) ELSE 1 - (i / 4.0::DOUBLE - 0.5 - floor(i / 4.0::DOUBLE - 0.5)) END AS w FROM (SELECT unnest(range(8))::INT AS i), (VALUES (0), (1)) t(a))""") + """SELECT tile.vec_id, tile.y, tile.x, least(255, greatest(0, round_even(sum(t * ty.w * tx.w), 0)))::INT AS v FROM tile JOIN tap ty ON ty.i = tile.y JOIN tap tx ON tx.i = tile.x JOIN lut ON lut.vec_id = tile.vec_id AND lut.py = ty.p AND lut.px = tx.p AND lut.v = tile.v GROUP BY tile.vec_id, tile.y, tile.x""")
def clahe_tile(spark, sf):
    """Every pixel of each tile, equalised in four parts; SQL makes whole tables of 256 levels."""
    return R.equalised(X.tiles(spark, sf), "vec_id", 8, 2)


@query(both(X.SQL_TILES, """place AS (SELECT t, floor((t + 0.5) / 2 - 0.5)::INT AS p, (t + 0.5::DOUBLE) / 2 - 0.5 - floor((t + 0.5::DOUBLE) / 2 - 0.5) AS f FROM (SELECT unnest(range(16))::INT AS t)),
tap AS (SELECT t, least(7, greatest(0, p + k - 1)) AS i, CASE WHEN abs(f - k + 1) <= 1 THEN ((-0.75 + 2) * abs(f - k + 1) - (-0.75 + 3)) * abs(f - k + 1) * abs(f - k + 1) + 1 ELSE ((-0.75 * abs(f - k + 1) + 5 * 0.75) * abs(f - k + 1) - 8 * 0.75) * abs(f - k + 1) + 4 * 0.75 END::DOUBLE AS w FROM place, (VALUES (0), (1), (2), (3)) t(k))""") + """SELECT vec_id, ty.t AS y, tx.t AS x, least(255.0, greatest(0.0, round_even(round(sum(v * ty.w * tx.w), 9), 0)))::INT AS v FROM tile JOIN tap ty ON ty.i = tile.y JOIN tap tx ON tx.i = tile.x GROUP BY vec_id, ty.t, tx.t""")
def double_tile(spark, sf):
    """Each tile at twice its size, by cubic convolution."""
    return R.doubled(X.tiles(spark, sf), "vec_id", 8)


LOW, HIGH = 128, 160


@query(both(X.SQL_TILES, f"weak AS MATERIALIZED (SELECT vec_id, y, x, v, y * 8 + x AS p FROM tile WHERE v > {LOW})", """reach AS (SELECT vec_id, p, p AS root FROM weak
  UNION
  SELECT b.vec_id, b.p, r.root FROM reach r JOIN weak a ON a.vec_id = r.vec_id AND a.p = r.p JOIN weak b ON b.vec_id = a.vec_id AND abs(b.x - a.x) <= 1 AND abs(b.y - a.y) <= 1)""", recursive=True) + f"""SELECT vec_id, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, count(*) AS n FROM weak JOIN (SELECT vec_id, p, min(root) AS root FROM reach GROUP BY vec_id, p) USING (vec_id, p) GROUP BY vec_id, root HAVING max(v) > {HIGH}""")
def component_boxes(spark, sf):
    """Groups of touching pixels above one level of each tile that hold one above another."""
    return R.components(X.tiles(spark, sf), "vec_id", LOW, HIGH)
