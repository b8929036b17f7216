"""Matching of template fields and detected boxes, page by page.

Pairs are found by an equi-join on grid cells, never by comparing all boxes of a
page; steps that depend on their own earlier choices (suppression, one-to-one
assignment) are folds over one page's sorted boxes, so a page is the unit of work
and pages spread over the cluster.

Defined results: pages without detections have no rows; of equal distances the
smaller detection index wins; boxes with null corners match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as B

# Fixed values on which results depend.
SEARCH = 64.0
SNAP = 30.0
SNAP_X = 28.0
GATE = 30
MAX_SHIFT = 0.06
IOU = 0.4


def centre(b: B.Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2.0, (b[1] + b[3]) / 2.0


def corners(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{n}") for n in ("x0", "y0", "x1", "y1")]


def near_pairs(fields: DataFrame, found: DataFrame, radius: float, keys: list[str]) -> DataFrame:
    """Fields (.., cx, cy) and detections (.., px, py) of equal keys closer than radius, with d.

    Each field is looked up in the 3 by 3 grid cells around it; a cell is as wide as the radius.
    """
    step = F.sequence(F.lit(-1), F.lit(1))
    cell = lambda c: F.floor(c / radius).cast("int")
    spread = fields.withColumn("__i", F.explode(step)).withColumn("__j", F.explode(step)).withColumn("__u", cell(F.col("cx")) + F.col("__i")).withColumn("__v", cell(F.col("cy")) + F.col("__j")).drop("__i", "__j")
    placed = found.withColumn("__u", cell(F.col("px"))).withColumn("__v", cell(F.col("py")))
    d = F.sqrt((F.col("px") - F.col("cx")) * (F.col("px") - F.col("cx")) + (F.col("py") - F.col("cy")) * (F.col("py") - F.col("cy")))
    return placed.join(spread, [*keys, "__u", "__v"]).drop("__u", "__v").withColumn("d", d).where(F.col("d") < radius)


def check_boxes(fields: DataFrame, w: int, h: int) -> DataFrame:
    """(pos, pixel box, centre) of the check boxes, without padding."""
    px = B.to_pixels(corners(), w, h)
    boxes = fields.where("field_type = 'checkbox'").select("pos", *[c.alias(n) for c, n in zip(px, ("fx0", "fy0", "fx1", "fy1"), strict=True)])
    cx, cy = centre(corners("f"))
    return boxes.withColumn("cx", cx).withColumn("cy", cy)


def with_centres(found: DataFrame) -> DataFrame:
    px, py = centre(corners())
    return found.withColumn("px", px).withColumn("py", py)


def nearest(fields: DataFrame, found: DataFrame, w: int, h: int, radius: float = SEARCH) -> DataFrame:
    """(page, pos, idx, d, dx, dy): for each page and check box the closest detection within the radius. A detection may serve many."""
    pairs = near_pairs(F.broadcast(check_boxes(fields, w, h)), with_centres(found), radius, [])
    best = F.min_by(F.struct("idx", (F.col("px") - F.col("cx")).alias("dx"), (F.col("py") - F.col("cy")).alias("dy"), "d"), F.struct("d", "idx"))
    return pairs.groupBy("page", "pos").agg(best.alias("b")).select("page", "pos", "b.idx", "b.d", "b.dx", "b.dy")


def global_shift(near: DataFrame, pages: DataFrame, w: int, h: int) -> DataFrame:
    """(page, n_detected, n_offset_hits, dx, dy): independent medians, clipped; zero where nothing is near."""
    med = near.groupBy("page").agg(F.count(F.lit(1)).alias("n_offset_hits"), F.median("dx").alias("mx"), F.median("dy").alias("my"))
    clip = lambda c, size: B.clamp(F.coalesce(F.col(c), F.lit(0.0)), -size * MAX_SHIFT, size * MAX_SHIFT)
    return pages.join(med, "page", "left").select("page", "n_detected", F.coalesce("n_offset_hits", F.lit(0)).alias("n_offset_hits"), clip("mx", w).alias("dx"), clip("my", h).alias("dy"))


def page_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("page").agg(F.count(F.lit(1)).alias("n_detected"))


def moved_fields(fields: DataFrame, shift: DataFrame, w: int, h: int) -> DataFrame:
    """(page, field columns) of all fields, relative boxes moved by each page's rounded shift; every page gets the whole template."""
    px = B.to_pixels(corners(), w, h)
    base = fields.select("pos", "field_id", "field_type", "pad", *[c.alias(n) for c, n in zip(px, ("a", "b", "c", "d"), strict=True)])
    every = shift.select("page", B.half_even(F.col("dx")).alias("sx"), B.half_even(F.col("dy")).alias("sy")).join(F.broadcast(base))
    rel = B.to_relative([F.col("a") + F.col("sx"), F.col("b") + F.col("sy"), F.col("c") + F.col("sx"), F.col("d") + F.col("sy")], w, h)
    return every.select("page", "pos", "field_id", "field_type", "pad", *[c.alias(n) for c, n in zip(rel, ("x0", "y0", "x1", "y1"), strict=True)])


def greedy_snap(moved: DataFrame, found: DataFrame, w: int, h: int) -> DataFrame:
    """(page, pos, idx): one-to-one matches; fields choose in template order the closest detection that is free."""
    px = B.to_pixels(corners(), w, h)
    boxes = moved.where("field_type = 'checkbox'").select("page", "pos", *[c.alias(n) for c, n in zip(px, ("fx0", "fy0", "fx1", "fy1"), strict=True)])
    cx, cy = centre(corners("f"))
    pairs = near_pairs(boxes.withColumn("cx", cx).withColumn("cy", cy), with_centres(found), SNAP, ["page"]).where(F.abs(F.col("px") - F.col("cx")) <= SNAP_X)
    asked = pairs.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("pos", "d", "idx"))).alias("asked"))
    pair = "struct<pos:int,idx:int>"
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast(f"array<{pair}>").alias("pairs"))

    def step(state: Column, c: Column) -> Column:
        done = (F.size(state["pairs"]) > 0) & (F.element_at(state["pairs"], -1)["pos"] == c["pos"])
        free = ~F.coalesce(done, F.lit(False)) & ~F.array_contains(state["used"], c["idx"])
        new = F.struct(c["pos"].alias("pos"), c["idx"].alias("idx"))
        return F.when(free, F.struct(F.concat(state["used"], F.array(c["idx"])).alias("used"), F.concat(state["pairs"], F.array(new)).alias("pairs"))).otherwise(state)

    return asked.select("page", F.explode(F.aggregate("asked", start, step, lambda s: s["pairs"])).alias("m")).select("page", "m.pos", "m.idx")


def snap_overlay(fields: DataFrame, found: DataFrame, w: int, h: int) -> tuple[DataFrame, DataFrame]:
    """Snapped fields per page, and one summary row per page.

    Pages with fewer than GATE detections keep the template; the others are
    shifted as a whole and then matched box by box. A matched field takes the
    detection's box. Handwriting fields are shifted only. Detections are dealt by
    page once; what follows groups and joins by page and needs no other shuffle of them.

    Defined results: a page without detections has no row; detections with equal
    boxes are told apart by idx; null pages are a page of their own that joins
    nothing; a template without check boxes snaps nothing, with confidence 0.
    """
    found = found.repartition("page")
    pages = page_counts(found)
    open_pages = pages.where(F.col("n_detected") >= GATE)
    used = found.join(open_pages.select("page"), "page", "left_semi")
    shift = global_shift(nearest(fields, used, w, h), open_pages, w, h)
    moved = moved_fields(fields, shift, w, h)
    pairs = greedy_snap(moved, used, w, h)
    taken = pairs.join(used.select("page", "idx", *[F.col(n).alias(f"d{n}") for n in ("x0", "y0", "x1", "y1")]), ["page", "idx"])
    rel = B.to_relative(corners("d"), w, h)
    boxes = taken.select("page", "pos", F.lit(True).alias("snapped"), *[c.alias(f"n{n}") for c, n in zip(rel, ("x0", "y0", "x1", "y1"), strict=True)])
    snapped = moved.join(boxes, ["page", "pos"], "left").select("page", "pos", "field_id", "field_type", "pad", *[F.coalesce(f"n{n}", n).alias(n) for n in ("x0", "y0", "x1", "y1")], F.coalesce("snapped", F.lit(False)).alias("snapped"))
    frozen = pages.where(F.col("n_detected") < GATE).select("page").join(F.broadcast(fields.select("pos", "field_id", "field_type", "pad", "x0", "y0", "x1", "y1"))).withColumn("snapped", F.lit(False))
    n_boxes = fields.where("field_type = 'checkbox'").agg(F.count(F.lit(1)).alias("n_boxes"))
    hits = pairs.groupBy("page").agg(F.count(F.lit(1)).alias("n_snapped"))
    joined = pages.join(shift.drop("n_detected"), "page", "left").join(hits, "page", "left").join(F.broadcast(n_boxes))
    passed = F.col("n_detected") >= GATE
    n = F.coalesce("n_snapped", F.lit(0))
    summary = joined.select(
        "page",
        "n_detected",
        n.cast("bigint").alias("n_snapped"),
        F.when(passed, F.col("n_offset_hits")).alias("n_offset_hits"),
        F.when(passed, F.bround(F.col("dx"), 2)).otherwise(0.0).alias("dx"),
        F.when(passed, F.bround(F.col("dy"), 2)).otherwise(0.0).alias("dy"),
        F.when(passed, "global-shift-then-snap").otherwise("frozen").alias("method"),
        F.when(passed, B.clamp(n / F.greatest(F.col("n_boxes"), F.lit(1)), 0.0, 1.0)).alias("confidence"),
    )
    return snapped.unionByName(frozen), summary


def suppress(found: DataFrame, iou: float = IOU) -> DataFrame:
    """Non-maximum suppression that prefers small boxes; of equal areas the later index."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    rows = found.groupBy("page").agg(F.array_sort(F.collect_list(F.struct(area.alias("area"), (-F.col("idx")).alias("neg"), "idx", "x0", "y0", "x1", "y1"))).alias("boxes"))
    corner = lambda b: [b["x0"], b["y0"], b["x1"], b["y1"]]
    kind = rows.schema["boxes"].dataType.simpleString()

    def step(kept: Column, b: Column) -> Column:
        hit = F.exists(kept, lambda k: B.intersection_over_union(corner(k), corner(b)) >= iou)
        return F.when(hit, kept).otherwise(F.concat(kept, F.array(b)))

    kept = F.aggregate("boxes", F.array().cast(kind), step)
    return rows.select("page", F.explode(kept).alias("b")).select("page", "b.idx", "b.x0", "b.y0", "b.x1", "b.y1")


def column_cuts(fields: DataFrame) -> DataFrame:
    """One row: quartiles of the check boxes' centres."""
    cx = 0.5 * (F.col("x0") + F.col("x1"))
    return fields.where("field_type = 'checkbox'").agg(F.percentile(cx, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("cuts"))


def column_shifted(boxes: DataFrame, fields: DataFrame, shifts: DataFrame, h: int) -> DataFrame:
    """Pixel boxes (pos, x0..y1) of check boxes moved down by their column's rounded shift, within the canvas."""
    cx = 0.5 * (F.col("x0") + F.col("x1"))
    column = fields.where("field_type = 'checkbox'").join(F.broadcast(column_cuts(fields))).select("pos", B.bin_of(cx, F.col("cuts")).alias("col"))
    dy = B.half_even(F.coalesce("shift", F.lit(0.0)))
    rows = boxes.join(F.broadcast(column), "pos").join(F.broadcast(shifts), "col", "left").withColumn("dy", dy)
    move = lambda c, end: F.when(F.col("dy") == 0, F.col(c)).otherwise(F.greatest(F.lit(0), F.col(c) + F.col("dy")) if not end else F.least(F.lit(h), F.col(c) + F.col("dy")))
    return rows.select("pos", "col", "x0", move("y0", False).alias("y0"), "x1", move("y1", True).alias("y1"))


def pick_revision(scores: DataFrame) -> DataFrame:
    """(page, revision, score): the best revision of each page; the higher revision wins ties."""
    score = F.col("n_snapped") + 0.5 * F.coalesce("n_offset_hits", F.lit(0))
    return scores.groupBy("page").agg(F.max_by("revision", F.struct(score, "revision")).alias("revision"), F.max(score).alias("score"))


def ordered_fields(fields: DataFrame, order: list[str]) -> DataFrame:
    """Handwriting fields: in the order given, repeats and all, without ids that are unknown; without an order, all but check boxes."""
    if not order:
        return fields.where("field_type != 'checkbox'").select(F.col("pos").alias("place"), "field_id", "field_type")
    spark = fields.sparkSession
    wanted = spark.createDataFrame(list(enumerate(order)), "place int, field_id string")
    return F.broadcast(wanted).join(fields.select("field_id", "field_type"), "field_id").select("place", "field_id", "field_type")
