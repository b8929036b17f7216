"""Small gray images as relations (key, y, x, v): sums over boxes, equalisation, resampling, components.

Every step is a join or a window by key, so images spread over the cluster and one
image is one group. `pixels` has the same steps as kernels for whole pages.

Defined results: of images with missing pixels, sums and histograms are of those
that are there; boxes are cut at the image; images without pixels, or without any
above a threshold, have no rows; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pixels import cubic
from .profiles import let

#: What keys and ids are called meanwhile, whatever the user calls them.
KEY, ID = "__key", "__id"


def _own(tile: DataFrame, key: str) -> DataFrame:
    return tile.select(F.col(key).alias(KEY), "y", "x", "v")


def summed_areas(tile: DataFrame, key: str, value: Column) -> DataFrame:
    """(key, y, x, s): the sum of value over all pixels above and to the left, the pixel included; two running sums."""
    across = Window.partitionBy(key, "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(key, "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    return tile.select(key, "y", "x", F.sum(value).over(across).alias("r")).select(key, "y", "x", F.sum("r").over(down).alias("s"))


def box_sums(table: DataFrame, boxes: DataFrame, key: str, id_cols: list[str], parts: dict[str, tuple[Column, Column, Column, Column]]) -> DataFrame:
    """(key, ids, one sum for each part): sums of a summed-area table over boxes [x0, x1) x [y0, y1), four lookups for each; outside the table there is nothing."""
    corners = []
    for name, (x0, y0, x1, y1) in parts.items():
        corners += [F.struct(F.lit(name).alias("part"), (y - 1).alias("y"), (x - 1).alias("x"), F.lit(sign).alias("sign")) for x, y, sign in ((x1, y1, 1), (x0, y1, -1), (x1, y0, -1), (x0, y0, 1))]
    asked = boxes.select(key, *id_cols, F.explode(F.array(*corners)).alias("c")).select(key, *id_cols, "c.*")
    found = asked.join(table, [key, "y", "x"], "left")
    own = lambda name: F.sum(F.when(F.col("part") == name, F.col("sign") * F.coalesce("s", F.lit(0)))).alias(name)
    return found.groupBy(key, *id_cols).agg(*[own(name) for name in parts])


def check_box_places(tile: DataFrame, boxes: DataFrame, key: str, id_col: str, size: int) -> DataFrame:
    """(key, id, pixels, centre, sides, dark, hit): what a box's place looks like, from summed-area tables alone; boxes (x0, y0, x1, y1) are cut at the image of size by size pixels and must meet it."""
    cut = lambda c, lo: F.greatest(F.least(F.col(c), F.lit(size)), F.lit(lo))
    tile = _own(tile, key)
    b = boxes.select(F.col(key).alias(KEY), F.col(id_col).alias(ID), *[cut(c, 0).alias(c) for c in ("x0", "y0", "x1", "y1")]).where("x1 > x0 and y1 > y0")
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    cx, cy = x0 + F.floor((x1 - x0) / 2).cast("int"), y0 + F.floor((y1 - y0) / 2).cast("int")
    middle = (F.greatest(cx - 1, x0), F.greatest(cy - 1, y0), F.least(cx + 2, x1), F.least(cy + 2, y1))
    tones = box_sums(summed_areas(tile, KEY, F.col("v")), b, KEY, [ID], {"middle": middle, "top": (x0, y0, x1, y0 + 1), "bottom": (x0, y1 - 1, x1, y1), "left_": (x0, y0, x0 + 1, y1), "right_": (x1 - 1, y0, x1, y1)})
    darks = box_sums(summed_areas(tile, KEY, (F.col("v") < 190).cast("int")), b, KEY, [ID], {"n_dark": (x0, y0, x1, y1)})
    rows = b.join(tones, [KEY, ID]).join(darks, [KEY, ID])
    pixels = (x1 - x0) * (y1 - y0)
    centre = F.col("middle") / ((middle[2] - middle[0]) * (middle[3] - middle[1]))
    sides = (F.col("top") + F.col("bottom") + F.col("left_") + F.col("right_")) / (2 * (x1 - x0 + y1 - y0))
    dark = F.col("n_dark") / pixels
    hit = (pixels >= 16) & (((centre > 180) & (dark >= 0.03) & (dark <= 0.70)) | ((centre - sides >= 6.0) & (centre >= 140)))
    return rows.select(F.col(KEY).alias(key), F.col(ID).alias(id_col), pixels.alias("pixels"), centre.alias("centre"), sides.alias("sides"), dark.alias("dark"), hit.alias("hit"))


def equalised(tile: DataFrame, key: str, size: int, grid: int, limit: float = 2.0) -> DataFrame:
    """(key, y, x, v): contrast-limited adaptive equalisation of images of size by size pixels, cut into grid by grid parts (a divisor of size).

    A part's histogram is clipped, and what is cut off goes to all levels alike, the
    rest of it to evenly spaced ones; both have closed forms, so only levels that
    occur are rows. A pixel blends the four parts around it.
    """
    tile = _own(tile, key)
    step = size // grid
    area = step * step
    most = max(1, int(limit * area / 256))
    part = lambda c: F.floor(F.col(c) / step).cast("int")
    levels = tile.groupBy(KEY, part("y").alias("py"), part("x").alias("px"), F.col("v").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(KEY, "py", "px")
    clipped = levels.select(KEY, "py", "px", "level", F.least("n", F.lit(most)).alias("n"), F.sum(F.greatest(F.col("n") - most, F.lit(0))).over(whole).alias("excess"))

    at = lambda c: F.col(c) / float(step) - 0.5
    near = lambda c, k: F.greatest(F.lit(0), F.least(F.lit(grid - 1), F.floor(at(c)).cast("int") + k))
    share = lambda c, k: (at(c) - F.floor(at(c))) if k else (1 - (at(c) - F.floor(at(c))))
    four = F.explode(F.array(*[F.struct(near("y", a).alias("py"), near("x", b).alias("px"), (share("y", a) * share("x", b)).alias("w"), F.lit(2 * a + b).alias("k")) for a in (0, 1) for b in (0, 1)]))
    asked = tile.select(KEY, "y", "x", "v", four.alias("f")).select(KEY, "y", "x", "v", "f.*")
    joined = asked.join(clipped, [KEY, "py", "px"])
    below = F.sum(F.when(F.col("level") <= F.col("v"), F.col("n")).otherwise(0))
    tables = joined.groupBy(KEY, "y", "x", "v", "k", "w").agg(below.alias("below"), F.first("excess").alias("excess"))
    left = F.col("excess") % 256
    extra = F.when(left > 0, F.least(left, F.floor(F.col("v") / F.greatest(F.floor(256 / left), F.lit(1))) + 1)).otherwise(0)
    total = F.col("below") + (F.col("v") + 1) * F.floor(F.col("excess") / 256) + extra
    tone = F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.rint(total * (255.0 / area))))
    return tables.groupBy(F.col(KEY).alias(key), "y", "x").agg(F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.rint(F.sum(tone * F.col("w"))))).cast("int").alias("v"))


def doubled(tile: DataFrame, key: str, size: int) -> DataFrame:
    """(key, y, x, v): images twice as large by cubic convolution: a join with the sixteen taps of every target pixel; borders repeat the edge."""
    taps = []
    for target in range(2 * size):
        place = (target + 0.5) / 2 - 0.5
        first = int(place // 1)
        taps.append([(min(max(first + k - 1, 0), size - 1), float(w)) for k, w in enumerate(cubic(place - first))])
    spark = tile.sparkSession
    line = spark.createDataFrame([(t, at, w) for t, row in enumerate(taps) for at, w in row], "target int, at int, w double")
    weights = F.broadcast(line.alias("a").crossJoin(line.alias("b")).groupBy(F.col("a.target").alias("ty"), F.col("b.target").alias("tx"), F.col("a.at").alias("y"), F.col("b.at").alias("x")).agg(F.sum(F.col("a.w") * F.col("b.w")).alias("w")))
    sums = _own(tile, key).join(weights, ["y", "x"]).groupBy(KEY, "ty", "tx").agg(F.sum(F.col("v") * F.col("w")).alias("s"))
    return sums.select(F.col(KEY).alias(key), F.col("ty").alias("y"), F.col("tx").alias("x"), F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.rint(F.round("s", 9)))).cast("int").alias("v"))


def components(tile: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """(key, x0, y0, x1, y1, n): boxes and sizes of the groups of pixels above `low` that touch, corners included, and hold one above `high`.

    Pixels are put into runs by row first. Runs are joined within an image's own row,
    in reading order: a run takes the smallest label of the runs above that it touches,
    and their labels become that one. That needs no recursion, whose depth and number
    of rows Spark bounds.
    """
    line = Window.partitionBy(KEY, "y").orderBy("x")
    weak = _own(tile, key).where(F.col("v") > low).withColumn("run", F.col("x") - F.row_number().over(line))
    runs = weak.groupBy(KEY, "y", "run").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"), F.max((F.col("v") > high).cast("int")).alias("strong"))
    rows = runs.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("y", "x0", "x1", "strong"))).alias("runs"))
    kind = "struct<label:int,y:int,x0:int,x1:int,strong:int>"

    def add(state: Column, r: Column) -> Column:
        touching = F.filter(state, lambda s: (s["y"] == r["y"] - 1) & (s["x0"] <= r["x1"]) & (s["x1"] >= r["x0"]))

        def join(labels: Column) -> Column:
            own = F.coalesce(F.array_min(labels), F.size(state)).cast("int")
            new = F.struct(own.alias("label"), *[r[n].alias(n) for n in ("y", "x0", "x1", "strong")])
            renamed = F.transform(state, lambda s: F.struct(F.when(F.array_contains(labels, s["label"]), own).otherwise(s["label"]).alias("label"), *[s[n].alias(n) for n in ("y", "x0", "x1", "strong")]))
            return F.concat(renamed, F.array(new))

        return let(F.transform(touching, lambda s: s["label"]), join)

    labelled = rows.select(KEY, F.explode(F.aggregate("runs", F.array().cast(f"array<{kind}>"), add)).alias("r")).select(KEY, "r.*")
    boxes = labelled.groupBy(KEY, "label").agg(F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), (F.max("y") + 1).alias("y1"), F.sum(F.col("x1") - F.col("x0")).alias("n"), F.max("strong").alias("strong"))
    return boxes.where("strong = 1").select(F.col(KEY).alias(key), "x0", "y0", "x1", "y1", "n")
