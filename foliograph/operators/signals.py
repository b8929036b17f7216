"""Profiles (one value for each row or column of a page) and small gray tiles, as relations.

A profile is (key, i, v), a tile (key, y, x, v). Windows are partitioned by the
key, so one page's profile is one task's work and pages are spread.

Defined results: null values count as missing in sums and means, as in SQL; of equal
values the first place wins; repeated places of one key are separate samples; an
empty profile or tile gives no rows; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .profiles import let


def smoothed(profile: DataFrame, key: str, k: int, digits: int = 9) -> DataFrame:
    """Moving average of k samples, zeros beyond the ends; an even window has one more before than after."""
    w = Window.partitionBy(key).orderBy("i").rowsBetween(-(k // 2), (k - 1) // 2)
    return profile.withColumn("s", F.round(F.sum("v").over(w) / k, digits))


def band_shift(profile: DataFrame, key: str, band: int, y0: int) -> DataFrame:
    """(key, dy, score): where the mean of `band` samples is largest, against y0, and how far above the mean of all."""
    w = Window.partitionBy(key).orderBy("i").rowsBetween(0, band - 1)
    full = profile.withColumn("e", F.round(F.sum(F.abs("v")).over(w) / band, 9)).withColumn("n", F.count("v").over(w)).where(F.col("n") == band)
    best = full.groupBy(key).agg(F.max_by("i", F.struct("e", (-F.col("i")).alias("o"))).alias("peak"), F.max("e").alias("top"), F.avg("e").alias("mean"))
    return best.select(key, (F.col("peak") - y0).cast("int").alias("dy"), F.round(F.least(F.lit(1.0), F.col("top") / (F.col("mean") + 1e-6) / 3.0), 6).alias("score"))


def local_maxima(profile: DataFrame, key: str, k: int, floor: float) -> DataFrame:
    """Smoothed samples above floor that neither neighbour exceeds; the ends are none."""
    s = smoothed(profile, key, k)
    w = Window.partitionBy(key).orderBy("i")
    near = s.withColumn("before", F.lag("s").over(w)).withColumn("after", F.lead("s").over(w))
    return near.where((F.col("s") > floor) & (F.col("s") >= F.col("before")) & (F.col("s") >= F.col("after"))).select(key, "i", "s")


def suppressed_peaks(profile: DataFrame, key: str, k: int, n: int, apart: int) -> DataFrame:
    """(key, peaks): n times the first largest smoothed sample, with [peak - apart, peak + apart) set to zero after each; sorted."""
    rows = smoothed(profile, key, k).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda r: r["s"]).alias("s"))
    start = F.struct(F.col("s").alias("work"), F.array().cast("array<int>").alias("peaks"))

    def step(state: Column, _: Column) -> Column:
        peak = (F.array_position(state["work"], F.array_max(state["work"])) - 1).cast("int")
        cleared = F.transform(state["work"], lambda v, i: F.when((i >= peak - apart) & (i < peak + apart), F.lit(0.0)).otherwise(v))
        return F.struct(cleared.alias("work"), F.concat(state["peaks"], F.array(peak)).alias("peaks"))

    return rows.select(key, F.array_sort(F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, step, lambda s: s["peaks"])).alias("peaks"))


def circular_lag(profile: DataFrame, expected: DataFrame, key: str, n: int, most: int) -> DataFrame:
    """(key, lag, score): the lag from -most to most at which the profile, rolled by it, agrees best with the expected mask; the first one of equals."""
    lags = profile.sparkSession.range(-most, most + 1).select(F.col("id").cast("int").alias("lag"))
    mask = F.broadcast(expected.where("m != 0").crossJoin(lags).select(F.pmod(F.col("j") - F.col("lag"), F.lit(n)).alias("i"), "lag", "m"))
    scored = profile.join(mask, "i").groupBy(key, "lag").agg(F.round(F.sum(F.col("v") * F.col("m")), 6).alias("score"))
    return scored.groupBy(key).agg(F.max_by("lag", F.struct("score", (-F.col("lag")).alias("o"))).alias("lag"), F.max("score").alias("score"))


def reflected(tile: DataFrame, key: str, size: int, offsets: list[tuple[int, int]], border: str = "mirror") -> DataFrame:
    """(key, y, x, dy, dx, v): each pixel with its neighbours at the offsets; borders mirror without repeating the edge, or repeat it."""
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in offsets]))

    def inside(c: Column) -> Column:
        if border == "mirror":
            return F.when(c < 0, -c).when(c >= size, 2 * (size - 1) - c).otherwise(c)
        return F.least(F.greatest(c, F.lit(0)), F.lit(size - 1))

    spread = tile.select(key, "y", "x").withColumn("o", near).select(key, "y", "x", "o.dy", "o.dx", inside(F.col("y") + F.col("o.dy")).alias("__y"), inside(F.col("x") + F.col("o.dx")).alias("__x"))
    other = tile.select(F.col(key), F.col("y").alias("__y"), F.col("x").alias("__x"), "v")
    return spread.join(other, [key, "__y", "__x"]).drop("__y", "__x")


def stencil(tile: DataFrame, key: str, size: int, weights: dict[tuple[int, int], float], border: str = "mirror") -> DataFrame:
    """(key, y, x, s): weighted sums of neighbours."""
    rows = reflected(tile, key, size, list(weights), border)
    weight = F.lit(0.0)
    for (a, b), value in weights.items():
        weight = F.when((F.col("dy") == a) & (F.col("dx") == b), F.lit(float(value))).otherwise(weight)
    return rows.groupBy(key, "y", "x").agg(F.sum(F.col("v") * weight).alias("s"))


LAPLACE = {(0, 0): -4.0, (-1, 0): 1.0, (1, 0): 1.0, (0, -1): 1.0, (0, 1): 1.0}
SOBEL_Y = {(-1, -1): -1.0, (-1, 0): -2.0, (-1, 1): -1.0, (1, -1): 1.0, (1, 0): 2.0, (1, 1): 1.0}


def quality(tile: DataFrame, key: str, size: int) -> DataFrame:
    """(key, quality, blur, glare): sharpness from the Laplacian's variance, and the share of pixels that are nearly white."""
    sharp = stencil(tile, key, size, LAPLACE).groupBy(key).agg(F.var_pop("s").alias("var"))
    glare = tile.groupBy(key).agg(F.avg((F.col("v") >= 250).cast("double")).alias("glare"))
    blur = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("var") / 250.0))
    return sharp.join(glare, key).select(key, F.round(blur * (1 - F.col("glare")), 6).alias("quality"), F.round(blur, 6).alias("blur"), F.round("glare", 6).alias("glare"))


def histogram(tile: DataFrame, key: str) -> DataFrame:
    """(key, v, n, below): pixels of each level that occurs, and pixels up to it."""
    n = tile.groupBy(key, "v").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    return n.withColumn("below", F.sum("n").over(w))


def otsu(tile: DataFrame, key: str) -> DataFrame:
    """(key, level): the smallest level at which the variance between dark and bright pixels is largest."""
    h = histogram(tile, key)
    w = Window.partitionBy(key).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(key)
    s = h.withColumn("mass", F.sum(F.col("v") * F.col("n")).over(w)).withColumn("total", F.sum("n").over(every)).withColumn("all_mass", F.sum(F.col("v") * F.col("n")).over(every))
    n0, n1 = F.col("below"), F.col("total") - F.col("below")
    m0, m1 = F.col("mass") / n0, (F.col("all_mass") - F.col("mass")) / n1
    between = F.round(n0 * n1 * (m0 - m1) * (m0 - m1) / (F.col("total") * F.col("total")), 6)
    scored = s.withColumn("b", F.when(n1 > 0, between).otherwise(0.0))
    return scored.groupBy(key).agg(F.max_by("v", F.struct("b", (-F.col("v")).alias("o"))).alias("level"))


def around(values: Column, size: int, reach: int, of: Callable[..., Column]) -> Column:
    """of(the neighbours in a square) for each value of a tile in reading order; borders repeat the edge, and places that a short tile lacks are null."""
    steps = range(-reach, reach + 1)

    def inside(c: Column) -> Column:
        return F.least(F.greatest(c, F.lit(0)), F.lit(size - 1))

    def near(_: Column, i: Column) -> Column:
        ys, xs = [inside(F.floor(i / size) + a) for a in steps], [inside(i % size + b) for b in steps]
        return of(*[F.get(values, (y * size + x).cast("int")) for y in ys for x in xs])

    return F.transform(values, near)


def morph_close(tiles: DataFrame, key: str, size: int, reach: int = 1) -> DataFrame:
    """(key, y, x, v) of tiles (key, v: values in reading order): largest of the neighbours, then smallest of those, in a square; beyond the border there is nothing.

    A tile is one row until the end, so its pixels are shuffled once, as one array. Of repeated keys each place has its largest value; without a key or values there are no rows.
    """
    rows = tiles.where(F.col(key).isNotNull() & F.col("v").isNotNull()).groupBy(key).agg(F.collect_list("v").alias("v"))
    longest = F.aggregate("v", F.array().cast(tiles.schema["v"].dataType), lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y)))
    closed = let(longest, lambda v: let(around(v, size, reach, F.greatest), lambda w: around(w, size, reach, F.least)))
    rows = rows.select(key, closed.alias("v"))
    return rows.select(key, F.posexplode("v").alias("i", "v")).select(key, F.floor(F.col("i") / size).cast("int").alias("y"), (F.col("i") % size).cast("int").alias("x"), "v")


def box_divide(tile: DataFrame, key: str, size: int, reach: int = 1) -> DataFrame:
    """Division by the local mean, scaled to 255 and saturated."""
    square = {(a, b): 1.0 for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)}
    mean = stencil(tile, key, size, square).withColumn("m", F.greatest(F.lit(1.0), F.rint(F.col("s") / len(square)))).drop("s")
    return tile.join(mean, [key, "y", "x"]).select(key, "y", "x", F.least(F.lit(255.0), F.rint(F.col("v") * 255.0 / F.col("m"))).cast("int").alias("v"))


def correlation(tile: DataFrame, key: str, size: int, patch: DataFrame, n: int) -> DataFrame:
    """(key, dy, dx, score): best place of a patch (y, x, p) of side n by zero-mean normalised correlation; the first in reading order."""
    m = size - n + 1
    places = tile.sparkSession.range(m * m).select(F.floor(F.col("id") / m).cast("int").alias("dy"), (F.col("id") % m).cast("int").alias("dx"))
    look = F.broadcast(patch.crossJoin(places).select((F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), "dy", "dx", "p"))
    k = float(n * n)
    sums = tile.join(look, ["y", "x"]).groupBy(key, "dy", "dx").agg(F.sum(F.col("v") * F.col("p")).alias("vp"), F.sum("v").alias("sv"), F.sum("p").alias("sp"), F.sum(F.col("v") * F.col("v")).alias("vv"), F.sum(F.col("p") * F.col("p")).alias("pp"))
    num = F.col("vp") - F.col("sv") * F.col("sp") / k
    den = F.sqrt((F.col("vv") - F.col("sv") * F.col("sv") / k) * (F.col("pp") - F.col("sp") * F.col("sp") / k))
    scored = sums.withColumn("score", F.when(den > 0, F.round(num / den, 6)).otherwise(0.0))
    best = F.max_by(F.struct("dy", "dx", "score"), F.struct("score", (-F.col("dy")).alias("a"), (-F.col("dx")).alias("b")))
    return scored.groupBy(key).agg(best.alias("b")).select(key, "b.dy", "b.dx", "b.score")


def check_box_score(tile: DataFrame, key: str, size: int) -> DataFrame:
    """(key, hit): whether a window looks like a check box; corner pixels count twice in the border."""
    c = size // 2
    at = lambda cond: F.avg(F.when(cond, F.col("v")))
    last = size - 1
    edge = (F.col("y") == 0).cast("int") + (F.col("y") == last).cast("int") + (F.col("x") == 0).cast("int") + (F.col("x") == last).cast("int")
    near = F.col("y").between(c - 1, c + 1) & F.col("x").between(c - 1, c + 1)
    rows = tile.groupBy(key).agg(at(near).alias("centre"), (F.sum(F.col("v") * edge) / F.sum(edge)).alias("border"), F.avg((F.col("v") < 190).cast("double")).alias("dark"))
    hit = ((F.col("centre") > 180) & F.col("dark").between(0.03, 0.70)) | ((F.col("centre") - F.col("border") >= 6.0) & (F.col("centre") >= 140))
    return rows.select(key, hit.alias("hit"))


def header_score(edge_ratio: Column, dark_ratio: Column, peaks: Column) -> Column:
    """Fusion of the three signs that a page stands upright."""
    peak = 1.0 - F.abs(F.least(peaks, F.lit(8)) - 4) / 4.0
    return 0.4 * F.least(edge_ratio, F.lit(3.0)) / 3.0 + 0.3 * F.least(dark_ratio, F.lit(3.0)) / 3.0 + 0.3 * peak
