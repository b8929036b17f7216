"""Form inputs derived from the star-schema tables.

There are no scans among those tables, so boxes, detections, signals, tiles and
corner points are computed from keys and values by fixed integer arithmetic. The
same definitions are given as SQL, for checks against another engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, HEIGHT = 2048, 1720
N_CHECKBOX, N_FIELDS = 124, 133
PAD = 0.002


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def field_pixels(k: Column) -> tuple[Column, Column, Column, Column]:
    """Pixel box of field k: 31 rows of 4 check boxes, then 9 handwriting boxes."""
    m = k - N_CHECKBOX
    box = k < N_CHECKBOX
    x0 = F.when(box, 200 + 480 * F.floor(k / 31)).otherwise(100 + 640 * (m % 3))
    y0 = F.when(box, 200 + 48 * (k % 31)).otherwise(20 + 50 * F.floor(m / 3))
    return tuple(c.cast("int") for c in (x0, y0, x0 + F.when(box, 14).otherwise(500), y0 + F.when(box, 14).otherwise(40)))


def template_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, field_id, field_type, x0, y0, x1, y1 relative, pad) of one template of 133 fields."""
    k = F.col("p_partkey").cast("int")
    px = field_pixels(k)
    rel = [(c / F.lit(float(d))).alias(n) for c, d, n in zip(px, (WIDTH, HEIGHT, WIDTH, HEIGHT), ("x0", "y0", "x1", "y1"), strict=True)]
    return table(spark, sf_dir, "part").where(F.col("p_partkey") < N_FIELDS).select(k.alias("pos"), F.concat(F.lit("f"), k.cast("string")).alias("field_id"), F.when(k < N_CHECKBOX, "checkbox").otherwise("handwriting_box").alias("field_type"), *rel, F.lit(PAD).alias("pad"))


def detections(spark: SparkSession, sf_dir: str, halved: bool = False) -> DataFrame:
    """(page, idx, x0, y0, x1, y1 pixels, event_id): noisy boxes around the fields; halved keeps even events."""
    e, u = F.col("event_id"), F.col("user_id")
    x, y, _, _ = field_pixels((e * 7) % N_CHECKBOX)
    x0 = (x + u % 9 - 4 + e % 3 - 1).cast("int")
    y0 = (y + u % 11 - 5 + e % 5 - 2).cast("int")
    rows = table(spark, sf_dir, "events")
    if halved:
        rows = rows.where(e % 2 == 0)
    from pyspark.sql import Window

    order = Window.partitionBy("page").orderBy("y0", "x0", "event_id")
    rows = rows.select(u.alias("page"), e, x0.alias("x0"), y0.alias("y0"), (x0 + 14 + e % 4).cast("int").alias("x1"), (y0 + 14 + e % 3).cast("int").alias("y1"))
    return rows.withColumn("idx", (F.row_number().over(order) - 1).cast("int"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, i, v): each embedding as a signal of 64 samples, rounded to six places."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e")).select("vec_id", "i", F.round(F.col("e").cast("double"), 6).alias("v"))


def gray(e: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), F.rint(128 + 200 * e.cast("double")).cast("int")))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, y, x, v): each embedding as a gray tile of 8 by 8."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e")).select("vec_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), gray(F.col("e")).alias("v"))


def tile_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, v): the same tiles, each one row with its values in reading order."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", gray).alias("v"))


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, x0, y0, .., x3, y3): four jittered corners in clockwise order from the top left."""
    o = F.col("o_orderkey")
    base = [(100, 80, 7, 11), (1900, 80, 13, 5), (1900, 1600, 17, 19), (100, 1600, 23, 3)]
    cols = [o.alias("page")]
    for k, (x, y, a, b) in enumerate(base):
        cols += [(x + o % a * 9).cast("double").alias(f"x{k}"), (y + o % b * 9).cast("double").alias(f"y{k}")]
    return table(spark, sf_dir, "orders").select(*cols)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, event_type, s): values as scores from 0 to 1."""
    s = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 400))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", (s + 0.0).alias("s"))


# The same inputs as common table expressions.
SQL_FIELDS = f"""fields AS (
  SELECT pos, field_id, field_type, px0, py0, px1, py1, px0 / {WIDTH}.0::DOUBLE AS x0, py0 / {HEIGHT}.0::DOUBLE AS y0, px1 / {WIDTH}.0::DOUBLE AS x1, py1 / {HEIGHT}.0::DOUBLE AS y1, {PAD}::DOUBLE AS pad
  FROM (SELECT pos, 'f' || pos AS field_id, CASE WHEN pos < 124 THEN 'checkbox' ELSE 'handwriting_box' END AS field_type, px0, py0, px0 + CASE WHEN pos < 124 THEN 14 ELSE 500 END AS px1, py0 + CASE WHEN pos < 124 THEN 14 ELSE 40 END AS py1
    FROM (SELECT p_partkey::INT AS pos, (CASE WHEN p_partkey < 124 THEN 200 + 480 * (p_partkey // 31) ELSE 100 + 640 * ((p_partkey - 124) % 3) END)::INT AS px0,
      (CASE WHEN p_partkey < 124 THEN 200 + 48 * (p_partkey % 31) ELSE 20 + 50 * ((p_partkey - 124) // 3) END)::INT AS py0 FROM part WHERE p_partkey < 133)))"""
SQL_DETECTIONS = """det AS (
  SELECT page, event_id, x0, y0, x1, y1, (row_number() OVER (PARTITION BY page ORDER BY y0, x0, event_id) - 1)::INT AS idx
  FROM (SELECT user_id AS page, event_id, x0, y0, (x0 + 14 + event_id % 4)::INT AS x1, (y0 + 14 + event_id % 3)::INT AS y1
    FROM (SELECT user_id, event_id, (200 + 480 * (((event_id * 7) % 124) // 31) + user_id % 9 - 4 + event_id % 3 - 1)::INT AS x0,
      (200 + 48 * (((event_id * 7) % 124) % 31) + user_id % 11 - 5 + event_id % 5 - 2)::INT AS y0 FROM events WHERE /*half*/ true)))"""
SQL_GATE = SQL_DETECTIONS.replace("/*half*/ true", "event_id % 2 = 0")
SQL_PROFILES = """prof AS (SELECT vec_id, i, round(e::DOUBLE, 6) AS v FROM (SELECT vec_id, unnest(embedding) AS e, (generate_subscripts(embedding, 1) - 1)::INT AS i FROM embeddings))"""
SQL_TILES = """tile AS (SELECT vec_id, (i // 8)::INT AS y, (i % 8)::INT AS x, least(255, greatest(0, round_even(128 + 200 * e::DOUBLE, 0)))::INT AS v
  FROM (SELECT vec_id, unnest(embedding) AS e, (generate_subscripts(embedding, 1) - 1)::INT AS i FROM embeddings))"""
SQL_QUADS = """quad AS (SELECT o_orderkey AS page, (100 + o_orderkey % 7 * 9)::DOUBLE AS x0, (80 + o_orderkey % 11 * 9)::DOUBLE AS y0, (1900 + o_orderkey % 13 * 9)::DOUBLE AS x1, (80 + o_orderkey % 5 * 9)::DOUBLE AS y1,
  (1900 + o_orderkey % 17 * 9)::DOUBLE AS x2, (1600 + o_orderkey % 19 * 9)::DOUBLE AS y2, (100 + o_orderkey % 23 * 9)::DOUBLE AS x3, (1600 + o_orderkey % 3 * 9)::DOUBLE AS y3 FROM orders)"""
SQL_SCORES = """score AS (SELECT event_id, user_id, event_type, least(1.0, greatest(0.0, value / 400))::DOUBLE + 0.0 AS s FROM events)"""
