"""Views that present the given star-schema tables in the shapes of the engine.

Each view exists twice: as a DataFrame here, and as SQL text in `catalog/views.py`
for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.fragments import split_tracks

CLASSES = ["egg", "L1", "L2", "L3", "L4", "adult"]
STAGES = [*CLASSES, "blob"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _events(spark, sf):
    e = table(spark, sf, "events")
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    return e.select(
        F.col("event_type").alias("video_id"), (F.col("user_id") % 20).alias("track_id"),
        F.floor(seconds / 900).cast("long").alias("frame"), F.col("event_id").alias("row_id"),
        F.col("value").alias("v"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("k"))


def track_points(spark, sf) -> DataFrame:
    return _events(spark, sf).select(
        "video_id", "track_id", "frame",
        F.when(F.col("row_id") % 53 != 0, F.col("v")).alias("x"), F.col("k").alias("y"), "row_id",
        (F.col("row_id") % 7 != 0).cast("int").alias("has_skeleton"))


def track_series(spark, sf) -> DataFrame:
    i = F.col("row_id")
    return _events(spark, sf).select(
        "video_id", "track_id", "frame", "row_id",
        F.when(i % 11 != 0, F.col("v") - 50).alias("speed"),
        F.when(i % 13 != 0, (i % 3 - 1).cast("int")).alias("motion_mode"),
        F.when(i % 17 != 0, F.lit(40) + F.col("v") / 10).alias("length"),
        (F.lit(5) + F.col("k") / 50).alias("width_midbody"),
        ((F.col("v") - 50) / 50).alias("eig1"), ((F.col("k") - 50) / 50).alias("eig2"),
        (F.lit(0.5) + (i % 50) / 100).alias("solidity"),
        (i % 7 != 0).cast("int").alias("was_skeletonized"))


def fragment_points(spark, sf) -> DataFrame:
    """Track points cut where the frame step exceeds 30."""
    return split_tracks(track_points(spark, sf))


def skeletons(spark, sf) -> DataFrame:
    """49-point body lines walked from the embedding values as turning angles."""
    e = table(spark, sf, "embeddings")
    walk = ("transform(sequence(1, 49), i -> struct("
            "if(vec_id % 19 = 0 and i = 7, null, aggregate(slice(embedding, 1, i), 0D, "
            "(s, a) -> s + 10 * cos(3 * cast(a as double)))) as x, "
            "aggregate(slice(embedding, 1, i), 0D, (s, a) -> s + 10 * sin(3 * cast(a as double))) as y))")
    return e.select(
        F.concat(F.lit("v"), (F.col("vec_id") % 5).cast("string")).alias("video_id"),
        (F.floor(F.col("vec_id") / 5) % 4).alias("track_id"),
        F.floor(F.col("vec_id") / 20).alias("frame"), F.col("vec_id").alias("skeleton_id"),
        F.col("label"), F.expr(walk).alias("skeleton"))


def detections(spark, sf) -> DataFrame:
    """Boxes; 20 per image whatever the table size."""
    e = table(spark, sf, "embeddings")

    def at(i):
        return F.get("embedding", F.lit(i - 1)).cast("double")

    x1, y1 = F.lit(500) + F.lit(2000) * at(1), F.lit(500) + F.lit(2000) * at(2)
    scores = F.array(*[F.lit(1) / (F.lit(1) + F.exp(F.lit(-10) * at(i))) for i in range(10, 16)])
    return e.select(
        F.floor(F.col("vec_id") / 20).alias("image_id"), F.col("vec_id").alias("det_id"),
        F.get(F.array(*[F.lit(c) for c in CLASSES]), F.col("label") % 6).alias("cls"),
        x1.alias("x1"), y1.alias("y1"),
        (x1 + 20 + F.lit(400) * F.abs(at(3))).alias("x2"),
        (y1 + 20 + F.lit(400) * F.abs(at(4))).alias("y2"),
        (F.lit(1) / (F.lit(1) + F.exp(F.lit(-10) * at(5)))).alias("score"),
        (F.col("vec_id") % 4 == 0).alias("truncated"), scores.alias("scores"))


def images(spark, sf) -> DataFrame:
    """One row per plate image, with its condition, timepoint, plate and error flag."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    k, seg = F.col("o_orderkey"), F.col("c_mktsegment")
    dose = (k % 4) * 20
    label = F.when((seg == "MACHINERY") & (dose == 60), seg).otherwise(
        F.concat(seg, F.lit(" "), dose.cast("string"), F.lit("J")))
    plate = F.when((seg == "FURNITURE") & (dose == 40), F.lit(1)).otherwise(F.col("o_custkey") % 3 + 1)
    tp = ((F.year("o_orderdate") - 1995) * 24).cast("double")
    quad = F.get(F.array(*[F.lit(q) for q in ("NE", "NW", "SE", "SW")]), (F.floor(k / 4) % 4).cast("int"))
    d = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        label.alias("condition"), tp.alias("tp"), F.concat(F.lit("p0"), plate.cast("string")).alias("plate"),
        k.alias("image_id"),
        F.concat(F.lit("img"), k.cast("string"), F.lit("_"), quad, F.lit(".png")).alias("image"),
        (k % 97 == 0).alias("has_error"))
    return d.where(~((F.col("condition") == "BUILDING 40J") & (F.col("tp") == 24.0)))


def stage_counts(spark, sf) -> DataFrame:
    """Animals per (image, stage)."""
    l = table(spark, sf, "lineitem")
    stage = F.get(F.array(*[F.lit(s) for s in STAGES]), F.col("l_linenumber") % 7)
    return l.groupBy(F.col("l_orderkey").alias("image_id"), stage.alias("stage")).agg(
        F.sum(F.col("l_quantity").cast("long")).alias("n"))


def sizes(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("grp"), F.col("l_extendedprice").alias("size_px"))


def image_paths(spark, sf) -> DataFrame:
    """Capture-style relative paths of depth 0 to 2."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    k = F.col("o_orderkey")

    def pick(values, by):
        return F.get(F.array(*[F.lit(v) for v in values]), by.cast("int"))

    strain = pick(["601", "N2", "604"], F.col("o_custkey") % 3)
    dose = pick(["_20J", "_0j", "_100uM", "", "_60J"], k % 5)
    plate = pick(["_p01", "_P2", "_p13", ""], F.floor(k / 5) % 4)
    stamp = F.concat(F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("T"),
                     pick(["075438", "235959", "256060"], F.floor(k / 20) % 3))
    quad = pick(["_NE", "_nw", "_SE", "_SW", ""], F.floor(k / 3) % 5)
    stem = F.concat(strain, F.lit("_Train"), dose, plate, stamp, quad)
    plate_dir = F.concat(F.lit("plate"), (k % 12).cast("string"))
    cond = F.concat(strain, F.lit(" "), ((k % 4) * 20).cast("string"),
                    pick(["J", " uM", "j", " x"], F.floor(k / 7) % 4))
    name = F.concat(stem, pick([".png", ".TIF", ".txt"], F.floor(k / 11) % 3))
    path = (F.when(k % 3 == 0, name).when(k % 3 == 1, F.concat_ws("/", plate_dir, name))
            .otherwise(F.concat_ws("/", cond, plate_dir, name)))
    return o.select(k.alias("file_id"), path.alias("path"), name.alias("name"), stem.alias("stem"),
                    cond.alias("label"), (F.col("o_custkey") % 10).alias("folder_id"))


def files(spark, sf) -> DataFrame:
    """File inventory with hash and acknowledgement, from the page table."""
    p = table(spark, sf, "pages")
    i = F.col("page_id")
    hidden = F.when(i % 23 == 0, ".thumbs/").otherwise("")
    return p.select(
        i.alias("file_id"), F.concat(F.lit("s"), (i % 7).cast("string")).alias("session_id"),
        F.concat(F.lit("s"), (i % 7).cast("string"), F.lit("/"), hidden, F.lit("f"), i.cast("string"),
                 F.when(i % 29 == 0, ".sha256").otherwise(".tif")).alias("relative_path"),
        F.length("html").cast("long").alias("size_bytes"),
        F.when(i % 31 != 0, F.sha2(F.col("html"), 256)).alias("sha256"),
        (F.lit(1704067200) + i * 3600).alias("mtime"), (i % 3 == 0).alias("acked"),
        F.when(i % 3 == 0, F.lit(1704067200) + i * 3600 + (i % 5) * 100000).alias("acked_at"))
