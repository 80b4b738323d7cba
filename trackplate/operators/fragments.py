"""Fragment summaries and neighbour search between fragments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import axis
from .ranking import ordered_prefix

KEYS = ("video_id",)


def split_tracks(points: DataFrame, keys: Sequence[str] = KEYS, track: str = "track_id",
                 max_step: int = 30) -> DataFrame:
    """Cut a track wherever the frame axis jumps by more than `max_step`.

    Pieces are numbered through all tracks of a unit, in order of track and place, so no
    number of pieces makes two of them one.
    """
    k = [*keys, track]
    d = axis.with_previous(points, k, {"_pf": F.col("frame")})
    new = F.col("frame") - F.coalesce(F.col("_pf"), F.col("frame")) > max_step
    d = axis.islands(d, k, new, "_seg")
    pieces = d.groupBy(*k).agg((F.max("_seg") + 1).alias("_pieces"))
    before = ordered_prefix(pieces, list(keys), [track], {"_earlier": "_pieces"}).select(*k, "_earlier")
    return d.join(before, k).withColumn(track, F.col("_earlier") + F.col("_seg")).drop("_seg", "_pf", "_earlier")


def fragment_summary(points: DataFrame, keys: Sequence[str] = KEYS, track: str = "track_id",
                     n: int = 5) -> DataFrame:
    """First/last frame and the mean of the first/last `n` centroids, skipping NULLs.

    `row_number() <= n` is applied before the shuffle (partial group limit), so only
    n rows per track and task move.
    """
    k = [*keys, track]
    ends = {}
    for name, order in (("start", (F.asc("frame"), F.asc("row_id"))),
                        ("end", (F.desc("frame"), F.desc("row_id")))):
        w = Window.partitionBy(*k).orderBy(*order)
        ends[name] = (points.select(*k, "frame", "row_id", "x", "y")
                      .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
                      .groupBy(*k).agg(F.avg("x").alias(f"{name}_x"), F.avg("y").alias(f"{name}_y")))
    span = points.groupBy(*k).agg(F.min("frame").alias("start_frame"),
                                  F.max("frame").alias("end_frame"),
                                  F.count(F.lit(1)).alias("n_rows"))
    return span.join(ends["start"], k, "left").join(ends["end"], k, "left")


def neighbours(frags: DataFrame, keys: Sequence[str] = KEYS, track: str = "track_id",
               min_gap: int = 0, max_gap: int = 150, max_dist: float = 50.0) -> DataFrame:
    """Ordered pairs (a, b): b starts min_gap..max_gap frames after a ends, within
    max_dist pixels. Equi-join on (key, time bucket, grid cell); the exact test runs
    on the few rows that share a bucket, so no pair outside the neighbourhood exists.
    """
    t, c = F.lit(max(max_gap, 1)), F.lit(float(max_dist))
    a = frags.select(*keys, F.col(track).alias("a"), F.col("end_frame").alias("a_end"),
                     F.col("end_x").alias("_ax"), F.col("end_y").alias("_ay")).where(
        F.col("_ax").isNotNull() & F.col("_ay").isNotNull())
    b = frags.select(*keys, F.col(track).alias("b"), F.col("start_frame").alias("b_start"),
                     F.col("start_x").alias("_bx"), F.col("start_y").alias("_by")).where(
        F.col("_bx").isNotNull() & F.col("_by").isNotNull())
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    a = (a.withColumn("_t", F.explode(F.array(F.floor(F.col("a_end") / t), F.floor(F.col("a_end") / t) + 1)))
         .withColumn("_dx", F.explode(near)).withColumn("_dy", F.explode(near))
         .withColumn("_cx", F.floor(F.col("_ax") / c) + F.col("_dx"))
         .withColumn("_cy", F.floor(F.col("_ay") / c) + F.col("_dy")).drop("_dx", "_dy"))
    b = (b.withColumn("_t", F.floor(F.col("b_start") / t))
         .withColumn("_cx", F.floor(F.col("_bx") / c)).withColumn("_cy", F.floor(F.col("_by") / c)))
    gap = F.col("b_start") - F.col("a_end")
    dist = F.sqrt(F.pow(F.col("_bx") - F.col("_ax"), 2) + F.pow(F.col("_by") - F.col("_ay"), 2))
    return (a.join(b, [*keys, "_t", "_cx", "_cy"])
            .where((F.col("a") != F.col("b")) & gap.between(min_gap, max_gap))
            .withColumn("dist", dist).where(F.col("dist") <= max_dist)
            .select(*keys, "a", "b", "a_end", "b_start", gap.alias("gap"), "dist"))


def successor_candidates(frags: DataFrame, fps: float, keys: Sequence[str] = KEYS,
                         track: str = "track_id", max_s: float = 5.0,
                         max_dist: float = 150.0) -> DataFrame:
    """Candidates to continue a fragment: start strictly after its end, within max_s."""
    return neighbours(frags, keys, track, 1, int(max_s * fps), max_dist)
