"""Track tables: parquet in, NULL for missing, optional columns added."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import add_missing, nan_to_null
from ..operators.ranking import ordered_prefix

POINTS_NEEDED = ["video_id", "track_id", "frame", "x", "y"]
POINTS_OPTIONAL = {"row_id": "bigint", "skeleton_id": "bigint", "has_skeleton": "int", "was_skeletonized": "int",
                   "solidity": "double", "condition": "string", "plate": "string"}
SERIES_NEEDED = ["video_id", "track_id", "frame"]
SERIES_OPTIONAL = {"row_id": "bigint", "speed": "double", "motion_mode": "int", "length": "double", "width_midbody": "double",
                   "curvature_midbody": "double", "eig1": "double", "eig2": "double"}


def clean_tracks(df: DataFrame, needed: list[str], optional: dict[str, str]) -> DataFrame:
    """Check required columns once; a table that lacks one gives no rows, not an error.

    Rows need a position: equal rows are told apart by it, and ties follow it. A table that
    carries none has to be read with `read_tracks` or `read_series`, which number its rows.
    """
    if not set(needed) <= set(df.columns):
        spark = df.sparkSession
        types = ", ".join([f"{c} string" for c in needed] + [f"{c} {t}" for c, t in optional.items()])
        return spark.createDataFrame([], types)
    if "row_id" not in df.columns:
        raise ValueError("track tables need a row_id")
    d = add_missing(nan_to_null(df), optional)
    return d.select(*needed, *optional)


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table with `row_id`: its own, or the row's place through all files in path order."""
    d = spark.read.parquet(path)
    if "row_id" in d.columns:
        return d
    d = d.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = d.groupBy("_file").agg((F.max("_row") + 1).alias("_rows"))
    before = ordered_prefix(files, [], ["_file"], {"_earlier": "_rows"}).select("_file", "_earlier")
    return d.join(before, "_file").withColumn("row_id", F.col("_earlier") + F.col("_row")).drop("_file", "_row", "_earlier")


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    return clean_tracks(numbered(spark, path), POINTS_NEEDED, POINTS_OPTIONAL)


def read_series(spark: SparkSession, path: str) -> DataFrame:
    return clean_tracks(numbered(spark, path), SERIES_NEEDED, SERIES_OPTIONAL)


def attach_skeletons(points: DataFrame, skeletons: DataFrame) -> DataFrame:
    """Body line by (video, skeleton_id); a negative or unknown id has none."""
    s = skeletons.select("video_id", "skeleton_id", "skeleton")
    return points.join(s, ["video_id", "skeleton_id"], "left")


def attach_by_row(points: DataFrame, extra: DataFrame, cols: list[str]) -> DataFrame:
    """Values that belong to the same row position, through the explicit row id.

    A position that `extra` repeats counts once, with its largest values, so points never multiply.
    """
    one = extra.groupBy("video_id", "row_id").agg(F.max(F.struct(*cols)).alias("_e")).select("video_id", "row_id", "_e.*")
    return points.join(one, ["video_id", "row_id"], "left")
