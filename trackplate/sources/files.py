"""File inventories from a folder tree; content is read only when it is hashed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse as P


def _listing(spark: SparkSession, root: str) -> DataFrame:
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    rel = F.regexp_replace(F.regexp_replace(F.col("path"), r"^[a-z0-9]+:/*", "/"), "^" + base.replace(".", r"\."), "")
    return d.withColumn("relative_path", rel)


def scan_files(spark: SparkSession, root: str, extensions=P.IMAGE_EXTENSIONS, depth: int = 3) -> DataFrame:
    """relative_path, size, mtime of image files; the content column is never read."""
    d = _listing(spark, root).select("relative_path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))
    return d.where(P.is_image(F.col("relative_path"), depth, tuple(extensions)))


def hash_files(spark: SparkSession, root: str) -> DataFrame:
    """relative_path and SHA-256 of every data file."""
    d = _listing(spark, root).where(P.is_data_file(F.col("relative_path")))
    return d.select("relative_path", F.sha2(F.col("content"), 256).alias("sha256"))
