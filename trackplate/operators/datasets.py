"""Names for labelled image copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import ordered_prefix


def training_names(files: DataFrame, stage: str) -> DataFrame:
    """condition/plate/file paths to (png, file_id, path), png strain_stage_cohort_pNN_NNNN.png; first file keeps a name.

    The index counts the sorted image files of a plate folder; other paths get no name.
    """
    files = files.where(F.lower("path").rlike(r"\.(tif|tiff|png|jpg|jpeg)$"))
    parts = F.split("path", "/")
    words = F.split(F.get(parts, F.lit(0)), r"\s+")
    clean = "[^A-Za-z0-9]"
    d = files.select(
        "file_id", "path", F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))).alias("_dir"),
        F.regexp_replace(F.element_at(words, -1), clean, "").alias("cohort"),
        F.regexp_replace(F.concat_ws("", F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))), clean, "").alias("strain"),
        F.regexp_extract(F.get(parts, F.lit(1)), r"(\d+)", 1).alias("_n"))
    d = d.where((F.col("strain") != "") & (F.col("cohort") != "") & (F.col("_n") != ""))
    d = ordered_prefix(d, ["_dir"], ["path", "file_id"]).withColumn("idx", F.col("rank_no").cast("int"))
    name = F.format_string("%s_%s_%s_p%02d_%04d.png", "strain", F.lit(stage), "cohort", F.col("_n").cast("int"), F.col("idx"))
    return d.withColumn("png", name).groupBy("png").agg(F.min(F.struct("path", "file_id")).alias("_f")).select("png", "_f.file_id", "_f.path")
