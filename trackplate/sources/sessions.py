"""Session documents: nested JSON to one row per plate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """id string, name string, assay_mode string, assay_config map<string,string>, created_at string,
schema_version int, plates array<struct<id:string, condition_id:string, name:string, condition_name:string,
treatment_label:string, plate_number:int, created_at:string>>"""


def folder_name(condition: Column, name: Column, number: Column) -> Column:
    return F.format_string("%s_%s_plate%02d", condition, name, number)


def explode_sessions(docs: DataFrame, text: str = "value") -> DataFrame:
    """One row per plate; a document that does not parse is skipped."""
    d = docs.select(F.from_json(F.col(text), SCHEMA, {"mode": "PERMISSIVE"}).alias("s")).where(F.col("s.id").isNotNull())
    d = d.select(F.col("s.id").alias("session_id"), F.col("s.name").alias("experiment_name"), F.col("s.assay_mode").alias("assay_mode"),
                 F.col("s.assay_config").alias("assay_config"), F.explode("s.plates").alias("p"))
    label = F.concat_ws(" ", F.coalesce("p.condition_name", "p.name"), F.coalesce("p.treatment_label", "p.condition_id"))
    return d.select("session_id", "experiment_name", "assay_mode", "assay_config", F.col("p.id").alias("plate_id"),
                    F.col("p.plate_number").alias("plate_number"), label.alias("condition_name"),
                    folder_name(F.col("p.condition_id"), F.col("p.name"), F.col("p.plate_number")).alias("folder_name"))


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return explode_sessions(docs)
