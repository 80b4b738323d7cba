"""Corpus pipeline: `documents` through five stages, each written and read again.

Every stage but the last returns the columns it was given. Language ID drops documents it
can't place; line dedup takes repeated lines out of texts; the Jaccard join keeps the
smallest document of each group; mixing repeats and drops whole documents by their
source's target; encoding adds token ids and the text they decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackplate.core import written
from trackplate.llm import bpe, jaccard, langid, linededup, mixing
from trackplate.llm.catalog import vocabulary_file
from trackplate.llm.common import fresh, id_remainder, with_twin

LEAST_SCORE = 0.5             #: of the predicted language


def _apart(docs: DataFrame, *needed: str) -> tuple[DataFrame, str]:
    """The needed columns, and all others packed under a name of their own, so that no operator's column meets them."""
    keep = fresh(docs, "rest")
    rest = [c for c in docs.columns if c not in needed]
    return docs.select(*needed, (F.struct(*(F.col(f"`{c}`") for c in rest)) if rest else F.lit(None)).alias(keep)), keep


def _together(made: DataFrame, docs: DataFrame, keep: str, *needed: str) -> DataFrame:
    """The columns of `docs` again, in their order; n_chars follows the text."""
    out = made.select(*(F.col(f"`{c}`") if c in needed else F.col(keep)[c].alias(c) for c in docs.columns))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a known language; one learned from those outside the held-out quarter."""
    model = langid.train(docs.where(id_remainder("doc_id", 4) != 2))
    rows, keep = _apart(docs, "text")
    found = langid.identify(rows, model)
    sure = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return _together(sure, docs, keep, "text")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat, exactly or nearly, an earlier line."""
    rows, keep = _apart(docs, "doc_id", "text")
    return _together(linededup.dedup_lines(rows), docs, keep, "doc_id", "text")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id.

    Rows that share an id, or have none, are documents of their own by their texts; of equal rows one stays.
    """
    twin, name = fresh(docs, "twin"), fresh(docs, "name")
    rows = with_twin(docs, "doc_id", "text", twin).withColumn(
        name, F.when(F.col(twin) != 0, F.xxhash64(twin, "doc_id")).otherwise(F.col("doc_id")))
    groups = jaccard.jaccard_components(rows.select(F.col(name).alias("doc_id"), "text")).where(F.col("component_id").isNotNull())
    members = groups.select(F.col("doc_id").alias("member"), "component_id").distinct()
    named = rows.where(F.col(twin) != 0).select(F.col(name).alias("member"), F.col("doc_id").alias("id"), F.lit(True).alias("is")).distinct()
    ids = members.join(named, "member", "left").withColumn("id", F.when(F.col("is"), F.col("id")).otherwise(F.col("member")))
    first = ids.groupBy("component_id").agg(F.min_by("member", F.struct(F.col("id").isNull(), "id", "member")).alias("first"))
    gone = ids.join(first, "component_id").where(F.col("member") != F.col("first")).select(F.col("member").alias(name))
    left = rows.join(gone, name, "left_anti")
    return left.where(F.col(twin) == 0).unionByName(left.where(F.col(twin) != 0).dropDuplicates([name])).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them."""
    rows, keep = _apart(docs, "doc_id", "text", "source")
    return _together(mixing.repeated(mixing.whole(mixing.mix(rows))), docs, keep, "doc_id", "text", "source")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with `token_ids`, `decoded` and `n_tokens`."""
    return bpe.encode(docs, vocabulary_file()).withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_copies),
    ("mixing_sources", mixture),
    ("bpe", encoded),
]

#: SQL expresses neither the trained classifier nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
