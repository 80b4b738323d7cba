"""Helpers shared by the text operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import written

SPACES = " \t\n\x0b\f\r"
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the runs free of ASCII white space; empty for NULL and blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_GAP))


def id_remainder(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a NULL id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % n, F.lit(0))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the table does not have, in any case."""
    have, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name.lower() in have:
        name = f"_{stem}_{uuid.uuid4().hex[:8]}"
    return name


def twins(docs: DataFrame, doc_id: str) -> DataFrame:
    """(id): the ids of more than one row, NULL among them if it is there at all."""
    return docs.groupBy(F.col(doc_id).alias("id")).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col("id").isNull()).select("id")


def with_twin(docs: DataFrame, doc_id: str, text: str, name: str) -> DataFrame:
    """Add a hash of the text where an id names several rows (or is NULL), 0 elsewhere: with the id it names one text."""
    at = fresh(docs, f"several_{name}")
    several = written(twins(docs, doc_id), "twins")
    if several.isEmpty():                                  # no join, so that no text moves
        return docs.withColumn(name, F.lit(0).cast("long"))
    named = several.select(F.col("id").alias(at), F.lit(True).alias(f"{at}_is"))
    return (docs.join(named, F.col(doc_id).eqNullSafe(F.col(at)), "left")
            .withColumn(name, F.when(F.col(f"{at}_is"), F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())).otherwise(F.lit(0).cast("long")))
            .drop(at, f"{at}_is"))


def most_frequent(counts: DataFrame, most: int) -> list[tuple]:
    """(word, n) of the most frequent words of (word, n), at most `most`, by count downwards, then word.

    A histogram of counts, of some thousand steps at most, gives the threshold; words of about the same
    count stand or fall together, so only what is returned reaches the driver.
    """
    words = counts.withColumn("level", F.floor(F.log2("n") * 64))
    least, room = None, most
    for r in sorted(words.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["level"]):
        room -= r["n"]
        if room < 0:
            break
        least = r["level"]
    if least is None:
        return []
    return sorted(((r["word"], r["n"]) for r in words.where(F.col("level") >= least).select("word", "n").collect()), key=lambda r: (-r[1], r[0]))


def put_file(spark: SparkSession, path: str, data: bytes) -> None:
    """Write one small driver-made file to a folder of any store that Spark reaches."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        for k in range(0, len(data), 1 << 20):
            out.write(bytearray(data[k:k + (1 << 20)]))
    finally:
        out.close()
