"""Continuous jobs on Spark's keyed state.

What has landed, been emitted or been counted is state of the streaming query itself, by key and in
RocksDB, so a batch touches the keys it holds and no earlier output is listed or read. There is no
watermark: nothing comes too late. Every batch writes its own folder, so a repeated batch
replaces itself and, its state being that of the batch before, holds the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _put(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def _start(stream: DataFrame, mode: str, batch: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run what has arrived in batches; state lies in RocksDB unless the session names a provider of its own."""
    conf = stream.sparkSession.conf
    before, named = conf.get(PROVIDER), conf.get("spark.trackplate.keepStateProvider", "false") == "true"
    if not named:
        conf.set(PROVIDER, ROCKS)
    try:
        return (stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start())
    finally:
        conf.set(PROVIDER, before)


def ingest_stream(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Land files whose content matches its announced hash, then acknowledge them.

    files: (relative_path, sha256, content, size_bytes). Mismatches are refused and
    recorded; a (path, hash) that landed before is skipped, so retries change nothing.
    Acknowledgements are written after the content. Content is hashed once per batch.
    """
    key = ["relative_path", "sha256"]
    checked = files.where(F.col("sha256").isNotNull()).withColumn("_ok", F.sha2(F.col("content"), 256) == F.lower("sha256"))
    first = checked.withColumn("_ok", F.coalesce("_ok", F.lit(False))).dropDuplicates([*key, "_ok"])

    def batch(df: DataFrame, batch_id: int) -> None:
        d = df.persist()                       # one run of the state for the three tables
        try:
            _put(d.where("_ok").drop("_ok"), f"{out}/landed", batch_id)
            _put(d.where("_ok").select(*key), f"{out}/acks", batch_id)
            _put(d.where("NOT _ok").select(*key), f"{out}/refused", batch_id)
        finally:
            d.unpersist()

    return _start(first, "append", batch, checkpoint)


def latest_per_device(items: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Newest item per device; a newer one replaces a waiting one, each is emitted once.

    items: (device, seq, ...). State is one row per device: its newest item and the batch that brought
    it. A device is emitted when that is the present batch; of equal numbers the first to come stays.
    """
    cols = [c for c in items.columns if c != "device"]
    d = items.withColumn("_came", F.unix_micros(F.current_timestamp()))          # one instant per batch, the same if it is repeated
    row = F.struct(*(F.col(c) for c in ("seq", "_came", *(c for c in cols if c != "seq"))))
    newest = d.groupBy("device").agg(F.max_by(row, F.struct("seq", -F.col("_came"))).alias("_r"), F.max("_came").alias("_now"))

    def batch(df: DataFrame, batch_id: int) -> None:
        _put(df.where(F.col("_r._came") == F.col("_now")).select("device", "_r.*").drop("_came"), out, batch_id)

    return _start(newest, "update", batch, checkpoint)


def streaming_counts(images: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Running totals per condition; a repeated (path, sha256) counts once, however late it comes.

    images: (condition, path, sha256, n). State holds the keys counted so far; a batch adds
    the sums of its new images.
    """
    d = images.withColumns({"condition": F.col("condition").cast("string"), "n": F.col("n").cast("bigint")})

    def batch(df: DataFrame, batch_id: int) -> None:
        _put(df.groupBy("condition").agg(F.count(F.lit(1)).alias("n_images"), F.sum("n").alias("n_animals")), f"{out}/sums", batch_id)

    return _start(d.dropDuplicates(["path", "sha256"]), "append", batch, checkpoint)


def latest_counts(spark: SparkSession, out: str) -> DataFrame:
    """Total per condition over all batches."""
    d = spark.read.schema("condition string, n_images bigint, n_animals bigint, batch_id bigint").parquet(f"{out}/sums")
    return d.groupBy("condition").agg(F.sum("n_images").alias("n_images"), F.sum("n_animals").alias("n_animals"))


def finish(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
