"""Small helpers shared by every operator."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rnd(value: Column | str, digits: int = 6) -> Column:
    """Round half away from zero for output, on the scaled double; -0.0 becomes 0.0."""
    c = F.col(value) if isinstance(value, str) else value
    c = c.cast("double")
    scale = F.lit(float(10 ** digits))
    return F.signum(c) * F.floor(F.abs(c) * scale + F.lit(0.5)) / scale + F.lit(0.0)


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL when den is zero or NULL (ANSI division would raise)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is NULL, never NaN: applied once where a table enters the engine."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
            c = F.when(~bad, c).alias(f.name)
        out.append(c)
    return df.select(*out)


def add_missing(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add optional columns that a table lacks as typed NULLs."""
    have = set(df.columns)
    extra = {n: F.lit(None).cast(t) for n, t in columns.items() if n not in have}
    return df.withColumns(extra) if extra else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a temporary one only on local masters."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative step with a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """Write work that several steps read to a columnar table and read it back.

    Unlike a checkpoint the table keeps column pruning; it lies in the shared folder.
    """
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def null_safe_eq(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & left[c].eqNullSafe(right[c])
    return cond


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, reachable by every executor."""
    import uuid

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
