"""Per-detection score files: wide class columns in, maps inside the engine."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)
NEEDED = ("folder", "timepoint_h", "image", "hard_call")


def soft_scores(rows: DataFrame) -> DataFrame | None:
    """Type the columns and fold raw_<class> into a map; None when a needed column is missing."""
    if not set(NEEDED) <= set(rows.columns):
        log.warning("score table lacks %s", sorted(set(NEEDED) - set(rows.columns)))
        return None
    raw = [c for c in rows.columns if c.startswith("raw_")]
    names = F.array(*[F.lit(c.removeprefix("raw_")) for c in raw])
    values = F.array(*[F.col(f"`{c}`").try_cast("double") for c in raw])
    keep = [c for c in rows.columns if not c.startswith(("raw_", "p_"))]
    return rows.select(*keep, F.map_from_arrays(names, values).alias("raw"))


def split_lines(lines: DataFrame, header: Sequence[str], text: str = "value") -> DataFrame:
    """Rows of a headed text file, one record per line, quoted separators included.

    Lines with fewer fields than the header are dropped, further fields of longer ones are
    not read. The choice depends on the line alone, not on the columns that are used.
    """
    fields = F.size(F.split(F.regexp_replace(F.col(text), '"([^"]|"")*"', ""), ",", -1))
    names = [f"c{i}" for i in range(len(header))]
    parsed = F.from_csv(F.col(text), ", ".join(f"{n} string" for n in names), {"mode": "PERMISSIVE", "nullValue": "\u0000", "emptyValue": ""})
    d = lines.where(fields >= len(header)).withColumn("_p", parsed)
    return d.select(*[F.col("_p")[n].alias(h) for n, h in zip(names, header)])


def read_soft_scores(spark: SparkSession, path: str) -> DataFrame | None:
    header = spark.read.option("header", "true").csv(path).columns
    lines = spark.read.text(path)
    first = F.col("value").startswith(header[0]) & (F.regexp_replace("value", '"', "") == ",".join(header))
    return soft_scores(split_lines(lines.where(~first & (F.trim("value") != "")), header))


def merge_score_parts(parts: Sequence[tuple[DataFrame, DataFrame | None, Column, Column]]) -> DataFrame:
    """One table from (fresh, cached, folder, timepoint) parts.

    Folder and timepoint take this run's values. If any cached table has other columns
    than the fresh ones, all cached rows are left out and a warning is logged.
    """
    base = parts[0][0].columns
    usable = all(c is None or set(c.columns) == set(base) for _, c, _, _ in parts)
    if not usable:
        log.warning("cached score columns differ from this run's; cached rows were dropped")
    out = None
    for fresh, cached, folder, tp in parts:
        d = fresh if cached is None or not usable else fresh.unionByName(cached)
        d = d.withColumns({"folder": folder, "timepoint_h": tp})
        out = d if out is None else out.unionByName(d)
    return out
