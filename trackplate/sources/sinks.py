"""Result sets: one new folder per run, never overwritten, with a provenance row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import rnd


def round_numbers(df: DataFrame, digits: int = 4) -> DataFrame:
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({n: rnd(n, digits) for n in names}) if names else df


def write_results(tables: Mapping[str, DataFrame], root: str, run_id: str, settings: Mapping[str, str] | None = None,
                  partition: Mapping[str, Sequence[str]] | None = None, order: Mapping[str, Sequence] | None = None,
                  fmt: str = "parquet") -> str:
    """Write every table under root/run_id; fails if the run folder already has it.

    A partitioned table is cut into ranges of (partition, order), so one value that holds most rows
    has several files, each in order and following on the one before. The provenance row (run_info) has the settings and
    the rows of every table, counted on what was written.
    """
    out = f"{root.rstrip('/')}/{run_id}"
    for name, df in tables.items():
        d = round_numbers(df).withColumn("run_id", F.lit(run_id))
        cols = list((partition or {}).get(name, ()))
        by = [*cols, *(order or {}).get(name, ())]
        if by:
            d = d.repartitionByRange(*by).sortWithinPartitions(*by)
        w = d.write.mode("errorifexists").format(fmt)
        if fmt == "csv":
            w = w.option("header", "true")
        (w.partitionBy(*cols) if cols else w).save(f"{out}/{name}")
    spark = next(iter(tables.values())).sparkSession
    counts = {n: spark.read.schema(df.schema).format(fmt).option("header", fmt == "csv").load(f"{out}/{n}").count() for n, df in sorted(tables.items())}
    info = spark.createDataFrame([(run_id, counts, dict(settings or {}))], "run_id string, tables map<string,bigint>, settings map<string,string>")
    info.write.mode("errorifexists").json(f"{out}/run_info")
    return out


def provenance(spark, out: str) -> DataFrame:
    """(run_id, name, n_rows, settings) of a written run, a row per table."""
    info = spark.read.schema("run_id string, tables map<string,bigint>, settings map<string,string>").json(f"{out}/run_info")
    return info.select("run_id", F.explode("tables").alias("name", "n_rows"), "settings")


def pivot_counts(long: DataFrame, keys: Sequence[str], stages: Sequence[str]) -> DataFrame:
    """Wide stage columns for a sheet; the stage list is explicit, so no extra pass."""
    return long.groupBy(*keys).pivot("stage", list(stages)).agg(F.sum("n")).na.fill(0)


def report_rows(cond: DataFrame) -> DataFrame:
    """Condition rows with dense dose and timepoint indexes (NULL dose last).

    Label lists are small and become scalar arrays, so nothing is joined back.
    """
    doses = cond.agg(F.array_sort(F.collect_set("dose")).alias("d"))
    tps = cond.agg(F.array_sort(F.collect_set("tp")).alias("t"))
    d = cond.withColumns({"_d": doses.scalar(), "_t": tps.scalar()})
    di = F.when(F.col("dose").isNull(), F.size("_d").cast("long")).otherwise(F.array_position("_d", F.col("dose")) - 1)
    return d.withColumns({"di": di, "ti": F.array_position("_t", F.col("tp")) - 1}).drop("_d", "_t")


def _json(kind: str, *fields) -> list:
    return [F.lit(kind).alias("kind"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("payload")]


def report_payload(cond: DataFrame, points: DataFrame, shares: DataFrame, stages: Sequence[str], qc: DataFrame,
                   gaps: DataFrame, images: DataFrame, size: DataFrame | None = None, alpha: float = 0.0) -> DataFrame:
    """JSON lines (kind, payload) of a report; not measured is null.

    cond: a row per condition and timepoint, with the n and pct of every stage in `stages` (0 where it has none). rep: a
    flat row per replicate, in the unit its condition uses. qc: plate-based quality. size (where sizes are given: tp,
    condition, n, p25, p50, p75 and, if it is there, y, the density over the log grid): a row per condition. gap: a missing
    condition and timepoint. meta: one row of totals and label lists; images is the list of all images, errors among them.
    """
    r = report_rows(cond)
    index = r.select("tp", "condition", "strain", "di", "ti")
    held = shares.where(F.col("stage").isin(list(stages))).groupBy("tp", "condition").agg(
        F.map_from_entries(F.collect_list(F.struct("stage", F.struct("n", "pct")))).alias("_m"))       # a row per stage

    def per_stage(field, none, digits=None):
        def one(s):
            v = F.coalesce(F.try_element_at("_m", F.lit(s))[field], none)
            return (v if digits is None else rnd(v, digits)).alias(s)

        return F.struct(*[one(s) for s in stages])

    nothing = F.when(F.col("pooled_total") > 0, F.lit(0.0))
    c = r.join(held, ["tp", "condition"], "left").select(*_json(
        "cond", "condition", "strain", "di", "ti", "n_plates", "n_images", "replicate_unit", "n_replicates",
        rnd("stage_index_mean", 4).alias("si_mean"), rnd("stage_index_sd", 4).alias("si_sd"), "pooled_total",
        per_stage("n", F.lit(0)).alias("n"), per_stage("pct", nothing, 3).alias("pct")))
    p = points.select("tp", "condition", "stage_index", "total").join(index, ["tp", "condition"]).select(*_json(
        "rep", "strain", "di", "ti", rnd("stage_index", 4).alias("stage_index"), "total"))
    q = qc.drop("strain").join(index, ["tp", "condition"]).select(*_json(
        "qc", "strain", "di", "ti", "n_plates", "n_animals_total",
        *(rnd(f"animals_per_plate_{k}", 2).alias(f"animals_per_plate_{k}") for k in ("mean", "sd")), "animals_per_plate_min", "animals_per_plate_max",
        *(rnd(k, 2).alias(k) for k in ("pct_of_control", "quadrant_cv_pct_mean", "quadrant_cv_pct_max")), "n_image_errors"))
    g = gaps.select(*_json("gap", "condition", "tp"))
    out = c.unionByName(p).unionByName(q).unionByName(g)
    if size is not None:
        y = [F.transform("y", lambda v: rnd(v, 4)).alias("y")] if "y" in size.columns else []
        out = out.unionByName(size.join(index, ["tp", "condition"]).select(*_json(
            "size", "condition", "di", "ti", "n", *(rnd(k, 1).alias(k) for k in ("p25", "p50", "p75")), *y)))
    lists = {"strains": "strain", "doses": "dose", "tps": "tp"}                                        # labels, not rows
    total = cond.agg(
        *(F.array_sort(F.collect_set(v)).alias(k) for k, v in lists.items()), F.bool_or(F.col("dose").isNull()).alias("_open"),
        F.max(F.when(F.col("unit") != "", F.col("unit"))).alias("unit"),
        F.array_sort(F.collect_set("replicate_unit")).alias("replicate_units"),
        F.coalesce(F.sum("pooled_total"), F.lit(0)).alias("n_detections"), F.coalesce(F.sum("n_plates"), F.lit(0)).alias("n_plates"),
        F.coalesce(F.sum("n_images"), F.lit(0)).alias("n_images"))
    errors = images.agg(F.count_if("has_error").alias("n_errors"))
    m = total.withColumns({
        "n_errors": errors.scalar(), "alpha": F.lit(float(alpha)), "stages": F.array(*[F.lit(s) for s in stages]),
        # the wild type comes first
        "strains": F.concat(F.filter("strains", lambda s: F.lower(s) == "n2"), F.filter("strains", lambda s: F.lower(s) != "n2")),
        "doses": F.when(F.col("_open"), F.concat("doses", F.array(F.lit(None).cast("bigint")))).otherwise(F.col("doses"))})
    return out.unionByName(m.select(*_json(
        "meta", "strains", "doses", "tps", "stages", "unit", "replicate_units", "n_detections", "n_plates", "n_images", "n_errors", "alpha")))
