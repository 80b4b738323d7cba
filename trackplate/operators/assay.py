"""Plate, condition and timepoint roll-ups with quality control."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import null_safe_eq, written
from ..functions import parse as P
from .ranking import value_ranks

PLATE = ("tp", "condition", "plate")
COND = ("tp", "condition")
_SUMS = ["n_survivors", "n_non_survivors", "n_excluded", "unmapped", "n_staged", "_si"]


def survivor_pct(surv: Column, non: Column) -> Column:
    return F.try_divide(surv * 100.0, (surv + non).cast("double"))


def tally(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: animals per category, staged animals and the sum of index * n."""
    cat, n, idx = P.stage_category(F.col("stage")), F.col("n"), P.stage_index(F.col("stage"))

    def total(c):
        return F.coalesce(F.sum(F.when(c, n)), F.lit(0)).cast("long")

    return counts.groupBy(*keys).agg(
        total(cat == "survivor").alias("n_survivors"), total(cat == "non_survivor").alias("n_non_survivors"),
        total(cat == "excluded").alias("n_excluded"), total(cat == "unmapped").alias("unmapped"),
        total(idx.isNotNull()).alias("n_staged"), F.coalesce(F.sum(idx * n), F.lit(0.0)).alias("_si"))


def _derived(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "total": F.col("n_survivors") + F.col("n_non_survivors") + F.col("n_excluded") + F.col("unmapped"),
        "stage_index": F.try_divide(F.col("_si"), F.col("n_staged").cast("double")),
        "survival_pct": survivor_pct(F.col("n_survivors"), F.col("n_non_survivors"))})


def per_image(images: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per analysed image; an image without animals counts 0, an errored one is absent."""
    t = tally(counts, ["image_id"])
    d = images.where(~F.col("has_error")).join(t, "image_id", "left")
    return _derived(d.withColumns({c: F.coalesce(c, F.lit(0)) for c in _SUMS[:-1]} | {"_si": F.coalesce("_si", F.lit(0.0))}))


def per_plate(img: DataFrame) -> DataFrame:
    g = img.groupBy(*PLATE).agg(*[F.sum(c).alias(c) for c in _SUMS], F.count(F.lit(1)).alias("n_images"))
    return _derived(g)


def _replicates(df: DataFrame, prefix: str) -> DataFrame:
    """Mean and sample SD over replicates (SD NULL for a single one)."""
    aggs = [F.count(F.lit(1)).alias(f"{prefix}n")]
    for c in ("stage_index", "total", "survival_pct"):
        aggs += [F.avg(c).alias(f"{prefix}{c}_m"), F.stddev_samp(c).alias(f"{prefix}{c}_s")]
    return df.groupBy(*COND).agg(*aggs)


def per_condition(img: DataFrame, plates: DataFrame) -> DataFrame:
    """Condition x timepoint rows; replicates are plates if several, else images."""
    p, i = _replicates(plates, "p_"), _replicates(img, "i_")
    pooled = _derived(plates.groupBy(*COND).agg(*[F.sum(c).alias(c) for c in _SUMS]))
    d = p.join(i, list(COND)).join(pooled, list(COND))
    many = F.col("p_n") > 1

    def pick(c):
        return F.when(many, F.col(f"p_{c}")).otherwise(F.col(f"i_{c}"))

    return d.select(
        *COND, F.col("p_n").alias("n_plates"), F.col("i_n").alias("n_images"),
        F.when(many, "plate").otherwise("quadrant image").alias("replicate_unit"), pick("n").alias("n_replicates"),
        pick("stage_index_m").alias("stage_index_mean"), pick("stage_index_s").alias("stage_index_sd"),
        pick("total_m").alias("n_animals_mean"), pick("total_s").alias("n_animals_sd"),
        F.col("unmapped"), F.col("total").alias("pooled_total"), F.col("n_staged").alias("pooled_staged"),
        F.col("stage_index").alias("pooled_stage_index"), pick("survival_pct_m").alias("survival_pct_mean"),
        pick("survival_pct_s").alias("survival_pct_sd"), F.col("survival_pct").alias("pooled_survival_pct"))


def replicate_points(img: DataFrame, plates: DataFrame, cond: DataFrame) -> DataFrame:
    """Replicate rows in the unit each condition uses, with its mean and SD (NULL SD draws 0)."""
    c = cond.select(*COND, "replicate_unit", "stage_index_mean", F.coalesce("stage_index_sd", F.lit(0.0)).alias("stage_index_bar"))
    p = plates.select(*COND, F.col("plate").alias("unit_id"), "stage_index", "total").join(c.where("replicate_unit = 'plate'"), list(COND))
    i = img.select(*COND, F.col("image").alias("unit_id"), "stage_index", "total").join(c.where("replicate_unit <> 'plate'"), list(COND))
    return p.unionByName(i)


def composition(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of each stage in percent of all animals of the key (NULL for none)."""
    g = counts.groupBy(*keys, "stage").agg(F.sum("n").alias("n"))
    total = g.groupBy(*keys).agg(F.sum("n").alias("_t"))
    return g.join(total, list(keys)).select(
        *keys, "stage", "n", F.try_divide(F.lit(100.0) * F.col("n"), F.col("_t").cast("double")).alias("pct"))


def control_values(cond: DataFrame, value: str) -> DataFrame:
    """Per (tp, strain): value of the lowest dose; unparsed doses are never a control."""
    return (cond.where(F.col("dose").isNotNull()).groupBy("tp", "strain")
            .agg(F.min_by(value, F.struct("dose", "condition")).alias("control")))


def with_parts(df: DataFrame) -> DataFrame:
    p = P.parse_condition(F.col("condition"))
    return df.withColumns({"strain": p["strain"], "dose": p["dose"], "unit": p["unit"]})


def pct_of_control(df: DataFrame, value: str) -> DataFrame:
    """Add control and pct_of_control = 100 * value / control of the same strain and timepoint."""
    d = with_parts(df)
    c = control_values(d, value)
    j = d.join(c, ["tp", "strain"], "left")
    return j.withColumn("pct_of_control", F.try_divide(F.lit(100.0) * F.col(value), F.col("control").cast("double")))


def qc(images: DataFrame, img: DataFrame, plates: DataFrame) -> DataFrame:
    """Plate-based quality rows per condition and timepoint."""
    spread = img.groupBy(*PLATE).agg(F.count(F.lit(1)).alias("_n"), F.avg("total").alias("_m"), F.stddev_samp("total").alias("_s"))
    cv = F.when((F.col("_n") >= 2) & (F.col("_m") != 0), F.lit(100.0) * F.try_divide(F.col("_s"), F.col("_m")))
    worst = spread.groupBy(*COND).agg(F.avg(cv).alias("quadrant_cv_pct_mean"), F.max(cv).alias("quadrant_cv_pct_max"))
    g = plates.groupBy(*COND).agg(
        F.count(F.lit(1)).alias("n_plates"), F.sum("n_images").alias("n_images"), F.sum("total").alias("n_animals_total"),
        F.avg("total").alias("animals_per_plate_mean"), F.stddev_samp("total").alias("animals_per_plate_sd"),
        F.min("total").alias("animals_per_plate_min"), F.max("total").alias("animals_per_plate_max"))
    err = images.where("has_error").groupBy(*COND).agg(F.count(F.lit(1)).alias("_e"))
    d = pct_of_control(g, "animals_per_plate_mean").join(worst, list(COND)).join(err, list(COND), "left")
    return d.withColumn("n_image_errors", F.coalesce("_e", F.lit(0))).drop("_e", "control")


def gaps(have: DataFrame, row: str = "condition", col: str = "tp") -> DataFrame:
    """(row, col) cells absent although both labels occur. Only labels are combined."""
    every = have.agg(F.collect_set(col).alias("a"))
    per = have.groupBy(row).agg(F.collect_set(col).alias("_have"))
    missing = F.array_except(every.scalar(), F.col("_have"))
    return per.select(row, F.explode(missing).alias(col))


def counts_with_zeros(images: DataFrame, counts: DataFrame, classes: Sequence[str], excluded: Sequence[str] = ()) -> DataFrame:
    """Every class for every image: 0 when absent, NULL when the class was not looked for."""
    skip = [e.strip().lower() for e in excluded]
    base = images.select("image_id", F.explode(F.array(*[F.lit(c) for c in classes])).alias("stage"))
    d = base.join(counts, ["image_id", "stage"], "left")
    off = F.lower(F.trim(F.col("stage"))).isin(skip) if skip else F.lit(False)
    return d.select("image_id", "stage", F.when(~off, F.coalesce("n", F.lit(0))).alias("n"))


# --- timepoints -----------------------------------------------------------------------

def folder_capture_time(names: DataFrame, folder: str = "folder_id", stem: str = "stem") -> DataFrame:
    """Upper median capture stamp, stamped and total counts per folder; names are parsed once."""
    d = names.select(folder, F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), P.capture_time(F.col(stem))).alias("_t"))
    d = written(d.groupBy(folder, "_t").agg(F.count(F.lit(1)).alias("_c")), "stamps")
    n = d.groupBy(folder).agg(F.sum("_c").alias("n_images"), F.sum(F.when(F.col("_t").isNotNull(), F.col("_c")).otherwise(0)).alias("n_stamped"))
    r, at = value_ranks(d, [folder], "_t", "_c"), F.floor(F.col("rank_n") / 2)
    mid = r.where((F.col("rank_from") <= at) & (at < F.col("rank_from") + F.col("c"))).select(folder, F.col("v").alias("capture_s"))
    return n.join(mid, folder, "left")


def resolve_timepoints(folders: DataFrame, folder: str = "folder_id") -> DataFrame:
    """Hours per folder from typed text or capture time: (folder, hours, method, error).

    `folders` has `typed` text and `capture_s`. One row per folder, so the run-wide
    numbers are scalar subqueries.
    """
    text = F.trim(F.coalesce("typed", F.lit("")))
    number = F.regexp_replace(text, ",", ".").try_cast("double")
    d = folders.withColumns({
        "_h": F.when(text != "", number), "_typed": (text != "") & number.isNotNull(),
        "_todo": text == "", "_bad": (text != "") & number.isNull()})
    base = d.agg(F.min("capture_s").alias("b"))
    raw = (F.col("capture_s") - base.scalar()) / 3600.0
    d = d.withColumn("_raw", raw)
    anchor = F.col("_typed") & F.col("capture_s").isNotNull()
    run = d.agg(F.struct(
        F.count(F.lit(1)).alias("n"), F.count("capture_s").alias("stamped"), F.max(F.col("_typed").cast("int")).alias("typed"),
        F.sum(anchor.cast("int")).alias("anchors"), F.avg(F.when(anchor, F.col("_h") - F.col("_raw"))).alias("offset")).alias("s"))
    d = d.withColumn("_s", run.scalar())
    alone = (F.col("_s.n") == 1) & F.col("_todo")
    no_anchor = (F.col("_s.typed") == 1) & (F.col("_s.anchors") == 0)
    error = (F.when(F.col("_bad"), "not a number").when(~F.col("_todo") | alone, F.lit(None))
             .when(F.col("_s.stamped") == 0, "no stamp").when(no_anchor, "no anchor")
             .when(F.col("capture_s").isNull(), "no stamp"))
    hours = (F.when(F.col("_typed"), F.col("_h")).when(alone, F.lit(0.0))
             .when(error.isNull(), F.bround(F.col("_raw") + F.coalesce("_s.offset", F.lit(0.0)), 1)))
    method = F.when(F.col("_typed"), "typed").when(alone, "single folder").when(error.isNull(), "filenames").otherwise("")
    return d.select(folder, hours.alias("hours"), method.alias("method"), error.alias("error"))


def grouping_mode(names: DataFrame, folder: str = "folder_id", stem: str = "stem", share: float = 0.80) -> DataFrame:
    """'filename' when at least 80% of the stems carry a dose and a plate token."""
    ok = P.parse_tokens(F.col(stem)).isNotNull().cast("double")
    return names.groupBy(folder).agg(F.avg(ok).alias("encoded_fraction")).select(
        folder, "encoded_fraction", F.when(F.col("encoded_fraction") >= share, "filename").otherwise("directory").alias("mode"))


def dominant(df: DataFrame, keys: Sequence[str], value: str, default: str) -> DataFrame:
    """Most common value per key (ties: smallest), `default` when there is none."""
    c = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    top = c.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_c"), F.col(value))).alias("_v"))
    return df.select(*keys).distinct().join(top, list(keys), "left").select(*keys, F.coalesce("_v", F.lit(default)).alias(value))


def plate_pick(files: DataFrame, cond: Sequence[str], plate_dir: str = "plate_dir", name: str = "name", path: str = "path") -> DataFrame:
    """Per condition: first file of the highest-numbered plate folder, else a direct file."""
    digits = F.regexp_extract(plate_dir, r"(\d+)", 1)
    num = F.when(F.lower(plate_dir).startswith("plate"), F.coalesce(digits.try_cast("long"), F.lit(-1)))
    d = files.withColumns({"_num": num}).where(F.col("_num").isNotNull() | F.col(plate_dir).isNull())
    return d.groupBy(*cond).agg(F.min_by(path, F.struct(
        F.col("_num").isNull(), -F.coalesce("_num", F.lit(0)), F.col(plate_dir), F.col(name))).alias(path))


def order_rows(df: DataFrame, *extra: str) -> DataFrame:
    """Canonical report order; only for a sink."""
    cols = [F.asc("tp"), F.asc("strain"), F.asc_nulls_last("dose"), F.asc("condition")]
    return df.orderBy(*cols, *[F.asc(c) for c in extra])


def reconcile(got: DataFrame, want: DataFrame, key: str = "cell", tol: float = 5e-6) -> DataFrame:
    """Verdict per expected cell: ok, missing, unexpected, wrong."""
    j = want.withColumn("_w", F.lit(True)).join(got.withColumn("_g", F.lit(True)), key, "left")
    off = F.abs(F.col("got") - F.col("want")) > F.lit(tol) * F.greatest(F.lit(1.0), F.abs("want"))
    verdict = (F.when(F.col("want").isNull(), F.when(F.col("got").isNull(), "ok").otherwise("unexpected"))
               .when(F.col("got").isNull(), "missing").when(off, "wrong").otherwise("ok"))
    return j.select(key, verdict.alias("verdict"))


def completeness(plates: DataFrame, captured: DataFrame, quadrant_mode: Column) -> DataFrame:
    """Expected shots per plate minus captured ones: (plate_id, quadrant); NULL = one plain shot."""
    quads = F.array(*[F.lit(q) for q in ("NE", "NW", "SE", "SW")])
    want = plates.withColumn("quadrant", F.explode(F.when(quadrant_mode, quads).otherwise(F.array(F.lit(None).cast("string")))))
    seen = captured.select("plate_id", "quadrant").distinct()
    return want.join(seen, null_safe_eq(want, seen, ["plate_id", "quadrant"]), "left_anti")


# --- colonies ---------------------------------------------------------------------------

def colony_gate(colonies: DataFrame, min_diameter_um: float, min_solidity: float) -> DataFrame:
    """Add `reason`: border, area, solidity (in that order) or NULL; area floor in px."""
    d = F.coalesce(F.lit(min_diameter_um) / F.when(F.col("um_per_px") > 0, F.col("um_per_px")), F.lit(min_diameter_um))
    least = F.acos(F.lit(-1.0)) * F.pow(d / 2.0, F.lit(2))
    return colonies.withColumn("reason", F.when(F.col("touches_border"), "border").when(F.col("area_px") < least, "area")
                               .when(F.col("solidity") < min_solidity, "solidity"))


def colony_plates(colonies: DataFrame, confluent_at: float = 0.55) -> DataFrame:
    """Plate rows from gated colonies; plates without a kept colony keep a count of 0."""
    area = F.when(F.col("reason").isNull(), F.col("area_px") * F.pow(F.col("um_per_px") / 1000.0, F.lit(2)))
    return colonies.groupBy("condition", "plate").agg(
        F.count(F.when(F.col("reason").isNull(), 1)).alias("colony_count"), F.avg(area).alias("mean_area_mm2"),
        F.sum(area).alias("total_colony_area_mm2"), F.max("stained_fraction").alias("stained_fraction")).withColumn(
        "confluent", F.col("stained_fraction") > confluent_at)


def colony_conditions(plates: DataFrame) -> DataFrame:
    """Condition means; sample SD, 0.0 for a single plate."""
    def sd(c):
        return F.when(F.count(F.lit(1)) > 1, F.stddev_samp(c)).otherwise(F.lit(0.0))

    return plates.groupBy("condition").agg(
        F.count(F.lit(1)).alias("n_plates"), F.avg("colony_count").alias("colony_count_mean"), sd("colony_count").alias("colony_count_sd"),
        F.avg("mean_area_mm2").alias("mean_area_mm2"), F.avg("stained_fraction").alias("stained_fraction_mean"),
        sd("stained_fraction").alias("stained_fraction_sd"), F.sum(F.col("confluent").cast("long")).alias("n_confluent_plates"))


def debris_rule(displacement: Column, bpm: Column, length_cv: Column, solidity: Column, speed: Column) -> Column:
    """rule1: nearly still; rule2: flickery blob (all three shape metrics known); NULL keeps."""
    r2 = F.coalesce((length_cv > 0.10) & (solidity > 0.6) & (speed < 10.0), F.lit(False))
    return F.when((displacement < 8.0) & (bpm < 5.0), "rule1").when(r2, "rule2")
