"""Plate, condition and timepoint reports; colonies; size distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..core import rnd
from ..functions import parse as P
from ..operators import assay as S
from ..operators import sizes as Z
from .parse_queries import _TIME, _TOK, _cond_sql
from .registry import query
from .views import sql


def _r(df, names, digits=6):
    return df.withColumns({n: rnd(n, digits) for n in names})


_CAT = """CASE WHEN lower(stage) IN ('l3', 'l4', 'young adult', 'adult') THEN 's' WHEN lower(stage) IN ('l1', 'l2') THEN 'n' WHEN lower(stage) = 'egg' THEN 'e' ELSE 'u' END"""
_IDX = "CASE lower(stage) WHEN 'l1' THEN 1.0::DOUBLE WHEN 'l2' THEN 2 WHEN 'l3' THEN 3 WHEN 'l4' THEN 4 WHEN 'young adult' THEN 4.5 WHEN 'adult' THEN 5 END"
_DERIVED = """surv + non + exc + unm AS total, si / nullif(staged, 0) AS stage_index, surv * 100.0::DOUBLE / nullif(surv + non, 0) AS survival_pct"""
_IMG = f"""
tl AS (SELECT image_id, coalesce(sum(n) FILTER ({_CAT} = 's'), 0)::BIGINT AS surv, coalesce(sum(n) FILTER ({_CAT} = 'n'), 0)::BIGINT AS non,
    coalesce(sum(n) FILTER ({_CAT} = 'e'), 0)::BIGINT AS exc, coalesce(sum(n) FILTER ({_CAT} = 'u'), 0)::BIGINT AS unm,
    coalesce(sum(n) FILTER ({_IDX} IS NOT NULL), 0)::BIGINT AS staged, coalesce(sum({_IDX} * n), 0) AS si FROM v_stage_counts GROUP BY 1),
i0 AS (SELECT i.* EXCLUDE (has_error), coalesce(surv, 0) AS surv, coalesce(non, 0) AS non, coalesce(exc, 0) AS exc, coalesce(unm, 0) AS unm,
    coalesce(staged, 0) AS staged, coalesce(si, 0) AS si FROM v_images i LEFT JOIN tl USING (image_id) WHERE NOT has_error),
im AS (SELECT *, {_DERIVED} FROM i0),
p0 AS (SELECT tp, condition, plate, sum(surv)::BIGINT AS surv, sum(non)::BIGINT AS non, sum(exc)::BIGINT AS exc, sum(unm)::BIGINT AS unm, sum(staged)::BIGINT AS staged,
    sum(si) AS si, count(*) AS n_images FROM im GROUP BY 1, 2, 3),
pl AS (SELECT *, {_DERIVED} FROM p0)"""


def _img(spark, sf):
    return S.per_image(A.images(spark, sf), A.stage_counts(spark, sf))


_IMGCOLS = ["image_id", "condition", "tp", "plate", "unmapped", "total", "n_staged", "n_survivors", "n_non_survivors"]


@query("image_tally", "A13 A14 A15", sql("v_images v_stage_counts", _IMG + """
SELECT image_id, condition, tp, plate, unm AS unmapped, total, staged AS n_staged, surv AS n_survivors, non AS n_non_survivors,
  round(stage_index, 6) AS stage_index, round(survival_pct, 6) AS survival_pct FROM im"""))
def image_tally(spark, sf):
    return _img(spark, sf).select(*_IMGCOLS, rnd("stage_index").alias("stage_index"), rnd("survival_pct").alias("survival_pct"))


@query("stage_index", "A14", sql("v_images v_stage_counts", _IMG + """
SELECT tp, condition, sum(staged)::BIGINT AS n_staged, round(sum(si) / nullif(sum(staged), 0), 6) AS stage_index FROM im GROUP BY 1, 2"""))
def stage_index(spark, sf):
    g = _img(spark, sf).groupBy("tp", "condition").agg(F.sum("n_staged").alias("n_staged"), F.sum("_si").alias("si"))
    return g.select("tp", "condition", "n_staged", rnd(F.try_divide(F.col("si"), F.col("n_staged").cast("double"))).alias("stage_index"))


@query("survivor_ratio", "A15", sql("v_images v_stage_counts", _IMG + """
SELECT plate, tp, round(sum(surv) * 100.0::DOUBLE / nullif(sum(surv) + sum(non), 0), 6) AS survival_pct FROM im GROUP BY 1, 2"""))
def survivor_ratio(spark, sf):
    g = _img(spark, sf).groupBy("plate", "tp").agg(F.sum("n_survivors").alias("s"), F.sum("n_non_survivors").alias("n"))
    return g.select("plate", "tp", rnd(S.survivor_pct(F.col("s"), F.col("n"))).alias("survival_pct"))


@query("plate_rollup", "A16", sql("v_images v_stage_counts", _IMG + """
SELECT tp, condition, plate, n_images, total, staged AS n_staged, round(stage_index, 6) AS stage_index, round(survival_pct, 6) AS survival_pct FROM pl"""))
def plate_rollup(spark, sf):
    return S.per_plate(_img(spark, sf)).select("tp", "condition", "plate", "n_images", "total", "n_staged",
                                               rnd("stage_index").alias("stage_index"), rnd("survival_pct").alias("survival_pct"))


_COND = _IMG + """,
ra AS (SELECT tp, condition, count(*) AS n, avg(stage_index) AS a, stddev_samp(stage_index) AS b, avg(total) AS c, stddev_samp(total) AS d, avg(survival_pct) AS e, stddev_samp(survival_pct) AS f,
    sum(unm)::BIGINT AS unm, sum(total)::BIGINT AS total, sum(staged)::BIGINT AS staged, sum(si) / nullif(sum(staged), 0) AS psi, sum(surv) * 100.0::DOUBLE / nullif(sum(surv) + sum(non), 0) AS psv FROM pl GROUP BY 1, 2),
rb AS (SELECT tp, condition, count(*) AS n, avg(stage_index) AS a, stddev_samp(stage_index) AS b, avg(total) AS c, stddev_samp(total) AS d, avg(survival_pct) AS e, stddev_samp(survival_pct) AS f FROM im GROUP BY 1, 2),
co AS (SELECT tp, condition, ra.n AS n_plates, rb.n AS n_images, CASE WHEN ra.n > 1 THEN 'plate' ELSE 'quadrant image' END AS replicate_unit,
    CASE WHEN ra.n > 1 THEN ra.n ELSE rb.n END AS n_replicates, CASE WHEN ra.n > 1 THEN ra.a ELSE rb.a END AS stage_index_mean, CASE WHEN ra.n > 1 THEN ra.b ELSE rb.b END AS stage_index_sd,
    CASE WHEN ra.n > 1 THEN ra.c ELSE rb.c END AS n_animals_mean, CASE WHEN ra.n > 1 THEN ra.d ELSE rb.d END AS n_animals_sd, unm AS unmapped, total AS pooled_total, staged AS pooled_staged,
    psi AS pooled_stage_index, CASE WHEN ra.n > 1 THEN ra.e ELSE rb.e END AS survival_pct_mean, CASE WHEN ra.n > 1 THEN ra.f ELSE rb.f END AS survival_pct_sd, psv AS pooled_survival_pct
  FROM ra JOIN rb USING (tp, condition))"""
_CNUM = ["stage_index_mean", "stage_index_sd", "n_animals_mean", "n_animals_sd", "pooled_stage_index", "survival_pct_mean", "survival_pct_sd", "pooled_survival_pct"]


def _cond(spark, sf):
    img = _img(spark, sf)
    return S.per_condition(img, S.per_plate(img))


@query("condition_rollup", "A16", sql("v_images v_stage_counts", _COND + """
SELECT tp, condition, n_plates, n_images, replicate_unit, n_replicates, unmapped, pooled_total, pooled_staged, """ + ", ".join(f"round({c}, 6) AS {c}" for c in _CNUM) + " FROM co"))
def condition_rollup(spark, sf):
    return _r(_cond(spark, sf), _CNUM)


@query("ordered_report", "O1 V3", sql("v_images v_stage_counts", _COND + f""",
k AS (SELECT tp, condition, {_cond_sql('condition')}, replicate_unit, stage_index_mean FROM co)
SELECT CAST(row_number() OVER (ORDER BY tp, strain, dose NULLS LAST, condition) AS INT) AS pos, tp, condition, dose FROM k"""))
def ordered_report(spark, sf):
    return _numbered(S.with_parts(_cond(spark, sf)))


def _numbered(d):
    from pyspark.sql import Window
    w = Window.partitionBy("tp").orderBy("strain", F.asc_nulls_last("dose"), "condition")
    before = d.groupBy("tp").agg(F.count(F.lit(1)).alias("n"))
    prior = before.select(F.array_sort(F.collect_list(F.struct("tp", "n"))).alias("a"))
    d = d.withColumn("_p", prior.scalar())
    skip = F.aggregate(F.filter("_p", lambda e: e["tp"] < F.col("tp")), F.lit(0).cast("long"), lambda s, e: s + e["n"])
    return d.withColumn("pos", (skip + F.row_number().over(w)).cast("int")).select("pos", "tp", "condition", "dose")


@query("composition", "V4", sql("v_images v_stage_counts", """
g AS (SELECT tp, condition, stage, sum(n)::BIGINT AS n FROM v_stage_counts JOIN v_images USING (image_id) WHERE NOT has_error GROUP BY 1, 2, 3)
SELECT tp, condition, stage, n, round(100.0::DOUBLE * n / nullif(sum(n) OVER (PARTITION BY tp, condition), 0), 6) AS pct FROM g"""))
def composition(spark, sf):
    c = A.stage_counts(spark, sf).join(A.images(spark, sf).where(~F.col("has_error")), "image_id")
    return _r(S.composition(c, ["tp", "condition"]), ["pct"])


_QC = _IMG + f""",
g AS (SELECT tp, condition, count(*) AS n_plates, sum(n_images)::BIGINT AS n_images, sum(total)::BIGINT AS n_animals_total, avg(total) AS m, stddev_samp(total) AS s, min(total) AS lo, max(total) AS hi FROM pl GROUP BY 1, 2),
k AS (SELECT g.*, {_cond_sql('condition')} FROM g),
ct AS (SELECT tp, strain, arg_min(m, (dose, condition)) AS control FROM k WHERE dose IS NOT NULL GROUP BY 1, 2),
cv AS (SELECT tp, condition, plate, CASE WHEN count(*) >= 2 AND avg(total) <> 0 THEN 100 * stddev_samp(total) / avg(total) END AS cv FROM im GROUP BY 1, 2, 3),
cw AS (SELECT tp, condition, avg(cv) AS cm, max(cv) AS cx FROM cv GROUP BY 1, 2),
er AS (SELECT tp, condition, count(*) AS e FROM v_images WHERE has_error GROUP BY 1, 2)"""


@query("qc", "A17", sql("v_images v_stage_counts", _QC + """
SELECT tp, condition, strain, dose, unit, n_plates, n_images, n_animals_total, round(m, 6) AS animals_per_plate_mean, round(s, 6) AS animals_per_plate_sd, lo AS animals_per_plate_min,
  hi AS animals_per_plate_max, round(100 * m / nullif(control, 0), 6) AS pct_of_control, round(cm, 6) AS quadrant_cv_pct_mean, round(cx, 6) AS quadrant_cv_pct_max, coalesce(e, 0) AS n_image_errors
FROM k LEFT JOIN ct USING (tp, strain) LEFT JOIN cw USING (tp, condition) LEFT JOIN er USING (tp, condition)"""))
def qc(spark, sf):
    i = A.images(spark, sf)
    img = S.per_image(i, A.stage_counts(spark, sf))
    return _r(S.qc(i, img, S.per_plate(img)), ["animals_per_plate_mean", "animals_per_plate_sd", "pct_of_control", "quadrant_cv_pct_mean", "quadrant_cv_pct_max"])


@query("pct_of_control", "J8", sql("v_images v_stage_counts", _QC + """
SELECT tp, condition, round(control, 6) AS control, round(100 * m / nullif(control, 0), 6) AS pct_of_control FROM k LEFT JOIN ct USING (tp, strain)"""))
def pct_of_control(spark, sf):
    g = S.per_plate(_img(spark, sf)).groupBy("tp", "condition").agg(F.avg("total").alias("m"))
    return _r(S.pct_of_control(g, "m").select("tp", "condition", "control", "pct_of_control"), ["control", "pct_of_control"])


@query("gaps", "J11", sql("v_images", """
SELECT c.condition, t.tp FROM (SELECT DISTINCT condition FROM v_images) c CROSS JOIN (SELECT DISTINCT tp FROM v_images) t
WHERE NOT EXISTS (SELECT 1 FROM v_images i WHERE i.condition = c.condition AND i.tp = t.tp)"""))
def gaps(spark, sf):
    return S.gaps(A.images(spark, sf))


@query("dose_response", "V3", sql("v_images v_stage_counts", _COND + """
SELECT pl.tp, pl.condition, pl.plate AS unit_id, round(stage_index, 6) AS stage_index, pl.total, round(stage_index_mean, 6) AS stage_index_mean, round(coalesce(stage_index_sd, 0), 6) AS stage_index_bar
FROM pl JOIN co USING (tp, condition) WHERE replicate_unit = 'plate'
UNION ALL SELECT im.tp, im.condition, im.image, round(stage_index, 6), im.total, round(stage_index_mean, 6), round(coalesce(stage_index_sd, 0), 6) FROM im JOIN co USING (tp, condition) WHERE replicate_unit <> 'plate'"""))
def dose_response(spark, sf):
    img = _img(spark, sf)
    plates = S.per_plate(img)
    d = S.replicate_points(img, plates, S.per_condition(img, plates)).drop("replicate_unit")
    return _r(d, ["stage_index", "stage_index_mean", "stage_index_bar"])


@query("counts_with_zeros", "S10", sql("v_images v_stage_counts", """
SELECT i.image_id, c.stage, CASE WHEN c.stage <> 'egg' THEN coalesce(n, 0) END AS n FROM v_images i CROSS JOIN (SELECT unnest(['egg','L1','L2','L3','L4','adult']) AS stage) c
LEFT JOIN v_stage_counts s ON s.image_id = i.image_id AND s.stage = c.stage"""))
def counts_with_zeros(spark, sf):
    return S.counts_with_zeros(A.images(spark, sf), A.stage_counts(spark, sf), A.CLASSES, ["Egg "])


_FOLD = f"""
ft AS (SELECT folder_id, epoch({_TIME})::BIGINT AS t FROM v_paths),
fn AS (SELECT folder_id, count(*) AS n_images, count(t) AS n_stamped FROM ft GROUP BY 1),
fr AS (SELECT *, row_number() OVER (PARTITION BY folder_id ORDER BY t) AS rn, count(*) OVER (PARTITION BY folder_id) AS n FROM ft WHERE t IS NOT NULL),
fm AS (SELECT folder_id, t AS capture_s FROM fr WHERE rn = n // 2 + 1)"""


@query("folder_capture_time", "A35", sql("v_paths", _FOLD + """
SELECT folder_id, n_images, n_stamped, capture_s FROM fn LEFT JOIN fm USING (folder_id)"""))
def folder_capture_time(spark, sf):
    return S.folder_capture_time(A.image_paths(spark, sf))


@query("timepoints", "V1", sql("v_paths", _FOLD + """,
ty AS (SELECT fn.*, capture_s, CASE folder_id WHEN 0 THEN '24,5' WHEN 1 THEN 'soon' WHEN 2 THEN ' 6 ' ELSE '' END AS typed FROM fn LEFT JOIN fm USING (folder_id)),
nu AS (SELECT *, TRY_CAST(replace(trim(typed), ',', '.') AS DOUBLE) AS h, (capture_s - (SELECT min(capture_s) FROM fm)) / 3600.0::DOUBLE AS raw FROM ty),
of AS (SELECT avg(h - raw) AS o FROM nu WHERE trim(typed) <> '' AND h IS NOT NULL AND capture_s IS NOT NULL)
SELECT folder_id, CASE WHEN h IS NOT NULL AND trim(typed) <> '' THEN h WHEN trim(typed) = '' THEN round_even(raw + (SELECT o FROM of), 1) END AS hours,
  CASE WHEN trim(typed) = '' THEN 'filenames' WHEN h IS NOT NULL THEN 'typed' ELSE '' END AS method, CASE WHEN trim(typed) <> '' AND h IS NULL THEN 'not a number' END AS error FROM nu"""))
def timepoints(spark, sf):
    typed = F.when(F.col("folder_id") == 0, "24,5").when(F.col("folder_id") == 1, "soon").when(F.col("folder_id") == 2, " 6 ").otherwise("")
    return S.resolve_timepoints(S.folder_capture_time(A.image_paths(spark, sf)).withColumn("typed", typed))


@query("grouping_mode", "A34", sql("v_paths", _TOK + """
SELECT f.folder_id, round(avg(CAST(tr.file_id IS NOT NULL AS DOUBLE)), 6) AS encoded_fraction, CASE WHEN avg(CAST(tr.file_id IS NOT NULL AS DOUBLE)) >= 0.6 THEN 'filename' ELSE 'directory' END AS mode
FROM v_paths f LEFT JOIN tr ON tr.file_id = f.file_id GROUP BY 1"""))
def grouping_mode(spark, sf):
    return _r(S.grouping_mode(A.image_paths(spark, sf), share=0.6), ["encoded_fraction"])


@query("dominant_unit", "A33", sql("v_paths", f"""
u AS (SELECT folder_id, {_cond_sql('label')} FROM v_paths),
c AS (SELECT folder_id, unit, count(*) AS n FROM u WHERE unit <> '' GROUP BY 1, 2)
SELECT folder_id, arg_min(unit, (-n, unit)) AS unit FROM c GROUP BY 1"""))
def dominant_unit(spark, sf):
    u = P.parse_condition(F.col("label"))["unit"]
    d = A.image_paths(spark, sf).select("folder_id", F.when(u != "", u).alias("unit"))
    return S.dominant(d, ["folder_id"], "unit", "J/m²")


_GRIDSRC = """
ci AS (SELECT folder_id, label, 'plate' || (file_id % 12) AS plate_dir, CASE WHEN file_id % 12 = 5 THEN NULL ELSE file_id % 12 END AS num, name, path FROM v_paths
  WHERE regexp_matches(lower(name), '\\.(tif|png)$')),
pk AS (SELECT folder_id, label, arg_min(path, (num IS NULL, -coalesce(num, 0), name)) AS path FROM ci GROUP BY 1, 2)"""


def _grid_files(spark, sf):
    i = F.col("file_id") % 12
    d = A.image_paths(spark, sf).where(F.lower("name").rlike(r"\.(tif|png)$"))
    return d.select("folder_id", "label", F.when(i != 5, F.concat(F.lit("plate"), i.cast("string"))).alias("plate_dir"), "name", "path")


@query("plate_pick", "W13", sql("v_paths", _GRIDSRC + "SELECT folder_id, label, path FROM pk"))
def plate_pick(spark, sf):
    return S.plate_pick(_grid_files(spark, sf), ["folder_id", "label"])


@query("strain_dose_grid", "V2", sql("v_paths", _GRIDSRC + f""",
k AS (SELECT folder_id, label, path, {_cond_sql('label')} FROM pk)
SELECT folder_id, strain, dose, arg_max(path, label) AS path FROM k WHERE dose IS NOT NULL GROUP BY 1, 2, 3"""))
def strain_dose_grid(spark, sf):
    pk = S.plate_pick(_grid_files(spark, sf), ["folder_id", "label"])
    c = P.parse_condition(F.col("label"))
    d = pk.withColumns({"strain": c["strain"], "dose": c["dose"]}).where(F.col("dose").isNotNull())
    return d.groupBy("folder_id", "strain", "dose").agg(F.max_by("path", "label").alias("path"))


@query("reconcile", "J14", sql("", """
WITH w AS (SELECT o_orderkey AS cell, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS want FROM orders),
g AS (SELECT o_orderkey AS cell, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 9 = 0 THEN o_totalprice * 1.00001 WHEN o_orderkey % 8 = 0 THEN o_totalprice * 1.000001 ELSE o_totalprice END AS got FROM orders WHERE o_orderkey % 11 <> 0)
SELECT w.cell, CASE WHEN want IS NULL THEN CASE WHEN got IS NULL THEN 'ok' ELSE 'unexpected' END WHEN got IS NULL THEN 'missing'
  WHEN abs(got - want) > 5e-6 * greatest(1, abs(want)) THEN 'wrong' ELSE 'ok' END AS verdict FROM w LEFT JOIN g USING (cell)"""))
def reconcile(spark, sf):
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    o = A.table(spark, sf, "orders")
    want = o.select(k.alias("cell"), F.when(k % 10 != 0, p).alias("want"))
    got = o.where(k % 11 != 0).select(k.alias("cell"), F.when(k % 7 == 0, None).when(k % 9 == 0, p * 1.00001).when(k % 8 == 0, p * 1.000001).otherwise(p).alias("got"))
    return S.reconcile(got, want)


@query("capture_completeness", "J15", sql("v_images", """
p AS (SELECT DISTINCT condition || '/' || plate || '/' || CAST(tp AS INT) || '/' || (image_id % 50) AS plate_id, condition <> 'BUILDING 0J' AS qm FROM v_images),
w AS (SELECT plate_id, unnest(CASE WHEN qm THEN ['NE', 'NW', 'SE', 'SW'] ELSE [NULL] END) AS quadrant FROM p),
c AS (SELECT DISTINCT condition || '/' || plate || '/' || CAST(tp AS INT) || '/' || (image_id % 50) AS plate_id, CASE WHEN condition <> 'BUILDING 0J' THEN regexp_extract(image, '_([NS][EW])\\.', 1) END AS quadrant FROM v_images WHERE NOT has_error)
SELECT w.plate_id, w.quadrant FROM w WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.plate_id = w.plate_id AND c.quadrant IS NOT DISTINCT FROM w.quadrant)"""))
def capture_completeness(spark, sf):
    i = A.images(spark, sf)
    pid = F.concat_ws("/", "condition", "plate", F.col("tp").cast("int").cast("string"), (F.col("image_id") % 50).cast("string"))
    qm = F.col("condition") != "BUILDING 0J"
    plates = i.select(pid.alias("plate_id"), qm.alias("qm")).distinct()
    seen = i.where(~F.col("has_error")).select(pid.alias("plate_id"), F.when(qm, F.regexp_extract("image", r"_([NS][EW])\.", 1)).alias("quadrant"))
    return S.completeness(plates, seen, F.col("qm")).select("plate_id", "quadrant")


# --- colonies -----------------------------------------------------------------------

_COL = """
c0 AS (SELECT l_returnflag || l_linestatus AS condition, 'p' || (l_suppkey % 10) AS plate, l_orderkey * 10 + l_linenumber AS label, l_quantity * 4 AS area_px, 1 - l_discount * 3 AS solidity,
  l_linenumber = 7 AS border, CASE WHEN l_suppkey % 4 <> 0 THEN 5.0::DOUBLE END AS um FROM lineitem),
st AS (SELECT l_returnflag || l_linestatus AS condition, 'p' || (l_suppkey % 10) AS plate, avg(l_tax) * 13.75 AS stained FROM lineitem GROUP BY 1, 2),
cg AS (SELECT *, CASE WHEN border THEN 'border' WHEN area_px < pi() * (coalesce(40 / um, 40) / 2) ** 2 THEN 'area' WHEN solidity < 0.8 THEN 'solidity' END AS reason FROM c0)"""


def _colonies(spark, sf):
    l = A.table(spark, sf, "lineitem")
    d = l.select(F.concat("l_returnflag", "l_linestatus").alias("condition"), F.concat(F.lit("p"), (F.col("l_suppkey") % 10).cast("string")).alias("plate"),
                 (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("label"), (F.col("l_quantity") * 4).alias("area_px"),
                 (F.lit(1) - F.col("l_discount") * 3).alias("solidity"), (F.col("l_linenumber") == 7).alias("touches_border"),
                 F.when(F.col("l_suppkey") % 4 != 0, F.lit(5.0)).alias("um_per_px"), "l_tax")
    stained = d.groupBy("condition", "plate").agg((F.avg("l_tax") * 13.75).alias("stained_fraction"))
    return S.colony_gate(d.drop("l_tax").join(stained, ["condition", "plate"]), 40.0, 0.8)


@query("colony_gate", "F4", "WITH " + _COL.strip() + "\nSELECT label, coalesce(reason, 'kept') AS reason FROM cg")
def colony_gate(spark, sf):
    return _colonies(spark, sf).select("label", F.coalesce("reason", F.lit("kept")).alias("reason"))


_CPL = _COL.strip() + """,
cp AS (SELECT condition, plate, count(*) FILTER (reason IS NULL) AS colony_count, avg(area_px * (um / 1000) ** 2) FILTER (reason IS NULL) AS mean_area_mm2,
  sum(area_px * (um / 1000) ** 2) FILTER (reason IS NULL) AS total_colony_area_mm2, any_value(stained) AS stained_fraction FROM cg JOIN st USING (condition, plate) GROUP BY 1, 2)"""


@query("colony_plates", "A21", "WITH " + _CPL + """
SELECT condition, plate, colony_count, round(mean_area_mm2, 8) AS mean_area_mm2, round(total_colony_area_mm2, 6) AS total_colony_area_mm2, round(stained_fraction, 6) AS stained_fraction,
  stained_fraction > 0.55 AS confluent FROM cp""")
def colony_plates(spark, sf):
    d = _r(S.colony_plates(_colonies(spark, sf)), ["total_colony_area_mm2", "stained_fraction"])
    return _r(d, ["mean_area_mm2"], 8)


@query("colony_conditions", "A21", "WITH " + _CPL + """
SELECT condition, count(*) AS n_plates, round(avg(colony_count), 6) AS colony_count_mean, round(CASE WHEN count(*) > 1 THEN stddev_samp(colony_count) ELSE 0 END, 6) AS colony_count_sd,
  round(avg(mean_area_mm2), 8) AS mean_area_mm2, round(avg(stained_fraction), 6) AS stained_fraction_mean, round(CASE WHEN count(*) > 1 THEN stddev_samp(stained_fraction) ELSE 0 END, 6) AS stained_fraction_sd,
  count(*) FILTER (stained_fraction > 0.55) AS n_confluent_plates FROM cp GROUP BY 1""")
def colony_conditions(spark, sf):
    d = _r(S.colony_conditions(S.colony_plates(_colonies(spark, sf))), ["colony_count_mean", "colony_count_sd", "stained_fraction_mean", "stained_fraction_sd"])
    return _r(d, ["mean_area_mm2"], 8)


# --- distributions ---------------------------------------------------------------------

@query("size_percentiles", "A18", sql("v_sizes", """
SELECT grp, count(*) AS n, round(avg(size_px), 2) AS mean, round(exp(avg(ln(size_px))), 2) AS gmean, """
       + ", ".join(f"round(quantile_cont(size_px, 0.{p}), 2) AS p{p}" for p in (10, 25, 50, 75, 90)) + " FROM v_sizes WHERE size_px > 0 GROUP BY 1"))
def size_percentiles(spark, sf):
    return _r(Z.size_summary(A.sizes(spark, sf), ["grp"], "size_px"), ["mean", "gmean", "p10", "p25", "p50", "p75", "p90"], 2)


_GRID = """
q AS (SELECT ln(greatest(quantile_cont(size_px, 0.002), 1)) AS lo, ln(quantile_cont(size_px, 0.998)) AS hi FROM v_sizes WHERE size_px > 0),
gd AS (SELECT lo - 0.18 * (hi - lo) AS g0, hi + 0.18 * (hi - lo) AS g1 FROM q)"""
_HIST = _GRID + """,
hb AS (SELECT grp, CAST(least(floor((ln(size_px) - g0) / ((g1 - g0) / 149)), 148) AS BIGINT) AS bin FROM v_sizes, gd WHERE size_px > 0 AND ln(size_px) BETWEEN g0 AND g1),
hc AS (SELECT grp, bin, count(*) AS n FROM hb GROUP BY 1, 2),
ha AS (SELECT g.grp, b.bin, coalesce(n, 0) AS n, exp(g0 + b.bin * (g1 - g0) / 149) AS lo, exp(g0 + (b.bin + 1) * (g1 - g0) / 149) AS hi
  FROM (SELECT DISTINCT grp FROM v_sizes) g CROSS JOIN (SELECT unnest(range(0, 149)) AS bin) b CROSS JOIN gd LEFT JOIN hc ON hc.grp = g.grp AND hc.bin = b.bin)"""


@query("log_histogram", "A19", sql("v_sizes", _HIST + """
SELECT grp, bin, round(lo, 4) AS lo, round(hi, 4) AS hi, round(sqrt(lo * hi), 4) AS mid, n FROM ha"""))
def log_histogram(spark, sf):
    return _r(Z.log_histogram(A.sizes(spark, sf), ["grp"], "size_px"), ["lo", "hi", "mid"], 4)


@query("size_tables", "V5", sql("v_sizes", _HIST + """
SELECT grp, CAST(sum(n) AS BIGINT) AS n_in_grid, (SELECT count(*) FROM v_sizes v WHERE v.grp = ha.grp AND size_px > 0) AS n FROM ha GROUP BY 1"""))
def size_tables(spark, sf):
    s = A.sizes(spark, sf)
    inside = Z.log_histogram(s, ["grp"], "size_px").groupBy("grp").agg(F.sum("n").alias("n_in_grid"))
    return inside.join(Z.size_summary(s, ["grp"], "size_px").select("grp", "n"), "grp")


@query("kde", "A20", sql("v_sizes", _GRID + """,
sa AS (SELECT grp, count(*) AS n, least(0.42, greatest(0.17, 0.62 * pow(count(*)::DOUBLE, -0.2))) * greatest(stddev_samp(ln(size_px)), 1e-6) AS bw FROM v_sizes WHERE size_px > 0 GROUP BY 1 HAVING count(*) >= 8),
kd AS (SELECT v.grp, i, any_value(g0 + i * (g1 - g0) / 149) AS x, sum(exp(-0.5 * ((g0 + i * (g1 - g0) / 149 - ln(size_px)) / bw) ** 2)) AS s
  FROM v_sizes v JOIN sa USING (grp) CROSS JOIN gd CROSS JOIN (SELECT CAST(unnest(range(0, 150)) AS INT) AS i) WHERE size_px > 0 GROUP BY 1, 2)
SELECT grp, i, round(exp(x), 4) AS x, round((s / exp(x)) / max(s / exp(x)) OVER (PARTITION BY grp), 5) AS y FROM kd"""))
def kde(spark, sf):
    d = Z.kde_log(A.sizes(spark, sf), ["grp"], "size_px")
    return d.select("grp", "i", rnd("x", 4).alias("x"), rnd("y", 5).alias("y"))


def _otsu_sql(bins: str) -> str:
    return f"""
hh AS (SELECT grp, b, count(*) AS n FROM {bins} GROUP BY 1, 2),
cu AS (SELECT grp, b, sum(n) OVER w AS n1, sum(n * b) OVER w AS s1, sum(n) OVER (PARTITION BY grp) AS nt, sum(n * b) OVER (PARTITION BY grp) AS st FROM hh WINDOW w AS (PARTITION BY grp ORDER BY b)),
vr AS (SELECT grp, b, coalesce(n1::DOUBLE * (nt - n1)::DOUBLE * (s1::DOUBLE / n1 - (st - s1)::DOUBLE / nullif(nt - n1, 0)) ** 2, -1) AS v FROM cu),
ot AS (SELECT grp, arg_min(b, (-v, b)) AS b FROM vr GROUP BY 1)"""


@query("otsu", "A22", sql("v_sizes", """
sp AS (SELECT grp, min(size_px) AS lo, max(size_px) AS hi FROM v_sizes GROUP BY 1 HAVING max(size_px) > 0),
bi AS (SELECT grp, CAST(least(coalesce(floor((size_px - lo) / nullif((hi - lo) / 256, 0)), 0), 255) AS BIGINT) AS b FROM v_sizes JOIN sp USING (grp)),""" + _otsu_sql("bi") + """
SELECT grp, round((lo + (b + 0.5) * ((hi - lo) / 256)) * 1.25, 4) AS threshold FROM ot JOIN sp USING (grp)"""))
def otsu(spark, sf):
    return _r(Z.otsu(A.sizes(spark, sf), ["grp"], "size_px", scale=1.25), ["threshold"], 4)


_CONTRAST = """
sm AS (SELECT 'f' || (l_suppkey % 40) AS grp, CAST(floor(l_extendedprice / 400) AS BIGINT) % 256 AS b FROM lineitem),""" + _otsu_sql("sm").strip() + """,
fs AS (SELECT grp, count(*) AS n, stddev_pop(sm.b) AS std, avg(CAST(sm.b >= 254 AS DOUBLE)) * 100 AS sat_pct, quantile_cont(sm.b::DOUBLE, 0.01) AS p1, quantile_cont(sm.b::DOUBLE, 0.99) AS p99, any_value(ot.b)::DOUBLE AS threshold,
  count(*) FILTER (sm.b > ot.b) * 100.0::DOUBLE / count(*) AS fg_frac, CASE WHEN count(*) FILTER (sm.b > ot.b) > 1 THEN stddev_pop(sm.b) FILTER (sm.b > ot.b) ELSE 0 END AS fg_std FROM sm JOIN ot USING (grp) GROUP BY 1)"""


def _pixels(spark, sf):
    return A.table(spark, sf, "lineitem").select(
        F.concat(F.lit("f"), (F.col("l_suppkey") % 40).cast("string")).alias("grp"), (F.floor(F.col("l_extendedprice") / 400) % 256).alias("b"))


@query("contrast", "A23", "WITH " + _CONTRAST.strip() + """
SELECT grp, n, round(std, 6) AS std, round(sat_pct, 6) AS sat_pct, round(p1, 6) AS p1, round(p99, 6) AS p99, round(p99 - p1, 6) AS range, threshold, round(fg_frac, 6) AS fg_frac, round(fg_std, 6) AS fg_std FROM fs""")
def contrast(spark, sf):
    return _r(Z.contrast_stats(_pixels(spark, sf), ["grp"], "b"), ["std", "sat_pct", "p1", "p99", "range", "fg_frac", "fg_std"])


@query("contrast_groups", "A23", "WITH " + _CONTRAST.strip() + """
SELECT 'g' || (CAST(grp[2:] AS INT) % 5) AS exposure, count(*) AS n_files, round(avg(std), 6) AS std, round(avg(fg_std), 6) AS fg_std, avg(sat_pct) > 0.5 AS clipped FROM fs GROUP BY 1""")
def contrast_groups(spark, sf):
    f = Z.contrast_stats(_pixels(spark, sf), ["grp"], "b")
    f = f.withColumn("exposure", F.concat(F.lit("g"), (F.substring("grp", 2, 9).cast("int") % 5).cast("string")))
    return _r(Z.contrast_groups(f, "exposure").select("exposure", "n_files", "std", "fg_std", "clipped"), ["std", "fg_std"])


@query("optical_density", "X18", sql("v_sizes", """
i0 AS (SELECT grp, quantile_cont(size_px, 0.95) AS i0 FROM v_sizes GROUP BY 1)
SELECT grp, size_px, round(greatest(0, -log10((size_px + 1) / (i0 + 1))), 6) AS od FROM v_sizes JOIN i0 USING (grp)"""))
def optical_density(spark, sf):
    return _r(Z.optical_density(A.sizes(spark, sf), ["grp"], "size_px"), ["od"])
