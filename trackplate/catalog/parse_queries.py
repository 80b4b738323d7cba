"""Names, paths, skeleton geometry and scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..core import rnd
from ..functions import parse as P
from ..functions import skeleton as S
from ..operators import files as FI
from .registry import query
from .views import sql

_COND_RE = r"^(.+?)\s+(\d+)\s*([Jj]|[uUµ][Mm])$"


def _cond_sql(label):
    return (f"CASE WHEN regexp_matches(trim({label}), '{_COND_RE}') THEN regexp_extract(trim({label}), '{_COND_RE}', 1) ELSE {label} END AS strain, "
            f"TRY_CAST(nullif(regexp_extract(trim({label}), '{_COND_RE}', 2), '') AS BIGINT) AS dose, "
            f"CASE WHEN NOT regexp_matches(trim({label}), '{_COND_RE}') THEN '' WHEN lower(regexp_extract(trim({label}), '{_COND_RE}', 3)) = 'j' THEN 'J/m²' ELSE 'µM' END AS unit")


@query("condition_parse", "X1", sql("v_paths", f"SELECT file_id, {_cond_sql('label')} FROM v_paths"))
def condition_parse(spark, sf):
    c = P.parse_condition(F.col("label"))
    return A.image_paths(spark, sf).select("file_id", c["strain"].alias("strain"), c["dose"].alias("dose"), c["unit"].alias("unit"))


_TOK = """
tk AS (SELECT *, string_split(stem, '_')[1] AS t0,
  list_filter(string_split(stem, '_')[2:], lambda t: regexp_full_match(t, '(?i)(\\d+)(J|uM|µM)'))[1] AS td,
  list_filter(string_split(stem, '_')[2:], lambda t: regexp_full_match(t, '(?i)p(\\d+)'))[1] AS tp FROM v_paths),
tr AS (SELECT *, CAST(regexp_extract(td, '(\\d+)', 1) AS BIGINT) AS dose, CASE WHEN lower(regexp_extract(td, '^\\d+(.*)$', 1)) = 'j' THEN 'J' ELSE 'µM' END AS unit,
  CAST(regexp_extract(tp, '(\\d+)', 1) AS BIGINT) AS plate FROM tk WHERE td IS NOT NULL AND tp IS NOT NULL)"""


@query("filename_tokens", "X2", sql("v_paths", _TOK + """
SELECT file_id, t0 AS strain, dose, unit, plate FROM tr"""))
def filename_tokens(spark, sf):
    return (A.image_paths(spark, sf).withColumn("t", P.parse_tokens(F.col("stem"))).where(F.col("t").isNotNull())
            .select("file_id", "t.strain", "t.dose", "t.unit", "t.plate"))


_PLACE = """
pp AS (SELECT file_id, string_split(path, '/') AS p, regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '') AS st FROM v_paths),
pl AS (SELECT file_id, CASE WHEN len(p) <= 2 THEN 'default' ELSE p[-3] END AS condition, CASE WHEN len(p) = 1 THEN st ELSE p[-2] END AS plate FROM pp)"""


@query("path_place", "X3", sql("v_paths", _PLACE + "SELECT file_id, condition, plate FROM pl"))
def path_place(spark, sf):
    p = P.path_place(F.col("path"))
    return A.image_paths(spark, sf).select("file_id", p["condition"].alias("condition"), p["plate"].alias("plate"))


@query("resolve_record", "X4", sql("v_paths", _TOK + "," + _PLACE + """
SELECT f.file_id, CASE WHEN f.folder_id % 2 = 0 THEN pl.condition WHEN tr.file_id IS NULL THEN '__unparsed__' ELSE t0 || ' ' || dose || unit END AS condition,
  CASE WHEN f.folder_id % 2 = 0 THEN pl.plate WHEN tr.file_id IS NULL THEN f.stem ELSE 'p' || lpad(CAST(tr.plate AS VARCHAR), 2, '0') END AS plate
FROM v_paths f JOIN pl USING (file_id) LEFT JOIN tr ON tr.file_id = f.file_id"""))
def resolve_record(spark, sf):
    mode = F.when(F.col("folder_id") % 2 == 0, "directory").otherwise("filename")
    p = P.resolve_place(F.col("path"), mode)
    return A.image_paths(spark, sf).select("file_id", p["condition"].alias("condition"), p["plate"].alias("plate"))


@query("quadrant_of", "X5", sql("v_paths", """
SELECT file_id, CASE WHEN regexp_matches(stem, '(?i)_([NS][EW])$') THEN upper(stem[-2:]) ELSE stem END AS quadrant FROM v_paths"""))
def quadrant_of(spark, sf):
    return A.image_paths(spark, sf).select("file_id", P.quadrant(F.col("stem")).alias("quadrant"))


_TIME = "try_strptime(nullif(regexp_extract(stem, '(^|[^0-9])([0-9]{8}T[0-9]{6})([^0-9]|$)', 2), ''), '%Y%m%dT%H%M%S')"


@query("capture_time", "X6", sql("v_paths", f"SELECT file_id, strftime({_TIME}, '%Y-%m-%d %H:%M:%S') AS captured FROM v_paths"))
def capture_time(spark, sf):
    return A.image_paths(spark, sf).select(
        "file_id", F.date_format(P.capture_time(F.col("stem")), "yyyy-MM-dd HH:mm:ss").alias("captured"))


@query("stage_category", "X7", sql("", """
SELECT DISTINCT p_type AS stage, CASE lower(trim(p_type)) WHEN 'economy' THEN 'survivor' WHEN 'promo' THEN 'non_survivor' WHEN 'small' THEN 'excluded' ELSE 'unmapped' END AS category FROM part"""))
def stage_category(spark, sf):
    cats = {"survivor": [" Economy"], "non_survivor": ["PROMO "], "excluded": ["small"]}
    return A.table(spark, sf, "part").select(F.col("p_type").alias("stage"), P.stage_category(F.col("p_type"), cats).alias("category")).distinct()


@query("skeleton_length", "X13 J3", sql("v_skeletons", """
s AS (SELECT skeleton_id, CASE WHEN len(list_filter(px, lambda z: z IS NULL)) = 0 AND len(list_filter(py, lambda z: z IS NULL)) = 0 THEN
  list_sum(list_transform(range(2, 50), lambda i: sqrt((px[i] - px[i-1]) ** 2 + (py[i] - py[i-1]) ** 2))) END AS len FROM v_skeletons),
r AS (SELECT event_id AS row_id, CASE WHEN event_id % 5 = 0 THEN -1 ELSE event_id - event_id // 5 - 1 END AS sid FROM events)
SELECT row_id, round(len, 6) AS skeleton_length FROM r LEFT JOIN s ON s.skeleton_id = r.sid"""))
def skeleton_length(spark, sf):
    s = A.skeletons(spark, sf).select("skeleton_id", S.skeleton_length(F.col("skeleton")).alias("len"))
    i = F.col("event_id")
    r = A.table(spark, sf, "events").select(i.alias("row_id"), F.when(i % 5 == 0, -1).otherwise(i - F.floor(i / 5) - 1).alias("skeleton_id"))
    return r.join(s, "skeleton_id", "left").select("row_id", rnd("len").alias("skeleton_length"))


@query("head_angle", "X14", sql("v_skeletons", """
SELECT skeleton_id, round(CASE WHEN len(list_filter(px, lambda z: z IS NULL)) = 0 THEN atan2((px[1] - px[6]) * (py[21] - py[31]) - (py[1] - py[6]) * (px[21] - px[31]),
  (px[1] - px[6]) * (px[21] - px[31]) + (py[1] - py[6]) * (py[21] - py[31])) END, 6) AS head_angle FROM v_skeletons"""))
def head_angle(spark, sf):
    return A.skeletons(spark, sf).select("skeleton_id", rnd(S.head_angle(F.col("skeleton"))).alias("head_angle"))


@query("image_scale", "X16", sql("", """
m AS (SELECT o_orderkey AS image_id, CASE WHEN o_orderkey % 5 = 0 THEN 6.0 END AS d, 400 + o_custkey % 100 AS r, o_totalprice / 100 AS x,
  CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 1 END AS u, CASE WHEN o_custkey % 2 = 0 THEN 'ImageJ unit=um' ELSE 'plain' END AS ds FROM orders),
s AS (SELECT image_id, CASE WHEN d > 0 THEN d * 1000 / (2 * r) WHEN u = 2 THEN 25400 / nullif(x, 0) WHEN u = 3 THEN 10000 / nullif(x, 0)
  WHEN ds LIKE '%unit=um%' THEN 1 / nullif(x, 0) END AS um FROM m)
SELECT image_id, round(um, 6) AS um_per_px, CASE WHEN um IS NULL THEN 'skip' WHEN um / 7.5 = 1 THEN 'passthrough' WHEN um / 7.5 < 1 THEN 'downscale' ELSE 'refuse' END AS action,
  CASE WHEN um / 7.5 <= 1 THEN CAST(greatest(1, round_even(1000 * um / 7.5, 0)) AS BIGINT) END AS target_w FROM s""".replace("m AS (", "WITH m AS (", 1)))
def image_scale(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    m = A.table(spark, sf, "orders").select(
        k.alias("image_id"), F.when(k % 5 == 0, F.lit(6.0)).alias("d"), (F.lit(400) + c % 100).alias("r"), (F.col("o_totalprice") / 100).alias("x"),
        F.when(k % 4 == 0, 2).when(k % 4 == 1, 3).when(k % 4 == 2, 1).alias("u"), F.when(c % 2 == 0, "ImageJ unit=um").otherwise("plain").alias("ds"))
    um = P.um_per_px(F.col("d"), F.col("r"), F.col("x"), F.col("u"), F.col("ds"))
    d = m.withColumn("um", um)
    dims = F.when(F.col("um") / 7.5 <= 1, F.greatest(F.lit(1.0), F.bround(F.lit(1000) * F.col("um") / 7.5, 0)).cast("long"))
    return d.select("image_id", rnd("um").alias("um_per_px"), P.scale_action(F.col("um"), 7.5).alias("action"), dims.alias("target_w"))


@query("threshold_scale", "X17", sql("", """
SELECT p_partkey, round(pow(2.5::DOUBLE, (5 - least(10, greatest(0, p_size / 4.0 - 1))) / 5), 6) AS scale FROM part"""))
def threshold_scale(spark, sf):
    return A.table(spark, sf, "part").select("p_partkey", rnd(P.threshold_scale(F.col("p_size") / 4.0 - 1)).alias("scale"))


_BLOB = """
b AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 20 AS area, l_extendedprice / 20 * 0.004 * l_quantity + 50 AS per, l_tax * 10 AS circ, 1 - l_discount * 3 AS sol FROM lineitem),
r AS (SELECT *, CASE WHEN per * per - 16 * area >= 0 THEN (per + sqrt(per * per - 16 * area)) / 4 END AS len, 2 * sqrt(area / pi()) AS ed FROM b)"""


@query("size_class", "X19", "WITH " + _BLOB.strip() + """
SELECT l_orderkey, l_linenumber, CASE WHEN len IS NULL AND ed <= 70 AND circ >= 0.6 THEN 'egg' WHEN len IS NULL THEN 'debris' WHEN len <= 70 AND circ >= 0.6 THEN 'egg'
  WHEN len > 1500 OR (sol >= 0.85 AND circ >= 0.75) THEN 'debris' WHEN len >= 200 AND len < 300 THEN 'L1' WHEN len >= 300 AND len < 430 THEN 'L2'
  WHEN len >= 430 AND len < 600 THEN 'L3' WHEN len >= 600 AND len < 820 THEN 'L4' WHEN len >= 820 AND len < 1500 THEN 'adult' ELSE '?' END AS cls FROM r""")
def size_class(spark, sf):
    l = A.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 20).alias("area"),
        (F.col("l_extendedprice") / 20 * 0.004 * F.col("l_quantity") + 50).alias("per"), (F.col("l_tax") * 10).alias("circ"),
        (F.lit(1) - F.col("l_discount") * 3).alias("sol"))
    ed = F.lit(2) * F.sqrt(F.col("area") / F.acos(F.lit(-1.0)))
    c = P.size_class(P.ribbon_length(F.col("area"), F.col("per")), ed, F.col("circ"), F.col("sol"))
    return l.select("l_orderkey", "l_linenumber", c["cls"].alias("cls"))


@query("safe_name", "X21", sql("", """
t AS (SELECT page_id, trim(translate(url, '\\/:*?"<>|', '_________'), '. ')[:200] AS s FROM pages),
n AS (SELECT page_id, sh, row_number() OVER (PARTITION BY sh ORDER BY page_id) AS k FROM (SELECT page_id, regexp_replace(url, '[\\[\\]:*?/\\\\]', '_', 'g')[:31] AS sh FROM pages))
SELECT page_id, CASE WHEN s = '' THEN '_' ELSE s END AS folder, CASE WHEN k = 1 THEN sh ELSE sh[:30 - length(k::VARCHAR)] || '_' || k END AS sheet
FROM t JOIN n USING (page_id)""".replace("t AS (", "WITH t AS (", 1).strip()))
def safe_name(spark, sf):
    p = A.table(spark, sf, "pages").select("page_id", P.safe_name(F.col("url")).alias("folder"), "url")
    return FI.sheet_names(p, "url", ["page_id"]).drop("url")


@query("sort_keys", "X22", sql("v_paths", """
f AS (SELECT DISTINCT stem, CASE file_id % 3 WHEN 0 THEN regexp_extract(stem, '_([0-9]{6})[0-9]{2}T', 1) || ' run' WHEN 1 THEN 'Series Day  ' || (file_id % 9) ELSE 'misc' || (file_id % 5) END AS day,
  regexp_extract(label, '^(\\S+)', 1) AS strain FROM v_paths)
SELECT stem, day, CASE WHEN lower(strain) IN ('n2', 'wt', 'control', 'ctrl') THEN 0 WHEN NOT regexp_matches(strain, '\\d') THEN 1 ELSE 2 END AS strain_rank,
  CASE WHEN regexp_matches(day, '(?i)day\\s*\\d+') THEN lower(trim(regexp_replace(regexp_extract(day, '(?i)(day\\s*\\d+)', 1), '\\s+', ' ', 'g')))
    WHEN regexp_matches(day, '^\\d{6}') THEN day[1:2] || '-' || day[3:4] || '-' || day[5:6] ELSE day END AS day_label FROM f"""))
def sort_keys(spark, sf):
    i = F.col("file_id")
    day = (F.when(i % 3 == 0, F.concat(F.regexp_extract("stem", "_([0-9]{6})[0-9]{2}T", 1), F.lit(" run")))
           .when(i % 3 == 1, F.concat(F.lit("Series Day  "), (i % 9).cast("string"))).otherwise(F.concat(F.lit("misc"), (i % 5).cast("string"))))
    d = A.image_paths(spark, sf).select("stem", day.alias("day"), F.regexp_extract("label", r"^(\S+)", 1).alias("strain")).distinct()
    return d.select("stem", "day", P.strain_key(F.col("strain"))["rank"].alias("strain_rank"), P.day_label(F.col("day")).alias("day_label"))


@query("settings_digest", "X23", sql("", """
SELECT p_partkey, sha256('{"brand":"' || p_brand || '","conf":"' || p_size || '.123457","pipeline":"assay-2","type":"' || p_type || '"}') AS digest FROM part"""))
def settings_digest(spark, sf):
    m = F.create_map(F.lit("type"), F.col("p_type"), F.lit("_note"), F.col("p_name"), F.lit("rescore_alpha"), F.col("p_retailprice").cast("string"),
                     F.lit("conf"), F.concat(F.col("p_size").cast("string"), F.lit(".1234567")), F.lit("brand"), F.col("p_brand"))
    return A.table(spark, sf, "part").select("p_partkey", FI.row_digest(m, "assay-2").alias("digest"))


@query("scan_files", "S2 F6", sql("v_paths v_files", """
a AS (SELECT path FROM v_paths UNION ALL SELECT '_out/' || path FROM v_paths WHERE file_id % 10 = 0 UNION ALL SELECT 'deep/' || path FROM v_paths WHERE file_id % 10 = 1),
p AS (SELECT path, string_split(path, '/') AS s FROM a)
SELECT path FROM p WHERE regexp_matches(lower(path), '\\.(tif|tiff|png|jpg|jpeg)$') AND len(s) <= 3 AND len(list_filter(s[:-2], lambda d: regexp_matches(d, '^[_.]'))) = 0"""))
def scan_files(spark, sf):
    p = A.image_paths(spark, sf).select("path", "file_id")
    i = F.col("file_id")
    a = p.select("path").unionByName(p.where(i % 10 == 0).select(F.concat(F.lit("_out/"), "path").alias("path"))).unionByName(
        p.where(i % 10 == 1).select(F.concat(F.lit("deep/"), "path").alias("path")))
    return a.where(P.is_image(F.col("path")))
