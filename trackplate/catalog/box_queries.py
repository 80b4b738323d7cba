"""Detections: gates, overlap, suppression, relabelling, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..core import rnd
from ..functions import boxes as FB
from ..operators import boxes as B
from .registry import query
from .views import sql

NAMES = A.CLASSES
# fixed values: shipped per-class score floors, reference scores and size bounds (px)
FLOORS = {"_default": 0.40, "egg": 0.40, "L1": 0.40, "L2": 0.25, "L3": 0.40, "L4": 0.40, "young adult": 0.40, "adult": 0.40}
REFS = {"L1": 0.8075, "L2": 0.1418, "L3": 0.7944, "L4": 0.7199, "adult": 0.86}
SIZES = {"L1": (21, 56), "L2": (30, 64), "L3": (26, 102), "L4": (37, 106), "adult": (43, 183)}
SWEEP = [0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.60]
ALPHA = 1.0

_SIZE = "sqrt(greatest(0, x2 - x1) * greatest(0, y2 - y1))"


def _case(table, i=None):
    rows = [(k, v if i is None else v[i]) for k, v in table.items() if k != "_default"]
    return "CASE cls " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in rows) + " END"


_GATE = f"""CASE WHEN cls = 'egg' THEN 'class' WHEN score < coalesce({_case(FLOORS)}, 0.4) THEN 'score'
  WHEN NOT truncated AND coalesce({_SIZE} < {_case(SIZES, 0)} OR {_SIZE} > {_case(SIZES, 1)}, false) THEN 'size' END"""


@query("box_geometry", "X10", sql("v_detections", f"""
SELECT a.det_id, round(sqrt(greatest(0, a.x2 - a.x1) * greatest(0, a.y2 - a.y1)), 6) AS size_px,
  round(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) / greatest(1e-9, (a.x2 - a.x1) * (a.y2 - a.y1)), 6) AS covered
FROM v_detections a JOIN v_detections b ON a.image_id = b.image_id AND b.det_id = a.det_id + 1"""))
def box_geometry(spark, sf):
    d = A.detections(spark, sf)
    box = F.struct("x1", "y1", "x2", "y2")
    a = d.select("image_id", "det_id", box.alias("a"), FB.box_size().alias("s"))
    b = d.select("image_id", (F.col("det_id") - 1).alias("det_id"), box.alias("b"))
    j = a.join(b, ["image_id", "det_id"])
    return j.select("det_id", rnd("s").alias("size_px"), rnd(FB.covered_fraction("a", "b")).alias("covered"))


@query("class_options", "X8", sql("v_detections", f"""
SELECT DISTINCT cls, CAST(coalesce({_case(FLOORS)}, 0.4) AS DOUBLE) AS floor, CAST({_case(SIZES, 0)} AS DOUBLE) AS size_lo,
  CAST(coalesce({_case(REFS)}, 1.0) AS DOUBLE) AS ref FROM v_detections"""))
def class_options(spark, sf):
    c = F.col("cls")
    return A.detections(spark, sf).select(
        "cls", FB.class_option(c, {" EGG": 0.4, **FLOORS}).alias("floor"),
        FB.class_option(c, {k.lower(): v[0] for k, v in SIZES.items()}).alias("size_lo"),
        FB.class_option(c, REFS, 1.0).alias("ref")).distinct()


_TILE = """
fr AS (SELECT p_partkey AS frame_id, 2000 + p_size * 41 AS w FROM part),
og AS (SELECT DISTINCT frame_id, unnest(list_append(range(0, greatest(w - 640 + 1, 1), 448), greatest(0, w - 640))) AS origin FROM fr)"""


@query("tile_grid", "X11", sql("", "WITH " + _TILE.strip() + """
SELECT frame_id, CAST(origin AS BIGINT) AS origin FROM og"""))
def tile_grid(spark, sf):
    p = A.table(spark, sf, "part").select(F.col("p_partkey").alias("frame_id"), (F.lit(2000) + F.col("p_size") * 41).alias("w"))
    return B.tile_grid(p, "w", 640, 0.30).select("frame_id", "origin")


@query("tile_to_frame", "X12", sql("v_detections", """
t AS (SELECT det_id, x1 % 400 AS bx, (x1 % 400) + (x2 - x1) AS bx2, y1 % 400 AS by1, (y1 % 400) + (y2 - y1) AS by2,
  448 * (det_id % 4) AS ox, 448 * (det_id % 3) AS oy FROM v_detections)
SELECT det_id, round(bx + ox, 6) AS x1, round(by2 + oy, 6) AS y2,
  (ox > 0 AND bx <= 8) OR (ox + 640 < 1984 AND bx2 >= 632) OR (oy > 0 AND by1 <= 8) OR (oy + 640 < 1536 AND by2 >= 632) AS truncated FROM t"""))
def tile_to_frame(spark, sf):
    d = A.detections(spark, sf)
    i = F.col("det_id")
    t = d.select("det_id", (F.col("x1") % 400).alias("x1"), ((F.col("x1") % 400) + (F.col("x2") - F.col("x1"))).alias("x2"),
                 (F.col("y1") % 400).alias("y1"), ((F.col("y1") % 400) + (F.col("y2") - F.col("y1"))).alias("y2"),
                 (i % 4 * 448).alias("tile_x"), (i % 3 * 448).alias("tile_y"), F.lit(640).alias("tile_w"), F.lit(640).alias("tile_h"),
                 F.lit(1984).alias("frame_w"), F.lit(1536).alias("frame_h"))
    return B.tile_to_frame(t, 8).select("det_id", rnd("x1").alias("x1"), rnd("y2").alias("y2"), "truncated")


@query("detection_gate", "F1", sql("v_detections", f"SELECT det_id, coalesce({_GATE}, 'kept') AS gate FROM v_detections"))
def detection_gate(spark, sf):
    g = B.gate_reason(FLOORS, SIZES, ["egg"])
    return A.detections(spark, sf).select("det_id", F.coalesce(g, F.lit("kept")).alias("gate"))


_INTER = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"


@query("box_overlaps", "J12", sql("v_detections", f"""
p AS (SELECT a.image_id, a.det_id AS a, b.det_id AS b, {_INTER} AS i, (a.x2 - a.x1) * (a.y2 - a.y1) AS aa, (b.x2 - b.x1) * (b.y2 - b.y1) AS ab
  FROM v_detections a JOIN v_detections b ON a.image_id = b.image_id AND a.det_id < b.det_id)
SELECT image_id, a, b, round(i / (aa + ab - i + 1e-9), 6) AS iou FROM p WHERE i / (aa + ab - i + 1e-9) >= 0.05"""))
def box_overlaps(spark, sf):
    o = B.overlaps(A.detections(spark, sf), min_iou=0.05)
    return o.select("image_id", F.col("a.det_id").alias("a"), F.col("b.det_id").alias("b"), rnd("overlap").alias("iou"))


def _walk_sql(src: str, out: str, measure: str, limit: float, part: str, order: str, can_drop: str = "true") -> str:
    """Recursive walk over one image (and class), carrying the kept boxes."""
    inter = "greatest(0, least(n.x2, k.x2) - greatest(n.x1, k.x1)) * greatest(0, least(n.y2, k.y2) - greatest(n.y1, k.y1))"
    area_n, area_k = "(n.x2 - n.x1) * (n.y2 - n.y1)", "(k.x2 - k.x1) * (k.y2 - k.y1)"
    test = (f"{inter} / ({area_n} + {area_k} - {inter} + 1e-9) >= {limit}" if measure == "iou"
            else f"{inter} / greatest(1e-9, {area_n}) >= {limit}")
    return f"""
{out}_o AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {order}, det_id) AS rn FROM {src}),
{out}_w AS (SELECT {part}, 0::BIGINT AS rn, NULL::BIGINT AS det_id, false AS keep,
    []::STRUCT(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[] AS kept FROM {out}_o GROUP BY {part}
  UNION ALL
  SELECT {', '.join('s.' + p.strip() for p in part.split(','))}, s.rn, s.det_id, NOT s.drop, CASE WHEN s.drop THEN s.kept
      ELSE list_append(s.kept, {{'x1': s.x1, 'y1': s.y1, 'x2': s.x2, 'y2': s.y2}}) END
  FROM (SELECT n.*, w.kept, ({can_drop}) AND len(list_filter(w.kept, lambda k: {test})) > 0 AS drop
        FROM {out}_w w JOIN {out}_o n ON {' AND '.join('n.' + p.strip() + ' = w.' + p.strip() for p in part.split(','))} AND n.rn = w.rn + 1) s),
{out} AS (SELECT d.* FROM {src} d JOIN {out}_w w ON w.det_id = d.det_id WHERE w.keep)"""


_AREA = "(x2 - x1) * (y2 - y1) DESC"
_KEPT = "SELECT image_id, det_id, cls, round(score, 6) AS score FROM "


def _kept(df):
    return df.select("image_id", "det_id", "cls", rnd("score").alias("score"))


@query("nms_class", "G6", sql("v_detections", "RECURSIVE " + _walk_sql("v_detections", "k1", "iou", 0.1, "image_id, cls", "score DESC") + "\n" + _KEPT + "k1"))
def nms_class(spark, sf):
    return _kept(B.suppress(A.detections(spark, sf), B.Rule("iou", 0.1, same_class=True)))


@query("nested_suppress", "G7", sql("v_detections", "RECURSIVE " + _walk_sql("v_detections", "k1", "cover", 0.3, "image_id, cls", _AREA) + "\n" + _KEPT + "k1"))
def nested_suppress(spark, sf):
    return _kept(B.suppress(A.detections(spark, sf), B.Rule("cover", 0.3, order="area", same_class=True)))


@query("cross_class_nms", "G8", sql("v_detections", "RECURSIVE " + _walk_sql("v_detections", "k1", "iou", 0.1, "image_id", "score DESC") + "\n" + _KEPT + "k1"))
def cross_class_nms(spark, sf):
    return _kept(B.suppress(A.detections(spark, sf), B.Rule("iou", 0.1)))


@query("seam_suppress", "G9", sql("v_detections", "RECURSIVE " + _walk_sql("v_detections", "k1", "cover", 0.2, "image_id", "score DESC", "n.truncated") + "\n" + _KEPT + "k1"))
def seam_suppress(spark, sf):
    return _kept(B.suppress(A.detections(spark, sf), B.Rule("cover", 0.2, only_truncated=True)))


def _refs_list(alpha):
    return "[" + ", ".join(str(REFS.get(n, 1.0) ** alpha) for n in NAMES if n != "egg") + "]"


def _best(alpha, lst="scores"):
    """(list of weighted scores without the excluded first class) expressions."""
    return f"list_transform(list_zip({lst}[2:], {_refs_list(alpha)}), lambda z: z[1] / z[2])"


_NAME_LIST = "['L1', 'L2', 'L3', 'L4', 'adult']"


@query("rescore", "R1", sql("v_detections", f"""
w AS (SELECT *, {_best(ALPHA)} AS ws FROM v_detections)
SELECT det_id, cls AS cls_raw, ({_NAME_LIST})[list_position(ws, list_max(ws))] AS cls, round(scores[1 + list_position(ws, list_max(ws))], 6) AS score FROM w"""))
def rescore(spark, sf):
    d = B.rescore(A.detections(spark, sf), NAMES, REFS, ALPHA, ["egg"])
    return d.select("det_id", "cls_raw", "cls", rnd("score").alias("score"))


@query("relabel_cached", "R2", sql("v_detections", f"""
w AS (SELECT *, CASE WHEN det_id % 13 <> 0 THEN scores END AS sc, {_best(0.5)} AS ws FROM v_detections)
SELECT det_id, CASE WHEN sc IS NOT NULL THEN ({_NAME_LIST})[list_position(ws, list_max(ws))] ELSE cls END AS cls,
  sc IS NULL AS no_vector, sc IS NOT NULL AND ({_NAME_LIST})[list_position(ws, list_max(ws))] <> cls AS relabelled FROM w"""))
def relabel_cached(spark, sf):
    d = A.detections(spark, sf).withColumns(
        {"cls_raw": F.col("cls"), "scores": F.when(F.col("det_id") % 13 != 0, F.col("scores"))})
    return B.relabel_cached(d, NAMES, REFS, 0.5, ["egg"]).select("det_id", "cls", "no_vector", "relabelled")


@query("merge_detections", "G10 R1 F1", sql("v_detections", "RECURSIVE " + f"g0 AS (SELECT * FROM v_detections WHERE ({_GATE}) IS NULL),"
       + _walk_sql("g0", "g1", "iou", 0.1, "image_id, cls", "score DESC") + ","
       + _walk_sql("g1", "g2", "cover", 0.3, "image_id, cls", _AREA) + ","
       + _walk_sql("g2", "g3", "iou", 0.3, "image_id", "score DESC") + ","
       + _walk_sql("g3", "g4", "cover", 0.2, "image_id", "score DESC", "n.truncated") + f""",
w AS (SELECT *, {_best(ALPHA)} AS ws FROM g4)
SELECT image_id, det_id, cls AS cls_raw, ({_NAME_LIST})[list_position(ws, list_max(ws))] AS cls FROM w"""))
def merge_detections(spark, sf):
    d = B.merge_detections(A.detections(spark, sf), FLOORS, SIZES, NAMES, REFS, ALPHA, ["egg"],
                           B.merge_rules(0.1, 0.3, 0.3, 0.2))
    return d.select("image_id", "det_id", "cls_raw", "cls")


@query("score_entropy", "X20", sql("v_detections", """
p AS (SELECT det_id, list_transform(scores, lambda v: v / CASE WHEN list_sum(scores) = 0 THEN 1 ELSE list_sum(scores) END) AS pr FROM v_detections)
SELECT det_id, round(list_sum(list_transform(list_filter(pr, lambda q: q > 0), lambda q: -q * ln(q))), 6) AS entropy, round(list_max(pr), 6) AS top_p FROM p"""))
def score_entropy(spark, sf):
    p = A.detections(spark, sf).select("det_id", FB.score_probs(F.col("scores")).alias("p"))
    return p.select("det_id", rnd(FB.entropy(F.col("p"))).alias("entropy"), rnd(F.array_max("p")).alias("top_p"))


@query("threshold_sweep", "A24", sql("v_detections", f"""
SELECT c.cls, t.threshold, count(d.det_id) FILTER (d.score >= t.threshold) AS n
FROM (SELECT unnest({NAMES}) AS cls) c CROSS JOIN (SELECT unnest({SWEEP})::DOUBLE AS threshold) t LEFT JOIN v_detections d ON d.cls = c.cls GROUP BY 1, 2"""))
def threshold_sweep(spark, sf):
    return B.threshold_sweep(A.detections(spark, sf), NAMES, SWEEP)


@query("box_percentiles", "A25", sql("v_detections", """
SELECT cls, count(*) AS n, round(max(x2 - x1), 6) AS w_max, round(max(y2 - y1), 6) AS h_max, round(quantile_cont(x2 - x1, 0.5), 6) AS w_p50,
  round(quantile_cont(x2 - x1, 0.95), 6) AS w_p95, round(quantile_cont(y2 - y1, 0.5), 6) AS h_p50, round(quantile_cont(y2 - y1, 0.95), 6) AS h_p95
FROM v_detections WHERE score >= 0.25 GROUP BY 1"""))
def box_percentiles(spark, sf):
    d = B.box_percentiles(A.detections(spark, sf))
    return d.select("cls", "n", *[rnd(c).alias(c) for c in ("w_max", "h_max", "w_p50", "w_p95", "h_p50", "h_p95")])


_BOUNDS = f"""
s AS (SELECT cls, {_SIZE} AS s FROM v_detections WHERE score >= 0.25 AND NOT truncated),
q AS (SELECT cls, round_even(quantile_cont(s, 0.02), 0) AS lo, round_even(quantile_cont(s, 0.98), 0) AS hi, quantile_cont(s, 0.5) AS p50, count(*) AS n FROM s GROUP BY 1),
b AS (SELECT cls, n, p50, lo, hi, (SELECT count(*) FROM s WHERE s.cls = q.cls AND (s.s < q.lo OR s.s > q.hi)) AS n_out FROM q)"""


@query("size_bounds", "A25", sql("v_detections", _BOUNDS + """
SELECT cls, n, round(p50, 6) AS p50, CASE WHEN n >= 20 THEN lo END AS lo, CASE WHEN n >= 20 THEN hi END AS hi, CASE WHEN n >= 20 THEN n_out END AS n_out FROM b"""))
def size_bounds(spark, sf):
    return B.size_bounds(A.detections(spark, sf)).select("cls", "n", rnd("p50").alias("p50"), "lo", "hi", "n_out")


@query("monotonic_check", "A26", sql("v_detections", _BOUNDS + f"""
SELECT below, above, round(bm, 6) AS below_median, round(p50, 6) AS above_median FROM (
  SELECT cls AS above, p50, lag(cls) OVER w AS below, lag(p50) OVER w AS bm FROM b WINDOW w AS (ORDER BY list_position({NAMES}, cls))) WHERE bm >= p50"""))
def monotonic_check(spark, sf):
    m = B.monotonic_breaks(B.size_bounds(A.detections(spark, sf)), NAMES)
    return m.select("below", "above", rnd("below_median").alias("below_median"), rnd("above_median").alias("above_median"))


@query("duplicate_pairs", "A27 O3", sql("v_detections", f"""
c AS (SELECT a.image_id, a.det_id, a.cls AS dropped, b.cls AS kept, row_number() OVER (PARTITION BY a.det_id ORDER BY b.score DESC, b.det_id) AS rn
  FROM v_detections a JOIN v_detections b ON a.image_id = b.image_id AND (b.score > a.score OR (b.score = a.score AND b.det_id < a.det_id))
  WHERE a.score >= 0.25 AND b.score >= 0.25 AND {_INTER} / greatest(1e-9, (a.x2 - a.x1) * (a.y2 - a.y1)) >= 0.2)
SELECT kept, dropped, count(*) AS n FROM c WHERE rn = 1 AND kept <> dropped GROUP BY 1, 2 ORDER BY n DESC, kept, dropped LIMIT 20"""))
def duplicate_pairs(spark, sf):
    return B.duplicate_pairs(A.detections(spark, sf), 0.2)


@query("score_bands", "F7", sql("v_detections", f"""
s AS (SELECT score, CASE WHEN {_SIZE} < 50 THEN 'small' WHEN {_SIZE} < 80 THEN 'disputed' ELSE 'clear' END AS band FROM v_detections)
SELECT band, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM s), 6) AS pct, round(quantile_cont(score, 0.5), 6) AS median_score,
  round(avg(CAST(score >= 0.7 AS DOUBLE)), 6) AS high_share FROM s GROUP BY 1"""))
def score_bands(spark, sf):
    d = B.score_bands(A.detections(spark, sf), [("small", 0, 50), ("disputed", 50, 80), ("clear", 80, float("inf"))])
    return d.select("band", "n", *[rnd(c).alias(c) for c in ("pct", "median_score", "high_share")])


@query("clustered_sample", "O4", sql("v_detections", """
d AS (SELECT * FROM v_detections WHERE cls IN ('L3', 'L4')),
p AS (SELECT image_id, count(*) AS n, least(count(*), 8) AS take FROM d GROUP BY 1),
b AS (SELECT *, coalesce(sum(take) OVER (ORDER BY n DESC, image_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p),
r AS (SELECT d.image_id, d.det_id, before, row_number() OVER (PARTITION BY d.image_id ORDER BY sha256('0:' || d.det_id)) AS rn FROM d JOIN b USING (image_id) WHERE before < 24)
SELECT image_id, det_id FROM r WHERE rn <= 8 AND before + rn <= 24"""))
def clustered_sample(spark, sf):
    d = A.detections(spark, sf).where(F.col("cls").isin("L3", "L4"))
    return B.clustered_sample(d, 24).select("image_id", "det_id")
