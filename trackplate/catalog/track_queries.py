"""Movement metrics, windows and sequences along tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..core import rnd
from ..operators import axis
from ..operators import peaks as P
from ..operators import tracks as T
from ..operators import windows as W
from .registry import query
from .views import sql

FPS = 10.0
KEYS = ["video_id", "track_id"]


def _r(df, names, digits=6):
    return df.withColumns({n: rnd(n, digits) for n in names})


# --- aggregates ------------------------------------------------------------------

@query("shape_metrics", "A2", sql("v_track_series", """
SELECT video_id, track_id, round(CASE WHEN count(length) >= 10 AND avg(length) > 0 THEN stddev_pop(length) / avg(length) END, 6) AS length_cv,
  round(quantile_cont(solidity, 0.5), 6) AS solidity_median, round(quantile_cont(abs(speed), 0.5), 6) AS speed_median_abs
FROM v_track_series GROUP BY 1, 2"""))
def shape_metrics(spark, sf):
    return _r(T.shape_metrics(A.track_series(spark, sf)), ["length_cv", "solidity_median", "speed_median_abs"])


_KIN = ["mean_speed_pxs", "mean_forward_speed_pxs", "mean_backward_speed_pxs", "fraction_forward", "fraction_backward",
        "fraction_paused", "mean_speed_when_moving", "activity_fraction_above_1pxs", "activity_fraction_above_3pxs",
        "activity_fraction_above_5pxs", "speed_cv", "mean_length_px", "length_cv", "mean_width_midbody_px"]


@query("kinematics", "A6", sql("v_track_series", """
th AS (SELECT video_id, 0.1 * quantile_cont(abs(speed), 0.5) AS th FROM v_track_series GROUP BY 1),
d AS (SELECT s.*, th, abs(speed) AS a FROM v_track_series s JOIN th USING (video_id))
SELECT video_id, track_id, count(speed) AS n_speed, round(avg(a), 9) AS mean_speed_pxs,
  round(CASE WHEN count(speed) > 0 THEN coalesce(avg(speed) FILTER (speed > 0), 0) END, 9) AS mean_forward_speed_pxs,
  round(CASE WHEN count(speed) > 0 THEN coalesce(avg(-speed) FILTER (speed < 0), 0) END, 9) AS mean_backward_speed_pxs,
  round(avg(CAST(speed > 0 AS DOUBLE)), 9) AS fraction_forward, round(avg(CAST(speed < 0 AS DOUBLE)), 9) AS fraction_backward,
  round(avg(CAST(a < th AS DOUBLE)), 9) AS fraction_paused, round(avg(a) FILTER (a >= th), 9) AS mean_speed_when_moving,
  round(avg(CAST(a >= 1 AS DOUBLE)), 9) AS activity_fraction_above_1pxs, round(avg(CAST(a >= 3 AS DOUBLE)), 9) AS activity_fraction_above_3pxs,
  round(avg(CAST(a >= 5 AS DOUBLE)), 9) AS activity_fraction_above_5pxs,
  round(CASE WHEN avg(a) > 0 THEN stddev_pop(a) / avg(a) END, 9) AS speed_cv, round(avg(length), 9) AS mean_length_px,
  round(CASE WHEN avg(length) > 0 THEN stddev_pop(length) / avg(length) END, 9) AS length_cv,
  round(avg(width_midbody), 9) AS mean_width_midbody_px FROM d GROUP BY 1, 2"""))
def kinematics(spark, sf):
    s = A.track_series(spark, sf)
    return _r(T.kinematics(s, T.paused_threshold(s)), _KIN, 9)


@query("path_geometry", "A7", sql("v_track_points", """
p AS (SELECT *, lag(frame) OVER w AS pf, lag(x) OVER w AS px, lag(y) OVER w AS py FROM v_track_points
  WHERE x IS NOT NULL AND y IS NOT NULL WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame, row_id)),
g AS (SELECT video_id, track_id, sum(CASE WHEN frame - pf = 1 THEN sqrt((x - px) ** 2 + (y - py) ** 2) ELSE 0 END) AS path,
  arg_min(x, (frame, row_id)) AS x0, arg_min(y, (frame, row_id)) AS y0, arg_max(x, (frame, row_id)) AS x1, arg_max(y, (frame, row_id)) AS y1
  FROM p GROUP BY 1, 2)
SELECT video_id, track_id, round(path, 6) AS path_length_px, round(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2), 6) AS net_displacement_px,
  round(path / greatest(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2), 1), 6) AS tortuosity FROM g"""))
def path_geometry(spark, sf):
    return _r(T.path_geometry(A.track_points(spark, sf)), ["path_length_px", "net_displacement_px", "tortuosity"])


@query("skeleton_coverage", "A8", sql("v_track_points", """
SELECT video_id, track_id, round(avg(has_skeleton), 6) AS skeleton_coverage FROM v_track_points GROUP BY 1, 2"""))
def skeleton_coverage(spark, sf):
    return _r(T.coverage(A.track_points(spark, sf)), ["skeleton_coverage"])


_TRACKROW = """
trk AS (SELECT video_id, track_id, avg(length) AS mean_length_px, (max(frame) - min(frame) + 1) / 10.0::DOUBLE AS track_duration_s
  FROM v_track_series GROUP BY 1, 2),
st AS (SELECT *, count(*) FILTER (track_duration_s >= 10) OVER (PARTITION BY video_id) AS n_stable FROM trk WHERE mean_length_px IS NOT NULL),
us AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY mean_length_px) AS rn, count(*) OVER (PARTITION BY video_id) AS n
  FROM st WHERE n_stable < 5 OR track_duration_s >= 10),
pl AS (SELECT video_id, avg(mean_length_px) AS plate_mean_length_px FROM us
  WHERE n - 2 * floor(n * 0.1) <= 0 OR (rn > floor(n * 0.1) AND rn <= n - floor(n * 0.1)) GROUP BY 1)"""


def _trackrow(s):
    return s.groupBy(*KEYS).agg(F.avg("length").alias("mean_length_px"),
                                ((F.max("frame") - F.min("frame") + 1) / F.lit(FPS)).alias("track_duration_s"))


@query("trimmed_plate_length", "A9", sql("v_track_series", _TRACKROW + """
SELECT video_id, round(plate_mean_length_px, 6) AS plate_mean_length_px FROM pl"""))
def trimmed_plate_length(spark, sf):
    return _r(T.plate_mean_length(_trackrow(A.track_series(spark, sf))), ["plate_mean_length_px"])


@query("per_body_length", "X15", sql("v_track_series", _TRACKROW + """
SELECT video_id, track_id, round(CASE WHEN plate_mean_length_px > 0 THEN avg(abs(speed)) / plate_mean_length_px END, 6) AS mean_speed_bls
FROM v_track_series JOIN pl USING (video_id) GROUP BY 1, 2, plate_mean_length_px"""))
def per_body_length(spark, sf):
    s = A.track_series(spark, sf)
    pl = T.plate_mean_length(_trackrow(s))
    d = s.groupBy(*KEYS).agg(F.avg(F.abs("speed")).alias("m")).join(pl, "video_id")
    return d.select(*KEYS, rnd(T.per_body_length(F.col("m"), F.col("plate_mean_length_px"))).alias("mean_speed_bls"))


@query("track_quality", "X25 F5", sql("v_track_points", """
SELECT video_id, track_id, round((max(frame) - min(frame) + 1) / 10.0, 6) AS track_duration_s,
  (max(frame) - min(frame) + 1) / 10.0 >= 5 AS is_long,
  coalesce((max(frame) - min(frame) + 1) / 10.0 >= 30 AND avg(has_skeleton) >= 0.85, false) AS passed
FROM v_track_points GROUP BY 1, 2"""))
def track_quality(spark, sf):
    g = A.track_points(spark, sf).groupBy(*KEYS).agg(
        ((F.max("frame") - F.min("frame") + 1) / F.lit(FPS)).alias("d"), F.avg("has_skeleton").alias("c"))
    ok = F.coalesce((F.col("d") >= T.MIN_SPAN_S) & (F.col("c") >= 0.85), F.lit(False))
    return g.select(*KEYS, rnd("d").alias("track_duration_s"), (F.col("d") >= 5).alias("is_long"), ok.alias("passed"))


@query("diameter", "A5", sql("v_track_points", """
p AS (SELECT DISTINCT video_id, track_id, x, y FROM v_track_points WHERE x IS NOT NULL AND y IS NOT NULL)
SELECT a.video_id, a.track_id, round(max(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 6) AS displacement_px
FROM p a JOIN p b ON a.video_id = b.video_id AND a.track_id = b.track_id GROUP BY 1, 2"""))
def diameter(spark, sf):
    return _r(T.diameter(A.track_points(spark, sf)), ["displacement_px"])


# --- windows -----------------------------------------------------------------------

_FLICK = """
fl AS (SELECT *, coalesce(stddev_pop(length) OVER (PARTITION BY video_id, track_id ORDER BY frame, row_id
    ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0) AS rolling_std FROM v_track_series),
mk AS (SELECT *, length IS NULL OR rolling_std > 6 AS bad FROM fl)"""


def _masked(spark, sf):
    return W.flicker_mask(A.track_series(spark, sf), "length", FPS, std_limit=6.0)


@query("rolling_flicker", "W1", sql("v_track_series", _FLICK + """
SELECT video_id, track_id, row_id, round(rolling_std, 5) AS rolling_std, bad FROM mk"""))
def rolling_flicker(spark, sf):
    return _masked(spark, sf).select(*KEYS, "row_id", rnd("rolling_std", 5).alias("rolling_std"), "bad")


_SEGS = _FLICK + """,
sg AS (SELECT *, sum(CAST(bad AS INT)) OVER (PARTITION BY video_id, track_id ORDER BY frame, row_id ROWS UNBOUNDED PRECEDING)::BIGINT AS segment,
    lag(bad) OVER (PARTITION BY video_id, track_id ORDER BY frame, row_id) AS pb FROM mk),
cs AS (SELECT video_id, track_id, segment, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS n_rows
  FROM sg WHERE NOT bad GROUP BY 1, 2, 3)"""


@query("clean_segments", "W2", sql("v_track_series", _SEGS + """
SELECT video_id, track_id, segment, start_frame, end_frame, n_rows FROM cs"""))
def clean_segments(spark, sf):
    return W.clean_spans(W.clean_segments(_masked(spark, sf)))


@query("flicker_stats", "W2", sql("v_track_series", _SEGS + """,
b AS (SELECT video_id, track_id, max(n_rows) / 10.0::DOUBLE AS m FROM cs GROUP BY 1, 2)
SELECT video_id, track_id, CAST(sum(CAST(bad AS INT)) AS BIGINT) AS flicker_frames,
  CAST(sum(CAST(bad AND NOT coalesce(pb, false) AS INT)) AS BIGINT) AS flicker_stretches, count(*) AS total_frames,
  round(coalesce(any_value(m), 0), 6) AS longest_clean_s FROM sg LEFT JOIN b USING (video_id, track_id) GROUP BY 1, 2"""))
def flicker_stats(spark, sf):
    return _r(W.flicker_stats(_masked(spark, sf), FPS), ["longest_clean_s"])


_DETREND = """
va AS (SELECT video_id, track_id, frame, row_id, (x - 50) / 50 AS angle, count(*) OVER (PARTITION BY video_id, track_id) AS n_valid,
    row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame, row_id) AS ord FROM v_track_points WHERE x IS NOT NULL),
sm AS (SELECT *, avg(angle) OVER (PARTITION BY video_id, track_id ORDER BY ord ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s
  FROM va WHERE n_valid >= 10),
dt AS (SELECT *, s - avg(s) OVER (PARTITION BY video_id, track_id ORDER BY ord ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS detrended FROM sm)"""

# runs of equal values, their neighbours, and the bases up to the nearest higher sample
_PEAKS = _DETREND + """,
sg AS (SELECT video_id, track_id, ord, frame, sgn, sgn * detrended AS v FROM dt, (SELECT unnest([1, -1]) AS sgn)),
ch AS (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY video_id, track_id, sgn ORDER BY ord) THEN 0 ELSE 1 END AS c FROM sg),
rn AS (SELECT *, sum(c) OVER (PARTITION BY video_id, track_id, sgn ORDER BY ord) AS r FROM ch),
ru AS (SELECT video_id, track_id, sgn, r, any_value(v) AS v, min(ord) AS lo, max(ord) AS hi FROM rn GROUP BY 1, 2, 3, 4),
nb AS (SELECT *, lag(v) OVER w AS pv, lead(v) OVER w AS nv FROM ru WINDOW w AS (PARTITION BY video_id, track_id, sgn ORDER BY r)),
ca AS (SELECT * FROM nb WHERE v > pv AND v > nv),
wl AS (SELECT c.video_id, c.track_id, c.sgn, c.lo, c.hi, c.v, coalesce(max(s.ord) FILTER (s.ord < c.lo AND s.v > c.v), 0) AS l,
    coalesce(min(s.ord) FILTER (s.ord > c.hi AND s.v > c.v), 1000000000) AS h
  FROM ca c JOIN sg s USING (video_id, track_id, sgn) GROUP BY 1, 2, 3, 4, 5, 6),
pr AS (SELECT w.video_id, w.track_id, w.sgn, (w.lo + w.hi) // 2 AS ord, w.v,
    w.v - greatest(min(s.v) FILTER (s.ord > w.l AND s.ord <= w.lo), min(s.v) FILTER (s.ord < w.h AND s.ord >= w.hi)) AS prom
  FROM wl w JOIN sg s USING (video_id, track_id, sgn) GROUP BY 1, 2, 3, 4, 5),
pk AS (SELECT p.video_id, p.track_id, p.sgn AS sign, p.ord, d.frame, d.row_id, p.sgn * p.v AS height
  FROM pr p JOIN dt d ON d.video_id = p.video_id AND d.track_id = p.track_id AND d.ord = p.ord WHERE prom >= 0.3)"""


def _detrended(spark, sf):
    p = A.track_points(spark, sf).withColumn("angle", (F.col("x") - 50) / 50)
    return W.detrend(p, "angle", FPS)


def _peaks(spark, sf):
    return P.find_peaks(_detrended(spark, sf), KEYS, "detrended", 0.3)


@query("detrended_signal", "W3 V8", sql("v_track_points", _PEAKS + """
SELECT d.video_id, d.track_id, d.ord, d.frame, round(d.frame / 10.0::DOUBLE, 6) AS t_s, round(detrended, 6) AS detrended,
  CAST(coalesce(p.sign, 0) AS INT) AS peak FROM dt d LEFT JOIN pk p ON p.video_id = d.video_id AND p.track_id = d.track_id AND p.ord = d.ord"""))
def detrended_signal(spark, sf):
    d = _detrended(spark, sf)
    p = P.find_peaks(d, KEYS, "detrended", 0.3).select(*KEYS, "ord", "sign")
    return d.join(p, [*KEYS, "ord"], "left").select(
        *KEYS, "ord", "frame", rnd(F.col("frame") / F.lit(FPS)).alias("t_s"), rnd("detrended").alias("detrended"),
        F.coalesce("sign", F.lit(0)).alias("peak"))


@query("detrend_peaks", "W4", sql("v_track_points", _PEAKS + """
SELECT video_id, track_id, CAST(sign AS INT) AS sign, ord, frame, round(height, 6) AS height FROM pk"""))
def detrend_peaks(spark, sf):
    return _r(_peaks(spark, sf), ["height"])


@query("bends_per_minute", "A3", sql("v_track_points", _PEAKS + """,
n AS (SELECT video_id, track_id, count(*) AS n_valid FROM dt GROUP BY 1, 2),
h AS (SELECT video_id, track_id, count(*) AS hb FROM pk GROUP BY 1, 2)
SELECT video_id, track_id, coalesce(hb, 0) AS half_bends, n_valid, round(coalesce(hb, 0) / 2.0 / (n_valid / 600.0), 6) AS bpm
FROM n LEFT JOIN h USING (video_id, track_id)"""))
def bends_per_minute(spark, sf):
    d = _detrended(spark, sf)
    n = d.groupBy(*KEYS).agg(F.max("n_valid").alias("n_valid"))
    h = P.find_peaks(d, KEYS, "detrended", 0.3).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("hb"))
    j = n.join(h, KEYS, "left").withColumn("half_bends", F.coalesce("hb", F.lit(0)))
    return j.select(*KEYS, "half_bends", "n_valid",
                    rnd(T.bends_per_minute(F.col("half_bends"), F.col("n_valid"), FPS)).alias("bpm"))


@query("interval_cv", "A4", sql("v_track_points", _PEAKS + """,
g AS (SELECT video_id, track_id, frame, (frame - lag(frame) OVER (PARTITION BY video_id, track_id ORDER BY frame, ord, sign)) / 10.0::DOUBLE AS gap FROM pk)
SELECT video_id, track_id, count(*) AS n_peaks, round(CASE WHEN count(*) >= 3 AND avg(gap) >= 1e-9 THEN stddev_pop(gap) / avg(gap) END, 6) AS bend_interval_cv
FROM g GROUP BY 1, 2"""))
def interval_cv(spark, sf):
    return _r(T.interval_cv(_peaks(spark, sf), FPS), ["bend_interval_cv"])


@query("head_spectrum", "W15", sql("v_track_points", _DETREND + """,
m AS (SELECT *, detrended - avg(detrended) OVER (PARTITION BY video_id, track_id) AS z FROM dt),
ks AS (SELECT video_id, track_id, any_value(n_valid) AS n, unnest(range(0, any_value(n_valid) // 2 + 1)) AS k FROM dt GROUP BY 1, 2),
sp AS (SELECT ks.video_id, ks.track_id, k, n, sqrt(sum(z * cos(-2 * pi() * ((k * (ord - 1)) % n) / n)) ** 2 + sum(z * sin(-2 * pi() * ((k * (ord - 1)) % n) / n)) ** 2) * 2 / n AS amp
  FROM ks JOIN m ON m.video_id = ks.video_id AND m.track_id = ks.track_id GROUP BY 1, 2, 3, 4)
SELECT video_id, track_id, round(sum(CASE WHEN k * 10.0 / n BETWEEN 0.5 AND 2 THEN amp ** 2 ELSE 0 END), 6) AS band_power,
  round(sum(CASE WHEN k * 10.0 / n BETWEEN 0.5 AND 2 THEN amp ** 2 ELSE 0 END) / sum(amp ** 2), 6) AS band_share FROM sp GROUP BY 1, 2"""))
def head_spectrum(spark, sf):
    s = P.spectrum(_detrended(spark, sf), KEYS, "detrended", FPS)
    return _r(P.band_power(s, KEYS), ["band_power", "band_share"])




def _good():
    return F.col("was_skeletonized") == 1


_RUNS = """
pv AS (SELECT *, was_skeletonized = 1 AS ok, lag(frame) OVER w AS pf, lag(was_skeletonized = 1) OVER w AS po FROM v_track_series
  WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame, row_id)),
rr AS (SELECT *, sum(CASE WHEN coalesce(po AND frame - pf = 1, false) THEN 0 ELSE 1 END) OVER (PARTITION BY video_id, track_id ORDER BY frame, row_id
  ROWS UNBOUNDED PRECEDING)::BIGINT AS run_id FROM pv),
cr AS (SELECT video_id, track_id, run_id, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS n_rows FROM rr WHERE ok GROUP BY 1, 2, 3)"""


@query("consecutive_runs", "W5", sql("v_track_series", _RUNS + """
SELECT video_id, track_id, run_id, start_frame, end_frame, n_rows FROM cr"""))
def consecutive_runs(spark, sf):
    return W.consecutive_runs(A.track_series(spark, sf), _good())


@query("bridged_runs", "W6", sql("v_track_series", """
g AS (SELECT DISTINCT video_id, track_id, frame FROM v_track_series WHERE was_skeletonized = 1),
n AS (SELECT *, CASE WHEN frame - lag(frame) OVER w - 1 <= 30 THEN 0 ELSE 1 END AS s FROM g WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame)),
r AS (SELECT *, sum(s) OVER (PARTITION BY video_id, track_id ORDER BY frame) AS r FROM n),
b AS (SELECT video_id, track_id, max(frame) - min(frame) + 1 AS len FROM r GROUP BY 1, 2, r.r)
SELECT t.video_id, t.track_id, round(coalesce(max(len), 0) / 10.0, 6) AS longest_run_s
FROM (SELECT DISTINCT video_id, track_id FROM v_track_series) t LEFT JOIN b USING (video_id, track_id) GROUP BY 1, 2"""))
def bridged_runs(spark, sf):
    return _r(W.longest_bridged_run(A.track_series(spark, sf), _good(), FPS), ["longest_run_s"])


@query("reversals", "W7", sql("v_track_series", """
l AS (SELECT video_id, track_id, frame, arg_max(coalesce(motion_mode, 9), row_id) AS mm FROM v_track_series GROUP BY 1, 2, 3),
d AS (SELECT *, lag(frame) OVER w AS pf, row_number() OVER w AS rn FROM l WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame)),
z AS (SELECT *, sum(CASE WHEN mm = 9 OR frame - pf <> 1 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, track_id ORDER BY frame) AS holes,
   sum(CASE WHEN mm = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, track_id ORDER BY frame) AS pauses FROM d)
SELECT b.video_id, b.track_id, b.frame FROM z b JOIN z f ON f.video_id = b.video_id AND f.track_id = b.track_id AND f.mm = 1 AND b.mm = -1
  AND f.frame < b.frame AND f.holes = b.holes AND b.pauses - f.pauses <= 60
WHERE NOT EXISTS (SELECT 1 FROM z m WHERE m.video_id = b.video_id AND m.track_id = b.track_id AND m.frame > f.frame AND m.frame < b.frame AND m.mm <> 0)"""))
def reversals(spark, sf):
    return W.reversals(A.track_series(spark, sf))


_DENSE = """
lp AS (SELECT video_id, track_id, frame // 24 AS frame, arg_max(x, row_id) AS x, arg_max(y, row_id) AS y FROM v_track_points
  WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2, 3),
sp AS (SELECT video_id, track_id, unnest(range(min(frame), max(frame) + 1)) AS frame FROM lp GROUP BY 1, 2),
de AS (SELECT sp.*, x, y FROM sp LEFT JOIN lp USING (video_id, track_id, frame)),
ve AS (SELECT d.video_id, d.track_id, d.frame, (b.x - a.x) / 6 AS vx, (b.y - a.y) / 6 AS vy FROM de d
  LEFT JOIN lp a ON a.video_id = d.video_id AND a.track_id = d.track_id AND a.frame = d.frame - 3
  LEFT JOIN lp b ON b.video_id = d.video_id AND b.track_id = d.track_id AND b.frame = d.frame + 3),
hc AS (SELECT d.video_id, d.track_id, d.frame, CASE WHEN hypot0 >= 0.1 AND hypot1 >= 0.1 THEN
    degrees(acos(greatest(-1, least(1, dot / (hypot0 * hypot1))))) END AS angle
  FROM (SELECT d.video_id, d.track_id, d.frame, sqrt(a.vx ** 2 + a.vy ** 2) AS hypot0, sqrt(b.vx ** 2 + b.vy ** 2) AS hypot1, a.vx * b.vx + a.vy * b.vy AS dot
    FROM ve d LEFT JOIN ve a ON a.video_id = d.video_id AND a.track_id = d.track_id AND a.frame = d.frame - 5
    LEFT JOIN ve b ON b.video_id = d.video_id AND b.track_id = d.track_id AND b.frame = d.frame + 5) d)"""


def _thinned(spark, sf):
    p = A.track_points(spark, sf).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    return axis.last_per_frame(p.withColumn("frame", F.floor(F.col("frame") / 24)), KEYS, ["x", "y"])


def _dense(spark, sf):
    return axis.densify(_thinned(spark, sf), KEYS, ["x", "y"])


@query("densify", "W8", sql("v_track_points", _DENSE + """
SELECT video_id, track_id, frame, round(x, 6) AS x, round(y, 6) AS y FROM de"""))
def densify(spark, sf):
    return _r(_dense(spark, sf), ["x", "y"])


@query("offset_value", "J5", sql("v_track_points", _DENSE + """
SELECT a.video_id, a.track_id, a.frame, round(b.x, 6) AS x_ahead FROM de a LEFT JOIN de b
ON b.video_id = a.video_id AND b.track_id = a.track_id AND b.frame = a.frame + 7"""))
def offset_value(spark, sf):
    d = W.offset_value(_dense(spark, sf), "x", 7, name="x_ahead")
    return d.select(*KEYS, "frame", rnd("x_ahead").alias("x_ahead"))


@query("velocity", "W9", sql("v_track_points", _DENSE + """
SELECT video_id, track_id, frame, round(CASE WHEN vy IS NOT NULL THEN vx END, 6) AS vx, round(CASE WHEN vx IS NOT NULL THEN vy END, 6) AS vy FROM ve"""))
def velocity(spark, sf):
    return _r(W.velocity(_dense(spark, sf), FPS), ["vx", "vy"]).select(*KEYS, "frame", "vx", "vy")


@query("heading_change", "W10", sql("v_track_points", _DENSE + """
SELECT video_id, track_id, frame, round(angle, 4) AS angle FROM hc"""))
def heading_change(spark, sf):
    return W.heading_change(_dense(spark, sf), FPS, F.lit(0.1)).select(*KEYS, "frame", rnd("angle", 4).alias("angle"))


_EVENTS = "RECURSIVE " + _DENSE + """,
ca AS (SELECT c.*, row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame) AS rn FROM (
    SELECT h.*, max(angle) OVER (PARTITION BY video_id, track_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS top FROM hc h) c
  WHERE angle >= 60 AND angle >= top),
wk AS (SELECT video_id, track_id, rn, frame, angle, true AS taken, frame AS last FROM ca WHERE rn = 1
  UNION ALL SELECT c.video_id, c.track_id, c.rn, c.frame, c.angle, c.frame - w.last >= 5, CASE WHEN c.frame - w.last >= 5 THEN c.frame ELSE w.last END
  FROM wk w JOIN ca c ON c.video_id = w.video_id AND c.track_id = w.track_id AND c.rn = w.rn + 1),
ev AS (SELECT video_id, track_id, frame, angle, CASE WHEN angle >= 140 THEN 'reversal' ELSE 'turn' END AS event FROM wk WHERE taken)"""


@query("turn_events", "W11", sql("v_track_points", _EVENTS + """
SELECT video_id, track_id, frame, round(angle, 4) AS angle, event FROM ev"""))
def turn_events(spark, sf):
    e = W.turn_events(W.motion_frames(_thinned(spark, sf), FPS), FPS, F.lit(0.1))
    return e.select(*KEYS, "frame", rnd("angle", 4).alias("angle"), "event")


@query("turn_rates", "W11", sql("v_track_points", _EVENTS + """,
o AS (SELECT video_id, track_id, count(vx) FILTER (vy IS NOT NULL) AS n FROM ve GROUP BY 1, 2),
c AS (SELECT video_id, track_id, count(*) FILTER (event = 'reversal') AS r, count(*) FILTER (event = 'turn') AS t FROM ev GROUP BY 1, 2)
SELECT video_id, track_id, coalesce(r, 0) AS arrow_reversal_count, coalesce(t, 0) AS turn_count,
  round(coalesce(r, 0) / nullif(n / 600.0::DOUBLE, 0), 6) AS arrow_reversal_rate_per_min, round(coalesce(t, 0) / nullif(n / 600.0::DOUBLE, 0), 6) AS turn_rate_per_min
FROM o LEFT JOIN c USING (video_id, track_id)"""))
def turn_rates(spark, sf):
    d = W.motion_frames(_thinned(spark, sf), FPS)
    e = W.turn_events(d, FPS, F.lit(0.1))
    return _r(W.turn_rates(e, W.velocity(d, FPS), FPS), ["arrow_reversal_rate_per_min", "turn_rate_per_min"])


@query("validity_transitions", "W12", sql("v_track_series", """
p AS (SELECT *, was_skeletonized = 1 AS v, lag(was_skeletonized = 1) OVER w AS pv FROM v_track_series WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame, row_id)),
t AS (SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame, row_id) AS nth FROM p WHERE v <> pv)
SELECT video_id, track_id, nth, frame, CASE WHEN v THEN 'n2v' ELSE 'v2n' END AS direction FROM t WHERE nth <= 20"""))
def validity_transitions(spark, sf):
    return W.transitions(A.track_series(spark, sf), _good(), most=20)


@query("phase_rotations", "W16", sql("v_track_series", """
sh AS (SELECT * REPLACE (eig1 + 0.01234567 AS eig1) FROM v_track_series),
p AS (SELECT *, atan2(eig2, eig1) AS ph FROM sh WHERE eig1 IS NOT NULL AND eig2 IS NOT NULL),
l AS (SELECT *, ph - lag(ph) OVER w AS st, sqrt((eig1 - lag(eig1) OVER w) ** 2 + (eig2 - lag(eig2) OVER w) ** 2) AS seg FROM p
  WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame, row_id)),
u AS (SELECT *, st - 2 * pi() * floor((st + pi()) / (2 * pi())) AS wr FROM l),
g AS (SELECT video_id, track_id, count(*) AS n, abs(sum(CASE WHEN wr = -pi() AND st > 0 THEN pi() ELSE wr END)) AS tn, sum(seg) AS pa,
  stddev_pop(sqrt(eig1 ** 2 + eig2 ** 2)) AS am FROM u GROUP BY 1, 2)
SELECT video_id, track_id, round(CASE WHEN n >= 10 THEN tn / (2 * pi()) * 30 / (n / 10.0) END, 6) AS rotations_30s,
  round(CASE WHEN n >= 10 THEN CASE WHEN am < 1e-6 THEN 0 ELSE pa / (2 * pi() * am) * 30 / (n / 10.0) END END, 6) AS path_bends_30s FROM g"""))
def phase_rotations(spark, sf):
    s = A.track_series(spark, sf).withColumn("eig1", F.col("eig1") + 0.01234567)   # no two phases exactly opposite
    return _r(W.phase_rotations(s, "eig1", "eig2", FPS), ["rotations_30s", "path_bends_30s"])


def _peaks_of(value, prominence):
    """The peak CTEs for another signal of the track series."""
    return _PEAKS.replace("(x - 50) / 50 AS angle", f"{value} AS angle").replace("v_track_points WHERE x IS NOT NULL", f"v_track_series WHERE ({value}) IS NOT NULL").replace(
        "prom >= 0.3", f"prom >= {prominence}")


def _peak_bends_sql(value, prominence):
    return _peaks_of(value, prominence) + f""",
n AS (SELECT video_id, track_id, count({value}) AS n FROM v_track_series GROUP BY 1, 2),
h AS (SELECT video_id, track_id, count(*) AS hb FROM pk GROUP BY 1, 2)
SELECT video_id, track_id, round(CASE WHEN n >= 10 THEN coalesce(hb, 0) / 2.0::DOUBLE * 30 / (n / 10.0::DOUBLE) END, 6) AS bends_30s FROM n LEFT JOIN h USING (video_id, track_id)"""


@query("curvature_bends", "W16", sql("v_track_series", _peak_bends_sql("speed / 50", 0.25)))
def curvature_bends(spark, sf):
    s = A.track_series(spark, sf).withColumn("curvature", F.col("speed") / 50)
    return _r(T.peak_bends(s, "curvature", FPS, 0.25), ["bends_30s"])


_EIG = "CASE WHEN was_skeletonized = 1 THEN eig1 END"


@query("eigen_bends", "W16", sql("v_track_series", _peak_bends_sql(_EIG, 0.4)))
def eigen_bends(spark, sf):
    s = A.track_series(spark, sf).withColumn("eig", F.when(F.col("was_skeletonized") == 1, F.col("eig1")))
    return _r(T.peak_bends(s, "eig", FPS, 0.4), ["bends_30s"])


# --- diagnostics ---------------------------------------------------------------------

@query("fragment_validity", "A30", sql("v_track_series v_track_points", """
p AS (SELECT s.*, t.x, t.y, was_skeletonized = 1 AS v, lag(was_skeletonized = 1) OVER w AS pv FROM v_track_series s JOIN v_track_points t USING (video_id, track_id, frame, row_id)
  WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame, row_id))
SELECT video_id, track_id, count(*) AS n_frames, round(avg(CAST(v AS DOUBLE)), 6) AS valid_fraction, count(*) FILTER (v <> pv) AS transitions,
  round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y FROM p GROUP BY 1, 2"""))
def fragment_validity(spark, sf):
    s = A.track_points(spark, sf).withColumnRenamed("has_skeleton", "was_skeletonized")
    return _r(T.fragment_validity(s), ["valid_fraction", "mean_x", "mean_y"])


@query("continuity", "A28 A29", sql("v_track_series", _RUNS + """,
b AS (SELECT video_id, track_id, max(n_rows / 10.0) AS best, sum(CASE WHEN n_rows >= 100 THEN n_rows / 10.0 ELSE 0 END) AS i10,
   sum(CASE WHEN n_rows >= 300 THEN n_rows / 10.0 ELSE 0 END) AS i30, sum(CASE WHEN n_rows >= 600 THEN n_rows / 10.0 ELSE 0 END) AS i60 FROM cr GROUP BY 1, 2),
f AS (SELECT video_id, track_id, count(*) / 10.0::DOUBLE AS dur, avg(CAST(was_skeletonized = 1 AS DOUBLE)) AS vf FROM v_track_series GROUP BY 1, 2)
SELECT video_id, count(*) AS total_fragments, round(avg(dur), 6) AS mean_fragment_duration_s, round(avg(vf), 6) AS mean_valid_skeleton_fraction,
  count(*) FILTER (best >= 5) AS fragments_with_5s_continuous, count(*) FILTER (best >= 10) AS fragments_with_10s_continuous,
  count(*) FILTER (best >= 15) AS fragments_with_15s_continuous, count(*) FILTER (best >= 30) AS fragments_with_30s_continuous,
  count(*) FILTER (best >= 60) AS fragments_with_60s_continuous, round(coalesce(sum(i10), 0)::DOUBLE, 2) AS total_seconds_in_10s_runs,
  round(coalesce(sum(i30), 0)::DOUBLE, 2) AS total_seconds_in_30s_runs, round(coalesce(sum(i60), 0)::DOUBLE, 2) AS total_seconds_in_60s_runs,
  round(quantile_cont(dur, 0.5), 6) AS median_fragment_duration_s FROM f LEFT JOIN b USING (video_id, track_id) GROUP BY 1"""))
def continuity(spark, sf):
    s = A.track_series(spark, sf)
    per = s.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_frames"), F.avg(_good().cast("double")).alias("valid_fraction"))
    d = T.continuity(per, W.consecutive_runs(s, _good()), FPS)
    d = _r(d, [f"total_seconds_in_{t}s_runs" for t in (10, 30, 60)], 2)
    return _r(d, ["mean_fragment_duration_s", "mean_valid_skeleton_fraction", "median_fragment_duration_s"])


_FIELDS = ["speed", "length", "width_midbody", "solidity", "eig1"]
_LONG = """lo AS (UNPIVOT (SELECT video_id, was_skeletonized AS f, speed, length, width_midbody::DOUBLE AS width_midbody, solidity, eig1 FROM v_track_series)
  ON speed, length, width_midbody, solidity, eig1 INTO NAME field VALUE value)"""


@query("flag_profile", "A32", sql("v_track_series", _LONG + """
SELECT field, f AS was_skeletonized, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max
FROM lo GROUP BY 1, 2"""))
def flag_profile(spark, sf):
    return _r(T.flag_profile(A.track_series(spark, sf), "was_skeletonized", _FIELDS), ["mean", "std", "min", "max"])


@query("effect_size", "A37", sql("v_track_series", _LONG + """,
g AS (SELECT video_id, field, avg(value) FILTER (f = 1) AS am, avg(value) FILTER (f = 0) AS rm, stddev_pop(value) FILTER (f = 1) AS sa, stddev_pop(value) FILTER (f = 0) AS sr FROM lo GROUP BY 1, 2),
d AS (SELECT *, coalesce(abs(am - rm) / nullif(sqrt((sa ** 2 + sr ** 2) / 2), 0), 0) AS d FROM g WHERE am IS NOT NULL AND rm IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY d DESC, field) AS rank_no FROM d)
SELECT video_id, field, round(d, 6) AS d, round(am, 6) AS acc_mean, round(rm, 6) AS rej_mean, rank_no FROM r WHERE rank_no <= 4"""))
def effect_size(spark, sf):
    d = T.effect_size(A.track_series(spark, sf), "was_skeletonized", _FIELDS, ["video_id"], top=4)
    return _r(d, ["d", "acc_mean", "rej_mean"])


@query("width_profile", "A38", sql("", """
SELECT flag, field, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM (
  UNPIVOT (SELECT label % 2 AS flag, list_max(w) AS width_max, list_min(w) AS width_min, list_avg(w) AS width_mean, list_stddev_pop(w) AS width_std, list_max(w) / list_min(w) AS width_ratio
    FROM (SELECT label, list_filter(list_transform(embedding, lambda z: z::DOUBLE), lambda z: z > 0) AS w FROM embeddings) WHERE len(w) > 0)
  ON width_max, width_min, width_mean, width_std, width_ratio INTO NAME field VALUE v) GROUP BY 1, 2"""))
def width_profile(spark, sf):
    e = A.table(spark, sf, "embeddings").select((F.col("label") % 2).alias("flag"), F.col("embedding").cast("array<double>").alias("w"))
    return _r(T.array_profile(e, "w", "flag"), ["mean", "std"])


@query("flag_coverage", "A39", sql("v_track_series", """
SELECT video_id, track_id, field, count(*) AS n_rows, CAST(sum(v) AS BIGINT) AS n_set, round(100.0 * sum(v) / count(*), 6) AS pct FROM (
  UNPIVOT (SELECT video_id, track_id, CAST(was_skeletonized = 1 AS INT) AS was_skeletonized, CAST(coalesce(motion_mode = 1, false) AS INT) AS motion_mode FROM v_track_series)
  ON was_skeletonized, motion_mode INTO NAME field VALUE v) GROUP BY 1, 2, 3"""))
def flag_coverage(spark, sf):
    return _r(T.flag_coverage(A.track_series(spark, sf), ["was_skeletonized", "motion_mode"]), ["pct"])


@query("method_calibration", "A31 O3", sql("v_track_series", """
u AS (UNPIVOT (SELECT v_track_series.width_midbody AS manual, eig1 * 5 AS by_phase, length / 8 AS by_length, abs(speed) / 5 AS by_speed FROM v_track_series)
  ON by_phase, by_length, by_speed INTO NAME method VALUE v)
SELECT method, count(v - manual) AS n, round(avg(abs(v - manual)), 6) AS mae, round(avg(v - manual), 6) AS bias FROM u GROUP BY 1 ORDER BY mae, method LIMIT 3"""))
def method_calibration(spark, sf):
    s = A.track_series(spark, sf).select(
        F.col("width_midbody").alias("manual"), (F.col("eig1") * 5).alias("by_phase"), (F.col("length") / 8).alias("by_length"),
        (F.abs("speed") / 5).alias("by_speed"))
    return _r(T.method_calibration(s, "manual", ["by_phase", "by_length", "by_speed"]).limit(3), ["mae", "bias"])


@query("metric_distribution", "A40", sql("v_track_series", """
r AS (SELECT video_id, track_id, avg(abs(speed)) AS mean_speed, avg(length) AS mean_length FROM v_track_series GROUP BY 1, 2),
lo AS (UNPIVOT (SELECT video_id, mean_speed, mean_length FROM r) ON mean_speed, mean_length INTO NAME metric VALUE v),
q AS (SELECT video_id, metric, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) AS q3 FROM lo GROUP BY 1, 2)
SELECT lo.video_id, lo.metric, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3, count(*) AS n,
  round(min(v) FILTER (v >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_lo, round(max(v) FILTER (v <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_hi
FROM lo JOIN q USING (video_id, metric) GROUP BY 1, 2, q1, med, q3"""))
def metric_distribution(spark, sf):
    r = A.track_series(spark, sf).groupBy(*KEYS).agg(F.avg(F.abs("speed")).alias("mean_speed"), F.avg("length").alias("mean_length"))
    d = T.metric_distribution(r, ["video_id"], ["mean_speed", "mean_length"])
    return _r(d, ["q1", "median", "q3", "whisker_lo", "whisker_hi"])


@query("top_tracks", "O2", sql("v_track_points", """
g AS (SELECT video_id, track_id, count(*) AS n_rows, track_id IN (3, 7) AS is_pinned FROM v_track_points GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id, is_pinned ORDER BY n_rows DESC, track_id) AS rn FROM g)
SELECT video_id, track_id, n_rows, is_pinned FROM r WHERE is_pinned OR rn <= 3"""))
def top_tracks(spark, sf):
    return T.top_tracks(A.track_points(spark, sf), 3, pinned=(3, 7))


@query("even_sample", "O5", sql("v_track_points", """
d AS (SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame, row_id) AS ord, count(*) OVER (PARTITION BY video_id, track_id) AS total FROM v_track_points),
p AS (SELECT DISTINCT video_id, track_id, (i * (total - 1)) // greatest(least(10, total) - 1, 1) + 1 AS ord
  FROM (SELECT DISTINCT video_id, track_id, total FROM d), range(0, 10) r(i) WHERE i < least(10, total))
SELECT d.video_id, d.track_id, d.ord, d.row_id FROM d JOIN p USING (video_id, track_id, ord)"""))
def even_sample(spark, sf):
    return T.even_sample(A.track_points(spark, sf), 10).select(*KEYS, "ord", "row_id")
