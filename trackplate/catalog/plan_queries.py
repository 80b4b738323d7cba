"""Whole pipelines and the rules that only appear inside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..core import rnd
from ..operators import assay as S
from ..operators import boxes as B
from ..operators import tracks as T
from ..plans import colonies as CO
from ..plans import crawling as C
from ..plans import motility as M
from ..plans import staging as ST
from .assay_queries import _CPL, _colonies
from .box_queries import ALPHA, FLOORS, NAMES, REFS, SIZES, _GATE, _NAME_LIST, _AREA, _best, _walk_sql
from .registry import query
from .track_queries import _PEAKS, _r
from .views import VIEWS, NEEDS, sql

SET = M.Settings(fps=10.0, max_dist=4.0, min_obs_s=0.8, flicker_std=20.0, long_s=5.0, prominence=0.30)

VIEWS["v_motion"] = """
SELECT p.video_id, p.track_id * 100 + (p.frame // 4) // 120 AS track_id, p.frame // 4 AS frame, p.row_id, p.x, p.y, s.length AS skeleton_length,
  CASE WHEN p.x IS NOT NULL THEN (p.y - 50) / 50 END AS angle, s.length, s.speed, s.solidity, s.motion_mode, s.width_midbody, p.has_skeleton
FROM v_track_points p JOIN v_track_series s USING (row_id)"""
NEEDS["v_motion"] = ["v_track_points", "v_track_series"]


def _motion(spark, sf):
    """Track rows on a coarser axis, cut every 120 frames, with all per-frame measures."""
    p = A.track_points(spark, sf)
    s = A.track_series(spark, sf).select("row_id", "length", "speed", "solidity", "motion_mode", "width_midbody")
    frame = F.floor(F.col("frame") / 4)
    d = p.join(s, "row_id")
    return d.select("video_id", (F.col("track_id") * 100 + F.floor(frame / 120)).alias("track_id"), frame.alias("frame"), "row_id", "x", "y",
                    F.col("length").alias("skeleton_length"), F.when(F.col("x").isNotNull(), (F.col("y") - 50) / 50).alias("angle"),
                    "length", "speed", "solidity", "motion_mode", "width_midbody", "has_skeleton")


def _frag_sql(n: int) -> str:
    return f"""
mf AS (SELECT video_id, track_id, min(frame) AS start_frame, max(frame) AS end_frame, avg(x) FILTER (ra <= {n}) AS sx, avg(y) FILTER (ra <= {n}) AS sy, avg(x) FILTER (rd <= {n}) AS ex, avg(y) FILTER (rd <= {n}) AS ey
  FROM (SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame, row_id) AS ra, row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame DESC, row_id DESC) AS rd FROM v_motion) GROUP BY 1, 2)"""


# peaks of every clean span, with the span folded into the track number
_SUBPEAKS = _PEAKS[_PEAKS.index("va AS"):].replace("(x - 50) / 50 AS angle", "angle").replace("FROM v_track_points WHERE x IS NOT NULL", "FROM sr WHERE angle IS NOT NULL")

_MOTILITY = "RECURSIVE " + _frag_sql(5) + """,
aj AS (SELECT a.video_id, a.track_id AS a, b.track_id AS b FROM mf a JOIN mf b ON a.video_id = b.video_id AND a.track_id <> b.track_id AND b.start_frame - a.end_frame BETWEEN 0 AND 50
  AND sqrt((b.sx - a.ex) ** 2 + (b.sy - a.ey) ** 2) <= 4),
mnb AS (SELECT video_id, a AS u, b AS v FROM aj UNION SELECT video_id, b, a FROM aj),
rc AS (SELECT video_id, track_id AS node, track_id AS other FROM mf UNION SELECT r.video_id, r.node, mnb.v FROM rc r JOIN mnb ON mnb.video_id = r.video_id AND mnb.u = r.other),
cp AS (SELECT video_id, node AS track_id, min(other) AS component FROM rc GROUP BY 1, 2),
dg AS (SELECT c.*, f.start_frame, f.end_frame, dense_rank() OVER (PARTITION BY c.video_id ORDER BY component) - 1 AS group_id,
  (SELECT count(*) FROM aj e WHERE e.video_id = c.video_id AND e.a = c.track_id) AS o, (SELECT count(*) FROM aj e WHERE e.video_id = c.video_id AND e.b = c.track_id) AS i
  FROM cp c JOIN mf f USING (video_id, track_id)),
gi AS (SELECT video_id, group_id, bool_and(o <= 1 AND i <= 1) AS chain, arg_min(track_id, (start_frame, track_id)) AS repr, count(*) AS fc, min(start_frame) AS fa, max(end_frame) AS fb FROM dg GROUP BY 1, 2),
fl AS (SELECT *, coalesce(stddev_pop(skeleton_length) OVER (PARTITION BY video_id, track_id ORDER BY frame, row_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0) AS sd FROM v_motion),
mk AS (SELECT *, skeleton_length IS NULL OR sd > 20 AS bad FROM fl),
sg AS (SELECT *, sum(CAST(bad AS INT)) OVER (PARTITION BY video_id, track_id ORDER BY frame, row_id ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM mk),
sn AS (SELECT s.video_id, s.track_id, s.segment, any_value(d.group_id) AS group_id, min(frame) AS a, max(frame) AS b, count(*) AS n FROM sg s JOIN dg d USING (video_id, track_id) WHERE NOT bad GROUP BY 1, 2, 3),
ch AS (SELECT gi.*, coalesce(sum(n), 0)::BIGINT AS clean FROM gi LEFT JOIN sn USING (video_id, group_id) WHERE chain GROUP BY ALL),
cs AS (SELECT sn.* FROM sn JOIN gi USING (video_id, group_id) WHERE NOT chain),
cf AS (SELECT video_id, group_id, a AS f FROM cs UNION SELECT video_id, group_id, b FROM cs),
al AS (SELECT cs.*, f, row_number() OVER (PARTITION BY video_id, group_id, f ORDER BY n DESC, track_id, segment) AS rn, count(*) OVER (PARTITION BY video_id, group_id, f) AS na
  FROM cs JOIN cf USING (video_id, group_id) WHERE f BETWEEN a AND b),
ck AS (SELECT video_id, group_id, least(greatest(max(na), 1), 3) AS nk FROM al GROUP BY 1, 2),
cn AS (SELECT video_id, group_id, count(*) AS have FROM cs GROUP BY 1, 2),
bt AS (SELECT video_id, group_id, f, sum(n) AS total FROM al JOIN ck USING (video_id, group_id) WHERE rn <= nk AND na >= nk GROUP BY 1, 2, 3),
bf AS (SELECT video_id, group_id, arg_max(f, (total, -f)) AS f FROM bt GROUP BY 1, 2),
cx AS (SELECT cs.* FROM cs JOIN ck USING (video_id, group_id) JOIN cn USING (video_id, group_id) WHERE have <= nk
  UNION ALL SELECT al.video_id, al.track_id, al.segment, al.group_id, al.a, al.b, al.n FROM al JOIN ck USING (video_id, group_id) JOIN cn USING (video_id, group_id) JOIN bf USING (video_id, group_id, f) WHERE have > nk AND rn <= nk),
un AS (SELECT video_id, group_id, -1 AS ut, -1 AS us, 'chain' AS classification, repr AS track_id, clean AS frames, fc - 1 AS curl_count, fc AS fragment_count, greatest((fb - fa) / 10.0::DOUBLE, 1e-9) AS duration FROM ch WHERE clean >= 8
  UNION ALL SELECT video_id, group_id, track_id, segment, 'collision', track_id, n, 0, 1, n / 10.0::DOUBLE FROM cx WHERE n >= 8),
fe AS (SELECT sn.video_id, sn.track_id, sn.segment, sn.group_id, -1 AS ut, -1 AS us FROM sn JOIN un ON un.video_id = sn.video_id AND un.group_id = sn.group_id AND un.ut = -1
  UNION ALL SELECT video_id, ut, us, group_id, ut, us FROM un WHERE ut >= 0),
ru0 AS (SELECT s.video_id, s.track_id, s.segment, s.frame, s.row_id, s.x, s.y, s.angle, fe.group_id, fe.ut, fe.us FROM sg s JOIN fe USING (video_id, track_id, segment) WHERE NOT bad),
sr AS (SELECT video_id, track_id * 1000 + segment AS track_id, frame, row_id, angle FROM ru0),
""" + _SUBPEAKS.replace("ch AS (", "pch AS (").replace("FROM ch)", "FROM pch)").replace("sg AS (", "psg AS (").replace("FROM sg)", "FROM psg)").replace("JOIN sg s", "JOIN psg s") + """,
fk AS (SELECT *, track_id * 1000 + segment AS sub FROM fe),
hb AS (SELECT fk.video_id, fk.group_id, ut, us, count(*) AS hb FROM pk JOIN fk ON fk.video_id = pk.video_id AND fk.sub = pk.track_id GROUP BY 1, 2, 3, 4),
nv AS (SELECT fk.video_id, fk.group_id, ut, us, sum(n) AS nv FROM (SELECT video_id, track_id, count(*) AS n FROM dt GROUP BY 1, 2) d JOIN fk ON fk.video_id = d.video_id AND fk.sub = d.track_id GROUP BY 1, 2, 3, 4),
gp AS (SELECT fk.video_id, fk.group_id, ut, us, (frame - lag(frame) OVER (PARTITION BY fk.video_id, fk.group_id, ut, us ORDER BY frame, ord, sign)) / 10.0::DOUBLE AS gap FROM pk JOIN fk ON fk.video_id = pk.video_id AND fk.sub = pk.track_id),
vc AS (SELECT video_id, group_id, ut, us, CASE WHEN count(*) >= 3 AND avg(gap) >= 1e-9 THEN stddev_pop(gap) / avg(gap) END AS cv FROM gp GROUP BY 1, 2, 3, 4),
dp AS (SELECT a.video_id, a.group_id, a.ut, a.us, max(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS disp FROM ru0 a JOIN ru0 b ON a.video_id = b.video_id AND a.group_id = b.group_id AND a.ut = b.ut AND a.us = b.us GROUP BY 1, 2, 3, 4),
bl AS (SELECT d.video_id, d.track_id, d.group_id, -1 AS ut, -1 AS us FROM dg d JOIN un ON un.video_id = d.video_id AND un.group_id = d.group_id AND un.ut = -1 UNION ALL SELECT video_id, ut, group_id, ut, us FROM un WHERE ut >= 0),
sh AS (SELECT video_id, group_id, ut, us, CASE WHEN count(length) >= 10 AND avg(length) > 0 THEN stddev_pop(length) / avg(length) END AS lcv, quantile_cont(solidity, 0.5) AS sol, quantile_cont(abs(speed), 0.5) AS spd
  FROM v_motion JOIN bl USING (video_id, track_id) GROUP BY 1, 2, 3, 4),
tf AS (SELECT video_id, max(frame) + 1 AS total FROM v_motion GROUP BY 1),
rw AS (SELECT un.video_id, un.group_id, un.ut AS unit_track, un.us AS unit_segment, classification, track_id AS repr_track_id, frames, curl_count, fragment_count, duration >= 5 AS is_long, round(duration, 3) AS duration_s,
  round(coalesce(hb, 0) / 2.0::DOUBLE / ((CASE WHEN classification = 'chain' THEN frames ELSE nv END) / 600.0::DOUBLE), 2) AS bpm, cv AS bend_interval_cv, round(frames / total * 100, 1) AS coverage_pct,
  round(CASE WHEN classification = 'chain' THEN least(frames / 10.0::DOUBLE / duration, 1) ELSE 1 END, 3) AS valid_frac, round(coalesce(disp, 0), 1) AS displacement_px, round(lcv, 4) AS length_cv, round(sol, 4) AS solidity_median, round(spd, 2) AS speed_median_abs
  FROM un LEFT JOIN hb USING (video_id, group_id, ut, us) LEFT JOIN nv USING (video_id, group_id, ut, us) LEFT JOIN vc USING (video_id, group_id, ut, us) LEFT JOIN dp USING (video_id, group_id, ut, us) LEFT JOIN sh USING (video_id, group_id, ut, us) JOIN tf USING (video_id)
  WHERE classification = 'chain' OR nv IS NOT NULL),
ro AS (SELECT *, CASE WHEN displacement_px < 8 AND bpm < 5 THEN 'rule1' WHEN length_cv > 0.10 AND solidity_median > 0.6 AND speed_median_abs < 10 THEN 'rule2' END AS debris_rule FROM rw),
kp AS (SELECT * FROM ro WHERE debris_rule IS NULL)"""


def _run(spark, sf):
    return M.motility(_motion(spark, sf), SET)


@query("motility_units", "F2 F3 F5 A2 A3 A4 A5", sql("v_motion", _MOTILITY + """
SELECT video_id, group_id, unit_track, unit_segment, classification, repr_track_id, frames, curl_count, fragment_count, is_long, duration_s, bpm, round(bend_interval_cv, 6) AS bend_interval_cv,
  coverage_pct, valid_frac, displacement_px, length_cv, solidity_median, speed_median_abs, debris_rule FROM ro"""))
def motility_units(spark, sf):
    return _r(_run(spark, sf).units, ["bend_interval_cv"])


def _agg_sql(fn, c, d=2):
    return f"round({fn}({c}) FILTER (is_long), {d})"


# a failed video without rows beside each, and one that failed after it left some
_VIDEO_SQL = """SELECT DISTINCT video_id, CASE WHEN video_id = (SELECT min(video_id) FROM v_motion) THEN 'tracker stopped' END AS error FROM v_motion
  UNION ALL SELECT DISTINCT video_id || ' copy', 'unreadable' FROM v_motion"""


def _videos(d):
    v = d.select("video_id").distinct()
    first = v.agg(F.min("video_id")).scalar()
    return v.withColumn("error", F.when(F.col("video_id") == first, "tracker stopped")).unionByName(
        v.select(F.concat("video_id", F.lit(" copy")).alias("video_id"), F.lit("unreadable").alias("error")))


@query("motility_summary", "A10 U1", sql("v_motion", _MOTILITY + f"""
SELECT v.video_id, count(k.video_id) AS n_fragments_total, count(*) FILTER (is_long) AS n_fragments_long, {_agg_sql('avg', 'bpm')} AS bpm_mean_long, {_agg_sql('stddev_pop', 'bpm')} AS bpm_std_long,
  {_agg_sql('min', 'bpm')} AS bpm_min_long, {_agg_sql('max', 'bpm')} AS bpm_max_long, {_agg_sql('avg', 'bend_interval_cv', 4)} AS bend_cv_mean_long,
  count(*) FILTER (is_long AND classification = 'chain') AS n_curl_long, count(*) FILTER (is_long AND classification = 'collision') AS n_collision_long,
  {_agg_sql('avg', 'valid_frac', 3)} AS mean_valid_frac_long, {_agg_sql('avg', 'fragment_count', 2)} AS mean_fragment_count_long, {_agg_sql('median', 'bpm')} AS bpm_median_long,
  {_agg_sql('median', 'bend_interval_cv', 4)} AS bend_cv_median_long, {_agg_sql('median', 'length_cv', 4)} AS length_cv_median_long, {_agg_sql('median', 'solidity_median', 4)} AS solidity_median_long,
  {_agg_sql('median', 'speed_median_abs', 4)} AS speed_median_abs_median_long, any_value(v.error) AS error
FROM ({_VIDEO_SQL}) v LEFT JOIN kp k ON k.video_id = v.video_id AND v.error IS NULL GROUP BY 1"""))
def motility_summary(spark, sf):
    m = _run(spark, sf)
    return M.video_summary(M.kept(m), _videos(m.frames))


@query("drop_funnel", "A12 F3", sql("v_motion", _MOTILITY + """,
sx AS (SELECT video_id, group_id, 'curl_too_short' AS reason FROM ch WHERE clean < 8 AND clean > 0 UNION ALL SELECT video_id, group_id, 'flicker_killed_track' FROM ch WHERE clean = 0
  UNION ALL SELECT d.video_id, d.group_id, 'collision_too_short' FROM dg d JOIN gi USING (video_id, group_id) WHERE NOT chain AND NOT EXISTS (SELECT 1 FROM cs WHERE cs.video_id = d.video_id AND cs.group_id = d.group_id)
  UNION ALL SELECT video_id, group_id, 'collision_too_short' FROM cx WHERE n < 8 UNION ALL SELECT video_id, group_id, 'debris' FROM ro WHERE debris_rule IS NOT NULL),
ec AS (SELECT video_id, group_id, count(*) AS k FROM ro WHERE classification = 'collision' GROUP BY 1, 2),
fs AS (SELECT video_id, track_id, count(*) FILTER (bad) AS n FROM mk GROUP BY 1, 2)
SELECT video_id, 'input_tracks' AS section, 'all' AS name, count(*) AS n FROM dg GROUP BY 1
UNION ALL SELECT video_id, 'groups', CASE WHEN chain THEN 'chain' ELSE 'collision' END, count(*) FROM gi GROUP BY 1, 3
UNION ALL SELECT video_id, 'fragments_per_group', CAST(fc AS VARCHAR), count(*) FROM gi GROUP BY 1, 3
UNION ALL SELECT video_id, 'dropped', reason, count(*) FROM sx GROUP BY 1, 3
UNION ALL SELECT video_id, 'animals_per_cluster', CAST(k AS VARCHAR), count(*) FROM ec GROUP BY 1, 3
UNION ALL SELECT video_id, 'multi_clusters', 'all', count(*) FROM ec WHERE k > 1 GROUP BY 1
UNION ALL SELECT video_id, 'tracks_with_flicker', 'all', count(*) FROM fs WHERE n > 0 GROUP BY 1
UNION ALL SELECT video_id, 'flicker_frames', 'all', CAST(sum(n) AS BIGINT) FROM fs GROUP BY 1"""))
def drop_funnel(spark, sf):
    return M.funnel(_run(spark, sf))


@query("member_map", "V7", sql("v_motion", _MOTILITY + """
SELECT DISTINCT video_id, unit_track AS track_id, group_id FROM kp WHERE unit_track >= 0
UNION ALL SELECT d.video_id, d.track_id, d.group_id FROM dg d JOIN kp ON kp.video_id = d.video_id AND kp.group_id = d.group_id WHERE unit_track < 0"""))
def member_map(spark, sf):
    return M.member_map(_run(spark, sf))


@query("pipeline_metrics", "A29", sql("v_motion", _MOTILITY + """,
fs AS (SELECT video_id, track_id, count(*) FILTER (bad) AS n FROM mk GROUP BY 1, 2),
fv AS (SELECT video_id, CAST(sum(n) AS BIGINT) AS total_flicker_frames, count(*) FILTER (n > 0) AS tracks_with_any_flicker, count(*) AS c FROM fs GROUP BY 1)
SELECT video_id, total_flicker_frames, tracks_with_any_flicker, round(tracks_with_any_flicker / c, 4) AS tracks_with_any_flicker_frac,
  (SELECT count(*) FROM kp WHERE kp.video_id = fv.video_id) AS pipeline_surviving_tracks, round((SELECT avg(bpm) FROM kp WHERE kp.video_id = fv.video_id), 6) AS bpm_mean_surviving,
  round((SELECT median(bpm) FROM kp WHERE kp.video_id = fv.video_id), 6) AS bpm_median_surviving FROM fv"""))
def pipeline_metrics(spark, sf):
    m = _run(spark, sf)
    return _r(M.pipeline_metrics(m, m.frames.select("video_id").distinct()), ["bpm_mean_surviving", "bpm_median_surviving"])


@query("sweep_comparison", "A29 U1", sql("v_motion", _MOTILITY + f""",
fs AS (SELECT video_id, track_id, count(*) FILTER (bad) AS n FROM mk GROUP BY 1, 2),
fv AS (SELECT video_id, CAST(sum(n) AS BIGINT) AS total_flicker_frames, count(*) FILTER (n > 0) AS tracks_with_any_flicker, count(*) AS c FROM fs GROUP BY 1),
vr AS (SELECT 'run-1' AS run_id, 'baseline' AS param_changed, '' AS param_value, video_id, NULL::VARCHAR AS error FROM (SELECT DISTINCT video_id FROM v_motion)
  UNION ALL SELECT 'run-2', 'attempt', '2', video_id, error FROM ({_VIDEO_SQL}))
SELECT vr.*, total_flicker_frames, tracks_with_any_flicker, round(tracks_with_any_flicker / c, 4) AS tracks_with_any_flicker_frac,
  CASE WHEN vr.error IS NULL THEN (SELECT count(*) FROM kp WHERE kp.video_id = vr.video_id) END AS pipeline_surviving_tracks,
  round((SELECT avg(bpm) FROM kp WHERE kp.video_id = fv.video_id), 6) AS bpm_mean_surviving, round((SELECT median(bpm) FROM kp WHERE kp.video_id = fv.video_id), 6) AS bpm_median_surviving
FROM vr LEFT JOIN fv ON fv.video_id = vr.video_id AND vr.error IS NULL"""))
def sweep_comparison(spark, sf):
    m = _run(spark, sf)
    sound = m.frames.select("video_id").distinct().withColumn("error", F.lit(None).cast("string"))
    runs = [M.Run("run-1", "baseline", "", m, sound), M.Run("run-2", "attempt", "2", m, _videos(m.frames))]
    return _r(M.sweep_comparison(runs), ["bpm_mean_surviving", "bpm_median_surviving"])


@query("debris_filter", "F2", sql("v_track_series", """
g AS (SELECT video_id, track_id, stddev_pop(length) / avg(length) * 0.9 AS cv, quantile_cont(solidity, 0.5) AS sol, quantile_cont(abs(speed), 0.5) AS spd, max(speed) - min(speed) AS disp, avg(motion_mode) AS bpm FROM v_track_series GROUP BY 1, 2)
SELECT video_id, track_id, CASE WHEN disp < 150 AND bpm < 0.05 THEN 'rule1' WHEN cv > 0.09 AND sol > 0.7 AND spd < 40 THEN 'rule2' END AS debris_rule FROM g"""))
def debris_filter(spark, sf):
    s = A.track_series(spark, sf)
    k = ["video_id", "track_id"]
    g = s.groupBy(*k).agg((F.stddev_pop("length") / F.avg("length") * 0.9).alias("cv"), (F.max("speed") - F.min("speed")).alias("disp"), F.avg("motion_mode").alias("bpm"))
    g = g.join(T.shape_metrics(s).select(*k, "solidity_median", "speed_median_abs"), k)
    rule = S.debris_rule(F.col("disp") * 8.0 / 150, F.col("bpm") * 5.0 / 0.05, F.col("cv") * 0.10 / 0.09, F.col("solidity_median") * 0.6 / 0.7, F.col("speed_median_abs") * 10.0 / 40)
    return g.select(*k, rule.alias("debris_rule"))


# --- crawling --------------------------------------------------------------------------

_CRAWL = "RECURSIVE " + _frag_sql(3) + """,
cand AS (SELECT a.video_id, a.track_id AS a, b.track_id AS b, a.end_frame AS a_end, b.start_frame AS b_start, sqrt((b.sx - a.ex) ** 2 + (b.sy - a.ey) ** 2) AS dist
  FROM mf a JOIN mf b ON a.video_id = b.video_id AND a.track_id <> b.track_id AND b.start_frame - a.end_frame BETWEEN 1 AND 50 AND sqrt((b.sx - a.ex) ** 2 + (b.sy - a.ey) ** 2) <= 12),
"""


def _crawl_links():
    from .fragment_queries import _LINK
    return _LINK[_LINK.index("lists AS"):]


_CRAWL = _CRAWL + _crawl_links() + """,
far AS (SELECT video_id, track_id, track_id AS last FROM mf UNION SELECT f.video_id, f.track_id, l.b FROM far f JOIN links l ON l.video_id = f.video_id AND l.a = f.last AND l.b IS NOT NULL),
gr AS (SELECT f.video_id, f.track_id, arg_max(last, start_frame) AS group_id FROM far f JOIN mf s ON s.video_id = f.video_id AND s.track_id = f.last GROUP BY 1, 2),
en AS (SELECT video_id, group_id, arg_min(mf.track_id, (start_frame, mf.track_id)) AS repr_track_id, count(*) AS n_members, (max(end_frame) - min(start_frame) + 1) / 10.0::DOUBLE AS track_duration_s FROM mf JOIN gr USING (video_id, track_id) GROUP BY 1, 2),
mo AS (SELECT m.*, group_id FROM v_motion m JOIN gr USING (video_id, track_id)),
th AS (SELECT video_id, 0.1 * quantile_cont(abs(speed), 0.5) AS th FROM v_motion GROUP BY 1),
ki AS (SELECT video_id, group_id, count(speed) AS n_speed, avg(abs(speed)) AS mean_speed_pxs, CASE WHEN count(speed) > 0 THEN coalesce(avg(speed) FILTER (speed > 0), 0) END AS fwd, avg(CAST(abs(speed) < th AS DOUBLE)) AS fraction_paused, avg(length) AS mean_length_px FROM mo JOIN th USING (video_id) GROUP BY 1, 2),
us AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY mean_length_px) AS rn, count(*) OVER (PARTITION BY video_id) AS n FROM (
  SELECT video_id, mean_length_px, track_duration_s, count(*) FILTER (track_duration_s >= 10) OVER (PARTITION BY video_id) AS ns FROM ki JOIN en USING (video_id, group_id) WHERE mean_length_px IS NOT NULL) WHERE ns < 5 OR track_duration_s >= 10),
pm AS (SELECT video_id, avg(mean_length_px) AS plate_mean_length_px FROM us WHERE n - 2 * floor(n * 0.1) <= 0 OR (rn > floor(n * 0.1) AND rn <= n - floor(n * 0.1)) GROUP BY 1),
pp AS (SELECT *, lag(frame) OVER w AS pf, lag(x) OVER w AS px, lag(y) OVER w AS py FROM mo WHERE x IS NOT NULL AND y IS NOT NULL WINDOW w AS (PARTITION BY video_id, group_id ORDER BY frame, row_id)),
pg AS (SELECT video_id, group_id, sum(CASE WHEN frame - pf = 1 THEN sqrt((x - px) ** 2 + (y - py) ** 2) ELSE 0 END) AS path_length_px FROM pp GROUP BY 1, 2),
co AS (SELECT video_id, group_id, avg(has_skeleton) AS skeleton_coverage FROM mo GROUP BY 1, 2),
rl AS (SELECT video_id, group_id, frame, arg_max(coalesce(motion_mode, 9), row_id) AS mm FROM mo GROUP BY 1, 2, 3),
rz AS (SELECT *, sum(CASE WHEN mm = 9 OR frame - pf <> 1 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, group_id ORDER BY frame) AS holes, sum(CASE WHEN mm = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, group_id ORDER BY frame) AS pauses
  FROM (SELECT *, lag(frame) OVER (PARTITION BY video_id, group_id ORDER BY frame) AS pf FROM rl)),
rm AS (SELECT *, lag(mm) OVER w AS pm, lag(holes) OVER w AS ph, lag(pauses) OVER w AS pq FROM rz WHERE mm IN (1, -1) WINDOW w AS (PARTITION BY video_id, group_id ORDER BY frame)),
rv AS (SELECT video_id, group_id, count(*) AS r FROM rm WHERE mm = -1 AND pm = 1 AND holes = ph AND pauses - pq <= 60 GROUP BY 1, 2)"""


def _crawl(spark, sf):
    d = _motion(spark, sf)
    return C.crawling(d, d.select("video_id", "track_id", "frame", "row_id", "speed", "motion_mode", "length", "width_midbody"),
                      fps=10.0, max_dist=12.0, min_span_s=10.0)


@query("crawling_tracks", "A6 A7 A8 A9 W7 X15 X25 G5", sql("v_motion", _CRAWL + """
SELECT video_id, group_id, repr_track_id, n_members, round(track_duration_s, 6) AS track_duration_s, n_members > 1 AS linked, round(mean_speed_pxs, 9) AS mean_speed_pxs, round(fwd, 9) AS mean_forward_speed_pxs, round(fraction_paused, 6) AS fraction_paused,
  round(mean_length_px, 9) AS mean_length_px, round(plate_mean_length_px, 6) AS plate_mean_length_px, round(mean_speed_pxs / plate_mean_length_px, 6) AS mean_speed_bls, round(path_length_px, 6) AS path_length_px, round(skeleton_coverage, 6) AS skeleton_coverage,
  CASE WHEN n_speed > 0 THEN coalesce(r, 0) END AS reversal_count, coalesce(track_duration_s >= 10 AND skeleton_coverage >= 0.7, false) AS passed_filter
FROM en JOIN ki USING (video_id, group_id) JOIN pm USING (video_id) LEFT JOIN pg USING (video_id, group_id) JOIN co USING (video_id, group_id) LEFT JOIN rv USING (video_id, group_id)"""))
def crawling_tracks(spark, sf):
    d = _crawl(spark, sf)
    d = d.select("video_id", "group_id", "repr_track_id", "n_members", "track_duration_s", (F.col("n_members") > 1).alias("linked"), "mean_speed_pxs", "mean_forward_speed_pxs",
                 "fraction_paused", "mean_length_px", "plate_mean_length_px", "mean_speed_bls", "path_length_px", "skeleton_coverage", "reversal_count", "passed_filter")
    d = _r(d, ["track_duration_s", "fraction_paused", "plate_mean_length_px", "mean_speed_bls", "path_length_px", "skeleton_coverage"])
    return _r(d, ["mean_speed_pxs", "mean_forward_speed_pxs", "mean_length_px"], 9)


@query("condition_aggregate", "A11", sql("v_track_series v_track_points", """
tr AS (SELECT s.video_id, s.track_id, s.track_id % 3 AS condition, avg(abs(speed)) AS mean_speed_pxs, avg(length) AS mean_length_px, stddev_pop(abs(speed)) / avg(abs(speed)) AS speed_cv, (max(s.frame) - min(s.frame) + 1) / 10.0::DOUBLE AS sp, avg(has_skeleton) AS cv
  FROM v_track_series s JOIN v_track_points p USING (row_id) GROUP BY 1, 2),
kp AS (SELECT *, sp >= 285 AND cv >= 0.7 AS ok FROM tr),
n AS (SELECT condition, count(*) AS n_total, count(*) FILTER (ok) AS n_kept FROM kp GROUP BY 1),
lo AS (UNPIVOT (SELECT condition, mean_speed_pxs, mean_length_px, speed_cv FROM kp WHERE ok) ON mean_speed_pxs, mean_length_px, speed_cv INTO NAME metric VALUE v)
SELECT n.condition, m.metric, n_total, n_kept, count(v) AS n, round(CASE WHEN m.metric <> 'speed_cv' THEN avg(v) END, 9) AS mean, round(CASE WHEN m.metric <> 'speed_cv' THEN stddev_pop(v) END, 9) AS std, round(median(v), 9) AS median
FROM n CROSS JOIN (SELECT unnest(['mean_speed_pxs', 'mean_length_px', 'speed_cv']) AS metric) m LEFT JOIN lo ON lo.condition = n.condition AND lo.metric = m.metric GROUP BY n.condition, m.metric, n_total, n_kept"""))
def condition_aggregate(spark, sf):
    s = A.track_series(spark, sf).join(A.track_points(spark, sf).select("row_id", "has_skeleton"), "row_id")
    a = F.abs("speed")
    g = s.groupBy("video_id", "track_id").agg(
        F.avg(a).alias("mean_speed_pxs"), F.avg("length").alias("mean_length_px"), (F.stddev_pop(a) / F.avg(a)).alias("speed_cv"),
        ((F.max("frame") - F.min("frame") + 1) / F.lit(10.0)).alias("track_duration_s"), F.avg("has_skeleton").alias("skeleton_coverage"))
    d = C.condition_rows(g.withColumn("condition", F.col("track_id") % 3), 285.0, ["mean_speed_pxs", "mean_length_px"], ["speed_cv"])
    return _r(d, ["mean", "std", "median"], 9)


_SHOWN = ["mean_speed_pxs", "fraction_paused", "path_length_px", "track_duration_s", "skeleton_coverage", "reversal_count"]


@query("crawling_conditions", "A11", sql("v_motion", _CRAWL + """,
ok AS (SELECT en.video_id AS condition, mean_speed_pxs, fraction_paused, path_length_px, track_duration_s, skeleton_coverage, (CASE WHEN n_speed > 0 THEN coalesce(r, 0) END)::DOUBLE AS reversal_count
  FROM en JOIN ki USING (video_id, group_id) LEFT JOIN pg USING (video_id, group_id) JOIN co USING (video_id, group_id) LEFT JOIN rv USING (video_id, group_id)),
nn AS (SELECT condition, count(*) AS n_total, count(*) FILTER (track_duration_s >= 10 AND skeleton_coverage >= 0.7) AS n_kept FROM ok GROUP BY 1),
lo AS (UNPIVOT (SELECT * FROM ok WHERE track_duration_s >= 10 AND skeleton_coverage >= 0.7) ON mean_speed_pxs, fraction_paused, path_length_px, track_duration_s, skeleton_coverage, reversal_count INTO NAME metric VALUE v)
SELECT condition, metric, n_total, n_kept, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(median(v), 6) AS median FROM lo JOIN nn USING (condition) GROUP BY 1, 2, 3, 4"""))
def crawling_conditions(spark, sf):
    d = C.condition_rows(_crawl(spark, sf).withColumn("condition", F.col("video_id")), 10.0)
    return _r(d.where(F.col("metric").isin(_SHOWN)), ["mean", "std", "median"])


# --- staging and colonies -------------------------------------------------------------------

_MERGED = ("RECURSIVE " + f"g0 AS (SELECT * FROM v_detections WHERE ({_GATE}) IS NULL),"
           + _walk_sql("g0", "g1", "iou", 0.1, "image_id, cls", "score DESC") + "," + _walk_sql("g1", "g2", "cover", 0.3, "image_id, cls", _AREA) + ","
           + _walk_sql("g2", "g4", "cover", 0.2, "image_id", "score DESC", "n.truncated"))
_STAGED_IMAGES = "SELECT DISTINCT image_id, CASE WHEN image_id % 2 = 0 THEN 'N2 0J' ELSE 'N2 20J' END AS condition, (image_id % 3) * 24.0::DOUBLE AS tp, 'p' || (image_id // 6 % 2) AS plate FROM v_detections"
_STAGED_INDEX = "sum(CASE stage WHEN 'L1' THEN 1 WHEN 'L2' THEN 2 WHEN 'L3' THEN 3 WHEN 'L4' THEN 4 WHEN 'adult' THEN 5 END)"


@query("staging_conditions", "G10 A16 A17", sql("v_detections", _MERGED + f""",
w AS (SELECT image_id, {_best(ALPHA)} AS ws FROM g4),
c AS (SELECT image_id, ({_NAME_LIST})[list_position(ws, list_max(ws))] AS stage FROM w),
i AS ({_STAGED_IMAGES}),
p AS (SELECT i.tp, i.condition, i.plate, count(c.stage) AS total, {_STAGED_INDEX} / nullif(count(c.stage), 0)::DOUBLE AS si FROM i LEFT JOIN c USING (image_id) GROUP BY 1, 2, 3)
SELECT tp, condition, count(*) AS n_plates, CAST(sum(total) AS BIGINT) AS pooled_total, round(avg(si), 6) AS stage_index_mean FROM p GROUP BY 1, 2 HAVING count(*) > 1"""))
def staging_conditions(spark, sf):
    raw = A.detections(spark, sf)
    s = ST.staging(_staged_images(raw), raw, FLOORS, SIZES, NAMES, REFS, ALPHA, ["egg"], B.merge_rules(0.1, 0.3, None, 0.2))
    return s.condition.where("n_plates > 1").select("tp", "condition", "n_plates", "pooled_total", rnd("stage_index_mean").alias("stage_index_mean"))


def _staged_images(raw):
    k = F.col("image_id")
    return raw.select("image_id").distinct().select(
        "image_id", F.concat(F.lit("im"), k.cast("string")).alias("image"), F.when(k % 2 == 0, "N2 0J").otherwise("N2 20J").alias("condition"),
        ((k % 3) * F.lit(24.0)).alias("tp"), F.concat(F.lit("p"), (F.floor(k / 6) % 2).cast("string")).alias("plate"), F.lit(False).alias("has_error"))


def _staged_again(spark, sf):
    """A run over folders of which two earlier runs cover parts; their stored rows lack every fifth box, so what is reused shows.

    Images with an id divisible by 7 changed since. One image name in 13 occurs on several plates. The raw rows of
    images that can be reused are not handed in.
    """
    k = F.col("image_id")
    every = A.detections(spark, sf)
    rules = B.merge_rules(0.1, 0.3, None, 0.2)
    images = _staged_images(every).withColumns({
        "image": F.when(k % 13 == 0, "twice").otherwise(F.col("image")), "folder": F.concat(F.lit("f"), (k % 4).cast("string")),
        "rel": F.concat(F.lit("im"), k.cast("string"))})
    inventory = images.select("folder", "rel", k.alias("size"), F.lit(1.0).alias("mtime"))
    runs = images.withColumn("run_id", F.explode(F.array(F.lit(1), F.lit(2))))
    manifests = runs.where((F.col("run_id") == 1) | (k % 4 == 1)).where("folder <> 'f3'").select(
        "folder", "rel", "run_id", (F.col("run_id") * 100).alias("written"), F.lit("d").alias("digest"), F.lit(True).alias("reusable"), F.lit(True).alias("has_covered"),
        F.when(k % 7 == 0, k + 1).otherwise(k).alias("size"), F.lit(1.0).alias("mtime"), ((F.col("run_id") == 1) | (k % 3 != 0)).alias("covered"), F.lit(False).alias("errored"))
    old = B.merge_detections(every, FLOORS, SIZES, NAMES, REFS, 0.0, ["egg"], rules).where("det_id % 5 <> 0")
    stored = old.join(runs.select("image_id", "folder", "rel", "run_id"), "image_id").drop("image_id")
    again = (k % 4 == 3) | (k % 7 == 0) | ((k % 4 == 1) & (k % 3 == 0))
    return ST.staging(images, every.where(again), FLOORS, SIZES, NAMES, REFS, ALPHA, ["egg"], rules, inventory, manifests, "d", stored)


_AGAIN = _MERGED + f""",
i AS (SELECT *, 'f' || (image_id % 4) AS folder, CASE WHEN image_id % 13 = 0 THEN 'twice' ELSE 'im' || image_id END AS image,
  CASE WHEN image_id % 4 = 3 OR image_id % 7 = 0 OR (image_id % 4 = 1 AND image_id % 3 = 0) THEN NULL WHEN image_id % 4 = 1 THEN 2 ELSE 1 END AS run_id FROM ({_STAGED_IMAGES})),
d AS (SELECT g4.*, i.* EXCLUDE (image_id), {_best(ALPHA)} AS ws FROM g4 JOIN i USING (image_id) WHERE run_id IS NULL OR det_id % 5 <> 0),
c AS (SELECT *, ({_NAME_LIST})[list_position(ws, list_max(ws))] AS stage, sqrt((x2 - x1) * (y2 - y1)) AS size_px FROM d)"""


@query("staging_reuse", "J10 A16 U3", sql("v_detections", _AGAIN + f""",
p AS (SELECT i.tp, i.condition, i.plate, count(c.stage) AS total, {_STAGED_INDEX} / nullif(count(c.stage), 0)::DOUBLE AS si FROM i LEFT JOIN c USING (image_id) GROUP BY 1, 2, 3)
SELECT 'condition' AS kind, condition || ' ' || tp AS name, CAST(sum(total) AS BIGINT) AS n_total, count(*) AS n_part, round(avg(si), 6) AS value FROM p GROUP BY tp, condition HAVING count(*) > 1
UNION ALL SELECT 'folder', folder || coalesce(' run ' || max(run_id), ''), count(*), count(run_id), NULL FROM i GROUP BY folder"""))
def staging_reuse(spark, sf):
    """Conditions of a run that reuses stored rows, and what it reuses by folder."""
    s = _staged_again(spark, sf)
    c = s.condition.where("n_plates > 1").select(
        F.lit("condition").alias("kind"), F.concat_ws(" ", "condition", F.col("tp").cast("string")).alias("name"), F.col("pooled_total").alias("n_total"),
        F.col("n_plates").alias("n_part"), rnd("stage_index_mean").alias("value"))
    run = F.concat(F.lit(" run "), F.col("run_id").cast("string"))
    return c.unionByName(s.reuse.select(
        F.lit("folder").alias("kind"), F.concat("folder", F.coalesce(run, F.lit(""))).alias("name"), F.col("n_images").alias("n_total"),
        F.col("n_reused").alias("n_part"), F.lit(None).cast("double").alias("value")))


@query("staging_sizes", "J7 A18 A17 J11", sql("v_detections", _AGAIN + f""",
lk AS (SELECT tp, image, count(DISTINCT (condition, plate)) AS places FROM i GROUP BY 1, 2),
j AS (SELECT c.*, places FROM c JOIN lk USING (tp, image)),
pl AS (SELECT i.tp, i.condition, i.plate, count(c.stage) AS total FROM i LEFT JOIN c USING (image_id) GROUP BY 1, 2, 3),
q AS (SELECT tp, condition, count(*) AS n, quantile_cont(size_px, 0.5) AS p50 FROM j WHERE places = 1 AND size_px > 0 GROUP BY 1, 2)
SELECT 'join' AS kind, CASE WHEN places > 1 THEN 'ambiguous' ELSE 'joined' END AS name, count(*) AS n, NULL::DOUBLE AS value FROM j GROUP BY 2
UNION ALL SELECT 'size', condition || ' ' || tp, n, round(p50, 6) FROM q
UNION ALL SELECT 'qc', condition || ' ' || tp, sum(total)::BIGINT, round(avg(total), 6) FROM pl GROUP BY tp, condition"""))
def staging_sizes(spark, sf):
    """How boxes met their image rows, the sizes of those that met one, and animals per plate, of the same run."""
    s = _staged_again(spark, sf)
    name = F.concat_ws(" ", "condition", F.col("tp").cast("string")).alias("name")
    return (s.size_joins.select(F.lit("join").alias("kind"), F.col("status").alias("name"), "n", F.lit(None).cast("double").alias("value"))
            .unionByName(s.size_summary.select(F.lit("size").alias("kind"), name, "n", rnd("p50").alias("value")))
            .unionByName(s.qc.select(F.lit("qc").alias("kind"), name, F.col("n_animals_total").alias("n"), rnd("animals_per_plate_mean").alias("value"))))


@query("colony_pipeline", "F4 A21", "WITH " + _CPL + """
SELECT condition, count(*) AS n_plates, round(avg(colony_count), 6) AS colony_count_mean, round(stddev_samp(colony_count), 6) AS colony_count_sd, round(avg(mean_area_mm2), 8) AS mean_area_mm2,
  round(avg(stained_fraction), 6) AS stained_fraction_mean, round(stddev_samp(stained_fraction), 6) AS stained_fraction_sd, count(*) FILTER (stained_fraction > 0.55) AS n_confluent_plates FROM cp GROUP BY 1""")
def colony_pipeline(spark, sf):
    c = CO.colonies(_colonies(spark, sf).drop("reason"), 40.0, 0.8)
    return _r(_r(c.condition, ["mean_area_mm2"], 8), ["colony_count_mean", "colony_count_sd", "stained_fraction_mean", "stained_fraction_sd"])
