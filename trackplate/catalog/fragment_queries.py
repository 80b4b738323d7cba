"""Fragment summaries, adjacency, components and linking."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..core import rnd, settle, written
from ..operators import fragments as FR
from ..operators import graph as G
from .registry import query
from .views import sql

FPS = 10.0


def _frags(spark, sf):
    return FR.fragment_summary(written(A.fragment_points(spark, sf), "fragments"))


def _kept_frags(spark, sf):
    """Fragment rows that several steps read, computed once."""
    return settle(_frags(spark, sf))


def _adjacent(frags):
    return FR.neighbours(frags, min_gap=0, max_gap=int(5 * FPS), max_dist=50.0)


@query("fragment_summary", "A1", sql("v_fragments", """
SELECT video_id, track_id, start_frame, end_frame, n_rows, round(start_x, 6) AS start_x,
  round(start_y, 6) AS start_y, round(end_x, 6) AS end_x, round(end_y, 6) AS end_y FROM v_fragments"""))
def fragment_summary(spark, sf):
    f = _frags(spark, sf)
    return f.select("video_id", "track_id", "start_frame", "end_frame", "n_rows",
                    *[rnd(c).alias(c) for c in ("start_x", "start_y", "end_x", "end_y")])


@query("fragment_adjacency", "J1", sql("v_adjacent", """
SELECT video_id, a, b, gap, round(dist, 6) AS dist FROM v_adjacent"""))
def fragment_adjacency(spark, sf):
    return _adjacent(_frags(spark, sf)).select("video_id", "a", "b", "gap", rnd("dist").alias("dist"))


_CAND = """
cand AS (SELECT a.video_id, a.track_id AS a, b.track_id AS b, a.end_frame AS a_end, b.start_frame AS b_start,
  sqrt((b.start_x - a.end_x) ** 2 + (b.start_y - a.end_y) ** 2) AS dist
  FROM v_fragments a JOIN v_fragments b ON a.video_id = b.video_id AND a.track_id <> b.track_id
  AND b.start_frame - a.end_frame BETWEEN 1 AND 50
  AND sqrt((b.start_x - a.end_x) ** 2 + (b.start_y - a.end_y) ** 2) <= 150)"""


@query("successor_candidates", "J2", sql("v_fragments", _CAND + """
SELECT video_id, a, b, b_start - a_end AS gap, round(dist, 6) AS dist FROM cand"""))
def successor_candidates(spark, sf):
    return FR.successor_candidates(_frags(spark, sf), FPS).select(
        "video_id", "a", "b", "gap", rnd("dist").alias("dist"))


_COMP = """RECURSIVE
nb AS (SELECT video_id, a AS u, b AS v FROM v_adjacent UNION SELECT video_id, b, a FROM v_adjacent),
reach AS (SELECT video_id, track_id AS node, track_id AS other FROM v_fragments
  UNION SELECT r.video_id, r.node, nb.v FROM reach r JOIN nb ON nb.video_id = r.video_id AND nb.u = r.other),
comp AS (SELECT video_id, node AS track_id, min(other) AS component FROM reach GROUP BY 1, 2)"""


@query("fragment_components", "G1", sql("v_adjacent", _COMP + """
SELECT video_id, track_id, component, dense_rank() OVER (PARTITION BY video_id ORDER BY component) - 1 AS group_id
FROM comp"""))
def fragment_components(spark, sf):
    f = _kept_frags(spark, sf)
    return G.number_components(settle(G.connected_components(f, _adjacent(f))))


@query("component_class", "G2", sql("v_adjacent", _COMP + """,
deg AS (SELECT c.*, f.start_frame,
    (SELECT count(*) FROM v_adjacent e WHERE e.video_id = c.video_id AND e.a = c.track_id) AS o,
    (SELECT count(*) FROM v_adjacent e WHERE e.video_id = c.video_id AND e.b = c.track_id) AS i
  FROM comp c JOIN v_fragments f USING (video_id, track_id))
SELECT video_id, component, CASE WHEN bool_and(o <= 1 AND i <= 1) THEN 'chain' ELSE 'collision' END AS classification,
  arg_min(track_id, (start_frame, track_id)) AS repr_track_id,
  CASE WHEN bool_and(o <= 1 AND i <= 1) THEN count(*) - 1 ELSE 0 END AS curl_count, count(*) AS fragment_count
FROM deg GROUP BY 1, 2"""))
def component_class(spark, sf):
    f = _kept_frags(spark, sf)
    adj = settle(_adjacent(f))
    return G.classify_components(f, adj, G.connected_components(f, adj))


# The oracle walks the fragments of each video in order, carrying the claimed set.
_LINK = """RECURSIVE """ + _CAND + """,
lists AS (SELECT video_id, a, a_end, list({'d': dist, 'b': b, 's': b_start} ORDER BY dist, b, b_start) AS c,
    row_number() OVER (PARTITION BY video_id ORDER BY a_end, a) AS rn FROM cand GROUP BY 1, 2, 3),
walk AS (
  SELECT video_id, 0::BIGINT AS rn, NULL::BIGINT AS a, NULL::BIGINT AS b, false AS listed, []::BIGINT[] AS claimed
  FROM lists GROUP BY 1
  UNION ALL
  SELECT video_id, rn, a, pick AS b, listed, CASE WHEN pick IS NULL THEN claimed ELSE list_append(claimed, pick) END
  FROM (SELECT *, len(o) > 0 AS listed,
      CASE WHEN len(o) = 0 THEN NULL
           WHEN NOT (o[1].d < 3 AND coalesce(second, 'inf'::DOUBLE) < 3) AND coalesce(second, 'inf'::DOUBLE) < 2 * o[1].d THEN NULL
           ELSE o[1].b END AS pick
    FROM (SELECT *, list_min(list_transform(list_filter(o[2:], lambda z: abs(z.s - o[1].s) <= 10), lambda z: z.d)) AS second
      FROM (SELECT w.video_id, l.rn, l.a, w.claimed, list_filter(l.c, lambda z: NOT list_contains(w.claimed, z.b)) AS o
            FROM walk w JOIN lists l ON l.video_id = w.video_id AND l.rn = w.rn + 1)))),
links AS (SELECT video_id, a, b FROM walk WHERE listed)"""


@query("successor_links", "G5", sql("v_fragments", _LINK + """
SELECT video_id, a, b FROM links"""))
def successor_links(spark, sf):
    return G.link_fragments(FR.successor_candidates(_kept_frags(spark, sf), FPS), FPS)


@query("linked_groups", "G5 V7", sql("v_fragments", _LINK + """,
far AS (SELECT video_id, track_id, track_id AS last FROM v_fragments
  UNION SELECT f.video_id, f.track_id, l.b FROM far f JOIN links l ON l.video_id = f.video_id AND l.a = f.last AND l.b IS NOT NULL)
SELECT f.video_id, f.track_id, arg_max(last, start_frame) AS group_id FROM far f
JOIN v_fragments s ON s.video_id = f.video_id AND s.track_id = f.last GROUP BY 1, 2"""))
def linked_groups(spark, sf):
    f = _kept_frags(spark, sf)
    links = G.link_fragments(FR.successor_candidates(f, FPS), FPS)
    return G.chain_groups(f, links)


_SPANS = """spans AS (SELECT video_id, track_id, start_frame, end_frame, n_rows FROM v_fragments)"""


@query("alive_at_frame", "J6", sql("v_fragments", _SPANS + """,
fr AS (SELECT DISTINCT video_id, start_frame AS frame FROM spans)
SELECT s.video_id, fr.frame, count(*) AS n_alive, CAST(sum(s.n_rows) AS BIGINT) AS rows_alive
FROM spans s JOIN fr ON fr.video_id = s.video_id AND fr.frame BETWEEN s.start_frame AND s.end_frame GROUP BY 1, 2"""))
def alive_at_frame(spark, sf):
    s = _kept_frags(spark, sf)
    fr = s.select("video_id", F.col("start_frame").alias("frame")).distinct()
    return G.alive_counts(s, fr, ["video_id"], ["n_rows"]).withColumnRenamed("n_rows", "rows_alive")


@query("max_concurrent", "G3", sql("v_fragments", _SPANS + """,
fr AS (SELECT video_id, start_frame AS frame FROM spans UNION SELECT video_id, end_frame FROM spans),
n AS (SELECT s.video_id, fr.frame, count(*) AS n FROM spans s JOIN fr ON fr.video_id = s.video_id
  AND fr.frame BETWEEN s.start_frame AND s.end_frame GROUP BY 1, 2)
SELECT video_id, max(n) AS max_concurrent FROM n GROUP BY 1"""))
def max_concurrent(spark, sf):
    return G.max_concurrent(_kept_frags(spark, sf), ["video_id"])


@query("select_concurrent", "G4", sql("v_fragments", _SPANS + """,
fr AS (SELECT video_id, start_frame AS frame FROM spans UNION SELECT video_id, end_frame FROM spans),
al AS (SELECT s.video_id, fr.frame, s.track_id, s.n_rows, row_number() OVER (PARTITION BY s.video_id, fr.frame
    ORDER BY s.n_rows DESC, s.track_id) AS rn, count(*) OVER (PARTITION BY s.video_id, fr.frame) AS n
  FROM spans s JOIN fr ON fr.video_id = s.video_id AND fr.frame BETWEEN s.start_frame AND s.end_frame),
cap AS (SELECT video_id, least(greatest(max(n), 1), 3) AS n_keep FROM al GROUP BY 1),
best AS (SELECT al.video_id, frame, sum(n_rows) AS total FROM al JOIN cap USING (video_id)
  WHERE rn <= n_keep AND n >= n_keep GROUP BY 1, 2),
pick AS (SELECT video_id, arg_max(frame, (total, -frame)) AS frame FROM best GROUP BY 1)
SELECT al.video_id, al.track_id FROM al JOIN cap USING (video_id) JOIN pick USING (video_id, frame) WHERE rn <= n_keep"""))
def select_concurrent(spark, sf):
    s = _kept_frags(spark, sf)
    cap = settle(G.max_concurrent(s, ["video_id"]).select(
        "video_id", F.least(F.greatest("max_concurrent", F.lit(1)), F.lit(3)).alias("n_keep")))
    return G.select_concurrent(s, ["video_id"], "track_id", cap)
