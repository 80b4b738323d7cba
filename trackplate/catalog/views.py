"""The adapter views once more, as SQL for the oracle."""

PICK = "list_extract"

VIEWS = {
    "v_events": """
SELECT event_type AS video_id, user_id % 20 AS track_id,
  CAST(floor(floor(epoch(ts) - 1704067200) / 900) AS BIGINT) AS frame, event_id AS row_id,
  value AS v, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k FROM events""",
    "v_track_points": """
SELECT video_id, track_id, frame, CASE WHEN row_id % 53 <> 0 THEN v END AS x, k AS y, row_id,
  CAST(row_id % 7 <> 0 AS INT) AS has_skeleton FROM v_events""",
    "v_track_series": """
SELECT video_id, track_id, frame, row_id, CASE WHEN row_id % 11 <> 0 THEN v - 50 END AS speed,
  CASE WHEN row_id % 13 <> 0 THEN CAST(row_id % 3 - 1 AS INT) END AS motion_mode,
  CASE WHEN row_id % 17 <> 0 THEN 40 + v / 10 END AS length, 5 + k / 50 AS width_midbody,
  (v - 50) / 50 AS eig1, (k - 50) / 50 AS eig2, 0.5::DOUBLE + (row_id % 50) / 100.0::DOUBLE AS solidity,
  CAST(row_id % 7 <> 0 AS INT) AS was_skeletonized FROM v_events""",
    "v_fragment_points": """
SELECT video_id, dense_rank() OVER (PARTITION BY video_id ORDER BY track_id, seg) - 1 AS track_id, frame, x, y, row_id, has_skeleton FROM (
  SELECT *, sum(CAST(step > 30 AS BIGINT)) OVER (PARTITION BY video_id, track_id ORDER BY frame, row_id
    ROWS UNBOUNDED PRECEDING)::BIGINT AS seg
  FROM (SELECT *, frame - coalesce(lag(frame) OVER (PARTITION BY video_id, track_id ORDER BY frame, row_id), frame)
        AS step FROM v_track_points))""",
    "v_fragments": """
SELECT video_id, track_id, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS n_rows,
  avg(x) FILTER (ra <= 5) AS start_x, avg(y) FILTER (ra <= 5) AS start_y,
  avg(x) FILTER (rd <= 5) AS end_x, avg(y) FILTER (rd <= 5) AS end_y
FROM (SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame, row_id) AS ra,
        row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame DESC, row_id DESC) AS rd
      FROM v_fragment_points) GROUP BY 1, 2""",
    "v_adjacent": """
SELECT a.video_id, a.track_id AS a, b.track_id AS b, b.start_frame - a.end_frame AS gap,
  sqrt((b.start_x - a.end_x) ** 2 + (b.start_y - a.end_y) ** 2) AS dist, a.end_frame AS a_end, b.start_frame AS b_start
FROM v_fragments a JOIN v_fragments b ON a.video_id = b.video_id AND a.track_id <> b.track_id
  AND b.start_frame - a.end_frame BETWEEN 0 AND 50
  AND sqrt((b.start_x - a.end_x) ** 2 + (b.start_y - a.end_y) ** 2) <= 50""",
    "v_skeletons": """
SELECT 'v' || (vec_id % 5) AS video_id, (vec_id // 5) % 4 AS track_id, vec_id // 20 AS frame,
  vec_id AS skeleton_id, label,
  list_transform(range(1, 50), lambda i: CASE WHEN vec_id % 19 = 0 AND i = 7 THEN NULL ELSE
    list_sum(list_transform(embedding[1:i], lambda a: 10 * cos(3 * CAST(a AS DOUBLE)))) END) AS px,
  list_transform(range(1, 50), lambda i:
    list_sum(list_transform(embedding[1:i], lambda a: 10 * sin(3 * CAST(a AS DOUBLE))))) AS py
FROM embeddings""",
    "v_detections": """
SELECT vec_id // 20 AS image_id, vec_id AS det_id, label % 6 AS class_ix,
  (['egg','L1','L2','L3','L4','adult'])[label % 6 + 1] AS cls,
  500 + 2000 * embedding[1]::DOUBLE AS x1, 500 + 2000 * embedding[2]::DOUBLE AS y1,
  500 + 2000 * embedding[1]::DOUBLE + 20 + 400 * abs(embedding[3]::DOUBLE) AS x2,
  500 + 2000 * embedding[2]::DOUBLE + 20 + 400 * abs(embedding[4]::DOUBLE) AS y2,
  1 / (1 + exp(-10 * embedding[5]::DOUBLE)) AS score, vec_id % 4 = 0 AS truncated,
  [1 / (1 + exp(-10 * embedding[10]::DOUBLE)), 1 / (1 + exp(-10 * embedding[11]::DOUBLE)),
   1 / (1 + exp(-10 * embedding[12]::DOUBLE)), 1 / (1 + exp(-10 * embedding[13]::DOUBLE)),
   1 / (1 + exp(-10 * embedding[14]::DOUBLE)), 1 / (1 + exp(-10 * embedding[15]::DOUBLE))] AS scores
FROM embeddings""",
    "v_images": """
SELECT * FROM (
SELECT CASE WHEN c_mktsegment = 'MACHINERY' AND o_orderkey % 4 = 3 THEN c_mktsegment
    ELSE c_mktsegment || ' ' || ((o_orderkey % 4) * 20) || 'J' END AS condition,
  CAST((year(o_orderdate) - 1995) * 24 AS DOUBLE) AS tp,
  'p0' || CASE WHEN c_mktsegment = 'FURNITURE' AND o_orderkey % 4 = 2 THEN 1 ELSE o_custkey % 3 + 1 END AS plate,
  o_orderkey AS image_id,
  'img' || o_orderkey || '_' || (['NE','NW','SE','SW'])[(o_orderkey // 4) % 4 + 1] || '.png' AS image,
  o_orderkey % 97 = 0 AS has_error
FROM orders JOIN customer ON o_custkey = c_custkey)
WHERE NOT (condition = 'BUILDING 40J' AND tp = 24.0)""",
    "v_stage_counts": """
SELECT l_orderkey AS image_id, (['egg','L1','L2','L3','L4','adult','blob'])[l_linenumber % 7 + 1] AS stage,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2""",
    "v_sizes": "SELECT l_returnflag AS grp, l_extendedprice AS size_px FROM lineitem",
    "v_paths": """
SELECT file_id, CASE WHEN file_id % 3 = 0 THEN name WHEN file_id % 3 = 1 THEN plate_dir || '/' || name
    ELSE label || '/' || plate_dir || '/' || name END AS path, name, stem, label, folder_id
FROM (SELECT *, stem || (['.png','.TIF','.txt'])[(file_id // 11) % 3 + 1] AS name FROM (
  SELECT o_orderkey AS file_id, o_custkey % 10 AS folder_id, 'plate' || (o_orderkey % 12) AS plate_dir,
    (['601','N2','604'])[o_custkey % 3 + 1] || ' ' || ((o_orderkey % 4) * 20) ||
      (['J',' uM','j',' x'])[(o_orderkey // 7) % 4 + 1] AS label,
    (['601','N2','604'])[o_custkey % 3 + 1] || '_Train' || (['_20J','_0j','_100uM','','_60J'])[o_orderkey % 5 + 1]
      || (['_p01','_P2','_p13',''])[(o_orderkey // 5) % 4 + 1] || '_' || strftime(o_orderdate, '%Y%m%d') || 'T'
      || (['075438','235959','256060'])[(o_orderkey // 20) % 3 + 1]
      || (['_NE','_nw','_SE','_SW',''])[(o_orderkey // 3) % 5 + 1] AS stem
  FROM orders))""",
    "v_files": """
SELECT page_id AS file_id, 's' || (page_id % 7) AS session_id,
  's' || (page_id % 7) || '/' || CASE WHEN page_id % 23 = 0 THEN '.thumbs/' ELSE '' END || 'f' || page_id
    || CASE WHEN page_id % 29 = 0 THEN '.sha256' ELSE '.tif' END AS relative_path,
  length(html) AS size_bytes, CASE WHEN page_id % 31 <> 0 THEN sha256(html) END AS sha256,
  1704067200 + page_id * 3600 AS mtime, page_id % 3 = 0 AS acked,
  CASE WHEN page_id % 3 = 0 THEN 1704067200 + page_id * 3600 + (page_id % 5) * 100000 END AS acked_at
FROM pages""",
}

NEEDS = {
    "v_track_points": ["v_events"], "v_track_series": ["v_events"],
    "v_fragment_points": ["v_track_points"], "v_fragments": ["v_fragment_points"],
    "v_adjacent": ["v_fragments"],
}


def sql(views: str, body: str) -> str:
    """SQL text whose CTEs are the named views (and what they need) before `body`.

    `body` is a SELECT, or further CTE definitions followed by a SELECT.
    """
    order: list[str] = []

    def add(v):
        for n in NEEDS.get(v, []):
            add(n)
        if v not in order:
            order.append(v)

    for v in views.split():
        add(v)
    text = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in order)
    body = body.strip()
    recursive = "RECURSIVE" if body.startswith("RECURSIVE") else ""
    body = body.removeprefix("RECURSIVE").strip()
    joiner = "\n" if body.upper().startswith("SELECT") else ",\n"
    return f"WITH {recursive} {text}{joiner}{body}" if order else body
