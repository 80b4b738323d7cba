"""Fragment graph operators against brute force on random inputs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackplate.operators import fragments, graph


def _frags(seed, n=60):
    rng = np.random.default_rng(seed)
    rows = []
    for v in ("p", "q"):
        for i in range(n):
            a = int(rng.integers(0, 300))
            x, y = rng.uniform(0, 120, 2)
            rows.append((v, i, a, a + int(rng.integers(0, 40)), float(x), float(y), float(x + rng.normal() * 5), float(y + rng.normal() * 5), int(rng.integers(1, 50))))
    return rows


SCHEMA = "video_id string, track_id long, start_frame long, end_frame long, start_x double, start_y double, end_x double, end_y double, n_rows long"


def _pairs(rows, lo, hi, dmax):
    out = set()
    for a in rows:
        for b in rows:
            d = np.hypot(b[4] - a[6], b[5] - a[7])
            if a[0] == b[0] and a[1] != b[1] and lo <= b[2] - a[3] <= hi and d <= dmax:
                out.add((a[0], a[1], b[1]))
    return out


def test_neighbours(spark):
    rows = _frags(1)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.video_id, r.a, r.b) for r in fragments.neighbours(df, min_gap=0, max_gap=20, max_dist=30.0).collect()}
    assert got == _pairs(rows, 0, 20, 30.0) and got


def test_components(spark):
    rows = _frags(2)
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = _pairs(rows, 0, 10, 20.0)
    e = spark.createDataFrame(sorted(pairs), "video_id string, a long, b long")
    parent = {(r[0], r[1]): (r[0], r[1]) for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for v, a, b in pairs:
        i, j = sorted([find((v, a)), find((v, b))])
        parent[j] = i
    got = {(r.video_id, r.track_id): r.component for r in graph.connected_components(df, e).collect()}
    assert got == {k: find(k)[1] for k in parent}


def brute_links(rows, fps, dmax):
    out = {}
    for v in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == v), key=lambda r: (r[3], r[1]))
        claimed = set()
        for a in mine:
            c = sorted((float(np.hypot(b[4] - a[6], b[5] - a[7])), b[1], b[2]) for b in mine
                       if b[1] != a[1] and b[1] not in claimed and 1 <= b[2] - a[3] <= int(5 * fps)
                       and np.hypot(b[4] - a[6], b[5] - a[7]) <= dmax)
            if not c:
                continue
            rival = [x[0] for x in c[1:] if abs(x[2] - c[0][2]) <= fps]
            second = rival[0] if rival else np.inf
            if not (c[0][0] < 3 and second < 3) and second < 2 * c[0][0]:
                out[v, a[1]] = None
            else:
                out[v, a[1]] = c[0][1]
                claimed.add(c[0][1])
    return out


@pytest.mark.parametrize("region_rows", [1, 7, 10**6])
def test_links_do_not_depend_on_regions(spark, region_rows):
    rows = _frags(3, 40)
    cand = fragments.successor_candidates(spark.createDataFrame(rows, SCHEMA), 4.0, max_dist=60.0)
    got = {(r.video_id, r.a): r.b for r in graph.link_fragments(cand, 4.0, region_rows=region_rows).collect()}
    assert got == brute_links(rows, 4.0, 60.0) and any(v is not None for v in got.values())
    assert graph.link_fragments(cand.limit(0), 4.0).count() == 0


def walked(pairs, fps):
    """Links of (a, b, a_end, b_start, dist) of one video, one fragment after the other."""
    lists, claimed, out = {}, set(), {}
    for a, b, end, start, dist in pairs:
        lists.setdefault((end, a), []).append((dist, b, start))
    for (_, a), c in sorted(lists.items()):
        c = sorted(x for x in c if x[1] not in claimed)
        if not c:
            continue
        second = next((x[0] for x in c[1:] if abs(x[2] - c[0][2]) <= fps), np.inf)
        refused = not (c[0][0] < 3 and second < 3) and second < 2 * c[0][0]
        out[a] = None if refused else c[0][1]
        if not refused:
            claimed.add(c[0][1])
    return out


def test_links_of_one_long_video(spark):
    rnd = np.random.default_rng(5)
    a = np.repeat(np.arange(200_000), 5)                      # a million candidates, five a fragment
    end = a // 10
    gap = rnd.integers(1, 9, len(a))
    b = np.unique(np.c_[a, (end + gap) * 10 + rnd.integers(0, 10, len(a))], axis=0)
    pairs = [(int(x), int(y), int(x // 10), int(y // 10), float(d)) for (x, y), d in zip(b, rnd.integers(1, 400, len(b)) / 4)]
    cand = spark.createDataFrame(pd.DataFrame(pairs, columns=["a", "b", "a_end", "b_start", "dist"])).withColumn("video_id", F.lit("v"))
    got = {r.a: r.b for r in graph.link_fragments(cand, 4.0).collect()}
    assert len(pairs) > 900_000 and got == walked(pairs, 4)


def test_chain_groups(spark):
    nodes = spark.createDataFrame([("v", i) for i in range(9)], "video_id string, track_id long")
    links = spark.createDataFrame([("v", 0, 3), ("v", 3, 1), ("v", 1, 8), ("v", 5, 6), ("v", 2, None)], "video_id string, a long, b long")
    got = {r.track_id: r.group_id for r in graph.chain_groups(nodes, links).collect()}
    assert got == {0: 8, 3: 8, 1: 8, 8: 8, 5: 6, 6: 6, 2: 2, 4: 4, 7: 7}


@pytest.mark.parametrize("seed,many", [(4, 25), (9, 120)])
def test_concurrency(spark, seed, many):
    rows = _frags(seed, many)
    df = spark.createDataFrame(rows, SCHEMA)
    for r in graph.max_concurrent(df, ["video_id"]).collect():
        mine = [x for x in rows if x[0] == r.video_id]
        ends = {f for x in mine for f in x[2:4]}
        assert r.max_concurrent == max(sum(x[2] <= f <= x[3] for x in mine) for f in ends)
    for n in (1, 3):
        cap = df.select("video_id").distinct().withColumn("n_keep", F.lit(n))
        got = {}
        for r in graph.select_concurrent(df, ["video_id"], "track_id", cap).collect():
            got.setdefault(r.video_id, set()).add(r.track_id)
        for v in ("p", "q"):
            mine = [x for x in rows if x[0] == v]
            best = None
            for f in sorted({f for x in mine for f in x[2:4]}):
                top = sorted((x for x in mine if x[2] <= f <= x[3]), key=lambda x: (-x[8], x[1]))[:n]
                if len(top) == n and (best is None or sum(x[8] for x in top) > best[0]):
                    best = (sum(x[8] for x in top), {x[1] for x in top})
            assert got[v] == best[1]


def test_alive_counts(spark):
    """Counts and sums at listed frames equal a direct count; a span of 10^9 frames costs two deltas; uncovered frames are absent."""
    rows = _frags(5, 60) + [("p", 900, 0, 10**9, *_frags(5, 1)[0][4:])]
    df = spark.createDataFrame(rows, SCHEMA)
    asked = [(v, f) for v in ("p", "q", "none") for f in (-5, 0, 3, 40, 77, 10**9, 10**9 + 1)]
    got = {(r.video_id, r.frame): (r.n_alive, r.n_rows) for r in
           graph.alive_counts(df, spark.createDataFrame(asked, "video_id string, frame long"), ["video_id"], ["n_rows"]).collect()}
    want = {}
    for v, f in asked:
        live = [x for x in rows if x[0] == v and x[2] <= f <= x[3]]
        if live:
            want[v, f] = (len(live), sum(x[8] for x in live))
    assert got == want


def test_classify(spark):
    f = spark.createDataFrame([("v", i, 10 * i) for i in range(5)], "video_id string, track_id long, start_frame long")
    e = spark.createDataFrame([("v", 0, 1), ("v", 2, 3), ("v", 2, 4)], "video_id string, a long, b long")
    m = graph.connected_components(f, e)
    got = {r.component: (r.classification, r.repr_track_id, r.curl_count, r.fragment_count) for r in graph.classify_components(f, e, m).collect()}
    assert got == {0: ("chain", 0, 1, 2), 2: ("collision", 2, 0, 3)}
