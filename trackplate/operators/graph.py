"""Graph-like operators over fragments: components, classes, overlap, linking."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import settle, written
from . import axis
from .grouped import key_types, map_groups
from .ranking import ordered_prefix, value_ranks

KEYS = ("video_id",)
REGION_ROWS = 1 << 17         #: candidate pairs that one task walks in order


def _signature(edges: DataFrame):
    """Order-free fingerprint of an edge set, to see when a round changed nothing."""
    r = edges.agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.xxhash64(*edges.columns).cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def connected_components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS,
                         node: str = "track_id", src: str = "a", dst: str = "b",
                         max_rounds: int | None = None) -> DataFrame:
    """(keys, node, component): component is the smallest member id.

    Alternating large-star / small-star rounds on the edge table. Each half round is
    one aggregate with map-side combine (minimum per node) and one join, so a hub
    node is an ordinary skewed join key; the checkpoint after a round bounds lineage.
    """
    keys = list(keys)
    e = (edges.select(*keys, F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
         .where(F.col("u") != F.col("v")).distinct())
    e = settle(e)
    sig = _signature(e)
    for _ in range(max_rounds or 20 + 4 * int(sig[0]).bit_length()):
        if sig[0] == 0:
            break
        both = e.select(*keys, F.col("u").alias("c"), F.col("v").alias("o")).unionByName(
            e.select(*keys, F.col("v").alias("c"), F.col("u").alias("o")))
        low = both.groupBy(*keys, "c").agg(F.least(F.min("o"), F.col("c")).alias("m"))
        large = (both.where(F.col("o") > F.col("c")).join(low, [*keys, "c"])
                 .select(*keys, F.col("o").alias("u"), F.col("m").alias("v")))
        large = large.where(F.col("u") != F.col("v")).distinct()
        small_low = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        joined = large.join(small_low, [*keys, "u"])
        small = (joined.select(*keys, F.col("v").alias("p"), F.col("m").alias("q"))
                 .unionByName(joined.select(*keys, F.col("u").alias("p"), F.col("m").alias("q")))
                 .where(F.col("p") != F.col("q"))
                 .select(*keys, F.greatest("p", "q").alias("u"), F.least("p", "q").alias("v")).distinct())
        e = settle(small)
        now = _signature(e)
        if now == sig:
            break
        sig = now
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    root = e.groupBy(*keys, F.col("u").alias(node)).agg(F.min("v").alias("_root"))
    return (nodes.select(*keys, node).distinct().join(root, [*keys, node], "left")
            .select(*keys, node, F.coalesce("_root", F.col(node)).alias("component")))


def number_components(members: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Add group_id: 0-based order of the component's smallest member per video."""
    comps = members.select(*keys, "component").distinct()
    ids = value_ranks(comps, keys, "component").select(
        *keys, F.col("v").alias("component"), F.col("rank_from").alias("group_id"))
    return members.join(ids, [*keys, "component"])


def classify_components(frags: DataFrame, edges: DataFrame, members: DataFrame,
                        keys: Sequence[str] = KEYS, node: str = "track_id") -> DataFrame:
    """Per component: chain or collision, representative, curl and fragment counts."""
    k = [*keys, node]
    outs = edges.groupBy(*keys, F.col("a").alias(node)).agg(F.count(F.lit(1)).alias("_out"))
    ins = edges.groupBy(*keys, F.col("b").alias(node)).agg(F.count(F.lit(1)).alias("_in"))
    d = (members.join(frags.select(*k, "start_frame"), k)
         .join(outs, k, "left").join(ins, k, "left"))
    simple = (F.coalesce("_out", F.lit(0)) <= 1) & (F.coalesce("_in", F.lit(0)) <= 1)
    g = d.groupBy(*keys, "component").agg(
        F.bool_and(simple).alias("_chain"),
        F.min_by(node, F.struct("start_frame", node)).alias("repr_track_id"),
        F.count(F.lit(1)).alias("fragment_count"))
    return g.select(
        *keys, "component",
        F.when(F.col("_chain"), "chain").otherwise("collision").alias("classification"),
        "repr_track_id",
        F.when(F.col("_chain"), F.col("fragment_count") - 1).otherwise(0).cast("long").alias("curl_count"),
        "fragment_count")


def max_concurrent(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Most spans [start_frame, end_frame] alive at one frame: +1/-1 sweep.

    Deltas of one frame are summed before the sweep, so the ordered part has one
    row per distinct frame.
    """
    delta = spans.select(*keys, F.col("start_frame").alias("frame"), F.lit(1).cast("long").alias("d")).unionByName(
        spans.select(*keys, (F.col("end_frame") + 1).alias("frame"), F.lit(-1).cast("long").alias("d")))
    per = delta.groupBy(*keys, "frame").agg(F.sum("d").alias("d"))
    run = axis.with_running(per, keys, {"alive": F.col("d")}, order=("frame",))
    return run.groupBy(*keys).agg(F.max("alive").alias("max_concurrent"))


def alive_counts(spans: DataFrame, frames: DataFrame, keys: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """(keys, frame, n_alive, and each of `sums` over the spans alive) at each listed frame that some span covers.

    One sweep of +/-1 deltas with the listed frames as marks: no span meets a frame, so work grows with spans plus frames.
    """
    keys = list(keys)
    cols = {"n_alive": F.lit(1).cast("long")} | {c: F.col(c) for c in sums}
    ends = [(F.col("start_frame"), 1), (F.col("end_frame") + 1, -1)]
    deltas = [spans.select(*keys, at.cast("long").alias("frame"), *((c * sign).alias(n) for n, c in cols.items()), F.lit(False).alias("_ask")) for at, sign in ends]
    asked = frames.select(*keys, F.col("frame").cast("long").alias("frame"), *(F.lit(0).cast("long").alias(n) for n in cols), F.lit(True).alias("_ask"))
    per = deltas[0].unionByName(deltas[1]).unionByName(asked).groupBy(*keys, "frame").agg(
        *(F.sum(n).alias(f"_{n}") for n in cols), F.bool_or("_ask").alias("_ask"))
    run = axis.with_running(per, keys, {n: F.col(f"_{n}") for n in cols}, order=("frame",))
    return run.where(F.col("_ask") & (F.col("n_alive") > 0)).select(*keys, "frame", *cols)


def _frames_of(level):
    return F.call_function("shiftleft", F.lit(1).cast("long"), level.cast("int"))


def _stretches(start, end, levels):
    """The few aligned stretches (level, place) of 2^level frames that make up start..end, at most two a level."""
    def at(level):
        size = _frames_of(level)
        lo, hi = F.ceil(start / size).cast("long"), F.floor((end + 1) / size).cast("long")
        odd = F.pmod(lo, F.lit(2)) == 1
        inner = lo + odd.cast("long")
        return F.array_compact(F.array(
            F.when((lo < hi) & odd, F.struct(level.alias("level"), lo.alias("place"))),
            F.when((lo < hi) & (F.pmod(hi, F.lit(2)) == 1) & (hi - 1 >= inner), F.struct(level.alias("level"), (hi - 1).alias("place")))))

    return F.flatten(F.transform(F.sequence(F.lit(0), levels), at))


def select_concurrent(spans: DataFrame, keys: Sequence[str], id_col: str, limit: DataFrame) -> DataFrame:
    """Keep the N spans that share a frame and have the largest total length.

    `limit` carries `n_keep` per key. A span is cut into its aligned stretches of frames, two a level at most. Only the
    `n_keep` longest spans of a stretch can matter at a frame inside it, so the others are left out there, and a frame
    meets the spans left in the stretches around it, one a level: work grows with spans plus frames, times the levels,
    however many spans overlap. Ties: longer span, then smaller id; then smallest frame.
    """
    keys = list(keys)
    sizes = spans.groupBy(*keys).agg(F.count(F.lit(1)).alias("_have"))
    s = settle(spans.join(limit.select(*keys, "n_keep"), keys).join(sizes, keys))
    easy = s.where(F.col("_have") <= F.col("n_keep")).select(*keys, id_col)
    hard = s.where(F.col("_have") > F.col("n_keep"))
    best_first = (F.desc("n_rows"), F.asc(id_col))

    length = hard.agg(F.max(F.col("end_frame") - F.col("start_frame") + 1)).first()[0]
    levels = F.lit(int(length or 1).bit_length())
    cut = hard.withColumn("_s", F.explode(_stretches(F.col("start_frame"), F.col("end_frame"), levels))).select("*", "_s.*").drop("_s")
    for salt in ([F.pmod(F.xxhash64(id_col), F.lit(64))], []):                      # a crowded stretch is thinned in parts first
        longest = Window.partitionBy(*keys, "level", "place", *salt).orderBy(*best_first)
        cut = cut.withColumn("_rn", F.row_number().over(longest)).where(F.col("_rn") <= F.col("n_keep")).drop("_rn")
    frames = (hard.select(*keys, F.col("start_frame").alias("frame")).unionByName(
        hard.select(*keys, F.col("end_frame").alias("frame"))).distinct()
        .withColumn("level", F.explode(F.sequence(F.lit(0), levels)))
        .withColumn("place", F.floor(F.col("frame") / _frames_of(F.col("level"))).cast("long")))
    alive = cut.join(frames, [*keys, "level", "place"])
    at = Window.partitionBy(*keys, "frame").orderBy(*best_first)
    top = alive.withColumn("_rn", F.row_number().over(at)).where(F.col("_rn") <= F.col("n_keep"))
    score = top.groupBy(*keys, "frame", "n_keep").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("n_rows").alias("_total"),
        F.collect_list(id_col).alias("_ids")).where(F.col("_n") == F.col("n_keep"))
    best = score.groupBy(*keys).agg(
        F.max_by("_ids", F.struct("_total", -F.col("frame"))).alias("_ids"))
    chosen = best.select(*keys, F.explode("_ids").alias(id_col))
    no_frame = hard.join(best.select(*keys), keys, "left_anti").withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*best_first)))
    rest = no_frame.where(F.col("_rn") <= F.col("n_keep")).select(*keys, id_col)
    return easy.unionByName(chosen).unionByName(rest)


# --- greedy successor linking ------------------------------------------------

def _choose(d, b, s, ratio, floor_px, window):
    """Index of the accepted candidate, -1 when the choice is ambiguous."""
    order = np.lexsort((s, b, d))
    first = order[0]
    rivals = order[1:][np.abs(s[order[1:]] - s[first]) <= window]
    second = d[rivals[0]] if len(rivals) else np.inf
    noise = d[first] < floor_px and second < floor_px
    if not noise and second < ratio * d[first]:
        return -1
    return first


def _link_region(a_end, a, b, start, dist, blocked, ratio, floor_px, window):
    """Walk one region's candidate lists, sorted by (end frame, id): (a, accepted b or None) of what can be decided.

    A pair is blocked while a fragment of an earlier region may still claim its b. An undecided
    fragment holds all its open candidates, so later lists with one of them wait as well.
    """
    claimed, held = set(), set()
    cut = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (a_end[1:] != a_end[:-1])])
    for lo, hi in zip(cut, np.r_[cut[1:], len(a)]):
        open_ = [i for i in range(lo, hi) if b[i] not in claimed]
        if not open_:
            continue
        if any(blocked[i] or b[i] in held for i in open_):
            held.update(b[i] for i in open_)
            continue
        i = np.array(open_)
        best = _choose(dist[i], b[i], start[i], ratio, floor_px, window)
        if best >= 0:
            claimed.add(b[i[best]])
        yield a[lo], (b[i[best]] if best >= 0 else None)


def link_fragments(candidates: DataFrame, fps: float, keys: Sequence[str] = KEYS,
                   ratio: float = 2.0, floor_px: float = 3.0, window_s: float = 1.0,
                   region_rows: int = REGION_ROWS) -> DataFrame:
    """Decision per fragment with unclaimed candidates: (keys, a, b); b NULL = refused.

    Fragments are cut by (end frame, id) into regions of about `region_rows` candidate pairs,
    whatever the video. A wave walks all regions at once and decides each fragment whose
    list no earlier undecided one can change; claimed candidates then leave the other lists. A
    candidate is shared only by fragments that end within the search time, so a region waits for little beyond
    its border; the first open region of a video never waits, so the waves end. The links do
    not depend on the regions.
    """
    keys = list(keys)
    window = window_s * fps
    c = written(candidates.select(*keys, "a", "b", "a_end", "b_start", "dist"), "candidates")
    own = c.groupBy(*keys, "a_end", "a").agg(F.count(F.lit(1)).alias("_n"))
    place = ordered_prefix(own, keys, ["a_end", "a"], {"_earlier": "_n"})
    region = place.select(*keys, "a_end", "a", F.floor(F.col("_earlier") / F.lit(region_rows)).cast("long").alias("_region"))
    open_pairs = written(c.join(region, [*keys, "a_end", "a"]), "pairs")
    unit = [*keys, "_region"]

    def run(rows, starts):
        cols = [rows[x].to_numpy() for x in ("a_end", "a", "b", "b_start", "dist", "_blocked")]
        owner, src, dst = [], [], []
        for lo, hi in zip(starts, np.r_[starts[1:], len(rows)]):
            for x, y in _link_region(*[v[lo:hi] for v in cols], ratio, floor_px, window):
                owner.append(lo)
                src.append(x)
                dst.append(y)
        return rows[keys].iloc[owner].assign(a=src, b=pd.array(dst, dtype="Int64"))

    waves = []
    while True:
        first = open_pairs.groupBy(*keys, "b").agg(F.min("_region").alias("_first"))
        asked = open_pairs.join(first, [*keys, "b"]).withColumn("_blocked", F.col("_region") > F.col("_first")).drop("_first")
        decided = written(map_groups(asked, unit, ["a_end", "a"], run, f"{key_types(c, keys)}, a bigint, b bigint"), "links")
        waves.append(decided)
        taken = decided.where(F.col("b").isNotNull()).select(*keys, "b")
        open_pairs = written(open_pairs.join(decided.select(*keys, "a"), [*keys, "a"], "left_anti")
                             .join(taken, [*keys, "b"], "left_anti"), "pairs")
        if open_pairs.isEmpty():
            return functools.reduce(DataFrame.unionByName, waves)


def chain_groups(nodes: DataFrame, links: DataFrame, keys: Sequence[str] = KEYS,
                 node: str = "track_id") -> DataFrame:
    """Group id of every fragment = last member of its chain of links.

    Links form simple chains, so pointer jumping halves the remaining distance each
    round.
    """
    keys = list(keys)
    hop = links.where(F.col("b").isNotNull()).select(*keys, F.col("a").alias(node), F.col("b").alias("_to"))
    cur = settle(nodes.select(*keys, node).distinct().join(hop, [*keys, node], "left")
                 .select(*keys, node, F.coalesce("_to", F.col(node)).alias("group_id")))
    while True:
        nxt = cur.select(*keys, F.col(node).alias("group_id"), F.col("group_id").alias("_far"))
        step = settle(cur.join(nxt, [*keys, "group_id"])
                      .select(*keys, node, F.col("_far").alias("group_id"),
                              (F.col("_far") != F.col("group_id")).alias("_moved")))
        cur = step.drop("_moved")
        if step.where("_moved").isEmpty():
            return cur
