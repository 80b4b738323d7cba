"""Sequence operators along a track: smoothing, runs, reversals, velocity, events."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import axis
from .grouped import key_types, map_groups
from .ranking import join_groups

KEYS = ("video_id", "track_id")


def odd_window(fps: float, seconds: float, least: int) -> int:
    return max(least, int(fps * seconds) | 1)


def _rows(keys, back, ahead):
    return Window.partitionBy(*keys, "_chunk").orderBy("ord").rowsBetween(-back, ahead)


def rolling_std(df: DataFrame, value: str, window: int, name: str = "rolling_std",
                keys: Sequence[str] = KEYS) -> DataFrame:
    """Centred population std over `window` rows, skipping NULLs; all NULL gives 0."""
    h = window // 2
    d = axis.halo(axis.with_ordinal(df, keys), "ord", h)
    d = d.withColumn(name, F.coalesce(F.stddev_pop(value).over(_rows(keys, h, h)), F.lit(0.0)))
    return axis.home_rows(d)


def flicker_mask(df: DataFrame, length: str, fps: float, std_limit: float = 20.0,
                 window_s: float = 0.5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Add `bad`: length missing or rolling std above the limit."""
    d = rolling_std(df, length, odd_window(fps, window_s, 3), keys=keys)
    return d.withColumn("bad", F.col(length).isNull() | (F.col("rolling_std") > std_limit))


def segments(masked: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """All rows with `segment`: a bad row opens one, the good rows behind it share it."""
    return axis.islands(masked, keys, F.col("bad"), "segment")


def clean_segments(masked: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Good rows with `segment`, an id shared by neighbouring good rows."""
    return segments(masked, keys).where(~F.col("bad"))


def clean_spans(segments: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return segments.groupBy(*keys, "segment").agg(
        F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"),
        F.count(F.lit(1)).alias("n_rows"))


def flicker_stats(masked: DataFrame, fps: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Flagged rows, flagged stretches, longest clean span in seconds, per track."""
    return flicker_of(segments(masked, keys), fps, keys)


def flicker_of(marked: DataFrame, fps: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """The same from rows that carry their `segment`, in two aggregates.

    A flagged stretch begins at the first flagged row, and behind every segment with good
    rows that a further one follows.
    """
    per = marked.groupBy(*keys, "segment").agg(
        F.count(F.lit(1)).alias("_n"), F.sum((~F.col("bad")).cast("long")).alias("_good"))
    opened, good = F.col("segment") > 0, F.col("_good")
    d = per.groupBy(*keys).agg(
        F.sum(F.col("_n") - good).alias("flicker_frames"), F.sum("_n").alias("total_frames"), F.max(good).alias("_best"),
        F.sum((opened & (good > 0)).cast("long")).alias("_followed"), F.max(opened).alias("_any"), F.max_by(good, "segment").alias("_last"))
    stretches = F.when(F.col("_any"), F.col("_followed") + F.when(F.col("_last") > 0, 0).otherwise(1)).otherwise(0).cast("long")
    return d.select(*keys, "flicker_frames", stretches.alias("flicker_stretches"), "total_frames", (F.col("_best") / F.lit(fps)).alias("longest_clean_s"))


def valid_counts(df: DataFrame, value: str, keys: Sequence[str] = KEYS, min_valid: int = 10) -> DataFrame:
    """`n_valid` of the signals with enough valid samples."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_valid")).where(F.col("n_valid") >= min_valid)


def detrend(df: DataFrame, value: str, fps: float, keys: Sequence[str] = KEYS, name: str = "detrended",
            smooth_s: float = 0.3, base_s: float = 2.0, min_valid: int = 10, counts: DataFrame | None = None) -> DataFrame:
    """Smooth minus slow baseline over valid samples only (gaps squeezed out).

    Adds `ord` among valid samples; signals with fewer than `min_valid` are dropped. `counts`
    is a written table of `valid_counts`, where the caller has one.
    """
    a = odd_window(fps, smooth_s, 3) // 2
    b = odd_window(fps, base_s, 5) // 2
    valid = df.where(F.col(value).isNotNull())
    valid = valid.join(counts, list(keys)) if counts is not None else join_groups(valid, valid_counts(df, value, keys, min_valid), keys)
    d = axis.with_ordinal(valid, keys)        # rows go on by bucket, not by signal
    d = axis.halo(d, "ord", a + b)
    d = d.withColumn("_smooth", F.avg(value).over(_rows(keys, a, a)))
    d = d.withColumn(name, F.col("_smooth") - F.avg("_smooth").over(_rows(keys, b, b)))
    return axis.home_rows(d).drop("_smooth")


def runs(df: DataFrame, good: Column, max_step: int = 1, keys: Sequence[str] = KEYS) -> DataFrame:
    """Runs of good frames whose frame steps do not exceed max_step.

    `df` holds every row; a bad row ends a run when max_step is 1 because it leaves a
    hole in the frame numbers of the good rows.
    """
    g = df.where(good)
    d = axis.with_previous(g, keys, {"_pf": F.col("frame")})
    new = F.col("_pf").isNull() | (F.col("frame") - F.col("_pf") > max_step)
    d = axis.islands(d, keys, new, "run_id")
    return d.groupBy(*keys, "run_id").agg(
        F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"),
        F.count(F.lit(1)).alias("n_rows"))


def consecutive_runs(df: DataFrame, good: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """Runs broken by an invalid row or by any frame step other than 1."""
    d = axis.with_previous(df.withColumn("_ok", good), keys,
                           {"_pf": F.col("frame"), "_po": F.col("_ok")})
    joined = F.col("_po") & (F.col("frame") - F.col("_pf") == 1)
    d = axis.islands(d, keys, ~F.coalesce(joined, F.lit(False)), "run_id").where("_ok")
    return d.groupBy(*keys, "run_id").agg(
        F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"),
        F.count(F.lit(1)).alias("n_rows"))


def longest_bridged_run(df: DataFrame, good: Column, fps: float, bridge: int = 30,
                        keys: Sequence[str] = KEYS) -> DataFrame:
    """Longest good run in seconds; inner holes of up to `bridge` frames are closed."""
    frames = df.where(good).groupBy(*keys, "frame").agg(F.lit(0).alias("row_id"))
    r = runs(frames, F.lit(True), bridge + 1, keys)
    best = r.groupBy(*keys).agg(F.max(F.col("end_frame") - F.col("start_frame") + 1).alias("_best"))
    every = df.select(*keys).distinct()
    return every.join(best, list(keys), "left").select(
        *keys, (F.coalesce("_best", F.lit(0)) / F.lit(fps)).alias("longest_run_s"))


def reversals(df: DataFrame, mode: str = "motion_mode", pause: int = 60,
              keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows that start a backward run right after forward motion.

    Between them at most `pause` measured pauses and no missing frame or NULL. The
    last row of a frame wins. Running counts of holes and pauses turn "nothing but
    pauses in between" into a comparison with the previous non-pause row.
    """
    d = axis.last_per_frame(df, keys, [mode])
    d = axis.with_previous(d, keys, {"_pf": F.col("frame")}, order=("frame",))
    hole = F.col(mode).isNull() | (F.col("_pf").isNotNull() & (F.col("frame") - F.col("_pf") != 1))
    d = axis.with_running(d, keys, {"_holes": hole.cast("long"), "_pauses": (F.col(mode) == 0).cast("long")},
                          order=("frame",))
    m = d.where(F.col(mode).isNotNull() & (F.col(mode) != 0))
    m = axis.with_previous(m, keys, {"_pm": F.col(mode), "_ph": F.col("_holes"), "_pp": F.col("_pauses")},
                           order=("frame",))
    hit = ((F.col(mode) == -1) & (F.col("_pm") == 1) & (F.col("_holes") == F.col("_ph"))
           & (F.col("_pauses") - F.col("_pp") <= pause))
    return m.where(hit).select(*keys, "frame")


def offset_value(dense: DataFrame, col: str, k: int, keys: Sequence[str] = KEYS,
                 name: str = "value_at") -> DataFrame:
    """Value exactly k frames away (NULL if that frame is absent); frames are unique."""
    d = axis.halo(dense, "frame", abs(k))
    w = Window.partitionBy(*keys, "_chunk").orderBy("frame").rangeBetween(k, k)
    return axis.home_rows(d.withColumn(name, F.first(col).over(w)))


def motion_windows(fps: float) -> dict[str, int]:
    """Frame counts of the velocity step, look-ahead, event gap and local maximum."""
    return {"step": max(3, round(0.3 * fps)), "look": max(1, round(0.5 * fps)),
            "gap": max(1, round(0.5 * fps)), "hold": max(1, round(0.25 * fps))}


def motion_frames(points: DataFrame, fps: float, cols: Sequence[str] = ("x", "y"), keys: Sequence[str] = KEYS) -> DataFrame:
    """Measured frames and the gap frames around them at which velocity and heading can have a value; the rest of a gap is left out."""
    w = motion_windows(fps)
    return axis.densify(points, keys, cols, reach=w["step"] + w["look"])


def velocity(dense: DataFrame, fps: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Centred difference over +-step frames on the dense axis: vx, vy per frame."""
    s = motion_windows(fps)["step"]
    return axis.home_rows(_velocity(axis.halo(dense, "frame", s), s, keys))


def _at(keys, k):
    return Window.partitionBy(*keys, "_chunk").orderBy("frame").rangeBetween(k, k)


def _velocity(d, s, keys):
    fwd, back = _at(keys, s), _at(keys, -s)
    dx = F.first("x").over(fwd) - F.first("x").over(back)
    dy = F.first("y").over(fwd) - F.first("y").over(back)
    ok = dx.isNotNull() & dy.isNotNull()
    return d.withColumns({"_dx": dx / F.lit(2.0 * s), "_dy": dy / F.lit(2.0 * s), "_ok": ok}).withColumns(
        {"vx": F.when(F.col("_ok"), F.col("_dx")), "vy": F.when(F.col("_ok"), F.col("_dy"))}).drop(
        "_dx", "_dy", "_ok")


def _turning(d, look, min_speed: Column, keys):
    a, b = _at(keys, -look), _at(keys, look)
    d = d.withColumns({"_ax": F.first("vx").over(a), "_ay": F.first("vy").over(a),
                       "_bx": F.first("vx").over(b), "_by": F.first("vy").over(b)})
    s0, s1 = F.hypot("_ax", "_ay"), F.hypot("_bx", "_by")
    dot = F.try_divide(F.col("_ax") * F.col("_bx") + F.col("_ay") * F.col("_by"), s0 * s1)
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))
    fast = (s0 >= min_speed) & (s1 >= min_speed) & (s0 > 0) & (s1 > 0)
    return d.withColumn("angle", F.when(fast, angle)).drop("_ax", "_ay", "_bx", "_by")


def heading_change(dense: DataFrame, fps: float, min_speed: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """Angle in degrees between the velocity look frames before and after."""
    w = motion_windows(fps)
    d = axis.halo(dense, "frame", w["step"] + w["look"])
    return axis.home_rows(_turning(_velocity(d, w["step"], keys), w["look"], min_speed, keys))


def turn_events(dense: DataFrame, fps: float, min_speed: Column, turn_deg: float = 60.0,
                reversal_deg: float = 140.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Accepted turn / reversal events, at least `gap` frames apart.

    Candidates are local maxima of [i - hold, i + hold). Acceptance depends on the last
    accepted event, but only when that is less than `gap` frames away: `spaced` uses
    this to decide chunks of a track independently.
    """
    w = motion_windows(fps)
    d = axis.halo(dense, "frame", w["step"] + w["look"] + w["hold"])
    d = _turning(_velocity(d, w["step"], keys), w["look"], min_speed, keys)
    near = Window.partitionBy(*keys, "_chunk").orderBy("frame").rangeBetween(-w["hold"], w["hold"] - 1)
    d = axis.home_rows(d.withColumn("_top", F.max("angle").over(near)))
    c = d.where((F.col("angle") >= turn_deg) & (F.col("angle") >= F.col("_top"))).select(*keys, "frame", "angle")
    out = spaced(c, w["gap"], keys)
    kind = F.when(F.col("angle") >= reversal_deg, "reversal").otherwise("turn")
    return out.select(*keys, "frame", "angle", kind.alias("event"))


def spaced(cands: DataFrame, gap: int, keys: Sequence[str] = KEYS, width: int = axis.WIDTH) -> DataFrame:
    """Walk candidates (frame, angle) in order, keep one when >= gap after the last kept.

    A chunk of frames is entered with the last kept event 1..gap-1 frames before it, or
    none that near (state 0). Each chunk turns every entry state into an exit state; one
    row per chunk then passes the true state along the track, and each chunk is walked
    with its own.
    """
    width = max(width, gap)
    start = F.col("_chunk") * F.lit(width)
    far = F.lit(gap)
    c = cands.withColumn("_chunk", F.floor(F.col("frame") / F.lit(width)).cast("long"))
    lists = c.groupBy(*keys, "_chunk").agg(F.array_sort(F.collect_list(F.struct("frame", "angle"))).alias("_c"))
    lists = lists.withColumn("_start", start)

    def entry(state):        # frame of the last kept event before the chunk
        return F.col("_start") - F.when(state == 0, far).otherwise(state)

    def exit_state(state):
        last = F.aggregate("_c", entry(state), lambda acc, x: F.when(x["frame"] - acc >= far, x["frame"]).otherwise(acc))
        ahead = F.col("_start") + F.lit(width) - last
        return F.when(ahead < far, ahead).otherwise(F.lit(0)).cast("int")

    states = F.sequence(F.lit(0).cast("long"), F.lit(gap - 1).cast("long"))
    moves = lists.select(*keys, "_chunk", F.transform(states, exit_state).alias("_moves"))
    k = list(keys)

    def chain(rows, starts):
        chunk, move = rows["_chunk"].to_numpy(), rows["_moves"].to_numpy()
        out = np.zeros(len(rows), np.int64)
        first = set(starts.tolist())
        for i in range(len(rows)):
            if i not in first and chunk[i] == chunk[i - 1] + 1:
                out[i] = move[i - 1][out[i - 1]]
        return rows[[*k, "_chunk"]].assign(_state=out)

    known = map_groups(moves, k, ["_chunk"], chain, f"{key_types(moves, k)}, _chunk bigint, _state bigint")
    d = lists.join(known, [*k, "_chunk"])
    seed = F.struct(entry(F.col("_state")).alias("last"), F.slice("_c", 1, 0).alias("kept"))
    kept = F.aggregate("_c", seed, lambda acc, x: F.when(
        x["frame"] - acc["last"] >= far, F.struct(x["frame"].alias("last"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc))["kept"]
    return d.withColumn("_e", F.explode(kept)).select(*k, F.col("_e.frame").alias("frame"), F.col("_e.angle").alias("angle"))


def turn_rates(events: DataFrame, vel: DataFrame, fps: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Counts and rates per observed minute (frames with a velocity)."""
    seen = vel.groupBy(*keys).agg(F.count("vx").alias("_n"))
    per = events.groupBy(*keys).agg(
        F.sum((F.col("event") == "reversal").cast("long")).alias("_r"),
        F.sum((F.col("event") == "turn").cast("long")).alias("_t"))
    minutes = F.col("_n") / F.lit(fps * 60.0)
    d = seen.join(per, list(keys), "left")
    r, t = F.coalesce("_r", F.lit(0)), F.coalesce("_t", F.lit(0))
    return d.select(*keys, r.alias("arrow_reversal_count"), t.alias("turn_count"),
                    F.try_divide(r, minutes).alias("arrow_reversal_rate_per_min"),
                    F.try_divide(t, minutes).alias("turn_rate_per_min"))


def transitions(df: DataFrame, valid: Column, most: int | None = None,
                keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows where validity flips: direction v2n / n2v and running number."""
    d = axis.with_previous(df.withColumn("_v", valid), keys, {"_pv": F.col("_v")})
    d = d.where(F.col("_pv").isNotNull() & (F.col("_v") != F.col("_pv")))
    d = axis.with_ordinal(d, keys, "nth")
    if most is not None:
        d = d.where(F.col("nth") <= most)
    return d.select(*keys, "nth", "frame", F.when(F.col("_v"), "n2v").otherwise("v2n").alias("direction"))


def phase_rotations(df: DataFrame, a: str, b: str, fps: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Full turns of the (a, b) phase and path length over amplitude, per 30 s."""
    v = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_p", F.atan2(b, a))
    v = axis.with_previous(v, keys, {"_pp": F.col("_p"), "_pa": F.col(a), "_pb": F.col(b)})
    pi = F.acos(F.lit(-1.0))
    step = F.col("_p") - F.col("_pp")
    wrapped = step - F.floor((step + pi) / (2 * pi)) * (2 * pi)
    wrapped = F.when((wrapped == -pi) & (step > 0), pi).otherwise(wrapped)
    seg = F.hypot(F.col(a) - F.col("_pa"), F.col(b) - F.col("_pb"))
    g = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.abs(F.sum(wrapped)).alias("_turn"),
                             F.sum(seg).alias("_path"), F.stddev_pop(F.hypot(a, b)).alias("_amp"))
    per = F.lit(30.0) / (F.col("_n") / F.lit(fps))
    enough = F.col("_n") >= 10
    return g.select(
        *keys, F.when(enough, F.col("_turn") / (2 * pi) * per).alias("rotations_30s"),
        F.when(enough, F.when(F.col("_amp") < 1e-6, F.lit(0.0)).otherwise(
            F.try_divide(F.col("_path"), 2 * pi * F.col("_amp")) * per)).alias("path_bends_30s"))
