"""Per-track and per-video metrics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import ratio
from . import axis, peaks, windows
from .grouped import key_types, map_groups
from .ranking import column_quantiles, quantiles, value_ranks

KEYS = ("video_id", "track_id")
PAUSED_SHARE = 0.10
TRIM = 0.10
STABLE_SPAN_S = 10.0
STABLE_TRACKS = 5
MIN_SPAN_S = 30.0
MIN_COVERAGE = 0.70


# --- shape, kinematics, path ---------------------------------------------------

def shape_metrics(series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """length_cv (>= 10 lengths), median solidity, median |speed| per group."""
    k = list(keys)
    base = series.groupBy(*k).agg(
        F.count("length").alias("_n"), F.avg("length").alias("_m"), F.stddev_pop("length").alias("_s"))
    mid = column_quantiles(series.withColumn("_a", F.abs("speed")), k, {"solidity": {"solidity_median": 0.5}, "_a": {"speed_median_abs": 0.5}})
    cv = F.when((F.col("_n") >= 10) & (F.col("_m") > 0), ratio(F.col("_s"), F.col("_m")))
    return (base.join(mid, k, "left")
            .select(*k, cv.alias("length_cv"), "solidity_median", "speed_median_abs"))


def paused_threshold(series: DataFrame, video: Sequence[str] = ("video_id",)) -> DataFrame:
    """Per video: 10% of the exact median of |speed|."""
    m = quantiles(series.withColumn("_a", F.abs("speed")), list(video), "_a", {"_m": 0.5})
    return m.select(*video, (F.lit(PAUSED_SHARE) * F.col("_m")).alias("paused_threshold"))


def kinematics(series: DataFrame, thresholds: DataFrame, keys: Sequence[str] = KEYS,
               video: Sequence[str] = ("video_id",)) -> DataFrame:
    """Speed means, direction shares, activity and variation per track.

    Everything is NULL when the track has no speed at all; forward and backward means
    are 0 when only that direction is missing.
    """
    d = series.join(thresholds, list(video), "left").withColumn(
        "paused_threshold", F.coalesce("paused_threshold", F.lit(0.0)))
    s, a, th = F.col("speed"), F.abs("speed"), F.col("paused_threshold")
    some = F.count("speed") > 0

    def share(cond):
        return F.avg(F.when(s.isNotNull(), cond.cast("double")))

    return d.groupBy(*keys).agg(
        F.count("speed").alias("n_speed"), F.avg(a).alias("mean_speed_pxs"),
        F.when(some, F.coalesce(F.avg(F.when(s > 0, s)), F.lit(0.0))).alias("mean_forward_speed_pxs"),
        F.when(some, F.coalesce(F.avg(F.when(s < 0, -s)), F.lit(0.0))).alias("mean_backward_speed_pxs"),
        share(s > 0).alias("fraction_forward"), share(s < 0).alias("fraction_backward"),
        share(a < th).alias("fraction_paused"), F.avg(F.when(a >= th, a)).alias("mean_speed_when_moving"),
        share(a >= 1).alias("activity_fraction_above_1pxs"), share(a >= 3).alias("activity_fraction_above_3pxs"),
        share(a >= 5).alias("activity_fraction_above_5pxs"),
        F.when(F.avg(a) > 0, F.try_divide(F.stddev_pop(a), F.avg(a))).alias("speed_cv"),
        F.avg("length").alias("mean_length_px"),
        F.when(F.avg("length") > 0, F.try_divide(F.stddev_pop("length"), F.avg("length"))).alias("length_cv"),
        F.avg("width_midbody").alias("mean_width_midbody_px"))


def path_geometry(points: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Path over steps of exactly one frame, net displacement, tortuosity."""
    p = points.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    p = axis.with_previous(p, keys, {"_pf": F.col("frame"), "_px": F.col("x"), "_py": F.col("y")})
    step = F.hypot(F.col("x") - F.col("_px"), F.col("y") - F.col("_py"))
    at = F.struct("frame", "row_id")
    xy = F.struct("x", "y")
    g = p.groupBy(*keys).agg(
        F.sum(F.when(F.col("frame") - F.col("_pf") == 1, step).otherwise(0.0)).alias("path_length_px"),
        F.min_by(xy, at).alias("_a"), F.max_by(xy, at).alias("_b"))
    net = F.hypot(F.col("_b.x") - F.col("_a.x"), F.col("_b.y") - F.col("_a.y"))
    return g.select(*keys, "path_length_px", net.alias("net_displacement_px"),
                    (F.col("path_length_px") / F.greatest(net, F.lit(1.0))).alias("tortuosity"))


def coverage(points: DataFrame, flag: str = "has_skeleton", keys: Sequence[str] = KEYS) -> DataFrame:
    return points.groupBy(*keys).agg(F.avg(F.col(flag).cast("double")).alias("skeleton_coverage"))


def track_quality(span: Column, cov: Column, min_span: float = MIN_SPAN_S) -> Column:
    return F.coalesce((span >= min_span) & (cov >= MIN_COVERAGE), F.lit(False))


# --- trimmed length scalar -------------------------------------------------------

def trimmed_mean(df: DataFrame, keys: Sequence[str], value: str, name: str, trim: float = TRIM) -> DataFrame:
    """Mean after dropping floor(n * trim) values at each end, by distributed rank."""
    r = value_ranks(df, keys, value)
    k = F.floor(F.col("rank_n") * trim)
    lo, hi = F.greatest(F.col("rank_from"), k), F.least(F.col("rank_from") + F.col("c"), F.col("rank_n") - k)
    used = F.when(F.col("rank_n") - 2 * k <= 0, F.col("c")).otherwise(F.greatest(hi - lo, F.lit(0)))
    return r.withColumn("_u", used).groupBy(*keys).agg(
        (F.sum(F.col("v") * F.col("_u")) / F.sum("_u")).alias(name))


def plate_mean_length(tracks: DataFrame, length: str = "mean_length_px", span: str = "track_duration_s",
                      video: Sequence[str] = ("video_id",)) -> DataFrame:
    """One length per video: tracks of >= 10 s, or all when fewer than 5 such."""
    v = list(video)
    d = tracks.where(F.col(length).isNotNull()).withColumn(
        "_stable", F.coalesce(F.col(span) >= STABLE_SPAN_S, F.lit(False)))
    n = d.groupBy(*v).agg(F.sum(F.col("_stable").cast("int")).alias("_n"))
    d = d.join(n, v).where((F.col("_n") < STABLE_TRACKS) | F.col("_stable"))
    return trimmed_mean(d, v, length, "plate_mean_length_px")


def per_body_length(value: Column, length: Column) -> Column:
    return F.when(length > 0, F.try_divide(value, length))


# --- bends ---------------------------------------------------------------------

def bends_per_minute(half_bends: Column, frames: Column, fps: float, empty: Column | None = None) -> Column:
    """(positive + negative) / 2 per minute of `frames`; `empty` when there is no time."""
    minutes = frames / F.lit(fps * 60.0)
    return F.when(minutes >= 1e-9, F.try_divide(half_bends / F.lit(2.0), minutes)).otherwise(
        F.lit(0.0) if empty is None else empty)


def interval_cv(peaks: DataFrame, fps: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Population std over mean of the time between peaks; NULL below 3 peaks."""
    d = axis.with_previous(peaks, keys, {"_pf": F.col("frame")}, order=("frame", "ord", "sign"))
    gap = (F.col("frame") - F.col("_pf")) / F.lit(fps)
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_peaks"), F.avg(gap).alias("_m"), F.stddev_pop(gap).alias("_s"))
    return g.select(*keys, "n_peaks", F.when(
        (F.col("n_peaks") >= 3) & (F.col("_m") >= 1e-9), F.col("_s") / F.col("_m")).alias("bend_interval_cv"))


def peak_bends(series: DataFrame, value: str, fps: float, prominence: float, keys: Sequence[str] = KEYS, name: str = "bends_30s") -> DataFrame:
    """Bends per 30 s of valid samples: half the peaks of both signs of the detrended signal (body curvature, first eigen projection).

    A row per key; NULL where fewer than 10 samples are valid.
    """
    k = list(keys)
    d = windows.detrend(series, value, fps, k)
    halves = peaks.find_peaks(d, k, "detrended", prominence).groupBy(*k).agg(F.count(F.lit(1)).alias("_half"))
    n = series.groupBy(*k).agg(F.count(value).alias("_n"))
    rate = F.coalesce("_half", F.lit(0)) / F.lit(2.0) * F.lit(30.0) / (F.col("_n") / F.lit(fps))
    return n.join(halves, k, "left").select(*k, F.when(F.col("_n") >= 10, rate).alias(name))


# --- diameter --------------------------------------------------------------------

def _corners(xy: np.ndarray) -> np.ndarray:
    """Row numbers of the convex hull corners (monotone chain).

    Points strictly inside the polygon of eight extreme points cannot be corners and
    are left out first.
    """
    rows = np.arange(len(xy))
    if len(xy) > 32:
        turn = np.arange(8) * (np.pi / 4)
        far = np.argmax(xy @ np.vstack([np.cos(turn), np.sin(turn)]), axis=0)
        inside = np.ones(len(xy), bool)
        for a, b in zip(xy[far], xy[np.roll(far, -1)]):
            if (a != b).any():
                inside &= (b[0] - a[0]) * (xy[:, 1] - a[1]) - (b[1] - a[1]) * (xy[:, 0] - a[0]) > 0
        rows = np.unique(np.r_[rows[~inside], far])
    rows = rows[np.lexsort((xy[rows, 1], xy[rows, 0]))].tolist()
    if len(rows) < 3:
        return np.array(rows)
    x, y = xy[:, 0], xy[:, 1]

    def half(order):
        out: list = []
        for q in order:
            while len(out) > 1 and ((x[out[-1]] - x[out[-2]]) * (y[q] - y[out[-2]])
                                    - (y[out[-1]] - y[out[-2]]) * (x[q] - x[out[-2]])) <= 0:
                out.pop()
            out.append(q)
        return out

    return np.unique(half(rows) + half(rows[::-1]))


def _corner_rows(pdf: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """Only the hull corners of every group in the batch."""
    group = pdf.groupby(keys, sort=False).ngroup().to_numpy()
    order = np.argsort(group, kind="stable")
    xy = pdf[["x", "y"]].to_numpy()[order]
    cut = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
    kept = [a + _corners(xy[a:b]) for a, b in zip(cut, np.r_[cut[1:], len(xy)])]
    return pdf.iloc[order[np.concatenate(kept)]]


def _farthest(h: np.ndarray) -> float:
    best = 0.0
    for i in range(0, len(h), 512):
        d = h[i:i + 512, None, :] - h[None, :, :]
        best = max(best, float(np.sqrt((d ** 2).sum(axis=2)).max()))
    return best


def diameter(points: DataFrame, keys: Sequence[str] = KEYS, pool: int = 200_000) -> DataFrame:
    """Largest distance between two points of a group, exactly (0 below 2 points).

    Hulls merge: a task reduces its batches to corner points before any shuffle and
    hands on one hull per group (more often only when it holds very many groups).
    """
    k = list(keys)
    p = points.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(*k, "x", "y")

    def corners(batches):
        held: list[pd.DataFrame] = []
        for b in batches:
            if len(b) == 0:
                continue
            held.append(_corner_rows(b, k))
            if sum(map(len, held)) > pool:
                held = [_corner_rows(pd.concat(held, ignore_index=True), k)]
                if len(held[0]) > pool // 2:
                    yield held.pop()
        if held:
            yield _corner_rows(pd.concat(held, ignore_index=True), k)

    def widest(rows, starts):
        xy = rows[["x", "y"]].to_numpy()
        d = [_farthest(xy[a:b][_corners(xy[a:b])]) for a, b in zip(starts, np.r_[starts[1:], len(rows)])]
        return rows[k].iloc[starts].assign(displacement_px=d)

    types = key_types(p, k)
    hulls = p.mapInPandas(corners, f"{types}, x double, y double")
    found = map_groups(hulls, k, [], widest, f"{types}, displacement_px double")
    every = points.select(*k).distinct()
    return every.join(found, k, "left").select(*k, F.coalesce("displacement_px", F.lit(0.0)).alias("displacement_px"))


# --- diagnostics -----------------------------------------------------------------

def fragment_validity(series: DataFrame, flag: str = "was_skeletonized", keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows, valid share, validity flips and mean position per fragment."""
    v = F.col(flag) == 1
    d = axis.with_previous(series.withColumn("_v", v), keys, {"_pv": F.col("_v")})
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_frames"), F.avg(F.col("_v").cast("double")).alias("valid_fraction"),
        F.sum((F.col("_pv").isNotNull() & (F.col("_v") != F.col("_pv"))).cast("long")).alias("transitions"),
        F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"))


def continuity(per_fragment: DataFrame, runs: DataFrame, fps: float, keys: Sequence[str] = KEYS,
               video: Sequence[str] = ("video_id",)) -> DataFrame:
    """Per video: fragments with a run of >= 5/10/15/30/60 s and seconds in long runs."""
    k, v = list(keys), list(video)
    r = runs.withColumn("_s", F.col("n_rows") / F.lit(fps)).groupBy(*k).agg(
        F.max("_s").alias("_best"),
        *[F.sum(F.when(F.col("_s") >= t, F.col("_s")).otherwise(0.0)).alias(f"_in{t}") for t in (10, 30, 60)])
    d = per_fragment.join(r, k, "left").withColumn("_dur", F.col("n_frames") / F.lit(fps))
    base = d.groupBy(*v).agg(
        F.count(F.lit(1)).alias("total_fragments"), F.avg("_dur").alias("mean_fragment_duration_s"),
        F.avg("valid_fraction").alias("mean_valid_skeleton_fraction"),
        *[F.sum((F.coalesce("_best", F.lit(0.0)) >= t).cast("long")).alias(f"fragments_with_{t}s_continuous")
          for t in (5, 10, 15, 30, 60)],
        *[F.coalesce(F.sum(f"_in{t}"), F.lit(0.0)).alias(f"total_seconds_in_{t}s_runs") for t in (10, 30, 60)])
    return base.join(quantiles(d, v, "_dur", {"median_fragment_duration_s": 0.5}), v)


def unpivot(df: DataFrame, ids: Sequence[str], fields: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), [F.col(f).cast("double").alias(f) for f in fields], "field", "value")


def flag_profile(df: DataFrame, flag: str, fields: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """Mean, population std, min and max per field and flag value."""
    long = unpivot(df, [*ids, flag], fields)
    return long.groupBy(*ids, "field", flag).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))


def effect_size(df: DataFrame, flag: str, fields: Sequence[str], ids: Sequence[str], top: int | None = None) -> DataFrame:
    """Cohen's d between flag = 1 and flag = 0 per field, ranked inside `ids`."""
    p = flag_profile(df, flag, fields, ids)

    def side(value, col):
        return F.max(F.when(F.col(flag) == value, F.col(col)))

    g = p.groupBy(*ids, "field").agg(
        side(1, "mean").alias("acc_mean"), side(0, "mean").alias("rej_mean"),
        side(1, "std").alias("_sa"), side(0, "std").alias("_sr"))
    g = g.where(F.col("acc_mean").isNotNull() & F.col("rej_mean").isNotNull())
    pooled = F.sqrt((F.pow("_sa", F.lit(2)) + F.pow("_sr", F.lit(2))) / 2)
    d = F.coalesce(F.try_divide(F.abs(F.col("acc_mean") - F.col("rej_mean")), pooled), F.lit(0.0))
    g = g.withColumn("d", d)
    g = g.withColumn("rank_no", F.row_number().over(Window.partitionBy(*ids).orderBy(F.desc("d"), "field")))
    if top is not None:
        g = g.where(F.col("rank_no") <= top)
    return g.select(*ids, "field", "d", "acc_mean", "rej_mean", F.col("rank_no").cast("long").alias("rank_no"))


def array_profile(df: DataFrame, values: str, flag: str) -> DataFrame:
    """Positive width values of a row: max/min/mean/std/ratio, then mean and std by flag."""
    ok = F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v) & (v > 0))
    d = df.select(flag, ok.alias("_w")).where(F.size("_w") > 0)
    n = F.size("_w").cast("double")
    mean = F.aggregate("_w", F.lit(0.0), lambda s, v: s + v) / n
    d = d.select(flag, "_w", mean.alias("width_mean"), F.array_max("_w").alias("width_max"),
                 F.array_min("_w").alias("width_min"))
    var = F.aggregate("_w", F.lit(0.0), lambda s, v: s + (v - F.col("width_mean")) * (v - F.col("width_mean")))
    d = d.withColumns({"width_std": F.sqrt(var / F.size("_w")), "width_ratio": F.col("width_max") / F.col("width_min")})
    names = ["width_max", "width_min", "width_mean", "width_std", "width_ratio"]
    return flag_profile(d, flag, names).select(flag, "field", "n", "mean", "std")


def flag_coverage(df: DataFrame, flags: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows and percentage carrying each flag, per fragment."""
    long = unpivot(df.withColumns({f: (F.col(f) == 1).cast("int") for f in flags}), keys, flags)
    return long.groupBy(*keys, "field").agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("value"), F.lit(0.0)).cast("long").alias("n_set"),
        (F.lit(100.0) * F.coalesce(F.sum("value"), F.lit(0.0)) / F.count(F.lit(1))).alias("pct"))


def method_calibration(df: DataFrame, manual: str, methods: Sequence[str]) -> DataFrame:
    """Mean absolute error and bias of each method against the manual count, ranked."""
    long = unpivot(df, [manual], methods)
    diff = F.col("value") - F.col(manual)
    g = long.groupBy(F.col("field").alias("method")).agg(
        F.count(diff).alias("n"), F.avg(F.abs(diff)).alias("mae"), F.avg(diff).alias("bias"))
    return g.orderBy(F.asc("mae"), "method")


def metric_distribution(rows: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """n, quartiles and 1.5 IQR whiskers per metric and group; empty metrics are left out."""
    k = [*keys, "metric"]
    long = unpivot(rows, keys, fields).withColumnRenamed("field", "metric").where(F.col("value").isNotNull())
    q = quantiles(long, k, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    d = long.join(q, k)
    return d.groupBy(*k, "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.col("value") >= F.col("q1") - 1.5 * iqr, F.col("value"))).alias("whisker_lo"),
        F.max(F.when(F.col("value") <= F.col("q3") + 1.5 * iqr, F.col("value"))).alias("whisker_hi"))


def top_tracks(points: DataFrame, n: int, pinned: Sequence[int] = (), video: Sequence[str] = ("video_id",),
               track: str = "track_id") -> DataFrame:
    """Pinned ids first, then the n longest other tracks of each video."""
    g = points.groupBy(*video, track).agg(F.count(F.lit(1)).alias("n_rows"))
    pin = F.col(track).isin(list(pinned)) if pinned else F.lit(False)
    g = g.withColumn("is_pinned", pin)
    w = Window.partitionBy(*video).orderBy(F.desc("n_rows"), track)
    rest = g.where(~F.col("is_pinned")).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
    return g.where("is_pinned").unionByName(rest)


def even_sample(points: DataFrame, n: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """n evenly spaced rows per track: positions trunc(i * (N - 1) / (n - 1)), unique.

    A row decides from its own position alone whether some i lands on it.
    """
    d = axis.with_ordinal(points, keys)
    total = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    d = d.join(total, list(keys)).withColumn("_n", F.least(F.lit(n), F.col("_total")))
    p = F.col("ord") - 1
    # smallest i with trunc(i * step) >= p, tested in whole numbers
    i = F.ceil(F.try_divide(p * (F.col("_n") - 1), F.col("_total") - 1))
    lands = F.floor(F.try_divide(i * (F.col("_total") - 1), F.col("_n") - 1)) == p
    keep = F.when(F.col("_n") == 1, p == 0).otherwise(lands & (i <= F.col("_n") - 1))
    return d.where(keep).drop("_total", "_n")
