"""Crawling pipeline: linked identities, kinematics, body-length scaling, condition rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import rnd, settle, written
from ..operators import axis, fragments, graph, peaks, tracks, windows
from ..operators.ranking import quantiles

GROUP = ["video_id", "group_id"]
NOT_METRICS = {"video_id", "group_id", "track_id", "repr_track_id", "condition", "n_members", "n_valid"}


def metric_columns(rows: DataFrame) -> tuple[list[str], list[str]]:
    """Metrics of a track table: every numeric column but keys and counts of inputs.

    One rule decides their statistics: what is scaled by body length, or is a share above a
    threshold, is compared by its median alone; all else has mean and deviation too.
    """
    numeric = [f.name for f in rows.schema.fields if f.name not in NOT_METRICS and f.dataType.typeName() in ("double", "long", "integer", "float")]
    relative = [c for c in numeric if c.endswith(("_bl", "_bls")) or "_above_" in c]
    return [c for c in numeric if c not in relative], relative


def crawling(points: DataFrame, series: DataFrame, fps: float = 30.0, max_dist: float = 150.0, prominence: float = 0.30,
             min_span_s: float = tracks.MIN_SPAN_S, long_s: float = 5.0) -> DataFrame:
    """One row per linked animal.

    points: video_id, track_id, frame, row_id, x, y, has_skeleton, angle.
    series: video_id, track_id, frame, row_id, speed, motion_mode, length, width_midbody.
    """
    v = ["video_id"]
    frags = settle(fragments.fragment_summary(points, n=3))
    links = settle(graph.link_fragments(fragments.successor_candidates(frags, fps, max_dist=max_dist), fps))
    of = settle(graph.chain_groups(frags, links))
    p = written(points.join(of, [*v, "track_id"]), "linked_points")
    s = written(series.join(of, [*v, "track_id"]), "linked_series")

    ends = frags.join(of, [*v, "track_id"]).groupBy(*GROUP).agg(
        F.min_by("track_id", F.struct("start_frame", "track_id")).alias("repr_track_id"),
        F.count(F.lit(1)).alias("n_members"), ((F.max("end_frame") - F.min("start_frame") + 1) / F.lit(fps)).alias("track_duration_s"))
    threshold = settle(tracks.paused_threshold(series))
    kin = settle(tracks.kinematics(s, threshold, GROUP))
    rev = windows.reversals(s, keys=GROUP).groupBy(*GROUP).agg(F.count(F.lit(1)).alias("_rev"))
    path = tracks.path_geometry(p, GROUP)
    cov = tracks.coverage(p, keys=GROUP)
    run = windows.longest_bridged_run(p, F.col("has_skeleton") >= 1, fps, keys=[*GROUP, "track_id"]).groupBy(*GROUP).agg(
        F.max("longest_run_s").alias("longest_run_s"))

    key = [*GROUP, "track_id"]
    signal = windows.detrend(p, "angle", fps, keys=key)
    bends = settle(peaks.find_peaks(signal, key, "detrended", prominence))
    valid = signal.groupBy(*key).agg(F.max("n_valid").alias("n_valid")).groupBy(*GROUP).agg(F.sum("n_valid").alias("n_valid"))
    half = bends.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("half_bends"))
    cv = tracks.interval_cv(bends, fps, GROUP).select(*GROUP, "bend_interval_cv")

    lengths = ends.select(*GROUP, "track_duration_s").join(kin.select(*GROUP, "mean_length_px"), GROUP, "left")
    plate = settle(tracks.plate_mean_length(lengths))
    good = p.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    dense = windows.motion_frames(axis.last_per_frame(good, GROUP, ["x", "y"]), fps, keys=GROUP).join(plate, v, "left")
    slow = F.when(F.col("plate_mean_length_px") > 0, F.lit(0.001) * F.col("plate_mean_length_px")).otherwise(F.lit(0.1))
    dense = written(dense.withColumn("_slow", slow).select(*GROUP, "frame", "x", "y", "_slow"), "dense")
    events = windows.turn_events(dense, fps, F.col("_slow"), keys=GROUP)
    turns = windows.turn_rates(events, windows.velocity(dense, fps, GROUP), fps, GROUP)
    a, bl = F.abs("speed"), F.col("plate_mean_length_px")
    active = s.join(plate, v).where(bl > 0).groupBy(*GROUP).agg(*[
        F.avg(F.when(a.isNotNull(), (a >= F.lit(t) * bl).cast("double"))).alias(f"activity_fraction_above_{n}_bls")
        for t, n in ((0.05, "0p05"), (0.10, "0p10"), (0.20, "0p20"))])

    d = ends.join(plate, v, "left")
    for part in (kin, rev, path, cov, run, valid, half, cv, turns, active):
        d = d.join(part, GROUP, "left")
    measured = F.coalesce("n_speed", F.lit(0)) > 0
    minutes = F.col("n_speed") / F.lit(fps * 60.0)
    d = d.withColumns({
        "bpm": F.when(F.col("n_valid") > 0, rnd(tracks.bends_per_minute(F.coalesce("half_bends", F.lit(0)), F.col("n_valid"), fps), 2)),
        "is_long": F.col("track_duration_s") >= long_s,
        "reversal_count": F.when(measured, F.coalesce("_rev", F.lit(0))),
        "reversal_rate_per_min": F.when(measured, F.try_divide(F.coalesce("_rev", F.lit(0)).cast("double"), minutes)),
        "passed_filter": tracks.track_quality(F.col("track_duration_s"), F.col("skeleton_coverage"), min_span_s)})
    bl_of = {"mean_speed_bls": "mean_speed_pxs", "mean_forward_speed_bls": "mean_forward_speed_pxs",
             "mean_backward_speed_bls": "mean_backward_speed_pxs", "mean_speed_when_moving_bls": "mean_speed_when_moving",
             "path_length_bl": "path_length_px", "net_displacement_bl": "net_displacement_px"}
    d = d.withColumns({n: tracks.per_body_length(F.col(c), bl) for n, c in bl_of.items()})
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("arrow_reversal_count", "turn_count")}
    return d.withColumns(zero).drop("_rev", "half_bends", "n_speed")


def condition_rows(rows: DataFrame, min_span_s: float = tracks.MIN_SPAN_S, mean_cols=None, median_cols=None) -> DataFrame:
    """Long condition rows (condition, metric, n, mean, median, std) over tracks that pass the gate,
    recomputed from span and coverage; plus total and kept counts. Pivot only for a sheet."""
    found = metric_columns(rows)
    means = found[0] if mean_cols is None else mean_cols
    medians = found[1] if median_cols is None else median_cols
    ok = tracks.track_quality(F.col("track_duration_s"), F.col("skeleton_coverage"), min_span_s)
    d = settle(rows.withColumn("_ok", ok).select(
        "condition", "_ok", *[F.col(c).cast("double").alias(c) for c in [*means, *medians]]))
    n = d.groupBy("condition").agg(F.count(F.lit(1)).alias("n_total"), F.sum(F.col("_ok").cast("long")).alias("n_kept"))
    long = tracks.unpivot(d.where("_ok"), ["condition"], [*means, *medians]).withColumnRenamed("field", "metric")
    k = ["condition", "metric"]
    g = long.groupBy(*k).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    full = F.col("metric").isin(list(means))
    g = g.withColumns({c: F.when(full, F.col(c)) for c in ("mean", "std")})
    every = n.withColumn("metric", F.explode(F.array(*[F.lit(c) for c in [*means, *medians]])))
    return every.join(g, k, "left").join(quantiles(long, k, "value", {"median": 0.5}), k, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def wide_condition_rows(long: DataFrame, means: list[str], medians: list[str]) -> DataFrame:
    """Sheet layout: one row per condition, one column per statistic."""
    aggs = [F.max(F.when(F.col("metric") == m, F.col(s))).alias(f"{m}_{s}") for m in means for s in ("mean", "median", "std")]
    aggs += [F.max(F.when(F.col("metric") == m, F.col("median"))).alias(f"{m}_median") for m in medians]
    return long.groupBy("condition", "n_total", "n_kept").agg(*aggs)
