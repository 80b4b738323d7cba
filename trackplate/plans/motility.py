"""Swimming pipeline: fragments to groups to bend metrics to one row per video."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import ratio, rnd, settle, written
from ..operators import assay, fragments, graph, peaks, tracks, windows
from ..operators.ranking import join_groups, quantiles

UNIT = ["video_id", "group_id", "unit_track", "unit_segment"]
SUB = ["video_id", "track_id", "segment"]
KEPT = ["video_id", "track_id", "frame", "row_id", "x", "y", "angle"]
READ = [*KEPT, "skeleton_length", "length", "speed", "solidity"]


@dataclass(frozen=True)
class Settings:
    """Shipped thresholds; fps comes with the video."""

    fps: float = 30.0
    max_dist: float = 50.0
    gap_s: float = 5.0
    flicker_s: float = 0.5
    flicker_std: float = 20.0
    min_obs_s: float = 10.0
    most_tracks: int = 3
    long_s: float = 5.0
    prominence: float = 0.30


@dataclass(frozen=True)
class Motility:
    units: DataFrame        # one row per kept or debris animal
    drops: DataFrame        # one row per dropped track with its reason
    groups: DataFrame       # fragment -> group
    flicker: DataFrame      # flicker counts per fragment
    frames: DataFrame       # the rows read, as written


def _segments(frames: DataFrame, s: Settings) -> DataFrame:
    masked = windows.flicker_mask(frames, "skeleton_length", s.fps, s.flicker_std, s.flicker_s)
    masked = written(masked.select(*KEPT, "bad"), "masked")
    return written(windows.segments(masked).select(*SUB, "frame", "row_id", "x", "y", "angle", "bad"), "segments")


def motility(frames: DataFrame, s: Settings = Settings()) -> Motility:
    """frames: video_id, track_id, frame, row_id, x, y, skeleton_length, angle, length, speed, solidity.

    Row-level work happens in the flicker mask, the bend count, the diameter and the
    shape metrics; everything between works on one row per fragment or clean span. The
    rows are written once, whatever made them, as each of these steps reads them.
    """
    fps, v = s.fps, ["video_id"]
    frames = written(frames.select(*READ), "frames")
    frags = settle(fragments.fragment_summary(frames))
    adj = settle(fragments.neighbours(frags, min_gap=0, max_gap=int(s.gap_s * fps), max_dist=s.max_dist))
    comp = graph.number_components(graph.connected_components(frags, adj))
    groups = settle(comp.join(graph.classify_components(frags, adj, comp), [*v, "component"]))

    marked = _segments(frames, s)
    rows = marked.where(~F.col("bad")).drop("bad")
    spans = settle(windows.clean_spans(rows).join(groups.select(
        *v, "track_id", "group_id", "classification"), [*v, "track_id"]))

    # chain groups are one animal; collisions keep up to three concurrent clean spans
    total = spans.groupBy(*v, "group_id").agg(F.sum("n_rows").alias("clean_rows"))
    wall = frags.join(groups, [*v, "track_id"]).groupBy(*v, "group_id").agg(
        F.min("start_frame").alias("_a"), F.max("end_frame").alias("_b"))
    info = groups.select(*v, "group_id", "classification", "repr_track_id", "curl_count", "fragment_count").distinct()
    chain = (info.where("classification = 'chain'").join(total, [*v, "group_id"], "left").join(wall, [*v, "group_id"])
             .withColumn("clean_rows", F.coalesce("clean_rows", F.lit(0))))
    enough = F.col("clean_rows") / F.lit(fps) >= s.min_obs_s
    chain_units = chain.where(enough).select(
        *v, "group_id", F.lit(-1).cast("long").alias("unit_track"), F.lit(-1).cast("long").alias("unit_segment"), "classification",
        F.col("repr_track_id").alias("track_id"), F.col("clean_rows").alias("frames"), "curl_count", "fragment_count",
        F.greatest((F.col("_b") - F.col("_a")) / F.lit(fps), F.lit(1e-9)).alias("duration_s"))

    crowd = spans.where("classification = 'collision'").withColumn("sub", F.struct("track_id", "segment"))
    gk = [*v, "group_id"]
    keep = graph.max_concurrent(crowd, gk).select(
        *gk, F.least(F.greatest("max_concurrent", F.lit(1)), F.lit(s.most_tracks)).alias("n_keep"))
    chosen = settle(graph.select_concurrent(crowd, gk, "sub", keep).join(
        crowd.select(*gk, "sub", "n_rows"), [*gk, "sub"]))
    long_enough = F.col("n_rows") / F.lit(fps) >= s.min_obs_s
    crowd_units = chosen.where(long_enough).select(
        *gk, F.col("sub.track_id").alias("unit_track"), F.col("sub.segment").alias("unit_segment"), F.lit("collision").alias("classification"),
        F.col("sub.track_id").alias("track_id"), F.col("n_rows").alias("frames"), F.lit(0).cast("long").alias("curl_count"),
        F.lit(1).cast("long").alias("fragment_count"), (F.col("n_rows") / F.lit(fps)).alias("duration_s"))
    units = settle(chain_units.unionByName(crowd_units))

    # which clean spans feed which animal
    of_chain = spans.where("classification = 'chain'").select(*SUB, "group_id").join(
        chain_units.select(*gk), gk, "left_semi").select(
        *SUB, "group_id", F.lit(-1).cast("long").alias("unit_track"), F.lit(-1).cast("long").alias("unit_segment"))
    of_crowd = crowd_units.select(*v, F.col("unit_track").alias("track_id"), F.col("unit_segment").alias("segment"),
                                  "group_id", "unit_track", "unit_segment")
    feeds = settle(of_chain.unionByName(of_crowd))
    used = join_groups(rows, feeds, SUB)

    # one table of signal lengths for the signals and for the animals' counts
    valid = written(windows.valid_counts(used, "angle", SUB), "valid")
    signal = windows.detrend(used, "angle", fps, keys=SUB, counts=valid)
    bends = settle(peaks.find_peaks(signal, SUB, "detrended", s.prominence))
    by_unit = bends.join(feeds, SUB)
    half = by_unit.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("half_bends"))
    n_valid = valid.join(feeds, SUB).groupBy(*UNIT).agg(F.sum("n_valid").alias("n_valid"))
    cv = tracks.interval_cv(by_unit, fps, UNIT).select(*UNIT, "bend_interval_cv")
    disp = tracks.diameter(used, UNIT)
    belongs = feeds.select(*v, "track_id", "group_id", "unit_track", "unit_segment").distinct()
    whole = groups.where("classification = 'chain'").select(*v, "track_id", "group_id", F.lit(-1).cast("long").alias("unit_track"),
                                                             F.lit(-1).cast("long").alias("unit_segment"))
    belongs = belongs.where("unit_track >= 0").unionByName(whole.join(chain_units.select(*gk), gk, "left_semi").select(*belongs.columns))
    shape = tracks.shape_metrics(join_groups(frames.select(*v, "track_id", "length", "speed", "solidity"), belongs, [*v, "track_id"]), UNIT)
    total_frames = frags.groupBy(*v).agg(F.greatest(F.max("end_frame") + 1, F.lit(1)).alias("_total"))

    d = units
    for part in (half, n_valid, cv, disp, shape):
        d = d.join(part, UNIT, "left")
    d = d.join(total_frames, v)
    is_chain = F.col("classification") == "chain"
    d = d.where(is_chain | F.col("n_valid").isNotNull())      # a collision span needs a usable signal
    bpm = tracks.bends_per_minute(F.coalesce("half_bends", F.lit(0)), F.when(is_chain, F.col("frames")).otherwise(F.col("n_valid")), fps)
    frac = F.when(is_chain, F.least(F.col("frames") / F.lit(fps) / F.col("duration_s"), F.lit(1.0))).otherwise(F.lit(1.0))
    d = d.select(
        *UNIT, "classification", F.col("track_id").alias("repr_track_id"), "frames", "curl_count", "fragment_count",
        (F.col("duration_s") >= s.long_s).alias("is_long"), rnd("duration_s", 3).alias("duration_s"), rnd(bpm, 2).alias("bpm"),
        "bend_interval_cv", rnd(F.col("frames") / F.col("_total") * 100, 1).alias("coverage_pct"), rnd(frac, 3).alias("valid_frac"),
        rnd(F.coalesce("displacement_px", F.lit(0.0)), 1).alias("displacement_px"), rnd("length_cv", 4).alias("length_cv"),
        rnd("solidity_median", 4).alias("solidity_median"), rnd("speed_median_abs", 2).alias("speed_median_abs"))
    rule = assay.debris_rule(F.col("displacement_px"), F.col("bpm"), F.col("length_cv"), F.col("solidity_median"), F.col("speed_median_abs"))
    out = settle(d.withColumn("debris_rule", rule))

    member = groups.select(*v, "track_id", "group_id")
    short = chain.where(~enough).select(*gk, F.when(F.col("clean_rows") == 0, "flicker_killed_track").otherwise("curl_too_short").alias("reason"))
    empty = (info.where("classification = 'collision'").join(crowd.select(*gk).distinct(), gk, "left_anti")
             .select(*gk, F.lit("collision_too_short").alias("reason")))
    drops = short.unionByName(empty).join(member, gk).select(*v, "track_id", "group_id", "reason", F.lit(None).cast("string").alias("debris_rule"))
    drops = drops.unionByName(chosen.where(~long_enough).select(
        *v, F.col("sub.track_id").alias("track_id"), "group_id", F.lit("collision_too_short").alias("reason"), F.lit(None).cast("string").alias("debris_rule")))
    drops = drops.unionByName(out.where(F.col("debris_rule").isNotNull()).select(
        *v, F.col("repr_track_id").alias("track_id"), "group_id", F.lit("debris").alias("reason"), "debris_rule"))
    return Motility(out, drops, groups, windows.flicker_of(marked, fps), frames)


def kept(m: Motility) -> DataFrame:
    return m.units.where(F.col("debris_rule").isNull()).drop("debris_rule")


def member_map(m: Motility) -> DataFrame:
    """Fragment to final animal, kept animals only."""
    k = kept(m).select(*UNIT)
    one = k.where("unit_track >= 0").select("video_id", F.col("unit_track").alias("track_id"), "group_id").distinct()
    chain = k.where("unit_track < 0").join(m.groups, ["video_id", "group_id"]).select("video_id", "track_id", "group_id")
    return one.unionByName(chain)


def video_summary(rows: DataFrame, videos: DataFrame) -> DataFrame:
    """One row per video over its long animals; videos without any keep NULL metrics and their status.

    `videos` may carry an `error`: rows of a failed video, if it left any, do not count.
    """
    if "error" in videos.columns:
        rows = rows.join(videos.where(F.col("error").isNotNull()).select("video_id"), "video_id", "left_anti")
    v = ["video_id"]
    long = F.col("is_long")

    def over(fn, c, digits=2):
        return rnd(fn(F.when(long, F.col(c))), digits)

    g = rows.groupBy(*v).agg(
        F.count(F.lit(1)).alias("n_fragments_total"), F.sum(long.cast("long")).alias("n_fragments_long"),
        over(F.avg, "bpm").alias("bpm_mean_long"), over(F.stddev_pop, "bpm").alias("bpm_std_long"),
        over(F.min, "bpm").alias("bpm_min_long"), over(F.max, "bpm").alias("bpm_max_long"),
        over(F.avg, "bend_interval_cv", 4).alias("bend_cv_mean_long"),
        F.sum((long & (F.col("classification") == "chain")).cast("long")).alias("n_curl_long"),
        F.sum((long & (F.col("classification") == "collision")).cast("long")).alias("n_collision_long"),
        over(F.avg, "valid_frac", 3).alias("mean_valid_frac_long"), over(F.avg, "fragment_count", 2).alias("mean_fragment_count_long"))
    names = {"bpm": ("bpm_median_long", 2), "bend_interval_cv": ("bend_cv_median_long", 4), "length_cv": ("length_cv_median_long", 4),
             "solidity_median": ("solidity_median_long", 4), "speed_median_abs": ("speed_median_abs_median_long", 4)}
    m = quantiles(tracks.unpivot(rows.where(long), v, list(names)), [*v, "field"], "value", {"m": 0.5})
    m = m.groupBy(*v).agg(*[rnd(F.max(F.when(F.col("field") == f, F.col("m"))), d).alias(n) for f, (n, d) in names.items()])
    d = videos.join(g, v, "left").join(m, v, "left")
    counts = ["n_fragments_total", "n_fragments_long", "n_curl_long", "n_collision_long"]
    return d.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def funnel(m: Motility) -> DataFrame:
    """Analysis log per video as (video, section, name, n)."""
    v = ["video_id"]
    first = m.groups.select(*v, "group_id", "classification", "fragment_count").distinct()

    def count(df, section, name):
        return df.groupBy(*v, F.lit(section).alias("section"), name.alias("name")).agg(F.count(F.lit(1)).alias("n"))

    # one drop per group for whole-group reasons, one per animal otherwise
    whole = m.drops.where(F.col("reason").isin("curl_too_short", "flicker_killed_track")).select(*v, "group_id", "reason").distinct()
    rest = m.drops.where(~F.col("reason").isin("curl_too_short", "flicker_killed_track")).select(*v, "group_id", "reason")
    flicker = settle(m.flicker.select(*v, "flicker_frames"))
    extracted = (m.units.where("classification = 'collision'").groupBy(*v, "group_id").agg(F.count(F.lit(1)).alias("k")))
    parts = [
        count(m.groups, "input_tracks", F.lit("all")), count(first, "groups", F.col("classification")),
        count(first, "fragments_per_group", F.col("fragment_count").cast("string")), count(whole.unionByName(rest), "dropped", F.col("reason")),
        count(extracted, "animals_per_cluster", F.col("k").cast("string")), count(extracted.where("k > 1"), "multi_clusters", F.lit("all")),
        count(flicker.where("flicker_frames > 0"), "tracks_with_flicker", F.lit("all")),
        flicker.groupBy(*v, F.lit("flicker_frames").alias("section"), F.lit("all").alias("name")).agg(F.sum("flicker_frames").alias("n"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _measures(m: Motility) -> tuple[DataFrame, DataFrame]:
    """Per video: flicker counts, and survivors with their bends."""
    v = ["video_id"]
    fl = m.flicker.groupBy(*v).agg(F.count(F.lit(1)).alias("_n"), F.sum("flicker_frames").alias("total_flicker_frames"),
                                   F.sum((F.col("flicker_frames") > 0).cast("long")).alias("tracks_with_any_flicker"))
    k = kept(m)
    s = k.groupBy(*v).agg(F.count(F.lit(1)).alias("_k"), F.avg("bpm").alias("bpm_mean_surviving"))
    return settle(fl), settle(s.join(quantiles(k, v, "bpm", {"bpm_median_surviving": 0.5}), v, "left"))


def pipeline_metrics(m: Motility, videos: DataFrame) -> DataFrame:
    """Sweep comparison row per video: flicker share, survivors and their bends; all NULL where `videos` carries an `error`."""
    return _per_video(_measures(m), videos)


def _per_video(measures: tuple[DataFrame, DataFrame], videos: DataFrame) -> DataFrame:
    v = ["video_id"]
    d = videos.join(measures[0], v, "left").join(measures[1], v, "left")
    d = d.withColumns({"tracks_with_any_flicker_frac": rnd(ratio(F.col("tracks_with_any_flicker"), F.greatest("_n", F.lit(1))), 4),
                          "pipeline_surviving_tracks": F.coalesce("_k", F.lit(0))}).drop("_n", "_k")
    if "error" not in d.columns:
        return d
    return d.withColumns({c: F.when(F.col("error").isNull(), F.col(c)) for c in d.columns if c not in (*videos.columns,)})


@dataclass(frozen=True)
class Run:
    """One setting of a sweep: what changed, its results, and its videos with their `error`."""

    run_id: str
    param: str
    value: str
    result: Motility
    videos: DataFrame


def sweep_comparison(runs: Sequence[Run]) -> DataFrame:
    """One row per (run, video): run_id, param_changed, param_value, the metrics and `error`. A result that several runs share is measured once."""
    measures = {id(r.result): r.result for r in runs}
    measures = {k: _measures(m) for k, m in measures.items()}
    rows = [_per_video(measures[id(r.result)], r.videos).withColumns({
        "run_id": F.lit(r.run_id), "param_changed": F.lit(r.param), "param_value": F.lit(r.value)}) for r in runs]
    return functools.reduce(DataFrame.unionByName, rows)
