"""Peaks, runs, reversals and events against brute force, for several chunk sizes."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackplate.operators import peaks, tracks, windows
from trackplate.plans import motility


def brute_peaks(x, p):
    out, n, i = [], len(x), 1
    while i < n - 1:
        if x[i - 1] < x[i]:
            j = i
            while j + 1 < n and x[j + 1] == x[i]:
                j += 1
            if j + 1 < n and x[j + 1] < x[i]:
                m = (i + j) // 2
                l = m
                lo = x[m]
                while l >= 0 and x[l] <= x[m]:
                    lo = min(lo, x[l])
                    l -= 1
                h, hi = m, x[m]
                while h < n and x[h] <= x[m]:
                    hi = min(hi, x[h])
                    h += 1
                if x[m] - max(lo, hi) >= p:
                    out.append(m)
            i = j
        i += 1
    return out


@pytest.mark.parametrize("chunk", [4, 9, 50, 65536])
def test_peaks_any_chunk(spark, chunk):
    rng = np.random.default_rng(chunk)
    rows, want = [], set()
    for k in range(12):
        x = np.round(np.cumsum(rng.integers(-2, 3, 90)) / 2.0, 1) if k % 2 else np.round(rng.normal(size=90), 1)
        x[30:45] = x[30] if k % 3 == 0 else x[30:45]
        for i, v in enumerate(x):
            rows.append((k, i + 1, i * 2, len(x), float(v)))
        want |= {(k, 1, i + 1) for i in brute_peaks(x, 1.0)} | {(k, -1, i + 1) for i in brute_peaks(-x, 1.0)}
    df = spark.createDataFrame(rows, "k long, ord long, frame long, n_valid long, v double")
    got = peaks.find_peaks(df, ["k"], "v", 1.0, chunk).collect()
    assert {(r.k, r.sign, r.ord) for r in got} == want and len(got) == len(want)
    assert all(r.frame == (r.ord - 1) * 2 for r in got)


def test_spectrum_modes_agree(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(g, i + 1, float(v)) for g in range(2) for i, v in enumerate(rng.normal(size=40 + g))],
                               "g long, ord long, v double")
    a = peaks.spectrum(df, ["g"], "v", 30.0).toPandas()
    b = peaks.spectrum(df, ["g"], "v", 30.0, small=0).toPandas()
    m = a.merge(b, on=["g", "k"])
    assert len(m) == len(a) == len(b) and np.allclose(m["amplitude_x"], m["amplitude_y"])


@pytest.mark.parametrize("width", [10, 33, 100000])
def test_spaced_events(spark, width):
    rng = np.random.default_rng(width)
    rows, want = [], set()
    for k in range(3):
        fr = np.sort(rng.choice(400, 150, replace=False))
        last = -10**9
        for f in fr:
            rows.append((k, int(f), 90.0))
            if f - last >= 9:
                want.add((k, int(f)))
                last = f
    df = spark.createDataFrame(rows, "k long, frame long, angle double")
    assert {(r.k, r.frame) for r in windows.spaced(df, 9, ["k"], width).collect()} == want


def brute_reversals(mm, pause):
    hits, i = [], 0
    while i < len(mm):
        if mm[i] == -1:
            j, zeros = i - 1, 0
            while j >= 0 and mm[j] == 0:
                zeros, j = zeros + 1, j - 1
            if j >= 0 and mm[j] == 1 and zeros <= pause:
                hits.append(i)
            while i < len(mm) and mm[i] == -1:
                i += 1
        else:
            i += 1
    return hits


def test_reversals(spark):
    rng = np.random.default_rng(5)
    rows, want = [], set()
    for k in range(6):
        mm = rng.choice([1, 0, -1, 9, 8], 200, p=[0.3, 0.35, 0.25, 0.05, 0.05])
        for f, v in enumerate(mm):
            if v != 8:
                rows.append(("v", k, f, f, None if v == 9 else int(v)))
        lo = min(f for f, v in enumerate(mm) if v != 8)
        want |= {(k, f) for f in brute_reversals(mm, 2) if f >= lo}
    df = spark.createDataFrame(rows, "video_id string, track_id long, frame long, row_id long, motion_mode int")
    assert {(r.track_id, r.frame) for r in windows.reversals(df, pause=2).collect()} == want


def test_runs(spark):
    fr = [0, 1, 2, 4, 5, 40, 80]
    ok = [1, 1, 0, 1, 1, 1, 1]
    df = spark.createDataFrame([("v", 1, f, i, o) for i, (f, o) in enumerate(zip(fr, ok))],
                               "video_id string, track_id long, frame long, row_id long, ok int")
    r = windows.consecutive_runs(df, F.col("ok") == 1).orderBy("start_frame").collect()
    assert [(x.start_frame, x.n_rows) for x in r] == [(0, 2), (4, 2), (40, 1), (80, 1)]
    best = windows.longest_bridged_run(df, F.col("ok") == 1, 10.0, bridge=34).first()
    assert best.longest_run_s == pytest.approx(4.1)          # 0..40 bridges the hole of 34, not that of 39
    none = windows.longest_bridged_run(df, F.lit(False), 10.0).first()
    assert none.longest_run_s == 0.0


def test_peak_bends(spark):
    """Two turns of a sine over 60 valid samples at 10 a second; gaps are squeezed out; fewer than 10 samples give NULL."""
    t = np.arange(60)
    rows = [("v", 1, int(2 * i), int(i), float(np.sin(2 * np.pi * (i + 3) / 20))) for i in t]
    rows += [("v", 1, 1, 500, None), ("v", 3, 0, 600, None)] + [("v", 2, int(i), 700 + int(i), float(i % 2)) for i in range(9)]
    df = spark.createDataFrame(rows, "video_id string, track_id long, frame long, row_id long, e double")
    got = {r.track_id: r.bends_30s for r in tracks.peak_bends(df, "e", 10.0, 0.3).collect()}
    assert got == {1: pytest.approx(6 / 2 * 30 / 6.0), 2: None, 3: None}


def test_diameter_and_sample(spark):
    rng = np.random.default_rng(2)
    xy = rng.normal(size=(300, 2)) * 50
    df = spark.createDataFrame([("v", 1, i, i, float(a), float(b)) for i, (a, b) in enumerate(xy)] + [("v", 2, 0, 0, 1.0, 1.0), ("v", 3, 0, 0, None, 1.0)],
                               "video_id string, track_id long, frame long, row_id long, x double, y double")
    got = {r.track_id: r.displacement_px for r in tracks.diameter(df).collect()}
    assert got[1] == pytest.approx(np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2)).max()) and got[2] == got[3] == 0.0
    for n in (1, 7, 10, 300, 1000):
        pos = sorted(r.ord - 1 for r in tracks.even_sample(df.where("track_id = 1"), n).collect())
        m = min(n, 300)
        want = sorted({i * 299 // (m - 1) for i in range(m)}) if m > 1 else [0]
        assert pos == want


def test_trimmed_mean_fallback(spark):
    rows = [("v", float(i), 20.0) for i in range(20)] + [("w", 5.0, 1.0), ("w", 9.0, 30.0)]
    df = spark.createDataFrame(rows, "video_id string, mean_length_px double, track_duration_s double")
    got = {r.video_id: r.plate_mean_length_px for r in tracks.plate_mean_length(df).collect()}
    assert got == {"v": pytest.approx(np.mean(np.arange(2, 18))), "w": 7.0}


def test_detrended_rows_go_by_chunk(spark):
    """A signal's rows are spread over its buckets and chunks, not held in one task."""
    df = spark.range(0, 2_000_000, 1, 4).select(F.lit("v").alias("video_id"), (F.col("id") % 2).alias("track_id"), F.col("id").alias("frame"),
                                                F.col("id").alias("row_id"), F.sin("id").alias("angle"))
    plan = windows.detrend(df, "angle", 10.0)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\([^)]*_bucket#", plan) and re.search(r"hashpartitioning\([^)]*_chunk#", plan)


def test_flicker_from_segments(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for k in range(40):
        bad = rng.random(int(rng.integers(1, 30))) < rng.choice([0.0, 0.3, 0.9, 1.0])
        rows += [("v", k, i, i, bool(b)) for i, b in enumerate(bad)]
        runs = re.findall("b+|g+", "".join("b" if b else "g" for b in bad))
        want[k] = (int(bad.sum()), sum(r[0] == "b" for r in runs), len(bad), max([len(r) for r in runs if r[0] == "g"], default=0) / 10.0)
    marked = windows.segments(spark.createDataFrame(rows, "video_id string, track_id long, frame long, row_id long, bad boolean"))
    got = {r["track_id"]: tuple(r)[2:] for r in windows.flicker_of(marked, 10.0).collect()}
    assert got == want


def test_motility_makes_its_rows_once(spark):
    made = spark.sparkContext.accumulator(0)
    rows = [("v", t, f, t * 1000 + f, float(f), float(t), 40.0, float(np.sin(f / 3)), 40.0 + f % 3, 1.0, 0.8) for t in range(2) for f in range(60)]
    cols = ("video_id string, track_id long, frame long, row_id long, x double, y double, skeleton_length double, angle double, "
            "length double, speed double, solidity double")

    def count(batches):
        for b in batches:
            made.add(len(b))
            yield b

    m = motility.motility(spark.createDataFrame(rows, cols).mapInPandas(count, cols), motility.Settings(fps=10.0, min_obs_s=1.0))
    assert m.units.count() > 0
    assert made.value == len(rows)
