"""Chunked axis and rank primitives equal their plain one-task counterparts."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackplate.operators import axis, ranking, windows


def _track(n=120, seed=0):
    rng = np.random.default_rng(seed)
    f = np.sort(rng.integers(0, 200, n))
    return pd.DataFrame({"k": "a", "frame": f, "row_id": np.arange(n), "v": np.round(rng.normal(size=n), 3)})


@pytest.mark.parametrize("width", [3, 17, 100000])
def test_previous_next_running(spark, width):
    pdf = pd.concat([_track(seed=1), _track(40, seed=2).assign(k="b")])
    df = spark.createDataFrame(pdf)
    d = axis.with_previous(df, ["k"], {"p": F.col("v")}, width=width)
    d = axis.with_next(d, ["k"], {"q": F.col("v")}, width=width)
    d = axis.with_running(d, ["k"], {"s": F.col("row_id")}, width=width).toPandas().sort_values(["k", "frame", "row_id"])
    for _, g in d.groupby("k"):
        assert np.allclose(g["p"].iloc[1:], g["v"].iloc[:-1]) and np.isnan(g["p"].iloc[0])
        assert np.allclose(g["q"].iloc[:-1], g["v"].iloc[1:]) and np.isnan(g["q"].iloc[-1])
        assert (g["s"] == g["row_id"].cumsum()).all()


@pytest.mark.parametrize("width", [5, 100000])
def test_halo_window_equals_pandas(spark, width, monkeypatch):
    monkeypatch.setattr(axis.halo, "__defaults__", (width,))
    pdf = _track()
    pdf.loc[::7, "v"] = None
    d = windows.rolling_std(spark.createDataFrame(pdf.astype({"v": object}).where(pdf.notna(), None), "k string, frame long, row_id long, v double"),
                            "v", 5, keys=["k"])
    got = d.toPandas().sort_values(["frame", "row_id"])["rolling_std"].to_numpy()
    want = pdf.sort_values(["frame", "row_id"])["v"].rolling(5, center=True, min_periods=1).std(ddof=0).fillna(0.0)
    assert np.allclose(got, want, atol=1e-7)


def test_densify_never_interpolates(spark):
    df = spark.createDataFrame([("a", 3, 1.0), ("a", 6, 2.0), ("b", 1, 5.0)], "k string, frame long, x double")
    d = axis.densify(df, ["k"], ["x"], width=2).orderBy("k", "frame").collect()
    assert [(r.k, r.frame, r.x) for r in d] == [("a", 3, 1.0), ("a", 4, None), ("a", 5, None), ("a", 6, 2.0), ("b", 1, 5.0)]


def test_long_gaps(spark):
    """A gap of 10^9 frames gives only the frames in reach; gaps shorter than twice the reach are whole."""
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 10**9, 2.0), ("a", 10**9 + 5, 3.0), ("b", 7, 4.0)], "k string, frame long, x double")
    got = [(r.k, r.frame, r.x) for r in axis.densify(df, ["k"], ["x"], reach=3).orderBy("k", "frame").collect()]
    e = 10**9
    want = [("a", 0, 1.0), *[("a", i, None) for i in (1, 2, 3, e - 3, e - 2, e - 1)], ("a", e, 2.0), *[("a", e + i, None) for i in range(1, 5)], ("a", e + 5, 3.0), ("b", 7, 4.0)]
    assert got == want


def test_motion_frames_give_the_same_events(spark):
    rng = np.random.default_rng(8)
    f = np.unique(np.r_[rng.integers(0, 300, 180), 5000 + rng.integers(0, 60, 55), 9000])
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "frame": f, "x": rng.normal(size=len(f)).cumsum(), "y": rng.normal(size=len(f)).cumsum()}))
    out = []
    for d in (axis.densify(df, ["k"], ["x", "y"]), windows.motion_frames(df, 10.0, keys=["k"])):
        e = windows.turn_events(d, 10.0, F.lit(0.1), keys=["k"])
        out.append((sorted(tuple(r) for r in e.collect()), d.count(), [tuple(r) for r in windows.turn_rates(e, windows.velocity(d, 10.0, ["k"]), 10.0, ["k"]).collect()]))
    assert out[0][0] == out[1][0] and len(out[0][0]) > 5 and out[0][2] == out[1][2] and out[1][1] < 500 < out[0][1]


@pytest.mark.parametrize("few", [2000, 0])
def test_quantiles_with_hot_value(spark, monkeypatch, few):
    monkeypatch.setattr(ranking, "FEW", few)                  # 0: every group goes by its sketch
    monkeypatch.setattr(ranking, "MARGIN", 0.01)
    rng = np.random.default_rng(3)
    v = np.concatenate([np.full(4000, 7.0), rng.lognormal(3, 2, 5999), [1e300]])
    k = np.arange(10000) % 3 == 0
    df = spark.createDataFrame(pd.DataFrame({"k": np.where(k, "a", "b"), "v": v, "w": -v[::-1]})).withColumn("w", F.when(F.col("k") == "b", F.col("w")))
    probs = {"a1": 0.01, "a50": 0.5, "a98": 0.98}
    got = {r.k: r for r in ranking.column_quantiles(df, ["k"], {"v": probs, "w": {"w25": 0.25}}).collect()}
    for name, on in (("a", k), ("b", ~k)):
        assert np.allclose([got[name][c] for c in probs], np.quantile(v[on], [0.01, 0.5, 0.98]))
    assert got["a"].w25 is None and np.isclose(got["b"].w25, np.quantile(-v[::-1][~k], 0.25))
    one = ranking.quantiles(df, [], "v", probs).first()
    assert np.allclose([one.a1, one.a50, one.a98], np.quantile(v, [0.01, 0.5, 0.98]))
    assert ranking.quantiles(df.where("k = 'c'"), ["k"], "v", probs).count() == 0


def test_quantiles_move_few_values(spark):
    """Between sketch and answer only values near the wanted rank are grouped; an outlier changes nothing of that."""
    df = spark.range(200_000).select((F.col("id") % 100_000 + F.lit(0.5)).alias("v")).unionByName(spark.createDataFrame([(1e308,)], "v double"))
    moved = {}
    q = ranking.quantiles(df, [], "v", {"m": 0.5})
    assert q.first().m == pytest.approx(np.median(np.append(np.tile(np.arange(100_000) + 0.5, 2), 1e308)))
    for node in re.findall(r"\+- Generate explode.*", q._jdf.queryExecution().executedPlan().toString()):
        moved[node] = True
    assert moved
    binned = ranking._binned(df, [], "v").groupBy("_bin").count().toPandas()["count"]
    assert len(binned) == ranking.COARSE * ranking.FINE and binned.max() < 4 * 200_000 / len(binned)


def test_value_ranks_and_ordered_prefix(spark):
    pdf = pd.DataFrame({"k": ["a"] * 6, "v": [2, 2, 1, 5, 2, 9], "s": [1, 2, 3, 4, 5, 6], "n": list("fedcba")})
    df = spark.createDataFrame(pdf)
    got = {r.v: (r.rank_from, r.c, r.rank_n) for r in ranking.value_ranks(df, ["k"], "v").collect()}
    assert got == {1: (0, 1, 6), 2: (1, 3, 6), 5: (4, 1, 6), 9: (5, 1, 6)}
    for r in ranking.ordered_prefix(df, ["k"], ["n"], {"before": "s"}).collect():
        assert (r.rank_no, r.before) == ("abcdef".index(r.n) + 1, sum(pdf["s"][pdf["n"] < r.n]))


def test_group_tables_do_not_move_rows(spark):
    """Rows of few groups are joined to their group's row where they lie."""
    from trackplate.operators import sizes

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")        # below the size of the rows
    try:
        df = spark.range(0, 3000, 1, 8).select((F.col("id") % 3).alias("g"), (F.col("id") * 1.0).alias("v"))
        for d in (ranking.quantiles(df, ["g"], "v", {"m": 0.5}), sizes.optical_density(df, ["g"], "v")):
            plan = d._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        assert {r.g: r.m for r in ranking.quantiles(df, ["g"], "v", {"m": 0.5}).collect()} == {0: 1498.5, 1: 1499.5, 2: 1500.5}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
