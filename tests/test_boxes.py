"""Suppression at all sizes, overlap joins and relabelling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackplate.functions import boxes as FB
from trackplate.operators import boxes as B
from trackplate.operators import suppression as S

SCHEMA = "image_id long, det_id long, x1 double, y1 double, x2 double, y2 double, score double, cls string, truncated boolean"


def _boxes(seed, n=40, images=2):
    rng = np.random.default_rng(seed)
    rows = []
    for im in range(images):
        for i in range(n):
            x, y = rng.uniform(0, 300, 2)
            w, h = rng.uniform(20, 140, 2)
            rows.append((im, im * 1000 + i, float(x), float(y), float(x + w), float(y + h), float(np.round(rng.uniform(), 1)), str(rng.choice(["a", "b"])), bool(rng.uniform() < 0.5)))
    return rows


def _inter(a, b):
    return max(0.0, min(a[4], b[4]) - max(a[2], b[2])) * max(0.0, min(a[5], b[5]) - max(a[3], b[3]))


def _area(a):
    return (a[4] - a[2]) * (a[5] - a[3])


def _measure(rule, d, k):
    i = _inter(d, k)
    return i / (_area(d) + _area(k) - i + 1e-9) if rule.measure == "iou" else i / max(1e-9, _area(d))


def brute(rows, rule):
    kept = []
    for d in sorted(rows, key=lambda r: (-(r[6] if rule.order == "score" else _area(r)), r[1])):
        same = [k for k in kept if k[0] == d[0] and (k[7] == d[7] or not rule.same_class)]
        if (d[8] or not rule.only_truncated) and any(_measure(rule, d, k) >= rule.limit for k in same):
            continue
        kept.append(d)
    return kept


RULES = B.merge_rules(0.2, 0.5, 0.3, 0.4)


@pytest.fixture(params=[(2048, 8192), (10, 12)], ids=["whole", "pieces"])
def sizes(request, monkeypatch):
    """Regions of an ordinary size, and of a few boxes with walks of a few heads: both settle the same boxes."""
    monkeypatch.setattr(S, "REGION", request.param[0])
    monkeypatch.setattr(S, "HEADS", request.param[1])


@pytest.mark.parametrize("rule", RULES, ids=["class", "nested", "cross", "seam"])
def test_rules_at_all_sizes(spark, sizes, rule):
    rows = _boxes(7)
    df = spark.createDataFrame(rows, SCHEMA)
    want = {r[1] for r in brute(rows, rule)}
    assert want != {r[1] for r in rows}
    assert {r.det_id for r in B.suppress(df, rule).collect()} == want


def test_rule_order_split_and_merge(spark, sizes):
    rows = _boxes(8)
    left = rows
    for rule in RULES:
        left = brute(left, rule)
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.det_id for r in B.suppress(df, RULES).collect()} == {r[1] for r in left}


def fast(rows, rule):
    """brute() for one image, in numpy."""
    b = np.array([r[2:6] for r in rows])
    area, cls, cut = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1]), np.array([r[7] for r in rows]), np.array([r[8] for r in rows])
    rank = np.array([r[6] for r in rows]) if rule.order == "score" else area
    kept = []
    for i in np.lexsort((np.array([r[1] for r in rows]), -rank)):
        k = np.array([j for j in kept if cls[j] == cls[i] or not rule.same_class], int)
        w = np.clip(np.minimum(b[i, 2], b[k, 2]) - np.maximum(b[i, 0], b[k, 0]), 0, None)
        inter = w * np.clip(np.minimum(b[i, 3], b[k, 3]) - np.maximum(b[i, 1], b[k, 1]), 0, None)
        part = inter / (area[i] + area[k] - inter + 1e-9) if rule.measure == "iou" else inter / max(1e-9, area[i])
        if not ((cut[i] or not rule.only_truncated) and (part >= rule.limit).any()):
            kept.append(i)
    return [rows[i] for i in kept]


def test_thousands_of_boxes_on_one_spot(spark, monkeypatch):
    """A crowd inside one cell, far more than a region walks at once, with a few boxes elsewhere."""
    monkeypatch.setattr(S, "REGION", 500)
    monkeypatch.setattr(S, "HEADS", 600)
    rng = np.random.default_rng(4)
    rows = []
    for i in range(4000):
        x, y = rng.normal(1000, 9, 2) if i % 100 else rng.uniform(0, 5000, 2)
        w, h = rng.uniform(18, 40, 2)
        rows.append((0, i, float(x), float(y), float(x + w), float(y + h), float(np.round(rng.uniform(), 3)), str(rng.choice(["a", "b"])), bool(rng.uniform() < 0.3)))
    left = rows
    for rule in B.merge_rules():
        left = fast(left, rule)
    got = [r.det_id for r in B.suppress(spark.createDataFrame(rows, SCHEMA), B.merge_rules()).collect()]
    assert sorted(got) == sorted(r[1] for r in left) and len(got) < 400


def test_one_large_image_with_chains_and_mixed_sizes(spark, monkeypatch):
    """Rows of boxes that each hang on the one before, over many regions; and boxes of very different sizes."""
    monkeypatch.setattr(S, "REGION", 300)
    rows, rng = [], np.random.default_rng(6)
    for i in range(1200):                                                         # a chain: every other box goes
        rows.append((0, i, 4.0 * i, 0.0, 4.0 * i + 10, 10.0, 1 - i / 1e4, "a", True))
    for i in range(1200, 4000):
        x, y = rng.uniform(0, 4800), rng.uniform(20, 900)
        w, h = 2.0 ** rng.uniform(1, 9, 2)
        rows.append((0, i, float(x), float(y), float(x + w), float(y + h), float(np.round(rng.uniform(), 2)), str(rng.choice(["a", "b"])), bool(rng.uniform() < 0.5)))
    rules = B.merge_rules(0.4, 0.75, 0.7, 0.6)
    left = rows
    for rule in rules:
        left = fast(left, rule)
    got = [r.det_id for r in B.suppress(spark.createDataFrame(rows, SCHEMA), rules).collect()]
    assert sorted(got) == sorted(r[1] for r in left)


def test_boxes_without_a_side_or_score_stay(spark):
    rows = [(0, 1, 0.0, 0.0, 10.0, 10.0, 0.9, "a", True), (0, 2, 0.0, 0.0, 10.0, 10.0, 0.8, "a", True), (0, 3, None, 0.0, 10.0, 10.0, 0.8, "a", True),
            (0, 4, 0.0, 0.0, 10.0, 10.0, None, "a", None), (None, 5, 0.0, 0.0, 10.0, 10.0, 0.9, "a", True), (0, 6, 0.0, 0.0, 10.0, 10.0, 0.7, None, None),
            (0, 7, 3.0, 3.0, 3.0, 3.0, 0.1, "a", True), (1, 1, 0.0, 0.0, 10.0, 10.0, 0.9, "a", True)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.image_id if r.image_id is not None else -1, r.det_id) for r in B.suppress(df, B.Rule("iou", 0.5, same_class=True)).collect())
    assert got == [(-1, 5), (0, 1), (0, 3), (0, 4), (0, 6), (0, 7), (1, 1)]
    assert B.suppress(df.limit(0), B.merge_rules()).count() == 0 and B.suppress(df, []).count() == len(rows)


def test_overlap_pairs(spark):
    rows = _boxes(9)
    df = spark.createDataFrame(rows, SCHEMA)
    rule = B.Rule("iou", 0.1)
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and _measure(rule, a, b) >= 0.1}
    got = [(r.a.det_id, r.b.det_id) for r in B.overlaps(df, min_iou=0.1, cell=50.0).collect()]
    assert set(got) == want and len(got) == len(want)


def test_gate_order_and_open_bounds(spark):
    rows = [(0, 1, 0.0, 0.0, 10.0, 10.0, 0.1, "Egg ", False), (0, 2, 0.0, 0.0, 10.0, 10.0, 0.2, "a", False), (0, 3, 0.0, 0.0, 10.0, 10.0, 0.9, "a", False),
            (0, 4, 0.0, 0.0, 10.0, 10.0, 0.9, "a", True), (0, 5, 0.0, 0.0, 20.0, 20.0, 0.5, "a", False), (0, 6, 0.0, 0.0, 1.0, 1.0, 0.5, "other", False)]
    df = spark.createDataFrame(rows, SCHEMA)
    g = df.select("det_id", B.gate_reason({"_default": 0.3, "A": 0.5}, {"a": (20, None)}, ["egg"]).alias("g")).collect()
    assert {r.det_id: r.g for r in g} == {1: "class", 2: "score", 3: "size", 4: None, 5: None, 6: None}


def test_tiles_half_even(spark):
    df = spark.createDataFrame([(100,), (64,), (10,)], "w long")
    got = {}
    for r in B.tile_grid(df, "w", 64, 0.3).collect():
        got.setdefault(r.w, []).append(r.origin)
    assert {k: sorted(v) for k, v in got.items()} == {100: [0, 36], 64: [0], 10: [0]}


def test_rescore(spark):
    df = spark.createDataFrame([(1, "a", 0.5, [0.5, 0.4]), (2, "a", 0.5, None), (3, "b", 0.5, [0.5, 0.25])], "det_id long, cls string, score double, scores array<double>")
    got = {r.det_id: (r.cls, r.cls_raw, r.score) for r in B.rescore(df, ["a", "b"], {"a": 1.0, "b": 0.5}, 1.0).collect()}
    assert got == {1: ("b", "a", 0.4), 2: ("a", "a", 0.5), 3: ("a", "b", 0.5)}
    assert B.rescore(df, ["a", "b"], {}, 0.0).where("cls <> cls_raw").count() == 0
    back = B.relabel_cached(df.withColumn("cls_raw", F.lit("b")), ["a", "b"], {}, 0.0).collect()
    assert [(r.cls, r.relabelled, r.no_vector) for r in sorted(back)] == [("b", True, False), ("a", False, True), ("b", False, False)]


def test_entropy(spark):
    r = spark.createDataFrame([([0.0, 0.0],), ([1.0, 1.0],)], "s array<double>").select(FB.entropy(FB.score_probs(F.col("s"))).alias("e")).collect()
    assert [x.e for x in r] == [0.0, pytest.approx(np.log(2))]
