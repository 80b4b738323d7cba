"""Staging with stored results, counted joins, and the report of a run."""

import json

from pyspark.sql import functions as F

from trackplate.operators import assay, boxes
from trackplate.plans import staging
from trackplate.sources import sinks

NAMES, REFS = ["egg", "L1", "L2", "L3", "L4", "adult"], {n: 1.0 for n in ["egg", "L1", "L2", "L3", "L4", "adult"]}
RAW = "image_id long, det_id long, x1 double, y1 double, x2 double, y2 double, score double, cls string, truncated boolean, scores array<double>"
IMG = "image_id long, image string, condition string, tp double, plate string, has_error boolean, folder string, rel string"
MAN = "run_id long, folder string, rel string, written long, digest string, reusable boolean, has_covered boolean, size long, mtime double, covered boolean, errored boolean"


def _box(image, det, cls="L1", at=0.0):
    return (image, det, at, 0.0, at + 10.0, 10.0, 0.9, cls, False, [0.9 if n == cls else 0.1 for n in NAMES])


def _images(spark):
    return spark.createDataFrame([(1, "a", "N2 0J", 0.0, "p1", False, "f", "a"), (2, "b", "N2 0J", 0.0, "p2", False, "f", "b"),
                                  (3, "c", "N2 20J", 0.0, "p1", False, "g", "c"), (4, "a", "N2 20J", 0.0, "p1", False, "g", "d")], IMG)


def _run(spark, raw, stored, manifests, digest="d"):
    images = _images(spark)
    inventory = images.select("folder", "rel", F.lit(5).cast("long").alias("size"), F.lit(1.0).alias("mtime"))
    return staging.staging(images, spark.createDataFrame(raw, RAW), {}, {}, NAMES, REFS, 0.0, ["egg"], boxes.merge_rules(0.45),
                           inventory, spark.createDataFrame(manifests, MAN), digest, stored)


def _stored(spark, rows):
    made = spark.createDataFrame([r[1] for r in rows], RAW).withColumn("cls_raw", F.col("cls"))
    at = spark.createDataFrame([(r[1][1], *r[0]) for r in rows], "det_id long, run_id long, folder string, rel string")
    return made.drop("image_id").join(at, "det_id")


def _manifest(run, folder, rel, **other):
    row = dict(run_id=run, folder=folder, rel=rel, written=run * 10, digest="d", reusable=True, has_covered=True, size=5, mtime=1.0, covered=True, errored=False)
    return tuple((row | other).values())


def test_reused_images_keep_their_stored_rows(spark):
    """Image a has stored rows, b has none (no animals), c changed; raw rows of a are ignored."""
    stored = _stored(spark, [((1, "f", "a"), _box(9, 100)), ((1, "f", "a"), _box(9, 101, "L2", 50.0)), ((1, "g", "c"), _box(9, 102)), ((2, "f", "a"), _box(9, 103))])
    manifests = [_manifest(1, "f", "a"), _manifest(1, "f", "b"), _manifest(1, "g", "c", size=6), _manifest(2, "f", "a", errored=True)]
    s = _run(spark, [_box(1, 1), _box(3, 2, "L3"), _box(3, 3, "L3", 2.0)], stored, manifests)
    assert sorted((r.image_id, r.det_id, r.cls) for r in s.detections.collect()) == [(1, 100, "L1"), (1, 101, "L2"), (3, 2, "L3")]
    assert {r.image_id: r.total for r in s.image.collect()} == {1: 2, 2: 0, 3: 1, 4: 0}
    assert {tuple(r) for r in s.reuse.collect()} == {("f", 1, 2, 2, 0), ("g", None, 2, 0, 2)}


def test_other_settings_reuse_nothing(spark):
    stored = _stored(spark, [((1, "f", "a"), _box(9, 100))])
    s = _run(spark, [_box(1, 1), _box(2, 2)], stored, [_manifest(1, "f", "a")], digest="other")
    assert sorted(r.det_id for r in s.detections.collect()) == [1, 2]
    assert all(r.n_reused == 0 and r.run_id is None for r in s.reuse.collect())


def test_ambiguous_boxes_are_counted_and_left_out_of_sizes(spark):
    s = _run(spark, [_box(1, 1), _box(2, 2), _box(3, 3), _box(3, 4, at=99.0), _box(4, 5)], _stored(spark, [((1, "x", "x"), _box(9, 100))]), [_manifest(1, "x", "x")])
    assert {r.status: r.n for r in s.size_joins.collect()} == {"joined": 3, "ambiguous": 2}
    assert {(r.condition, r.n) for r in s.size_summary.collect()} == {("N2 0J", 1), ("N2 20J", 2)}


def test_payload(spark):
    """Errored images are only counted, an empty condition has no percent, dose-free conditions come last, N2 first."""
    images = spark.createDataFrame(
        [(1, "a", "601 0J", 0.0, "p1", False), (2, "b", "601 0J", 0.0, "p1", False), (3, "c", "N2", 0.0, "p1", False), (4, "d", "601 0J", 24.0, "p1", True),
         (5, "e", "601 20J", 24.0, "p1", False)], "image_id long, image string, condition string, tp double, plate string, has_error boolean")
    counts = spark.createDataFrame([(1, "L1", 2), (1, "L4", 6), (2, "L4", 2), (5, "L1", 1)], "image_id long, stage string, n long")
    img = assay.per_image(images, counts)
    plates = assay.per_plate(img)
    cond = assay.with_parts(assay.per_condition(img, plates))
    shares = assay.composition(counts.join(img.select("image_id", "tp", "condition"), "image_id"), ["tp", "condition"])
    size = spark.createDataFrame([(0.0, "601 0J", 2, 1.04, 2.05, 3.0, [0.5, 1.0])], "tp double, condition string, n long, p25 double, p50 double, p75 double, y array<double>")
    out = {}
    for r in sinks.report_payload(cond, assay.replicate_points(img, plates, cond), shares, ["L1", "L4"], assay.qc(images, img, plates), assay.gaps(cond), images, size, 0.3).collect():
        out.setdefault(r.kind, []).append(json.loads(r.payload))
    by = {(c["condition"], c["ti"]): c for c in out["cond"]}
    c = by["601 0J", 0]
    assert c["n"] == {"L1": 2, "L4": 8} and c["pct"] == {"L1": 20.0, "L4": 80.0} and c["n_images"] == 2 and c["replicate_unit"] == "quadrant image"
    assert c["si_mean"] == 3.625 and c["si_sd"] == 0.5303
    assert by["N2", 0]["pct"] == {"L1": None, "L4": None} and by["N2", 0]["si_mean"] is None and by["N2", 0]["di"] == 2
    assert len(out["rep"]) == 4 and {(g["condition"], g["tp"]) for g in out["gap"]} == {("601 0J", 24.0), ("601 20J", 0.0), ("N2", 24.0)}
    assert out["size"] == [{"condition": "601 0J", "di": 0, "ti": 0, "n": 2, "p25": 1.0, "p50": 2.1, "p75": 3.0, "y": [0.5, 1.0]}]
    m = out["meta"][0]
    assert m["strains"] == ["N2", "601"] and m["doses"] == [0, 20, None] and m["n_errors"] == 1 and m["n_images"] == 4 and m["n_detections"] == 11 and m["alpha"] == 0.3
    q = next(q for q in out["qc"] if q["strain"] == "601" and q["ti"] == 0)
    assert q["n_animals_total"] == 10 and q["quadrant_cv_pct_max"] == 84.85 and q["animals_per_plate_sd"] is None
