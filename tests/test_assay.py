"""Names, roll-ups with awkward cases, timepoints, colonies, distributions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackplate.functions import parse as P
from trackplate.functions import skeleton as S
from trackplate.operators import assay, sizes


def _one(spark, value, expr):
    return spark.createDataFrame([(value,)], "s string").select(expr(F.col("s")).alias("r")).first().r


@pytest.mark.parametrize("label,want", [("601 20J", ("601", 20, "J/m²")), ("N2 100 uM", ("N2", 100, "µM")), (" HAL 601 5 µm ", ("HAL 601", 5, "µM")), ("N2", ("N2", None, "")), ("N2 20x", ("N2 20x", None, ""))])
def test_condition(spark, label, want):
    r = _one(spark, label, P.parse_condition)
    assert (r.strain, r.dose, r.unit) == want


def test_tokens(spark):
    r = _one(spark, "601_Train_survival_0J_p01_0001", P.parse_tokens)
    assert (r.strain, r.dose, r.unit, r.plate) == ("601", 0, "J", 1)
    assert _one(spark, "20J_p01", P.parse_tokens) is None and _one(spark, "601_20J", P.parse_tokens) is None
    r = _one(spark, "N2_20J_40uM_P2_p3", P.parse_tokens)
    assert (r.dose, r.plate) == (20, 2)


@pytest.mark.parametrize("path,want", [("a.png", ("default", "a")), ("p1/a.png", ("default", "p1")), ("c/p1/a.png", ("c", "p1")), ("x/c/p1/a.png", ("c", "p1"))])
def test_place(spark, path, want):
    assert tuple(_one(spark, path, P.path_place)) == want


def test_small_names(spark):
    assert _one(spark, "plate_nw", P.quadrant) == "NW" and _one(spark, "plate_7", P.quadrant) == "plate_7"
    assert str(_one(spark, "20260805T075438_NW", P.capture_time)) == "2026-08-05 07:54:38"
    for bad in ("120260805T075438", "20260805T0754381", "20261305T075438", "none"):
        assert _one(spark, bad, P.capture_time) is None
    assert _one(spark, ' a/b:c*. ', P.safe_name) == "a_b_c_" and _one(spark, " .. ", P.safe_name) == "_"
    assert _one(spark, "x" * 300, lambda c: F.length(P.safe_name(c))) == 200
    assert _one(spark, "260805 Day  3", P.day_label) == "day 3" and _one(spark, "260805 x", P.day_label) == "26-08-05"
    keys = [tuple(_one(spark, s, P.strain_key)) for s in ("N2", "abc", "601")]
    assert [k[0] for k in keys] == [0, 1, 2]


def test_skeleton(spark):
    pts = [(float(i), 0.0) for i in range(49)]
    df = spark.createDataFrame([(1, pts), (2, [(None, 0.0)] + pts[1:]), (3, None)], "i int, p array<struct<x:double,y:double>>")
    r = {x.i: (x.l, x.h) for x in df.select("i", S.skeleton_length(F.col("p")).alias("l"), S.head_angle(F.col("p")).alias("h")).collect()}
    assert r == {1: (48.0, 0.0), 2: (None, None), 3: (None, None)}


@pytest.fixture(scope="module")
def run(spark):
    """Three strains x doses 0/20/60 x two plates x four quadrants x 0/24 h with the awkward cases."""
    imgs, counts, i = [], [], 0
    for tp in (0.0, 24.0):
        for s in ("N2", "601", "604"):
            for d in (0, 20, 60):
                if (s, d, tp) == ("604", 60, 24.0):
                    continue
                for p in (1, 2):
                    if (s, d) == ("N2", 60) and p == 2:
                        continue
                    for q in ("NE", "NW", "SE", "SW"):
                        i += 1
                        bad = (s, d, tp, p, q) == ("601", 20, 0.0, 1, "NE")
                        imgs.append((i, f"{s} {d}J", tp, f"p{p:02d}", f"img{i}_{q}.png", bad))
                        if not bad and q != "SW":
                            counts += [(i, "L1", 3 + p), (i, "adult", 1 + d // 20), (i, "egg", 2), (i, "blob", 1)]
    imgs.append((i + 1, "__unparsed__", 0.0, "stray_image_NE", "stray_image_NE.png", False))
    return (spark.createDataFrame(imgs, "image_id long, condition string, tp double, plate string, image string, has_error boolean"),
            spark.createDataFrame(counts, "image_id long, stage string, n long"))


def test_rollups(run):
    images, counts = run
    img = assay.per_image(images, counts)
    plates = assay.per_plate(img)
    cond = {(r.condition, r.tp): r for r in assay.per_condition(img, plates).collect()}
    r = cond["601 0J", 0.0]
    assert r.replicate_unit == "plate" and r.n_replicates == 2 and r.n_images == 8
    assert r.pooled_total == 3 * (8 + 9) and r.unmapped == 6
    one, two = (4 + 5) / 5, (5 + 5) / 6
    assert r.stage_index_mean == pytest.approx((one + two) / 2)
    r = cond["N2 60J", 0.0]
    assert r.replicate_unit == "quadrant image" and r.n_plates == 1 and r.n_replicates == 4
    assert r.stage_index_mean == pytest.approx((4 + 20) / 8) and r.n_animals_sd > 0
    r = cond["__unparsed__", 0.0]
    assert r.pooled_total == 0 and r.stage_index_mean is None and r.pooled_survival_pct is None
    q = {(r.condition, r.tp): r for r in assay.qc(images, img, plates).collect()}
    assert q["601 20J", 0.0].n_image_errors == 1 and q["601 0J", 0.0].n_image_errors == 0
    assert q["604 20J", 24.0].pct_of_control == pytest.approx(100 * q["604 20J", 24.0].animals_per_plate_mean / q["604 0J", 24.0].animals_per_plate_mean)
    assert q["__unparsed__", 0.0].pct_of_control is None
    gaps = {(r.condition, r.tp) for r in assay.gaps(assay.per_condition(img, plates)).collect()}
    assert gaps == {("604 60J", 24.0), ("__unparsed__", 24.0)}


def test_split_union_invariance(run):
    images, counts = run
    a = assay.per_image(images, counts).where("tp = 0").unionByName(assay.per_image(images, counts).where("tp = 24"))
    assert sorted(map(str, assay.per_plate(a).collect())) == sorted(map(str, assay.per_plate(assay.per_image(images, counts)).collect()))


CASES = [
    ([("0", None), ("24,5", None)], [(0.0, "typed", None), (24.5, "typed", None)]),
    ([("", None)], [(0.0, "single folder", None)]),
    ([("", 0), ("", 86436)], [(0.0, "filenames", None), (24.0, "filenames", None)]),
    ([("", None), ("", None)], [(None, "", "no stamp")] * 2),
    ([("soon", 0), ("", 0)], [(None, "", "not a number"), (0.0, "filenames", None)]),
    ([("6", 0), ("", 86400)], [(6.0, "typed", None), (30.0, "filenames", None)]),
    ([("6", None), ("", 86400)], [(6.0, "typed", None), (None, "", "no anchor")]),
]


@pytest.mark.parametrize("rows,want", CASES)
def test_timepoints(spark, rows, want):
    df = spark.createDataFrame([(i, t, None if c is None else 1_700_000_000 + c) for i, (t, c) in enumerate(rows)], "folder_id long, typed string, capture_s long")
    got = [(r.hours, r.method, r.error) for r in assay.resolve_timepoints(df).orderBy("folder_id").collect()]
    assert got == want


def test_capture_time_upper_median(spark):
    names = [("f", f"2026080{d}T000000_NE") for d in (1, 3, 2, 9)] + [("f", "stray"), ("g", "none")]
    got = {r.folder_id: (r.capture_s, r.n_stamped, r.n_images) for r in assay.folder_capture_time(spark.createDataFrame(names, "folder_id string, stem string")).collect()}
    assert got["f"][1:] == (4, 5) and got["g"] == (None, 0, 1)
    assert got["f"][0] == int(np.datetime64("2026-08-03T00:00:00", "s").astype(int))


def test_reconcile(spark):
    want = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 2.0), ("d", 100.0), ("e", None)], "cell string, want double")
    got = spark.createDataFrame([("a", 1.000001), ("b", 3.0), ("d", 101.0)], "cell string, got double")
    assert {r.cell: r.verdict for r in assay.reconcile(got, want).collect()} == {"a": "ok", "b": "unexpected", "c": "missing", "d": "wrong", "e": "ok"}


def test_colony_single_plate_sd(spark):
    df = spark.createDataFrame([("c", "p", 500.0, 0.9, False, 5.0, 0.6), ("c", "p", 500.0, 0.9, True, 5.0, 0.6), ("c", "p", 1.0, 0.9, False, 5.0, 0.6), ("c", "p", 500.0, 0.1, False, 5.0, 0.6), ("d", "p", 1.0, 0.9, False, None, 0.1)],
                               "condition string, plate string, area_px double, solidity double, touches_border boolean, um_per_px double, stained_fraction double")
    p = assay.colony_plates(assay.colony_gate(df, 40.0, 0.8))
    r = {x.condition: x for x in assay.colony_conditions(p).collect()}
    assert r["c"].colony_count_mean == 1 and r["c"].colony_count_sd == 0.0 and r["c"].n_confluent_plates == 1
    assert r["d"].colony_count_mean == 0 and r["d"].mean_area_mm2 is None


def test_distributions(spark):
    rng = np.random.default_rng(0)
    v = rng.lognormal(4, 0.5, 500)
    df = spark.createDataFrame([("a", float(x)) for x in v] + [("b", 50.0)] * 7, "g string, v double")
    h = sizes.log_histogram(df, ["g"], "v").toPandas()
    assert len(h) == 2 * 149
    all_v = np.r_[v, [50.0] * 7]
    lo, hi = np.log(np.quantile(all_v, [0.002, 0.998]))
    edges = np.exp(np.linspace(lo - 0.18 * (hi - lo), hi + 0.18 * (hi - lo), 150))
    assert (h[h.g == "a"].sort_values("bin")["n"].to_numpy() == np.histogram(v, edges)[0]).all()
    k = sizes.kde_log(df, ["g"], "v").toPandas()
    assert set(k.g) == {"a"} and k.y.max() == 1.0 and len(k) == 150      # b has 7 values: no curve


def test_otsu_two_levels(spark):
    df = spark.createDataFrame([("a", 0.0)] * 50 + [("a", 10.0)] * 50 + [("z", 0.0)] * 3, "g string, v double")
    t = {r.g: r.threshold for r in sizes.otsu(df, ["g"], "v").collect()}
    assert set(t) == {"a"} and 0 < t["a"] < 10


def test_folder_capture_time_parses_names_once(spark):
    """The step that reads the names groups them by stamp; ranks and counts start from there."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def name(i):
        calls.add(1)
        return f"a_202401{i % 9 + 10}T075438"

    names = spark.range(100).select((F.col("id") % 2).alias("folder_id"), name.asNondeterministic()("id").alias("stem"))
    got = {r.folder_id: (r.n_stamped, r.n_images) for r in assay.folder_capture_time(names).collect()}
    assert got == {0: (50, 50), 1: (50, 50)} and calls.value == 100
