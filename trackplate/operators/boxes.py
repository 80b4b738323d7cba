"""Detection tables: gates, overlap joins, greedy suppression, relabelling, reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from .ranking import column_quantiles, quantiles
from .suppression import Rule, suppress

KEYS = ("image_id",)
CELL = 256.0


# --- tiles and gates ---------------------------------------------------------------

def tile_grid(frames: DataFrame, total: str, tile: int, overlap: float, name: str = "origin") -> DataFrame:
    """Tile origins along one side: regular steps, last one flush with the far edge."""
    step = max(1, round(tile * (1 - overlap)))
    last = F.greatest(F.lit(0), F.col(total) - tile)
    return frames.withColumn(name, F.explode(F.array_distinct(
        F.concat(F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(step).cast("long")),
                 F.array(last.cast("long"))))))


def tile_to_frame(dets: DataFrame, margin: float) -> DataFrame:
    """Shift tile boxes to the frame; truncated = touches an inner seam within margin."""
    def seam(o, size, total, lo, hi):
        return (((F.col(o) > 0) & (F.col(lo) <= margin))
                | ((F.col(o) + F.col(size) < F.col(total)) & (F.col(hi) >= F.col(size) - margin)))

    cut = seam("tile_x", "tile_w", "frame_w", "x1", "x2") | seam("tile_y", "tile_h", "frame_h", "y1", "y2")
    return dets.withColumn("truncated", cut if margin > 0 else F.lit(False)).withColumns(
        {"x1": F.col("x1") + F.col("tile_x"), "x2": F.col("x2") + F.col("tile_x"),
         "y1": F.col("y1") + F.col("tile_y"), "y2": F.col("y2") + F.col("tile_y")})


def gate_reason(floors: Mapping[str, float], sizes: Mapping[str, tuple], excluded: Sequence[str] = ()) -> Column:
    """First gate a detection fails (class, score, size), NULL when it passes.

    Bounds are inclusive and may be open; truncated boxes skip the size gate.
    """
    cls = F.col("cls")
    skip = [" ".join(e.strip().lower().split()) for e in excluded]
    lo = B.class_option(cls, {k: v[0] for k, v in sizes.items()})
    hi = B.class_option(cls, {k: v[1] for k, v in sizes.items()})
    size = B.box_size()
    off = F.coalesce(size < lo, F.lit(False)) | F.coalesce(size > hi, F.lit(False))
    return (F.when(B.norm_key(cls).isin(skip) if skip else F.lit(False), "class")
            .when(F.col("score") < B.class_option(cls, floors, 0.0), "score")
            .when(~F.col("truncated") & off, "size"))


def detection_gate(dets: DataFrame, floors, sizes, excluded=()) -> DataFrame:
    return dets.where(gate_reason(floors, sizes, excluded).isNull())


# --- overlap -------------------------------------------------------------------------

def _cells(df: DataFrame, cell: float = CELL) -> DataFrame:
    """One copy per grid cell a box touches."""
    c = F.lit(cell)
    d = df.withColumn("_cx", F.explode(F.sequence(F.floor(F.col("x1") / c), F.floor(F.col("x2") / c))))
    return d.withColumn("_cy", F.explode(F.sequence(F.floor(F.col("y1") / c), F.floor(F.col("y2") / c))))


def _boxed(df: DataFrame, name: str, keys, extra: Sequence[str] = ()) -> DataFrame:
    """keys, cell and a struct with the geometry and ranking of a box."""
    fields = ["det_id", "x1", "y1", "x2", "y2", "score", "truncated", *extra]
    return df.select(*keys, "_cx", "_cy", F.struct(*fields).alias(name))


def overlaps(dets: DataFrame, keys: Sequence[str] = KEYS, min_iou: float | None = None,
             min_cover: float | None = None, cell: float = CELL) -> DataFrame:
    """Overlapping pairs (a before b by det_id for IoU; a inside b for cover).

    Boxes meet only in shared grid cells. A pair is reported in the cell that holds the
    top-left corner of its intersection, so no distinct is needed.
    """
    d = _cells(dets, cell)
    a, b = _boxed(d, "a", keys), _boxed(d, "b", keys)
    c = F.lit(cell)
    here = ((F.floor(F.greatest(F.col("a.x1"), F.col("b.x1")) / c) == F.col("_cx"))
            & (F.floor(F.greatest(F.col("a.y1"), F.col("b.y1")) / c) == F.col("_cy")))
    j = a.join(b, [*keys, "_cx", "_cy"]).where(here)
    if min_iou is not None:
        j = j.where(F.col("a.det_id") < F.col("b.det_id")).withColumn("overlap", B.iou("a", "b"))
        return j.where(F.col("overlap") >= min_iou)
    j = j.where(F.col("a.det_id") != F.col("b.det_id")).withColumn("overlap", B.covered_fraction("a", "b"))
    return j.where(F.col("overlap") >= min_cover)


# --- suppression -----------------------------------------------------------------------

def merge_rules(iou: float = 0.45, nested: float | None = 0.75, cross: float | None = None,
                seam: float | None = 0.6) -> list[Rule]:
    """Per-class NMS, nested same-class, cross-class NMS, seam fragments - in that order."""
    rules = [Rule("iou", iou, same_class=True)]
    if nested is not None:
        rules.append(Rule("cover", nested, order="area", same_class=True))
    if cross is not None and cross < 1.0:
        rules.append(Rule("iou", cross))
    if seam is not None:
        rules.append(Rule("cover", seam, only_truncated=True))
    return rules


def rescore(dets: DataFrame, names, refs, alpha: float, excluded=()) -> DataFrame:
    """Relabel by argmax raw / ref^alpha; no vector leaves a row untouched; the count never changes."""
    if not alpha:
        return dets.withColumn("cls_raw", F.col("cls"))
    best = B.best_class(F.col("scores"), names, refs, alpha, excluded)
    ok = F.col("scores").isNotNull() & (F.size("scores") == len(names))
    return dets.withColumn("_b", F.when(ok, best)).withColumns(
        {"cls_raw": F.col("cls"), "cls": F.coalesce("_b.name", "cls"),
         "score": F.coalesce("_b.raw", "score")}).drop("_b")


def relabel_cached(rows: DataFrame, names, refs, alpha: float, excluded=()) -> DataFrame:
    """Relabel stored rows for another alpha: 0 restores the recorded raw call."""
    best = B.best_class(F.col("scores"), names, refs, alpha, excluded)
    ok = F.col("scores").isNotNull() & (F.size("scores") == len(names)) & F.forall("scores", lambda v: v.isNotNull())
    new = F.when(ok, F.col("cls_raw") if alpha == 0 else best["name"])
    d = rows.withColumn("_new", F.coalesce(new, F.col("cls")))
    if alpha != 0:
        d = d.withColumn("score", F.when(ok & (F.col("_new") != F.col("cls")), best["raw"]).otherwise(F.col("score")))
    return d.withColumns({"relabelled": ok & (F.col("_new") != F.col("cls")), "no_vector": ~ok}).withColumn(
        "cls", F.col("_new")).drop("_new")


def merge_detections(dets: DataFrame, floors, sizes, names, refs, alpha=0.0, excluded=(), rules=None,
                     keys: Sequence[str] = KEYS) -> DataFrame:
    """Gates, suppression passes and relabelling in their fixed order."""
    gated = detection_gate(dets, floors, sizes, excluded)
    kept = suppress(gated, rules if rules is not None else merge_rules(), keys)
    return rescore(kept, names, refs, alpha, excluded)


# --- reports ------------------------------------------------------------------------------

def threshold_sweep(dets: DataFrame, names, thresholds) -> DataFrame:
    """Detections per class at or above each threshold, zero-filled (one narrow aggregate)."""
    counts = dets.groupBy("cls").agg(*[F.sum((F.col("score") >= t).cast("long")).alias(f"_{i}")
                                       for i, t in enumerate(thresholds)])
    spark = dets.sparkSession
    base = spark.createDataFrame([(n,) for n in names], "cls string")
    d = base.join(counts, "cls", "left")
    pairs = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.coalesce(f"_{i}", F.lit(0)).alias("n"))
                      for i, t in enumerate(thresholds)])
    return d.select("cls", F.explode(pairs).alias("_p")).select("cls", "_p.threshold", "_p.n")


def box_percentiles(dets: DataFrame, floor: float = 0.25) -> DataFrame:
    d = dets.where(F.col("score") >= floor).withColumns(
        {"_w": F.col("x2") - F.col("x1"), "_h": F.col("y2") - F.col("y1")})
    base = d.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.max("_w").alias("w_max"), F.max("_h").alias("h_max"))
    q = column_quantiles(d, ["cls"], {"_w": {"w_p50": 0.5, "w_p95": 0.95}, "_h": {"h_p50": 0.5, "h_p95": 0.95}})
    return base.join(q, "cls")


def size_bounds(dets: DataFrame, floor: float = 0.25, lo: float = 0.02, hi: float = 0.98, least: int = 20) -> DataFrame:
    """Suggested size bounds per class (NULL below `least` samples) and what they drop."""
    d = dets.where((F.col("score") >= floor) & ~F.col("truncated")).withColumn("_s", B.box_size())
    q = quantiles(d, ["cls"], "_s", {"_lo": lo, "_hi": hi, "p50": 0.5})
    q = q.withColumns({"lo": F.bround("_lo", 0), "hi": F.bround("_hi", 0)}).drop("_lo", "_hi")
    g = d.join(q, "cls").groupBy("cls", "lo", "hi", "p50").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(((F.col("_s") < F.col("lo")) | (F.col("_s") > F.col("hi"))).cast("long")).alias("n_out"))
    enough = F.col("n") >= least
    return g.select("cls", "n", "p50", *[F.when(enough, F.col(c)).alias(c) for c in ("lo", "hi", "n_out")])


def monotonic_breaks(medians: DataFrame, order: Sequence[str], col: str = "p50") -> DataFrame:
    """Adjacent present classes whose median does not rise along `order`."""
    pos = F.array_position(F.array(*[F.lit(o) for o in order]), F.col("cls"))
    d = medians.withColumn("_pos", pos).where(F.col("_pos") > 0)
    w = Window.partitionBy(F.lit(0)).orderBy("_pos")  # one row per class
    d = d.withColumns({"below": F.lag("cls").over(w), "_m": F.lag(col).over(w)})
    return d.where(F.col("_m") >= F.col(col)).select("below", F.col("cls").alias("above"),
                                                      F.col("_m").alias("below_median"), F.col(col).alias("above_median"))


def first_cover(dets: DataFrame, cover: float, floor: float = 0.25, keys: Sequence[str] = KEYS,
                cell: float = CELL) -> DataFrame:
    """Per box, the best-scoring better box that covers it: (keys, det_id, by_id)."""
    d = dets.where(F.col("score") >= floor)
    j = overlaps(d, keys, min_cover=cover, cell=cell)
    rank = lambda side: F.struct((-F.col(f"{side}.score")).alias("r"), F.col(f"{side}.det_id").alias("d"))
    j = j.where(rank("b") < rank("a"))
    return j.groupBy(*keys, F.col("a.det_id").alias("det_id")).agg(
        F.min(F.struct((-F.col("b.score")).alias("s"), F.col("b.det_id").alias("i"))).alias("_b")).select(
        *keys, "det_id", F.col("_b.i").alias("by_id"))


def duplicate_pairs(dets: DataFrame, cover: float, floor: float = 0.25, top: int = 20,
                    keys: Sequence[str] = KEYS) -> DataFrame:
    """Most frequent (kept class, suppressed class) pairs of different classes."""
    c = first_cover(dets, cover, floor, keys)
    k = list(keys)
    a = dets.select(*k, "det_id", F.col("cls").alias("dropped"))
    b = dets.select(*k, F.col("det_id").alias("by_id"), F.col("cls").alias("kept"))
    return (c.join(a, [*k, "det_id"]).join(b, [*k, "by_id"]).where(F.col("kept") != F.col("dropped"))
            .groupBy("kept", "dropped").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "kept", "dropped").limit(top))


def score_bands(dets: DataFrame, edges: Sequence[tuple[str, float, float]], high: float = 0.7) -> DataFrame:
    """n, share, median score and share of high scores per half-open size band."""
    s = B.box_size()
    band = F.lit(None).cast("string")
    for name, lo, hi in edges:
        band = F.when((s >= lo) & (s < hi), name).otherwise(band)
    d = dets.withColumn("band", band).where(F.col("band").isNotNull())
    total = dets.agg(F.count(F.lit(1)).alias("_total"))
    g = d.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("score") >= high).cast("double")).alias("high_share"))
    g = g.join(quantiles(d, ["band"], "score", {"median_score": 0.5}), "band")
    return g.select("band", "n", (F.lit(100.0) * F.col("n") / total.scalar()).alias("pct"), "median_score", "high_share")


def clustered_sample(dets: DataFrame, n: int, seed: int = 0, keys: Sequence[str] = KEYS) -> DataFrame:
    """n rows from the images with most rows, at most max(1, n // 3) from each.

    Order inside an image is a seeded hash. Only per-image counts are ranked globally:
    images are taken until their capped counts reach n.
    """
    k = list(keys)
    each = max(1, n // 3)
    per = dets.groupBy(*k).agg(F.count(F.lit(1)).alias("_n")).withColumn("_take", F.least("_n", F.lit(each)))
    first = per.orderBy(F.desc("_n"), *k).limit(n)     # every image gives at least one row
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("_n"), *k).rowsBetween(Window.unboundedPreceding, -1)
    first = first.withColumn("_before", F.coalesce(F.sum("_take").over(w), F.lit(0))).where(F.col("_before") < n)
    d = dets.join(first.select(*k, "_before"), k)
    shuffle = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("det_id").cast("string")), 256)
    d = d.withColumn("_rn", F.row_number().over(Window.partitionBy(*k).orderBy(shuffle)))
    return d.where((F.col("_rn") <= each) & (F.col("_before") + F.col("_rn") <= n)).drop("_rn", "_before")
