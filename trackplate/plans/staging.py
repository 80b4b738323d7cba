"""Development staging: reuse of stored results, detection merge, roll-ups, sizes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import settle
from ..functions.boxes import box_size
from ..operators import assay, boxes, files, sizes


@dataclass(frozen=True)
class Staging:
    plan: DataFrame | None              #: images with the run they are reused from (NULL: analysed now)
    reuse: DataFrame | None             #: the same counted by folder
    detections: DataFrame
    image: DataFrame
    plate: DataFrame
    condition: DataFrame
    composition: DataFrame
    qc: DataFrame
    gaps: DataFrame
    size_summary: DataFrame
    size_histogram: DataFrame
    size_joins: DataFrame               #: detections by how they met their image row: joined, ambiguous, unjoined


def reuse_summary(plan: DataFrame) -> DataFrame:
    """Per folder: the run that serves it (NULL for none), its images, how many are reused and how many are left."""
    g = plan.groupBy("folder").agg(F.max("run_id").alias("run_id"), F.count(F.lit(1)).alias("n_images"), F.count("run_id").alias("n_reused"))
    return g.withColumn("n_to_analyse", F.col("n_images") - F.col("n_reused"))


def stored_detections(plan: DataFrame, images: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of earlier runs for the images that the plan reuses, under the images' present ids.

    plan: folder, rel, run_id. images: image_id, folder, rel. stored: run_id, folder, rel and the columns of a merge.
    A reused image without stored rows has no animals.
    """
    at = images.select("image_id", "folder", "rel").join(plan.where(F.col("run_id").isNotNull()).select("folder", "rel", "run_id"), ["folder", "rel"])
    return stored.drop("image_id").join(at, ["run_id", "folder", "rel"]).drop("run_id", "folder", "rel")


def staging(images: DataFrame, raw: DataFrame, floors, size_limits, names, refs, alpha: float = 0.0, excluded=("egg",),
            rules=None, inventory: DataFrame | None = None, manifests: DataFrame | None = None, digest: str = "",
            stored: DataFrame | None = None) -> Staging:
    """images: image_id, image, condition, tp, plate, has_error. raw: detections before any merge.

    With an inventory, earlier manifests and the rows their runs stored, images also has folder and rel. What the plan
    reuses is taken from the stored rows and only relabelled; raw rows of those images are neither merged nor counted,
    so they may be absent.
    """
    plan = None
    if inventory is not None and manifests is not None and stored is not None:
        plan = settle(files.reuse_plan(inventory, manifests, F.lit(digest)).select("folder", "rel", "run_id"))
        reused = images.join(plan.where(F.col("run_id").isNotNull()), ["folder", "rel"], "left_semi").select("image_id")
        raw = raw.join(reused, "image_id", "left_anti")
    merged = boxes.merge_detections(raw, floors, size_limits, names, refs, alpha, excluded, rules)
    if plan is not None:
        old = boxes.relabel_cached(stored_detections(plan, images, stored), names, refs, alpha, excluded)
        merged = merged.unionByName(old.select(*merged.columns))
    merged = settle(merged)
    counts = merged.groupBy("image_id", F.col("cls").alias("stage")).agg(F.count(F.lit(1)).alias("n"))
    img = settle(assay.per_image(images, counts))
    plates = settle(assay.per_plate(img))
    cond = assay.with_parts(assay.per_condition(img, plates))
    sized = files.ambiguous_join(
        merged.withColumn("size_px", box_size()).join(images.select("image_id", "tp", "image"), "image_id"),
        img.select("tp", "image", "condition", "plate"), ["tp", "image"], ["condition", "plate"])
    placed = sized.where("status = 'joined'")
    shares = assay.composition(counts.join(img.select("image_id", "tp", "condition"), "image_id"), ["tp", "condition"])
    return Staging(plan, None if plan is None else reuse_summary(plan), merged, img, plates, cond, shares,
                   assay.qc(images, img, plates), assay.gaps(cond),
                   sizes.size_summary(placed, ["tp", "condition"], "size_px"), sizes.log_histogram(placed, ["tp", "condition"], "size_px"),
                   sized.groupBy("status").agg(F.count(F.lit(1)).alias("n")))
