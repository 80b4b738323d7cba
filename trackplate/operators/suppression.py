"""Greedy suppression of boxes, settled in waves of bounded regions: one algorithm for all sizes.

A rule walks the boxes of an image in its order and drops a box that a kept earlier one
overlaps enough. What happens to a box depends on earlier boxes near it alone. Images are cut
into square regions by their number and spread of boxes (one region for an ordinary image).
A region gets the boxes that may touch those whose centre it holds, the first HEADS of them by
rank at most, and walks them with three answers: kept, dropped, open. A box is open
while an earlier box that could drop it is open: one of a neighbouring region, or one beyond the
heads. The earliest open box of an image always settles, and a wave settles whole chains inside
its regions, so the number of waves follows the chains that cross regions, not the boxes.

The first wave walks all rules at once and settles nearly all images. For what is left, rules are
settled one after the other: boxes that were kept drop open ones through a grid of levels (boxes
lie in cells as large as themselves), and the next wave walks what remains.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import written
from ..functions import boxes as B
from .grouped import whole_groups

EPS = B.EPS
REGION = 2048                 #: boxes of a region, about
HEADS = 8192                  #: boxes that a region walks in one wave, at most
SIDES = ("x1", "y1", "x2", "y2")


@dataclass(frozen=True)
class Rule:
    """Walk boxes in `order`; drop one when a kept earlier box overlaps it enough."""

    measure: str            # "iou" or "cover" (share of the later box inside the kept one)
    limit: float            # above 0
    order: str = "score"    # "score" or "area", descending; ties by det_id
    same_class: bool = False
    only_truncated: bool = False


def _area(prefix: str = "") -> Column:
    return (F.col(f"{prefix}x2") - F.col(f"{prefix}x1")) * (F.col(f"{prefix}y2") - F.col(f"{prefix}y1"))


def _rank(rule: Rule, prefix: str = "") -> Column:
    first = F.col(f"{prefix}score") if rule.order == "score" else _area(prefix)
    return F.struct((-first).alias("r"), F.col(f"{prefix}det_id").alias("d"), F.col(f"{prefix}_row").alias("i"))


# --- one region ----------------------------------------------------------------------------

KEPT, OPEN, GONE = 1, 0, -1


def walk(box: np.ndarray, score: np.ndarray, cls: np.ndarray, cut: np.ndarray, ids: np.ndarray, home: np.ndarray, state: np.ndarray, after: np.ndarray,
         rule: Rule) -> np.ndarray:
    """The state after a rule of every box of a region; boxes of other regions have theirs in `after`.

    `state` is the one before the rule. The answers hold whatever the open boxes turn out to be.
    """
    area = (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1])
    rank = score if rule.order == "score" else area
    out = np.where(home, OPEN, after)
    out[state == GONE] = GONE
    near = np.zeros(len(box), bool)                              # earlier boxes that are not gone
    for i in np.lexsort((np.arange(len(box)), ids, -rank)):
        if out[i] == GONE:
            continue
        if home[i]:
            out[i] = state[i]
            k = np.flatnonzero(near & (cls == cls[i]) if rule.same_class else near)
            if len(k) and (cut[i] or not rule.only_truncated):
                w = np.minimum(box[i, 2], box[k, 2]) - np.maximum(box[i, 0], box[k, 0])
                h = np.minimum(box[i, 3], box[k, 3]) - np.maximum(box[i, 1], box[k, 1])
                inter = np.clip(w, 0, None) * np.clip(h, 0, None)
                base = area[i] + area[k] - inter + EPS if rule.measure == "iou" else max(EPS, area[i])
                hit = k[inter / base >= rule.limit]
                if len(hit):
                    out[i] = GONE if (out[hit] == KEPT).any() else OPEN
        near[i] = out[i] != GONE
    return out


def _walk_rules(rows: pd.DataFrame, rules: Sequence[Rule], first: int, heads: int) -> pd.DataFrame | None:
    """Home rows of one region with `_passed` and `_gone` after the rules from number `first` on."""
    more = len(rows) > heads
    rows = rows.iloc[:heads] if more else rows
    home = rows["_home"].to_numpy(bool)
    if not home.any():
        return None
    passed, gone = rows["_passed"].to_numpy().copy(), rows["_gone"].to_numpy().copy()
    box = rows[list(SIDES)].to_numpy(float)
    score, cls, ids = (rows[c].to_numpy() for c in ("score", "cls", "det_id"))
    cls = pd.factorize(cls)[0]
    cut = rows["truncated"].fillna(False).to_numpy(bool)

    def at(n):                                     # state after rule n, as far as it is known
        return np.where(passed >= n, KEPT, np.where(gone <= n, GONE, OPEN))

    for n, rule in enumerate(rules, first):
        out = walk(box, score, cls, cut, ids, home, at(n - 1), at(n), rule)
        passed = np.where(home & (out == KEPT), np.maximum(passed, n), passed)
        gone = np.where(home & (out == GONE), np.minimum(gone, n), gone)
        if more:                                   # what lies beyond may come first in another order
            break
    return rows.assign(_passed=passed, _gone=gone)[home]


def _wave(todo: DataFrame, rules: Sequence[Rule], first: int, keys: Sequence[str]) -> DataFrame:
    """The rows of `todo` that were walked, with what is known of them after the rules."""
    keys = list(keys)
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.lit(0.0))
    mid_x, mid_y = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    parts = F.sqrt(F.count(F.lit(1)) / F.lit(REGION))
    spread = 4 * F.greatest(F.stddev_pop(mid_x), F.stddev_pop(mid_y)) / parts
    large = (todo.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(side).alias("_most"), spread.alias("_side"))
             .where(F.col("_n") > REGION).select(*keys, "_most", F.greatest("_side", "_most", F.lit(1e-6)).alias("_side")))
    reach, cell = F.coalesce(F.col("_most"), F.lit(0.0)) / 2, F.col("_side")

    def span(low: str, high: str) -> Column:
        whole = F.sequence(F.floor((F.col(low) - reach) / cell), F.floor((F.col(high) + reach) / cell))
        return F.when(cell.isNull(), F.array(F.lit(0).cast("long"))).otherwise(whole)

    copies = (todo.join(large, keys, "left").withColumn("_rx", F.explode(span("x1", "x2"))).withColumn("_ry", F.explode(span("y1", "y2")))
              .withColumn("_home", cell.isNull() | ((F.floor(mid_x / cell) == F.col("_rx")) & (F.floor(mid_y / cell) == F.col("_ry"))))
              .drop("_most", "_side"))
    group = [*keys, "_rx", "_ry"]
    order = Window.partitionBy(*group).orderBy(_rank(rules[0]))
    heads = copies.withColumn("_no", F.row_number().over(order)).where(F.col("_no") <= HEADS + 1).drop("_no")   # one more tells that there are more

    most = HEADS

    def run(batches):
        for rows, starts in whole_groups(batches, group):
            out = [_walk_rules(rows.iloc[a:b], rules, first, most) for a, b in zip(starts, np.r_[starts[1:], len(rows)])]
            out = [o for o in out if o is not None]
            if out:
                yield pd.concat(out)[names]

    names = todo.columns
    return heads.mapInPandas(run, todo.schema)


# --- kept boxes against open ones ---------------------------------------------------------------

def _level() -> Column:
    """The least level whose cells are as large as the box."""
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.lit(1.0))
    return F.ceil(F.log2(side)).cast("int")


def _in_cells(df: DataFrame) -> DataFrame:
    """A row per cell of level `_level` that the box touches."""
    size = F.pow(F.lit(2.0), F.col("_level"))
    for name, low, high in (("_cx", "x1", "x2"), ("_cy", "y1", "y2")):
        df = df.withColumn(name, F.explode(F.sequence(F.floor(F.col(low) / size), F.floor(F.greatest(F.col(low), F.col(high)) / size))))
    return df


def _without_dropped(todo: DataFrame, kept: DataFrame, rule: Rule, keys: Sequence[str]) -> DataFrame:
    """`todo` without the boxes that a kept earlier box drops.

    A box looks into the cells of the kept boxes' levels: from so far below its own that a
    box of that size may still drop it, and for equal sizes (iou) to as far above.
    """
    keys = [*keys, "cls"] if rule.same_class else list(keys)
    down = math.ceil(math.log2(1 / min(1.0, rule.limit))) + 1
    used = ["det_id", "_row", "score", *SIDES]
    k = kept.withColumn("_level", _level())
    levels = sorted(r[0] for r in k.select("_level").distinct().collect())         # a double has some 2,000 at most
    if not levels:
        return todo
    own = _level()
    lookup = F.filter(F.array(*map(F.lit, levels)), lambda x: (x >= own - down) & ((x <= own + down) if rule.measure == "iou" else F.lit(True)))
    t = todo.where("truncated") if rule.only_truncated else todo
    a = _in_cells(t.withColumn("_level", F.explode(lookup))).select(*keys, "_level", "_cx", "_cy", F.struct(*used).alias("a"))
    b = _in_cells(k).select(*keys, "_level", "_cx", "_cy", F.struct(*used).alias("b"))
    measure = B.iou("a", "b") if rule.measure == "iou" else B.covered_fraction("a", "b")
    same = F.lit(True)
    left, right = a.alias("l"), b.alias("r")
    for c in (*keys, "_level", "_cx", "_cy"):
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    hits = left.join(right, same & (_rank(rule, "b.") < _rank(rule, "a.")) & (measure >= rule.limit), "left_semi")
    return todo.join(hits.select(F.col("a._row").alias("_row")).distinct(), "_row", "left_anti").select(*todo.columns)


def _settled(todo: DataFrame, kept: DataFrame, rule: Rule, n: int, keys: Sequence[str]) -> DataFrame:
    """All boxes kept by rule number n: `kept` and those of `todo` that waves keep."""
    out, fresh = [kept], kept
    while True:
        todo = written(_without_dropped(todo, fresh, rule, keys), "boxes-open")
        if todo.isEmpty():
            return out[0] if len(out) == 1 else written(_union(out), "boxes-kept")
        seen = written(_wave(todo, [rule], n, keys), "boxes-wave")
        fresh = seen.where(F.col("_passed") >= n)
        out.append(fresh)
        done = seen.where((F.col("_passed") >= n) | (F.col("_gone") <= n)).select("_row")
        todo = todo.join(done, "_row", "left_anti").select(*todo.columns)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def suppress(dets: DataFrame, rules: Sequence[Rule] | Rule, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Apply suppression rules in order, per image: the boxes that stay.

    Ties of score or area go by det_id, then by a number given to the row. A box with a NULL side or
    score overlaps nothing and stays; NULL keys are one image of their own each row, so they stay too.
    """
    rules, names = [rules] if isinstance(rules, Rule) else list(rules), dets.columns
    n = len(rules)
    if not n:
        return dets
    rows = written(dets.withColumns({"_row": F.monotonically_increasing_id(), "_passed": F.lit(0), "_gone": F.lit(n + 1)}), "boxes")
    able = F.lit(True)
    for c in (*keys, *SIDES, "score"):
        able = able & F.col(c).isNotNull()
    for c in (*SIDES, "score"):
        able = able & ~F.isnan(c)
    able = F.coalesce(able, F.lit(False))
    first = written(_wave(rows.where(able), rules, 1, keys), "boxes-wave")
    is_open = (F.col("_passed") < n) & (F.col("_gone") > n)
    counts = first.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_open, 1)).alias("open")).first()
    n_able = rows.where(able).count()
    if counts["n"] == n_able and not counts["open"]:
        left = first.where(F.col("_passed") == n)
    else:
        left = first if counts["n"] == n_able else written(
            first.unionByName(rows.where(able).join(first.select("_row"), "_row", "left_anti").select(*rows.columns)), "boxes-first")
        for k, rule in enumerate(rules, 1):
            known = left.where(F.col("_passed") >= k)
            left = _settled(left.where((F.col("_passed") < k) & (F.col("_gone") > k)), known, rule, k, keys)
            left = left.withColumn("_passed", F.greatest("_passed", F.lit(k)))
    return left.unionByName(rows.where(~able).select(*rows.columns)).select(*names)
