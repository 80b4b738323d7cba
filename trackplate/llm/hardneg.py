"""Hard negatives by coordinate pruning of inner-product search, after LEMP.

Vectors lie in buckets of about the same length; a bucket keeps, for each coordinate it is asked
for, the list of its normalised values in order. For an anchor q and a score s still to be
reached, a bucket whose longest vector cannot reach s is skipped. In the others the angle
between q and a good vector is bounded, which gives a feasible range for each coordinate;
the rows in range on the FOCUS largest coordinates of q are intersected and verified by exact
integer products. The score to reach rises while the buckets of a slab go by, longest first.

Two searches: the positives of every anchor, then its negatives inside the windows that the
positives' scores open. Anchors and rows are dealt as (anchor chunk, slab of rows); the rows of a
slab come one by one, longest first, and are cut into buckets where they are searched, so all of
a task's state is one anchor chunk, one bucket and the best rows so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import written

BUCKET = 2048                 #: rows of a bucket at most
SLAB = 8                      #: buckets that a task goes through in order, at least, if there are as many
ANCHORS = 8192                #: anchors of a chunk, about
CHUNK = 1 << 22               #: components of the anchors of a chunk, about
FOCUS = 3                     #: coordinates whose ranges are intersected
WIDTH = 1.1                   #: lengths in a bucket differ by this factor at most
LARGEST = 1 << 26             #: components saturate here, so that scores fit a long up to 2,047 dimensions
SLACK = 1e-9                  #: on feasible ranges, against rounding of the doubles


def whole_numbers(rows: DataFrame, vector: str, scale: float) -> DataFrame:
    """`vector` as whole numbers floor(scale * x), x as double; NULL if it is NULL or holds a NULL, NaN or infinity."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    whole = F.transform(x, lambda v: F.floor(F.least(F.greatest(v * scale, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))).cast("int"))
    return rows.withColumn(vector, F.when(fine, whole))


class Bucket:
    """Rows of about the same length with a sorted list of normalised values per coordinate, made on demand."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray):
        self.ids, self.labels, self.q = ids, labels, q
        length = np.sqrt((q.astype(float) ** 2).sum(1))
        self.longest = length.max(initial=0.0)
        self.unit = q / np.where(length > 0, length, 1.0)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def listed(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.lists[f] = order, self.unit[order, f]
        return self.lists[f]

    def candidates(self, q: np.ndarray, length: float, focus: np.ndarray, least: float) -> np.ndarray | None:
        """Rows that may score `least` or more with q; None stands for all of them."""
        if least <= 0 or length == 0:
            return None
        cos = least / (length * self.longest) if self.longest else 2.0
        if cos > 1 + SLACK:
            return np.zeros(0, np.int64)
        reach = np.arccos(min(1.0, cos))
        own = np.arccos(np.clip(q[focus] / length, -1, 1))
        low = np.cos(np.minimum(np.pi, own + reach)) - SLACK
        high = np.cos(np.maximum(0.0, own - reach)) + SLACK
        ranges = []
        for f, x, y in zip(focus, low, high):
            order, values = self.listed(f)
            ranges.append((np.searchsorted(values, x, "left"), np.searchsorted(values, y, "right"), order))
        a, b, order = min(ranges, key=lambda r: r[1] - r[0])
        at = order[a:b]
        for f, x, y in zip(focus, low, high):
            v = self.unit[at, f]
            at = at[(v >= x) & (v <= y)]
        return at


def best_first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k by score, the higher first, then the smaller id."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= cut)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


class Search:
    """One anchor's windows [low, high] of scores and the first k rows of each so far."""

    def __init__(self, row: int, anchor: int, label: int, q: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.row, self.anchor, self.label, self.q, self.k, self.same = row, anchor, label, q, k, same
        self.low, self.high = low.astype(float), high.astype(float)
        self.length = float(np.sqrt((q.astype(float) ** 2).sum()))
        self.focus = np.argsort(-np.abs(q), kind="stable")[:FOCUS]
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in low]

    def see(self, bucket: Bucket) -> None:
        at = bucket.candidates(self.q, self.length, self.focus, self.low.min())
        labels = bucket.labels if at is None else bucket.labels[at]
        mine = (labels == self.label) == self.same
        at = np.flatnonzero(mine) if at is None else at[mine]
        at = at[bucket.ids[at] != self.anchor]
        if not len(at):
            return
        scores, ids = bucket.q[at] @ self.q, bucket.ids[at]
        for k, (s, i) in enumerate(self.best):
            fit = (scores >= self.low[k]) & (scores <= self.high[k])
            if fit.any():
                s, i = np.concatenate([s, scores[fit]]), np.concatenate([i, ids[fit]])
                first = best_first(s, i, self.k)
                self.best[k] = s[first], i[first]
                if len(first) == self.k:
                    self.low[k] = max(self.low[k], float(s[first[-1]]))


def dealing(rows: DataFrame) -> DataFrame:
    """(dim, chunks, slabs) of the dimensions that have anchors: chunks by what a task may hold, slabs to give every partition work."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = F.greatest(F.lit(1), F.least(F.lit(ANCHORS), F.floor(F.lit(CHUNK) / F.greatest(F.lit(1), "dim"))))
    slabs = F.least(F.ceil(F.lit(n) / F.col("chunks")), F.ceil(F.col("n") / (SLAB * BUCKET)))
    return (rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("anchors")).where(F.col("anchors") > 0)
            .withColumn("chunks", F.ceil(F.col("anchors") / held).cast("int")).select("dim", "chunks", slabs.cast("int").alias("slabs")))


def searched(rows: DataFrame, anchors: DataFrame, dealt: DataFrame, k: int, same: bool) -> DataFrame:
    """(row, window, id, score): for each anchor and window the first k rows of every slab.

    `rows` are (row, vec_id, label, dim, length, q); `anchors` are the same with lists `low` and `high`; `dealt` is of dealing().
    """
    def numbers(of: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    def home(of: str) -> Column:
        return F.pmod(F.xxhash64("row"), F.col(of)).cast("int")

    empty = F.lit(None).cast("array<double>")
    sides = anchors.join(dealt, "dim").select(home("chunks").alias("chunk"), "dim", numbers("slabs").alias("slab"), F.lit(float("inf")).alias("length"),
                                              "row", "vec_id", "label", "q", "low", "high").unionByName(
        rows.join(dealt, "dim").select(numbers("chunks").alias("chunk"), "dim", home("slabs").alias("slab"), "length",
                                       "row", "vec_id", "label", "q", empty.alias("low"), empty.alias("high")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_, held, size, longest = None, [], [], 0, 0.0

        def see():
            nonlocal held, size
            if held and open_:
                bucket = Bucket(*map(np.concatenate, zip(*held)))
                for s in open_:
                    s.see(bucket)
            held, size = [], 0

        def out():
            for at in range(0, len(open_), 512):
                found = [(s.row, w, is_, xs) for s in open_[at:at + 512] for w, (xs, is_) in enumerate(s.best) if len(xs)]
                if found:
                    n = [len(f[3]) for f in found]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([f[0] for f in found], n), pa.int64()), pa.array(np.repeat([f[1] for f in found], n), pa.int32()),
                                                      *(pa.array(np.concatenate([f[c] for f in found]), pa.int64()) for c in (2, 3))], ["row", "window", "id", "score"])

        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in range(3)], 1)
            length, row, ids, labels = (b.column(c).to_numpy() for c in (3, 4, 5, 6))
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
            values, first = b.column(7).flatten().to_numpy(), 0
            for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)]):
                now = tuple(keys[x].tolist())
                if now != key:
                    see()
                    yield from out()
                    key, open_ = now, []
                q = values[first:first + (y - x) * now[1]].reshape(y - x, now[1])
                first += (y - x) * now[1]
                rows_at = x + int(np.isinf(length[x:y]).sum())                # anchors come first
                for n in range(x, rows_at):
                    open_.append(Search(int(row[n]), int(ids[n]), int(labels[n]), q[n - x].astype(np.int64), np.array(b.column(8)[n].as_py(), float),
                                        np.array(b.column(9)[n].as_py(), float), k, same))
                while rows_at < y:
                    if not size:
                        longest = length[rows_at]
                    end = min(y, rows_at + BUCKET - size)
                    end = rows_at + int(np.searchsorted(-length[rows_at:end], -longest / WIDTH, "right"))
                    if end > rows_at:
                        held.append((ids[rows_at:end], labels[rows_at:end], q[rows_at - x:end - x].astype(np.int64)))
                        size += end - rows_at
                    if size >= BUCKET or end < y:
                        see()
                    rows_at = end
        see()
        yield from out()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = sides.select("chunk", "dim", "slab", "length", "row", "vec_id", "label", "q", "low", "high").repartition(n, "chunk", "dim", "slab").sortWithinPartitions(
        "chunk", "dim", "slab", F.desc("length"))
    return order.mapInArrow(search, "row long, window int, id long, score long")


def hard_negatives(vectors: DataFrame, is_anchor: Column, vec_id: str = "vec_id", label: str = "label", vector: str = "vector",
                   n_positives: int = 5, n_negatives: int = 10, least: int = 30, most: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for vectors of whole numbers.

    Scores are inner products. An anchor's positives are its first rows of the same label and another id, by
    score downwards, then id; its negatives for a positive of score p are the first rows of other labels with
    least * p <= 100 * score <= most * p. Rows whose id, label or vector is NULL take no part; vectors of
    different dimensions don't meet; repeated rows count as rows of their own. No anchor, no row.
    """
    q = F.col(vector)
    squared = F.aggregate(q, F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    rows = written(vectors.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & q.isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("int").alias("label"),
        q.alias("q"), F.size(q).alias("dim"), F.sqrt(squared).alias("length"), F.coalesce(is_anchor, F.lit(False)).alias("anchor")), "negative-rows")
    anchors = rows.where("anchor")
    dealt = written(dealing(rows), "negative-dealing")
    any_score = F.array(F.lit(-float("inf"))), F.array(F.lit(float("inf")))
    first = Window.partitionBy("row").orderBy(F.desc("score"), "id")
    found = searched(rows, anchors.select("*", any_score[0].alias("low"), any_score[1].alias("high")), dealt, n_positives, True)
    positives = written(found.withColumn("window", F.row_number().over(first) - 1).where(F.col("window") < n_positives), "negative-positives")
    lists = positives.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("window", "score"))).alias("p"))
    ranged = (anchors.join(lists, "row")
              .withColumn("low", F.transform("p", lambda x: F.ceil(x["score"] * least / 100).cast("double")))
              .withColumn("high", F.transform("p", lambda x: F.floor(x["score"] * most / 100).cast("double"))).drop("p"))
    near = searched(rows, ranged, dealt, n_negatives, False)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("row", "window").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= n_negatives)
    own = positives.select("row", "window", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (ranked.join(own, ["row", "window"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
            .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
