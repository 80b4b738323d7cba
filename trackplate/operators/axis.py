"""Ordered operators along a frame axis that never need a whole track in one task.

A track can hold any share of the rows, so `partitionBy(track).orderBy(frame)` is
not safe. Two building blocks replace it:

* carry: cut the axis into buckets of fixed frame width, summarise every bucket
  with one (map-side combined) aggregate, hand the summary of the earlier buckets
  to the next one as a marker row, and run the window inside the bucket only;
* halo: cut the axis into chunks and copy the few rows near a chunk edge to the
  neighbour, so a bounded look-around window stays inside its chunk.

Only the bucket summaries (one row per WIDTH frames) are ordered per track.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 16384
ORDER = ("frame", "row_id")


def _bucketed(df: DataFrame, pos: str, width: int) -> DataFrame:
    return df.withColumn("_bucket", F.floor(F.col(pos) / F.lit(width)).cast("long"))


def _with_carried(df, keys, summary, carried, order, width, side):
    """Rows plus one marker row per bucket that holds what the other buckets hand on.

    The marker sorts before (side -1) or after (side 1) the rows of its bucket, so the
    window inside the bucket meets it like a neighbour and no join is needed: one
    exchange and one sort of the rows.
    """
    b = _bucketed(df, order[0], width)
    per_bucket = b.groupBy(*keys, "_bucket").agg(*summary)
    over = Window.partitionBy(*keys).orderBy("_bucket")
    state = per_bucket.select(*keys, "_bucket", *[e(over).alias(n) for n, e in carried.items()])
    state = state.where(F.coalesce(*[F.col(n).isNotNull() for n in carried])).withColumn("_side", F.lit(side))
    return b.withColumn("_side", F.lit(0)).unionByName(state, allowMissingColumns=True)


def _own_rows(d: DataFrame, *drop: str) -> DataFrame:
    return d.where(F.col("_side") == 0).drop("_side", "_bucket", *drop)


def _inside(keys, order):
    return Window.partitionBy(*keys, "_bucket").orderBy("_side", *order)


def with_previous(df: DataFrame, keys: Sequence[str], cols: Mapping[str, Column],
                  order: Sequence[str] = ORDER, width: int = WIDTH) -> DataFrame:
    """Add, per name, the value the column expression had on the preceding row."""
    row = F.struct(*[c.alias(n) for n, c in cols.items()])
    summary = [F.max_by(row, F.struct(*order)).alias("_tail")]
    d = _with_carried(df, keys, summary, {"_far": lambda o: F.lag("_tail").over(o)}, order, width, -1)
    seen = F.when(F.col("_side") == 0, row).otherwise(F.col("_far"))
    d = d.withColumn("_prev", F.lag(seen).over(_inside(keys, order)))
    return _own_rows(d.withColumns({n: F.col("_prev")[n] for n in cols}), "_prev", "_far")


def with_next(df: DataFrame, keys: Sequence[str], cols: Mapping[str, Column],
              order: Sequence[str] = ORDER, width: int = WIDTH) -> DataFrame:
    """Add, per name, the value the column expression has on the following row."""
    row = F.struct(*[c.alias(n) for n, c in cols.items()])
    summary = [F.min_by(row, F.struct(*order)).alias("_first")]
    d = _with_carried(df, keys, summary, {"_far": lambda o: F.lead("_first").over(o)}, order, width, 1)
    seen = F.when(F.col("_side") == 0, row).otherwise(F.col("_far"))
    d = d.withColumn("_next", F.lead(seen).over(_inside(keys, order)))
    return _own_rows(d.withColumns({n: F.col("_next")[n] for n in cols}), "_next", "_far")


def with_running(df: DataFrame, keys: Sequence[str], sums: Mapping[str, Column],
                 order: Sequence[str] = ORDER, width: int = WIDTH) -> DataFrame:
    """Add running sums (inclusive of the row) of numeric expressions."""
    zero = F.lit(0)
    summary = [F.sum(c).alias(f"_t_{n}") for n, c in sums.items()]

    def before(n):
        return lambda o: F.coalesce(
            F.sum(f"_t_{n}").over(o.rowsBetween(Window.unboundedPreceding, -1)), zero)

    d = _with_carried(df, keys, summary, {f"_p_{n}": before(n) for n in sums}, order, width, -1)
    w = _inside(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({n: F.coalesce(F.sum(F.when(F.col("_side") == 0, c).otherwise(F.col(f"_p_{n}"))).over(w), zero)
                       for n, c in sums.items()})
    return _own_rows(d, *[f"_p_{n}" for n in sums])


def with_ordinal(df: DataFrame, keys: Sequence[str], name: str = "ord",
                 order: Sequence[str] = ORDER, width: int = WIDTH) -> DataFrame:
    """1-based position of each row on its axis."""
    return with_running(df, keys, {name: F.lit(1).cast("long")}, order, width)


def halo(df: DataFrame, pos: str, reach: int, width: int = WIDTH) -> DataFrame:
    """Assign rows to `_chunk`s of `pos`, copying rows within `reach` of an edge.

    Window over keys + `_chunk`, then call `home_rows`.
    """
    width = max(width, reach)
    own = F.floor(F.col(pos) / F.lit(width)).cast("long")
    inside = F.col(pos) - own * F.lit(width)
    copies = F.array_compact(F.array(
        own,
        F.when(inside < F.lit(reach), own - 1),
        F.when(inside >= F.lit(width - reach), own + 1)))
    return df.withColumn("_own", own).withColumn("_chunk", F.explode(copies))


def home_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("_chunk") == F.col("_own")).drop("_chunk", "_own")


def islands(df: DataFrame, keys: Sequence[str], starts: Column, name: str = "island",
            order: Sequence[str] = ORDER, width: int = WIDTH) -> DataFrame:
    """Number consecutive groups; `starts` is true on the first row of each."""
    return with_running(df, keys, {name: starts.cast("long")}, order, width)


def last_per_frame(df: DataFrame, keys: Sequence[str], cols: Sequence[str],
                   frame: str = "frame", tie: str = "row_id") -> DataFrame:
    """One row per frame: the last written one (highest tie value) wins."""
    kept = F.max_by(F.struct(*cols), F.col(tie)).alias("_r")
    return df.groupBy(*keys, frame).agg(kept).select(*keys, frame, "_r.*")


def densify(df: DataFrame, keys: Sequence[str], cols: Sequence[str],
            frame: str = "frame", width: int = WIDTH, reach: int | None = None) -> DataFrame:
    """Contiguous frame axis from first to last frame; gap frames carry NULLs.

    Input has one row per frame. Every row emits itself and the gap behind it, in pieces of
    `width` frames, so no array is as long as a long gap and no join is needed. With `reach`
    only gap frames at most that far from a row are made: enough where a step looks no
    farther, and a gap of any length costs 2 * reach rows.
    """
    d = with_next(df, keys, {"_nf": F.col(frame)}, order=(frame,), width=width)
    own, last = F.col(frame), F.coalesce(F.col("_nf") - 1, F.col(frame))
    if reach is None:
        d = d.withColumn("_a", F.explode(F.sequence(own, last, F.lit(width).cast("long"))))
        d = d.withColumn("_f", F.explode(F.sequence("_a", F.least(last, F.col("_a") + (width - 1)))))
    else:
        head, tail = F.least(last, own + reach), F.greatest(own + reach + 1, last - reach + 1)
        none = F.array().cast("array<bigint>")
        d = d.withColumn("_f", F.explode(F.concat(F.sequence(own, head), F.when(tail <= last, F.sequence(tail, last)).otherwise(none))))
    filled = [F.when(F.col("_f") == F.col(frame), F.col(c)).alias(c) for c in cols]
    return d.select(*keys, F.col("_f").alias(frame), *filled)
