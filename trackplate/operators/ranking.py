"""Exact ranks, prefix sums and quantiles without sorting a group in one task.

A mergeable quantile sketch sets the edges between which values are ordered, so edges follow
the values wherever they lie. Quantiles move only the values between the two edges around
a wanted rank, each distinct one once per task; what lies below is a map-side count. Ranks of all values
order them inside their bin. The answers do not depend on the edges, only the balance does.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import written

COARSE, FINE = 32, 32         #: bins of a ranking: so many of equal weight, each cut into so many
SKETCH = 10_000               #: accuracy of the sketch: ranks are right to one part in so many
MARGIN = 0.001                #: of a group's rows on each side of a wanted rank, ten times the sketch's error
FEW = 2_000                   #: a group of so many values lies between its edges as a whole


def join_groups(df: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join one row per group to the rows.

    The table of groups is written, so its size is known when the join is planned: while it is
    small no row moves, whatever share of them a group holds.
    """
    return df.join(written(groups, "groups"), list(keys))


def _binned(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Add `_bin`, ascending with the value: its place among the sketch's edges, looked up in two steps."""
    v, n = F.col(value).cast("double"), COARSE * FINE
    edges = df.groupBy(*keys).agg(F.percentile_approx(v, [k / n for k in range(1, n)], SKETCH).alias("_edges"))
    if keys:
        d = join_groups(df, edges, keys)
    else:
        d = df.withColumn("_edges", edges.scalar())
    at = lambda lo, k: F.size(F.filter(F.slice("_edges", lo, k), lambda e: e <= v))
    heads = F.transform(F.sequence(F.lit(1), F.lit(COARSE - 1)), lambda k: F.element_at("_edges", k * FINE))
    coarse = F.size(F.filter(heads, lambda e: e <= v))
    return d.withColumn("_coarse", coarse).withColumn(
        "_bin", (F.col("_coarse") * FINE + at(F.col("_coarse") * FINE + 1, FINE - 1)).cast("long")).drop("_edges", "_coarse")


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, count: str | None = None) -> DataFrame:
    """Distinct values with their count and position: keys, v, c, rank_from (0-based), rank_n.

    A row stands for `count` equal ones where that column is given.

    Equal values are merged before anything is ordered, so a value that fills a third
    of the rows is one row here.
    """
    keys = list(keys)
    v = (df.where(F.col(value).isNotNull())
         .groupBy(*keys, F.col(value).alias("v")).agg((F.sum(count) if count else F.count(F.lit(1))).alias("c")))
    b = _binned(v, keys, "v")
    per_bin = b.groupBy(*keys, "_bin").agg(F.sum("c").alias("_n"))
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = part.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    state = per_bin.select(*keys, "_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                           F.sum("_n").over(part).alias("rank_n"))
    inside = Window.partitionBy(*keys, "_bin").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    d = b.join(state, [*keys, "_bin"])
    d = d.withColumn("rank_from", F.col("_before") + F.coalesce(F.sum("c").over(inside), F.lit(0)))
    return d.drop("_bin", "_before")


def ordered_prefix(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                   sums: Mapping[str, str] | None = None) -> DataFrame:
    """Add `rank_no` (1-based by `order`, which is unique per key) and, for each entry of
    `sums`, the total of that column over strictly earlier rows.

    A range partitioning on (keys, order) splits a hot key evenly whatever the column
    types; the written table pins it, so partition totals and rows always agree.
    """
    keys, sums = list(keys), dict(sums or {})
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = written(df.repartitionByRange(n, *keys, *order).withColumn("_pid", F.spark_partition_id()), "ordered")
    per = d.groupBy(*keys, "_pid").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s_{k}") for k, c in sums.items()])
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = part.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    state = per.select(*keys, "_pid", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"),
                       *[F.coalesce(F.sum(f"_s_{k}").over(upto), F.lit(0)).alias(f"_b_{k}") for k in sums])
    inside = Window.partitionBy(*keys, "_pid").orderBy(*order)
    d = d.join(state, [*keys, "_pid"])
    out = {"rank_no": F.col("_before") + F.row_number().over(inside)}
    for k, c in sums.items():
        out[k] = F.col(f"_b_{k}") + F.coalesce(F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.withColumns(out).drop("_pid", "_before", *[f"_b_{k}" for k in sums])


def column_quantiles(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Exact linearly interpolated quantiles of the non-NULL values of several columns: {column: {name: probability}}.

    One pass sketches all columns, a second moves the values around the wanted ranks. Groups without any
    value are left out; a column without one has NULL.
    """
    keys = list(keys)
    cols = {c: f"_q{k}" for k, c in enumerate(wanted)}
    items = [(cols[c], j, name, float(p)) for c, probs in wanted.items() for j, (name, p) in enumerate(probs.items())]
    d = df.select(*keys, *(F.col(c).cast("double").alias(q) for c, q in cols.items()))
    sketch = []
    for c, q in cols.items():
        sides = [x for p in wanted[c].values() for x in (max(0.0, p - MARGIN), min(1.0, p + MARGIN))]
        sketch.append(F.struct(F.count(q).alias("n"), F.percentile_approx(q, sides, SKETCH).alias("at")).alias(f"{q}_s"))
    edges = d.groupBy(*keys).agg(*sketch)
    if keys:
        d = join_groups(d, edges, keys)
    else:
        all_ = edges.select(F.struct(*(f"{q}_s" for q in cols.values())).alias("s")).scalar()
        d = d.withColumn("_all", all_).withColumns({f"{q}_s": F.col("_all")[f"{q}_s"] for q in cols.values()})

    def sides(q: str, j: int) -> tuple[Column, Column]:
        """Whether a value lies below the edges of a wanted quantile, and whether between them."""
        v, s = F.col(q), F.col(f"{q}_s")
        few, low, high = s["n"] <= FEW, s["at"][2 * j], s["at"][2 * j + 1]
        return ~few & (v < low), v.isNotNull() & (few | ((v >= low) & (v <= high)))

    # what lies below is counted in place; only rows between edges go through the generator
    inside = [sides(q, j)[1] for q, j, _, _ in items]
    some = d.where(functools.reduce(Column.__or__, inside))
    found = some.select(*keys, F.explode(F.filter(F.array(*(
        F.when(here, F.struct(F.lit(k).alias("_k"), F.col(f"{q}_s")["n"].alias("_n"), F.col(q).alias("_v")))
        for k, ((q, _, _, _), here) in enumerate(zip(items, inside)))), lambda x: x.isNotNull())).alias("_x"))
    moved = found.groupBy(*keys, "_x._k", "_x._v").agg(F.count(F.lit(1)).alias("_c"), F.max("_x._n").alias("_n"))
    under = d.groupBy(*keys).agg(*(F.count(F.when(sides(q, j)[0], 1)).alias(f"_u{k}") for k, (q, j, _, _) in enumerate(items)))
    below = under.select(*keys, F.posexplode(F.array(*(f"_u{k}" for k in range(len(items))))).alias("_k", "_c")).where(F.col("_c") > 0).select(
        *keys, "_k", F.lit(None).cast("double").alias("_v"), "_c", F.lit(0).cast("long").alias("_n"))
    sums = moved.unionByName(below)
    upto = Window.partitionBy(*keys, "_k").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    at = F.array(*(F.lit(p) for *_, p in items))[F.col("_k")] * (F.col("_n") - 1)
    end = sums.withColumns({"_end": F.sum("_c").over(upto), "_lo": F.floor(at), "_hi": F.ceil(at), "_frac": at - F.floor(at)})
    here = lambda pos: F.col("_v").isNotNull() & (F.col(pos) < F.col("_end")) & (F.col(pos) >= F.col("_end") - F.col("_c"))
    hit = end.where(here("_lo") | here("_hi"))
    aggs = []
    for k, (_, _, name, _) in enumerate(items):
        one = F.col("_k") == k
        lo, hi = (F.max(F.when(one & here(pos), F.col("_v"))) for pos in ("_lo", "_hi"))
        aggs.append((lo + (hi - lo) * F.max(F.when(one, F.col("_frac")))).alias(name))
    return hit.groupBy(*keys).agg(*aggs)


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles of the non-NULL values of each group."""
    return column_quantiles(df, keys, {value: probs})


def median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    return quantiles(df, keys, value, {name: 0.5})
