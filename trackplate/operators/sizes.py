"""Value distributions: percentiles, log histograms, densities, Otsu thresholds."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import settle
from .ranking import join_groups, quantiles

GRID = 150


def size_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, percentiles, mean and geometric mean of the positive values."""
    d = df.where(F.col(value) > 0)
    q = quantiles(d, keys, value, {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90})
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.exp(F.avg(F.ln(value))).alias("gmean"))
    return g.join(q, list(keys))


def log_grid(df: DataFrame, value: str) -> DataFrame:
    """One row (g0, g1): padded log range of the 0.2% and 99.8% quantiles of all values."""
    q = quantiles(df.where(F.col(value) > 0), [], value, {"a": 0.002, "b": 0.998})
    lo, hi = F.ln(F.greatest("a", F.lit(1.0))), F.ln("b")
    q = q.select(lo.alias("lo"), F.when(hi > lo, hi).otherwise(lo + 1.0).alias("hi"))
    pad = F.lit(0.18) * (F.col("hi") - F.col("lo"))
    return q.select((F.col("lo") - pad).alias("g0"), (F.col("hi") + pad).alias("g1"))


def _with_grid(df: DataFrame, grid: DataFrame) -> DataFrame:
    g = grid.select(F.struct("g0", "g1").alias("g"))
    return df.withColumn("_g", g.scalar())


def log_histogram(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Counts in 149 log-spaced bins of one global grid; outside values are not counted.

    Bins without values are present with 0.
    """
    grid = settle(log_grid(df, value))      # one row
    d = _with_grid(df.where(F.col(value) > 0), grid)
    g0, g1 = F.col("_g.g0"), F.col("_g.g1")
    v, step = F.ln(value), (g1 - g0) / F.lit(GRID - 1)
    b = F.least(F.floor((v - g0) / step), F.lit(GRID - 2)).cast("long")
    counts = d.where((v >= g0) & (v <= g1)).groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = _with_grid(df.where(F.col(value) > 0).select(*keys).distinct(), grid).withColumn(
        "bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(GRID - 2).cast("long"))))
    edge = [F.exp(g0 + (F.col("bin") + k) * step) for k in (0, 1)]
    return every.join(counts, [*keys, "bin"], "left").select(
        *keys, "bin", edge[0].alias("lo"), edge[1].alias("hi"), F.sqrt(edge[0] * edge[1]).alias("mid"),
        F.coalesce("n", F.lit(0)).alias("n"))


def kde_log(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Density over the log grid per group, scaled to a maximum of 1; none below 8 values.

    A task adds up the 150 sums of each group it meets as one vector and passes that on, whatever
    values it has seen.
    """
    keys = list(keys)
    d = df.where(F.col(value) > 0)
    lv = F.ln(value)
    stat = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp(lv).alias("_sd")).where(F.col("_n") >= 8)
    width = F.greatest(F.lit(0.17), F.least(F.lit(0.42), F.lit(0.62) * F.pow(F.col("_n").cast("double"), F.lit(-0.2))))
    stat = stat.select(*keys, (width * F.greatest("_sd", F.lit(1e-6))).alias("_bw"))
    grid = settle(log_grid(df, value))
    # in units of the bandwidth from the first grid point: the value, and the step between points
    d = _with_grid(join_groups(d, stat, keys), grid).select(
        *keys, ((lv - F.col("_g.g0")) / F.col("_bw")).alias("_v"), ((F.col("_g.g1") - F.col("_g.g0")) / F.lit(GRID - 1) / F.col("_bw")).alias("_step"))

    def add(batches):
        sums: dict[tuple, np.ndarray] = {}
        points = np.arange(GRID)

        def out():
            rows = pd.DataFrame(list(sums), columns=keys, dtype=object) if keys else pd.DataFrame(index=range(len(sums)))
            return rows.assign(_s=list(sums.values()))

        for b in batches:
            for at, rows in b.groupby(keys, dropna=False) if keys else [((), b)]:
                total = sums.setdefault(at, np.zeros(GRID))
                v, step = rows["_v"].to_numpy(), rows["_step"].iloc[0]
                for k in range(0, len(v), 4096):
                    z = v[k:k + 4096, None] - points * step
                    total += np.exp(-0.5 * z * z).sum(0)
            if len(sums) > 4096:
                yield out()
                sums = {}
        if sums:
            yield out()

    types = "".join(f"{k} {t}, " for k, t in d.select(*keys).dtypes)
    sums = d.mapInPandas(add, f"{types}_s array<double>").select(*keys, F.posexplode("_s").alias("i", "_s")).groupBy(*keys, "i").agg(F.sum("_s").alias("_s"))
    s = _with_grid(sums, grid)
    s = s.withColumn("_x", F.col("_g.g0") + F.col("i") * (F.col("_g.g1") - F.col("_g.g0")) / F.lit(GRID - 1)).drop("_g")
    s = s.withColumn("_d", F.col("_s") / F.exp("_x"))     # constant factors cancel in the scaling
    top = F.max("_d").over(Window.partitionBy(*keys))     # 150 rows per group
    return s.withColumn("_m", top).where(F.col("_m") > 0).select(
        *keys, "i", F.exp("_x").alias("x"), (F.col("_d") / F.col("_m")).alias("y"))


def otsu(df: DataFrame, keys: Sequence[str], value: str, scale: float = 1.0, byte_levels: bool = False) -> DataFrame:
    """Threshold per group by largest between-class variance over 256 bins.

    Bins span the group's min..max (threshold = bin centre), or are the byte levels
    themselves. Groups whose maximum is not positive have none. Only bin counts are
    ordered; their integer moments make ties exact, and the first best bin wins.
    """
    k = list(keys)
    v = F.col(value).cast("double")
    d = df.where(v.isNotNull())
    if byte_levels:
        d = d.withColumns({"_lo": F.lit(0.0), "_w": F.lit(1.0)})
        b = F.floor(v)
    else:
        span = d.groupBy(*k).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi")).where(F.col("_hi") > 0)
        d = join_groups(d, span, k).withColumn("_w", (F.col("_hi") - F.col("_lo")) / 256.0)
        b = F.least(F.coalesce(F.floor(F.try_divide(v - F.col("_lo"), F.col("_w"))), F.lit(0)), F.lit(255))
    h = d.groupBy(*k, "_lo", "_w", b.cast("long").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*k).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    full = Window.partitionBy(*k)
    h = h.withColumns({"_n1": F.sum("_n").over(upto), "_s1": F.sum(F.col("_n") * F.col("_b")).over(upto),
                       "_nt": F.sum("_n").over(full), "_st": F.sum(F.col("_n") * F.col("_b")).over(full)})
    n2, s2 = F.col("_nt") - F.col("_n1"), F.col("_st") - F.col("_s1")
    gap = F.col("_s1") / F.col("_n1") - F.try_divide(s2, n2)
    h = h.withColumn("_var", F.coalesce(F.col("_n1") * n2 * gap * gap, F.lit(-1.0)))
    best = h.groupBy(*k, "_lo", "_w").agg(F.min_by("_b", F.struct(-F.col("_var"), F.col("_b"))).alias("_b"))
    centre = F.col("_b") if byte_levels else F.col("_lo") + (F.col("_b") + 0.5) * F.col("_w")
    return best.select(*k, (centre * F.lit(scale)).cast("double").alias("threshold"))


def contrast_stats(samples: DataFrame, file: Sequence[str], value: str) -> DataFrame:
    """Spread, saturation, p1, p99 and foreground of byte samples per file.

    Byte values have 256 levels, so percentiles and moments work on level counts.
    """
    f = list(file)
    t = otsu(samples, f, value, byte_levels=True)
    q = quantiles(samples, f, value, {"p1": 0.01, "p99": 0.99})
    v = F.col(value).cast("double")
    fg = F.when(v > F.col("threshold"), v)
    g = join_groups(samples, t, f).groupBy(*f, "threshold").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_pop(v).alias("std"), (F.avg((v >= 254).cast("double")) * 100).alias("sat_pct"),
        (F.count(fg) / F.count(F.lit(1)) * 100).alias("fg_frac"),
        F.when(F.count(fg) > 1, F.stddev_pop(fg)).otherwise(F.lit(0.0)).alias("fg_std"))
    return g.join(q, f).withColumn("range", F.col("p99") - F.col("p1"))


def contrast_groups(files: DataFrame, group: str) -> DataFrame:
    """Group means with rank by fg_std and a clipping warning."""
    names = ["std", "sat_pct", "p1", "p99", "range", "threshold", "fg_frac", "fg_std"]
    g = files.groupBy(group).agg(F.count(F.lit(1)).alias("n_files"), *[F.avg(c).alias(c) for c in names])
    return g.withColumn("clipped", F.col("sat_pct") > 0.5).orderBy(F.desc("fg_std"), group)


def optical_density(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """max(0, -log10((v + 1) / (p95 + 1))) with the 95th percentile of the group."""
    q = quantiles(df, keys, value, {"_i0": 0.95})
    od = -F.log10((F.col(value) + 1.0) / (F.col("_i0") + 1.0))
    return join_groups(df, q, keys).withColumn("od", F.greatest(F.lit(0.0), od)).drop("_i0")
