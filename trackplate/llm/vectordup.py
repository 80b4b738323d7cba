"""Embedding near-duplicates: sorted passes over random projections, bounded windows.

Equal vectors are one class. In each pass every class gets the signs of CODE_BITS random
projections as one code; classes are range-partitioned, sorted and numbered by it, and each
is compared with the next WINDOW, across all borders of partitions. Verified pairs of all passes are united. The number of passes follows from
the number of classes: a pair at the limit agrees on as many leading bits as separate two
neighbours more than a window apart with a known probability, and enough passes are made
to find it with probability RECALL.

Where more classes than a window share these leading bits, the codes do not separate them:
such a run is compared as a whole, in blocks of its rows against each other. A block's task
returns one row per vector, the number of its links and the smallest vector it hangs
together with, never pairs. A pair that shares runs of several passes counts in the first, and windows
leave it out. So a pair at the limit is found with probability RECALL however dense its
neighbourhood is; the work grows with the square of a run.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import written
from ..operators.graph import connected_components

LEAST_COSINE = 0.95
CODE_BITS = 62
WINDOW = 384
RECALL = 0.99
BLOCK = 256
STRIP = 4096                  #: places of the order compared by one task
LEAST_ROWS, MOST_ROWS, PARTS = 512, 4096, 8   #: of a block of a run; blocks of a run before they reach MOST_ROWS


def shared_bits(classes: int, window: int = WINDOW) -> int:
    """Leading bits that leave a window or less to a code, were vectors spread evenly."""
    return int(max(0.0, math.log2(max(1, classes) / window)) + 1)


def passes_for(classes: int, window: int = WINDOW, recall: float = RECALL) -> int:
    bits = max(0.0, math.log2(max(1, classes) / window)) + 1
    agree = (1 - math.acos(LEAST_COSINE) / math.pi) ** bits
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - agree))) if agree < 1 else 4


def vector_classes(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(c, v, m, rep): distinct usable vectors with their number of rows and smallest id."""
    v = F.col(embedding).cast("array<double>")
    usable = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return (vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where(usable)
            .groupBy("v").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("rep")).withColumn("c", F.xxhash64("v")))


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows in double precision; rows of one length each."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def coded(classes: DataFrame, passes: int, seed: int = 7) -> DataFrame:
    """(dim, pass, code, c): a row per class and pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = (1 << np.arange(CODE_BITS - 1, -1, -1)).astype(np.int64)
        for b in batches:
            sizes = np.diff(b.column(1).offsets.to_numpy())
            for dim in np.unique(sizes).tolist():
                own = b.take(pa.array(np.flatnonzero(sizes == dim)))
                x = _matrix(own.column(1))
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, passes * CODE_BITS))
                for p in range(passes):
                    bits = x @ planes[dim][:, p * CODE_BITS:(p + 1) * CODE_BITS] > 0
                    n = len(x)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, p, np.int32)), pa.array(bits @ weights), own.column(0)],
                        ["dim", "pass", "code", "c"])

    return classes.select("c", "v").mapInArrow(run, "dim int, pass int, code long, c long")


def _partitions(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ordered(codes: DataFrame) -> DataFrame:
    """Add `pos`, the place in the order of dim, pass, code and c: ranges are counted, rows numbered within theirs."""
    order = ("dim", "pass", "code", "c")
    rows = written(codes.repartitionByRange(_partitions(codes), *order).sortWithinPartitions(*order)
                   .withColumn("at", F.monotonically_increasing_id()), "vector-order")
    part = F.shiftright("at", 33)                                            # Spark's number of the partition; the rest counts its rows
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
              .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    within = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("part", part).join(ranges, "part").select(*order, (F.col("start") + within).alias("pos"))


def _lists(column: pa.Array) -> np.ndarray:
    """(rows, passes) of run numbers, -1 where a row is in no run of the pass."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _together(runs: np.ndarray) -> bool:
    """Whether one run holds all rows."""
    return bool(((runs == runs[:1]) & (runs >= 0)).all(0).any())


def crowded(rows: DataFrame, bits: int, window: int = WINDOW) -> DataFrame:
    """(c, pass, pos, run, n): rows of `ordered` in runs of more than a window on the same leading bits; `run` is a run's first place."""
    rows = rows.withColumn("lead", F.shiftright("code", CODE_BITS - bits))
    runs = (rows.groupBy("dim", "pass", "lead").agg(F.min("pos").alias("run"), F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > window + 1))
    return rows.join(runs, ["dim", "pass", "lead"]).select("c", "pass", "pos", "run", "n")


def with_runs(classes: DataFrame, inside: DataFrame, passes: int) -> DataFrame:
    """Add `runs` to classes: by pass, the run a class is in, or -1."""
    lists = inside.groupBy("c").agg(F.map_from_entries(F.collect_list(F.struct("pass", "run"))).alias("by_pass"))
    run = lambda p: F.coalesce(F.try_element_at("by_pass", p), F.lit(-1).cast("long"))
    return (classes.join(lists, "c", "left").withColumn("runs", F.array(*(run(F.lit(p)) for p in range(passes)))).drop("by_pass"))


def _roots(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every row and column of a block, the smallest id among those it hangs together with."""
    root_a, root_b = a.copy(), b.copy()
    open_a, open_b = linked.any(1), np.ones(len(b), bool)
    for first in np.flatnonzero(open_a):
        if not open_a[first]:
            continue
        new, mine, others = np.array([first]), [], []
        while len(new):
            open_a[new] = False
            mine.append(new)
            at = np.flatnonzero(linked[new].any(0) & open_b)
            open_b[at] = False
            others.append(at)
            new = np.flatnonzero(linked[:, at].any(1) & open_a)
        mine, others = np.concatenate(mine), np.concatenate(others)
        root_a[mine] = root_b[others] = min(a[mine].min(), b[others].min())
    return root_a, root_b


def block_links(ids, m, x, runs, k: int, left: np.ndarray, right: np.ndarray, least: float = LEAST_COSINE):
    """(id, root, others) of the vectors in rows `left` and `right`, which share their run of pass k; the same rows twice for a block with itself."""
    same = left is right
    earlier = runs[:, :k]
    kinds, kind = np.unique(earlier, axis=0, return_inverse=True)
    kind = kind.reshape(-1)
    left = left[np.argsort(kind[left], kind="stable")]                       # rows of the same earlier runs lie together, to be passed over
    right = left if same else right[np.argsort(kind[right], kind="stable")]
    linked = np.zeros((len(left), len(right)), bool)
    of_left, of_right = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
    for at in range(0, len(left), BLOCK):
        some = left[at:at + BLOCK]
        for to in range(0, len(right), BLOCK):
            more = right[to:to + BLOCK]
            if k and _together(earlier[np.concatenate([some, more])]):
                continue
            i, u = np.unique(kind[some], return_inverse=True)
            j, v = np.unique(kind[more], return_inverse=True)
            met = np.zeros((len(i), len(j)), bool)
            for q in range(k):
                met |= (kinds[i, q][:, None] == kinds[j, q]) & (kinds[i, q][:, None] >= 0)
            near = (x[some] @ x[more].T >= least) & ~met[u][:, v]
            if same and at == to:
                np.fill_diagonal(near, False)
            linked[at:at + BLOCK, to:to + BLOCK] = near
            of_left[at:at + BLOCK] += near @ m[more]
            of_right[to:to + BLOCK] += m[some] @ near
    root_a, root_b = _roots(linked, ids[left], ids[right])
    out = [(ids[left], root_a, of_left)]
    if not same:
        out.append((ids[right], root_b, of_right))
    c, root, others = (np.concatenate(y) for y in zip(*out))
    ok = others > 0
    return c[ok], root[ok], others[ok]


def run_links(inside: DataFrame, classes: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """(c, root, others): by class and block pair, links counted by their rows, and a class it is connected with."""
    parts = F.greatest(F.ceil(F.col("n") / MOST_ROWS), F.least(F.ceil(F.col("n") / LEAST_ROWS), F.lit(PARTS)))
    part = F.floor((F.col("pos") - F.col("run")) * F.col("parts") / F.col("n"))
    dealt = (inside.withColumn("parts", parts).withColumn("part", part)
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
             .select("run", "pass", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"),
                     (F.col("part") <= F.col("other")).alias("first"), "c"))
    rows = dealt.join(classes.select("c", "v", "m", "runs"), "c")

    def run(t: pa.Table) -> pa.Table:
        t = t.select(["pass", "lo", "hi", "first", "c", "v", "m", "runs"]).combine_chunks()
        k, same = t["pass"][0].as_py(), t["lo"][0] == t["hi"][0]
        v, runs = t["v"].combine_chunks(), t["runs"].combine_chunks()
        first = t["first"].to_numpy()
        left = np.flatnonzero(first)
        found = block_links(t["c"].to_numpy(), t["m"].to_numpy(), _matrix(v), _lists(runs), k, left, left if same else np.flatnonzero(~first), least)
        return pa.table(dict(zip(("c", "root", "others"), map(pa.array, found))))

    return rows.groupBy("run", "lo", "hi").applyInArrow(run, "c long, root long, others long")


def window_pairs(rows: DataFrame, classes: DataFrame, window: int = WINDOW, least: float = LEAST_COSINE) -> DataFrame:
    """(a, b), a < b, of classes at most `window` places apart in a pass whose cosine is `least` or more.

    Places are cut into strips of STRIP; the last `window` rows of a strip are copied to the next one.
    Pairs that share a run are left out: `classes` has the runs of every class.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, x, runs = None, np.zeros(0, np.int64), None, None        # the last rows before this batch
        for b in batches:
            keys = np.stack([b.column(k).to_numpy() for k in range(3)], 1)   # strip, dim, pass
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                new, mine = _matrix(b.column(6).slice(lo, hi - lo)), _lists(b.column(7).slice(lo, hi - lo))
                if group != tuple(keys[lo]):
                    group, ids, x, runs = tuple(keys[lo]), np.zeros(0, np.int64), new[:0], mine[:0]
                halo = int((~b.column(4).slice(lo, hi - lo).to_numpy(zero_copy_only=False)).sum())
                before = len(ids) + halo                                     # copies come first and are not compared with each other
                ids, x = np.concatenate([ids, b.column(5).slice(lo, hi - lo).to_numpy()]), np.concatenate([x, new])
                runs = np.concatenate([runs, mine])
                left, right = [ids[:0]], [ids[:0]]
                for at in range(before, len(ids), BLOCK):
                    end, start = min(at + BLOCK, len(ids)), max(0, at - window)
                    if _together(runs[start:end]):
                        continue
                    i, j = np.nonzero(x[at:end] @ x[start:end].T >= least)
                    i, j = i + at, j + start
                    ok = (j < i) & (i - j <= window)
                    i, j = i[ok], j[ok]
                    ok = ~((runs[i] == runs[j]) & (runs[i] >= 0)).any(1)
                    left.append(ids[i[ok]])
                    right.append(ids[j[ok]])
                a, c = np.concatenate(left), np.concatenate(right)
                ok = a != c
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, c)[ok]), pa.array(np.maximum(a, c)[ok])], ["a", "b"])
                ids, x, runs = ids[-window:], x[-window:], runs[-window:]

    size = max(STRIP, window)
    own = F.floor(F.col("pos") / size)
    near = F.col("pos") % size >= size - window
    strips = (rows.withColumn("strip", F.explode(F.when(near, F.array(own, own + 1)).otherwise(F.array(own))))
              .select("strip", "dim", "pass", "pos", (F.col("strip") == own).alias("own"), "c"))
    placed = (strips.join(classes.select("c", "v", "runs"), "c").select("strip", "dim", "pass", "pos", "own", "c", "v", "runs")
              .repartition(_partitions(rows), "strip").sortWithinPartitions("strip", "pos"))
    return placed.mapInArrow(run, "a long, b long").distinct()


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", passes: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors that are NULL, empty, zero or hold NULL or non-finite components link with nothing;
    so do vectors of different lengths. Equal vectors always link. A NULL id counts as a
    vector, but never names a component. Repeated rows are vectors of their own.
    """
    classes = written(vector_classes(vectors, vec_id, embedding), "vector-classes")
    n = classes.count()
    passes = passes or passes_for(n)
    order = written(ordered(coded(classes, passes)), "vector-places")
    inside = written(crowded(order, shared_bits(n)), "vector-runs")
    classes = written(with_runs(classes, inside, passes), "vector-classes")
    pairs = written(window_pairs(order, classes), "vector-pairs")
    dense = written(run_links(inside, classes).groupBy("c", "root").agg(F.sum("others").alias("others")), "vector-links")
    size = classes.select("c", "m")
    both = pairs.union(pairs.select("b", "a"))
    linked = (both.join(size.select(F.col("c").alias("b"), "m"), "b").select(F.col("a").alias("c"), F.col("m").alias("others"))
              .union(dense.select("c", "others")).groupBy("c").agg(F.sum("others").alias("others")))
    edges = pairs.union(dense.where(F.col("c") != F.col("root")).select("root", "c"))
    groups = connected_components(classes.select(F.col("c").alias("node")), edges, keys=(), node="node", src="a", dst="b")
    placed = classes.select("v", "c", "m", "rep").join(groups.withColumnRenamed("node", "c"), "c").join(linked, "c", "left")
    first = placed.groupBy("component").agg(F.min("rep").alias("first"))
    told = placed.join(first, "component").select("v", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n"), "first")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    out = rows.join(told, "v", "left")
    component = F.coalesce("first", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
