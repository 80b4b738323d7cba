"""Exact Jaccard join of documents on word shingles: size-aware, heavy and light.

A document's set is its distinct five-word shingles. Two sets with a Jaccard similarity of
3/4 or more share at least k of the first n - ceil(3n/4) + k shingles of each in one common
order. Small sets therefore meet on fixed-size subsets (k = 2: pairs of their prefix), sets
that are or may meet large ones on single prefix shingles (k = 1), whose inverted lists
are scanned. The boundary is where the sum of subsets made and list entries scanned is
least, from the size histogram and the mean list length of the whole corpus. The order
puts the most frequent shingles last, so that shared passages do not make long lists.

Equal sets are one class, found by digest. Lists are scanned twice. First each member is
verified against its list's leader, which links groups of near copies with one comparison
per member; then members that are still in different components are compared pair by pair,
so no link between components is lost, and no pair inside one is spent.

Shingles travel as packed arrays per hash partition; keys that are frequent are dealt to
several partitions. Only a count table and a bitmap, both of fixed size, and a few totals pass
through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import written
from ..operators.graph import connected_components

WORDS = 5
SLOT_BITS, PART_BITS = 22, 16  #: of the count table that the order comes from, and of its stretches
SALT_ROWS = 4096              #: expected members of one piece of a frequent key's list
BITMAP_BITS = 26
ROUNDS = ((64, False), (4, True), (1, False))      #: blocks of a list, and whether one member of a component stands for it
SPLIT = 1 << 15               #: marks, beside the size step, entries of a split list
STEPS = 512                   #: size steps per doubling
REACH = 214                   #: steps between sizes that may match: 512 * log2(4/3) and rounding
SMALL_MOST = 256              #: sizes that may be called small
SLICE, MEMO = 512, 1 << 16    #: rows of a batch taken at a time, and words whose hashes a task keeps
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

U = np.uint64


def mix(h: np.ndarray, tag: int = 0) -> np.ndarray:
    h = (h ^ U(tag)) * U(0x9E3779B97F4A7C15)
    h ^= h >> U(29)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(32)
    return h


class WordHash(dict):
    """Hashes of words, kept while there are at most MEMO."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of SLICE rows, so that no more texts than that are Python strings at a time."""
    for b in batches:
        for k in range(0, b.num_rows, SLICE):
            yield b.slice(k, SLICE)
    pa.default_memory_pool().release_unused()


FACTORS = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)]


def shingle_set(text: str | None, memo: WordHash) -> np.ndarray:
    """Ascending distinct 64-bit shingles; fewer than WORDS words are one shingle of their own kind."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, U)
    w = np.fromiter(map(memo.__getitem__, words), U, len(words))
    n = max(1, len(w) - WORDS + 1)
    h = np.full(n, len(w) if len(w) < WORDS else 0, U)
    for k, f in enumerate(FACTORS[:len(w)]):
        h += w[k:k + n] * f
    h = mix(h)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def digest(s: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit sums that name a set."""
    sums = np.array([s.sum(dtype=U), (s * (s >> U(32) | U(1))).sum(dtype=U)])
    return tuple(mix(sums + U(len(s)), 4).view(np.int64).tolist())


def parities(s: np.ndarray) -> bytes:
    """Bit i says whether an odd number of shingles falls on i; a power of two of bits, as many as shingles or more.

    Folding halves onto each other gives the shorter form, and the bits in which two forms
    differ are at most the shingles in which their sets do.
    """
    m = max(512, 1 << (len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & U(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8)).tobytes()


def slots(s: np.ndarray) -> np.ndarray:
    return (s >> U(20) & U((1 << SLOT_BITS) - 1)).astype(np.int64)


class Order:
    """The common order: by how often a shingle's slot occurs in all documents, then by hash.

    Counts are kept as 8 * log2 in a table of fixed size.
    """

    def __init__(self, bits: int, levels: np.ndarray):
        self.bits, self.levels = bits, levels

    def reduced(self, s: np.ndarray) -> np.ndarray:
        """Partition (high bits) and 32 key bits; clashes only make candidates that fail."""
        return s & U((1 << 32 + self.bits) - 1)

    def prefix(self, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First n - ceil(3n/4) + k shingles, in no order, with the estimated counts of their keys."""
        level = self.levels[slots(s)]
        p = min(len(s), len(s) // 4 + k)
        first = np.argpartition(level.astype(U) << U(56) | s >> U(8), p - 1)[:p]
        return s[first], np.exp2(level[first] / 8.0)


def _pack(part: np.ndarray, columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [c[order] for c in columns]
    at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, int)
    cuts = [*at.tolist(), len(part)]
    blobs = [pa.array([c[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()) for c in columns]
    yield pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), *blobs], ["part", *names])


def described(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Documents (doc, n, d1, d2) and, as rows with `part`, each task's counts of all shingles by slot."""
    parts = 1 << SLOT_BITS - PART_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, memo = np.zeros(1 << SLOT_BITS, np.uint32), WordHash()
        for b in slices(batches):
            ids, rows = b.column(0), []
            for t in b.column(1).to_pylist():
                s = shingle_set(t, memo)
                rows.append((len(s), *(digest(s) if len(s) else (None, None))))
                np.add.at(total, slots(s), np.uint32(1))
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), ids.cast(pa.int64()), pa.array([r[0] for r in rows], pa.int64()),
                 pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())],
                ["part", "counts", "doc", "n", "d1", "d2"])
        while total.any():                                        # two bytes a slot; what is over goes into a further row
            now = np.minimum(total, 65535)
            total -= now
            blobs = pa.array([c.astype(np.uint16).tobytes() for c in now.reshape(parts, -1)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts, dtype=np.int32)), blobs, *(pa.nulls(parts, pa.int64()) for _ in range(4))],
                                             ["part", "counts", "doc", "n", "d1", "d2"])

    return docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "part int, counts binary, doc long, n long, d1 long, d2 long")


def _joined(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def slot_levels(blobs: DataFrame) -> DataFrame:
    """(part, levels): per stretch of slots, 8 * log2 of the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = np.frombuffer(c, np.uint16)
                sums[part] = sums[part] + own if part in sums else own.astype(np.uint64)
        for part, c in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([np.minimum(np.round(8 * np.log2(1.0 + c)), 255).astype(np.uint8).tobytes()], pa.binary())],
                ["part", "levels"])

    return blobs.repartition("part").mapInArrow(run, "part int, levels binary")


def boundary(sizes: dict[int, int], list_length: float) -> int:
    """Largest size called small: the one with the least subsets to make, prefix keys to make and list entries to scan."""
    def cost(x: int) -> float:
        subsets = sum(c * (n // 4 + 2) * (n // 4 + 1) / 2 for n, c in sizes.items() if 2 <= n <= x)
        prefixes = sum(c * (n // 4 + 1) for n, c in sizes.items() if 4 * n > 3 * x)
        return subsets + prefixes * (1 + list_length)

    return min(range(SMALL_MOST + 1), key=cost)


def size_step(n: int) -> int:
    return min(SPLIT - 1, round(STEPS * math.log2(n)))


def list_entries(docs: DataFrame, doc_id: str, text: str, order, small: int) -> DataFrame:
    """Packed (key, set digest, set size) of subset keys of small sets and prefix keys of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o, memo = order.value, WordHash()
        for b in slices(batches):
            seen, parts, keys, sets, sizes = set(), [], [], [], []
            for t in b.column(0).to_pylist():
                s = shingle_set(t, memo)
                if not len(s):
                    continue
                d = digest(s)[0]
                if d in seen:
                    continue
                seen.add(d)
                n, made = len(s), []
                if 4 * n > 3 * small:
                    own, count = o.prefix(s, 1)
                    r = o.reduced(own)
                    pieces = np.ceil(count / SALT_ROWS)
                    split = pieces > 1
                    piece = 1 + U(d & 0xFFFFFFFFFFFFFFFF) % pieces.astype(U)
                    moved = ((r >> U(32)) + piece) % U(1 << o.bits) << U(32) | r & U(0xFFFFFFFF)
                    made.append((np.where(split, moved, r), split))
                if 2 <= n <= small:
                    own, _ = o.prefix(s, 2)
                    i, j = np.triu_indices(len(own), 1)
                    r = o.reduced(mix(np.minimum(own[i], own[j]) + mix(np.maximum(own[i], own[j])), 7))
                    made.append((r, np.zeros(len(r), bool)))
                for r, split in made:
                    parts.append((r >> U(32)).astype(np.int32))
                    keys.append((r & U(0xFFFFFFFF)).astype(np.uint32))
                    sets.append(np.full(len(r), d, np.int64))
                    sizes.append(np.uint16(size_step(n)) | (split * SPLIT).astype(np.uint16))
            if parts:
                yield from _pack(np.concatenate(parts), [np.concatenate(x) for x in (keys, sets, sizes)], ["key", "d", "n"])

    return docs.select(F.col(text).cast("string")).mapInArrow(run, "part int, key binary, d binary, n binary")


def scan_lists(entries: DataFrame) -> DataFrame:
    """Rows (NULL, leader, member) to verify first, and (list, set, size) of lists with more pairs.

    Within a list, ordered by size, the smallest unmatched set leads all sets whose size a
    match allows. Lists of equal content are one. Pieces of a split list share its name.
    """

    def run(t: pa.Table) -> pa.Table:
        key, d, n = _joined(t.column("key"), np.uint32), _joined(t.column("d"), np.int64), _joined(t.column("n"), np.uint16).astype(np.int64)
        name = key.astype(U) | (n & SPLIT).astype(U) << U(17)
        n &= SPLIT - 1
        order = np.lexsort((d, n, name))
        name, d, n = name[order], d[order], n[order]
        new = np.concatenate([[True], (name[1:] != name[:-1]) | (d[1:] != d[:-1])])
        name, d, n = name[new], d[new], n[new]
        head = np.concatenate([[True], name[1:] != name[:-1]])
        which = np.cumsum(head) - 1
        size = np.bincount(which)
        split = name >> U(32) > 0
        many = (size[which] > 1) | split
        name, d, n, which, split, size = name[many], d[many], n[many], which[many], split[many], size
        left, leads, members = np.arange(len(d)), [], []
        while len(left):
            first = np.concatenate([[True], which[left][1:] != which[left][:-1]])
            lead = left[np.maximum.accumulate(np.where(first, np.arange(len(left)), 0))]
            near = n[left] - n[lead] <= REACH
            own = near & ~first
            leads.append(d[lead[own]])
            members.append(d[left[own]])
            left = left[~near]
        pairs = np.unique(np.column_stack([np.concatenate(leads), np.concatenate(members)]), axis=0) if leads else np.zeros((0, 2), np.int64)
        content = np.zeros(len(size), U)
        np.add.at(content, which, mix(d.view(U), 8))
        longer = split | (size[which] > 2)
        ids = np.where(split, name, mix(content[which] + size[which].astype(U), 9) | U(1 << 40)).view(np.int64)[longer]
        rows = np.unique(np.column_stack([ids, d[longer], n[longer]]), axis=0)
        return pa.table({"list": pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(rows[:, 0])]),
                         "a": np.concatenate([pairs[:, 0], rows[:, 1]]), "b": np.concatenate([pairs[:, 1], rows[:, 2]])})

    return entries.groupBy("part").applyInArrow(run, "list long, a long, b long")


def _lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, U), *sets]).view(np.int64)))


def fetch_sets(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame) -> DataFrame:
    """(d, p, n, s): name, parities, size and set of the documents named in wanted (doc).

    A bitmap of hashed ids lets the shingling pass skip other documents. Those that pass by a
    clash, and rows that repeat an id, only give sets that nobody asks for or that are equal.
    """
    spark = docs.sparkSession
    slot = F.pmod(F.xxhash64(F.col("doc")), F.lit(1 << BITMAP_BITS))
    # the bitmap functions count positions from 1
    marks = (wanted.select((slot + 1).alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect())
    bits = np.zeros(1 << BITMAP_BITS - 3, np.uint8)
    for bucket, own in marks:                                    # 4 KB each, 2^BITMAP_BITS bits in all
        at = (bucket - 1) * len(own)
        bits[at:at + len(own)] = np.frombuffer(bytes(own), np.uint8)
    shared = spark.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, memo = shared.value, WordHash()
        for b in slices(batches):
            at = b.column(1).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero((marked[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            own = b.take(pa.array(hit))
            sets = [shingle_set(t, memo) for t in own.column(2).to_pylist()]
            keep = [k for k, s in enumerate(sets) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([digest(sets[k])[0] for k in keep], pa.int64()), pa.array([parities(sets[k]) for k in keep], pa.binary()),
                 pa.array([len(sets[k]) for k in keep], pa.int64()), _lists([sets[k] for k in keep])], ["d", "p", "n", "s"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("t")).where("doc is not null")
    return rows.select("doc", slot.alias("slot"), "t").mapInArrow(run, "d long, p binary, n long, s array<long>")


def may_be_similar(a: pd.Series, b: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:
    """False where the parities of two sets of m and n shingles differ in more than (m + n) / 7 bits."""

    def one(x: bytes, y: bytes, total: int) -> bool:
        u, v = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
        while len(v) > len(u):
            v = v[:len(v) // 2] ^ v[len(v) // 2:]
        return 7 * int(np.bitwise_count(u ^ v).sum()) <= total

    return pd.Series([one(*row) for row in zip(a, b, m + n)], dtype=bool)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of 3/4 or more; parities sort most others out first."""
    side = lambda k, *cols: sets.select(F.col("d").alias(k), *(F.col(c).alias(c + k) for c in cols))
    near = (pairs.join(side("b", "p", "n"), "b").join(side("a", "p", "n"), "a").where("4 * least(na, nb) >= 3 * greatest(na, nb)")
            .where(F.pandas_udf(may_be_similar, "boolean")("pa", "pb", "na", "nb")).select("a", "b").distinct())
    near = written(near, "jaccard-near")
    # sets are long: compared where they lie, not sent to Python by the thousand
    return (near.join(side("b", "s"), "b").join(side("a", "s"), "a")
            .where("175 * size(array_intersect(sa, sb)) >= 75L * (size(sa) + size(sb))").select("a", "b"))


def _merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after the components that `links` join are one: a graph of components, not of sets."""
    at = lambda k: groups.select(F.col("node").alias(k), F.col("component").alias(f"c{k}"))
    between = links.join(at("a"), "a").join(at("b"), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    joined = connected_components(between.select(F.col("a").alias("node")).union(between.select("b")), between, keys=(), node="node", src="a", dst="b")
    new = joined.select(F.col("node").alias("component"), F.col("component").alias("to"))
    return written(groups.join(new, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "jaccard-components")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row.

    Rows with no word, or NULL, have an empty set and are their own component; a NULL id has
    a NULL component and links with nothing. Repeated rows are equal sets. An empty table
    gives no rows. Only the two columns are read, whatever others the table has.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    bits = min(24, max(6, (4 * docs.rdd.getNumPartitions() - 1).bit_length()))
    made = written(described(docs, "doc_id", "text"), "jaccard-described")
    told = made.where("part is null").select("doc", "n", "d1", "d2")
    levels = np.zeros((1 << SLOT_BITS - PART_BITS, 1 << PART_BITS), np.uint8)
    for r in slot_levels(made.where("part is not null").select("part", "counts")).collect():         # 2^SLOT_BITS bytes in all
        levels[r["part"]] = np.frombuffer(bytes(r["levels"]), np.uint8)
    order = spark.sparkContext.broadcast(Order(bits, levels.ravel()))
    classes = written(told.where("n > 0 and doc is not null").groupBy("d1", "d2").agg(
        F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n")), "jaccard-classes")
    sizes = {r["n"]: r["c"] for r in classes.groupBy(F.least("n", F.lit(2 * SMALL_MOST)).alias("n")).agg(F.count(F.lit(1)).alias("c")).collect()}
    mass = classes.agg(F.sum(F.col("n") * F.col("copies")), F.sum("n")).first()
    small = boundary(sizes, mass[0] / mass[1] if mass[1] else 1.0)          # the sets a list entry stands for, on average

    found = written(scan_lists(list_entries(docs.where("doc_id is not null"), "doc_id", "text", order, small)), "jaccard-lists")
    pairs = found.where("list is null").select("a", "b").distinct()
    lists = found.where("list is not null").select("list", F.col("a").alias("d"), F.col("b").alias("n")).distinct()
    members = pairs.select(F.col("a").alias("d1")).union(pairs.select("b")).union(lists.select("d")).distinct()
    wanted = classes.join(members, "d1", "left_semi").groupBy(F.col("d1").alias("d")).agg(F.min("rep").alias("doc"))
    sets = written(fetch_sets(docs, "doc_id", "text", written(wanted, "jaccard-wanted")), "jaccard-sets")

    alone = members.select(F.col("d1").alias("node"), F.col("d1").alias("component"))
    groups = _merged(alone, written(verified(pairs, sets), "jaccard-links"))
    # lists that still join several components: first one member of each against the smallest
    open_lists = _open(lists, groups)
    per = open_lists.groupBy("list", "c").agg(F.min(F.struct("n", "d")).alias("m"))
    lead = per.groupBy("list").agg(F.min("m").alias("lead"))
    more = (per.join(lead, "list").where(F.col("m.d") != F.col("lead.d")).where(F.col("m.n") - F.col("lead.n") <= REACH)
            .select(F.col("lead.d").alias("a"), F.col("m.d").alias("b")).distinct())
    groups = _merged(groups, written(verified(more, sets), "jaccard-links"))
    # then every remaining pair across components: pairs within small blocks of a list first, then
    # one member of each component, so that few pairs are left for the last round, which takes all
    rest = open_lists.drop("c")
    for blocks, one_each in ROUNDS:
        rest = written(_open(rest, groups), "jaccard-open")
        now = rest.groupBy("list", "c").agg(F.min_by(F.struct("d", "n"), F.xxhash64("d")).alias("m")).select("list", "c", "m.*") if one_each else rest
        now = now.withColumn("block", F.pmod(F.xxhash64("d"), F.lit(blocks)))
        x, y = (now.select("list", "block", *(F.col(k).alias(f"{side}_{k}") for k in "dnc")) for side in "xy")
        across = (x.join(y, ["list", "block"]).where(f"x_c <> y_c and (x_n < y_n or x_n = y_n and x_d < y_d) and y_n - x_n <= {REACH}")
                  .select(F.col("x_d").alias("a"), F.col("y_d").alias("b")).distinct())
        groups = _merged(groups, written(verified(across, sets), "jaccard-links"))
        rest = rest.drop("c")

    # a component is named by the smallest document of its sets; sets in no list are alone
    placed = classes.select("d1", "d2", "rep").join(groups.withColumnRenamed("node", "d1"), "d1", "left").withColumn("c", F.coalesce("component", "d1"))
    first = placed.groupBy("c").agg(F.min("rep").alias("first"))
    of_class = placed.join(first, "c").select("d1", "d2", "first")
    return (told.join(of_class, ["d1", "d2"], "left")
            .select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"),
                    F.when(F.col("doc").isNotNull(), F.coalesce("first", "doc")).alias("component_id")))


def _open(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """Members (list, d, n, c) of lists whose members lie in more than one component c."""
    placed = written(lists.join(groups.select(F.col("node").alias("d"), F.col("component").alias("c")), "d"), "jaccard-placed")
    several = placed.groupBy("list").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("list")
    return placed.join(several, "list", "left_semi")
