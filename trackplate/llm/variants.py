"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

One inserted, deleted or replaced code point moves a word's letter counts by a squared distance
of at most two, and so does it move the counts folded to a few bins. Words are therefore put
in blocks by counts folded to BINS bins; a block meets itself and the blocks whose bins differ by
one insertion (the adjacent length) or one replacement. Blocks are dealt as tiles of bounded
size. Of each pair of tiles, one product of letter-count matrices (folded to FOLD bins) gives
all squared distances; what is at most two is verified on the code points.

The form of a word is its most frequent near word if that is frequent enough; forms are
followed to the last by pointer doubling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import written

BINS, BITS = 6, 10            #: a block is BINS counts of BITS bits; larger counts stay at the maximum
FOLD = 32                     #: letters of a count vector
TILE = 1024                   #: words of a tile, about
TILE_CHARS = 1 << 18          #: characters of a tile, about
VERIFY = 1 << 22              #: code points compared at once
RUN = r"[a-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, FACTOR = 5, 3, 2

STEPS = [1 << (BITS * k) for k in range(BINS)]
#: From a block to those it meets, each unordered pair of blocks once: itself, replacements, insertions.
MEETS = [0, *(a - b for k, b in enumerate(STEPS) for a in STEPS[:k]), *STEPS]


def runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, run): every maximal run of letters in A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased; a NULL text has none."""
    low = F.translate(F.col(text), UPPER, LOWER)
    return docs.select(F.col(doc_id).alias("doc"), F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("run"))


def lettered(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the words in a row, and the lengths."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.fromiter(map(len, words), np.int64, len(words))


def folded(codes: np.ndarray, lengths: np.ndarray, bins: int) -> np.ndarray:
    """A row of letter counts per word, letters folded to bins."""
    rows = np.repeat(np.arange(len(lengths)), lengths)
    return np.bincount(rows * bins + codes % bins, minlength=len(lengths) * bins).reshape(-1, bins)


def block_of(words: list[str]) -> np.ndarray:
    counts = np.minimum(folded(*lettered(words), BINS), (1 << BITS) - 1)
    return counts @ np.array(STEPS, np.int64)


class Tile:
    """Words of one block with their code points and letter counts."""

    def __init__(self, words: list[str]):
        self.words = words
        self.codes, self.lengths = lettered(words)
        self.starts = np.cumsum(self.lengths) - self.lengths
        exact = np.float32 if self.lengths.max(initial=0) < 4000 else np.float64      # squares stay whole numbers
        self.counts = folded(self.codes, self.lengths, FOLD).astype(exact)
        self.squares = (self.counts ** 2).sum(1)


def near(a: Tile, b: Tile) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in a, in b) of all words exactly one edit apart."""
    d2 = a.counts @ (-2 * b.counts.T)
    d2 += a.squares[:, None]
    d2 += b.squares
    i, j = np.nonzero(d2 <= 2)
    found = [np.zeros(len(i), bool)]
    la, lb = a.lengths[i], b.lengths[j]
    for x, y in {*zip(la.tolist(), lb.tolist())}:
        if abs(x - y) > 1:
            continue
        at = np.flatnonzero((la == x) & (lb == y))
        step = max(1, VERIFY // max(x, y))
        for k in range(0, len(at), step):
            some = at[k:k + step]
            p, q = (a, b) if x <= y else (b, a)                  # p is the shorter
            ps, qs = (i[some], j[some]) if x <= y else (j[some], i[some])
            u = p.codes[p.starts[ps][:, None] + np.arange(min(x, y))]
            v = q.codes[q.starts[qs][:, None] + np.arange(max(x, y))]
            if x == y:
                ok = (u != v).sum(1) == 1
            else:
                head = np.minimum.accumulate(u == v[:, :-1], 1).sum(1)
                tail = np.minimum.accumulate((u == v[:, 1:])[:, ::-1], 1).sum(1)
                ok = head + tail >= min(x, y)
            found[0][some] = ok
    return i[found[0]], j[found[0]]


def tiles(vocab: DataFrame) -> DataFrame:
    """(block, tile, words, counts): the words of each block in tiles of bounded size; from (word, n)."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(block_of(b.column(0).to_pylist())), b.column(0), b.column(1)], ["block", "word", "n"])

    rows = vocab.select("word", "n").mapInArrow(blocks, "block long, word string, n long")
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum(F.length("word")) / TILE_CHARS))
    sizes = rows.groupBy("block").agg(parts.alias("parts"))
    return (rows.join(sizes, "block").groupBy("block", F.pmod(F.xxhash64("word"), F.col("parts")).alias("tile"))
            .agg(F.collect_list(F.struct("word", "n")).alias("c"))
            .select("block", "tile", F.col("c.word").alias("words"), F.col("c.n").alias("counts")))


def dealt_tiles(t: DataFrame) -> DataFrame:
    """(at, lt, guest, words, counts): every tile, and after it the tiles it meets, in order in one partition; from tiles().

    Which tiles meet is found from their numbers alone; words only go along. Their joins are merged, not broadcast: the size
    of a table of lists on disk does not tell what its rows take, and copies for the blocks met are not in Spark's estimate.
    """
    homes = t.groupBy("block").agg(F.sort_array(F.collect_list("tile")).alias("tiles"))
    asks = homes.select("block", F.explode(F.array(*map(F.lit, MEETS))).alias("step")).withColumn("at", F.col("block") - F.col("step"))
    visits = (asks.join(homes.select(F.col("block").alias("at"), "tiles"), "at").groupBy("block")
              .agg(F.collect_list(F.struct("at", "step", "tiles")).alias("visits")))
    hosts = t.select(F.col("block").alias("at"), F.col("tile").alias("lt"), F.lit(False).alias("guest"), "words", "counts")
    guests = (t.hint("merge").join(visits, "block").select("tile", F.explode("visits").alias("v"), "words", "counts")
              .select("tile", F.col("v.at").alias("at"), F.col("v.step").alias("step"), F.explode("v.tiles").alias("lt"), "words", "counts")
              .where((F.col("step") != 0) | (F.col("lt") < F.col("tile")))
              .select("at", "lt", F.lit(True).alias("guest"), "words", "counts"))
    # few rows of much work each: dealt evenly
    n = int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return hosts.unionByName(guests).repartition(4 * n, "at", "lt").sortWithinPartitions("at", "lt", "guest")


def near_words(vocab: DataFrame) -> DataFrame:
    """(word, other, n): every word of (word, n) with each word one edit away and that one's n; words are distinct."""
    dealt = dealt_tiles(written(tiles(vocab), "variant-tiles"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out():
            (x, xn), (y, yn) = ([np.concatenate([h[k] for h in held]) for k in ks] for ks in ((0, 1), (2, 3)))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x, y]), pa.string()), pa.array(np.concatenate([y, x]), pa.string()),
                                               pa.array(np.concatenate([yn, xn]))], ["word", "other", "n"])

        a, an = None, None
        for b in batches:
            guests, words, counts = b.column(2), b.column(3), b.column(4)
            for k in range(b.num_rows):
                c, cn = Tile(words[k].as_py()), counts[k].values.to_numpy()
                same = not guests[k].as_py()
                if same:
                    a, an = c, cn
                i, j = near(a, c)
                if same:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    held.append((np.array(a.words, object)[i], an[i], np.array(c.words, object)[j], cn[j]))
                    size += len(i)
                if size > 20_000:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return dealt.mapInArrow(compare, "word string, other string, n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words in (word, form): where following forms ends.

    A form is at least FACTOR times as frequent as its word, so a path has fewer than 64 steps.
    """
    cur = written(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        far = cur.select(F.col("word").alias("root"), F.col("root").alias("far"))
        step = written(cur.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "variant-roots")
        cur = step.drop("moved")
        if step.where("moved").isEmpty():
            return cur


def group_variants(words: DataFrame, word: str = "word", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
                   factor: int = FACTOR) -> DataFrame:
    """(word, n, form, form_n, n_near, root) of the words that are long and frequent enough; `words` has a row per occurrence.

    form is the near word of the largest n (ties: the first by code point) if its n is at least
    `factor` (2 or more) times the word's, else NULL with form_n NULL; root is the word itself if it has no form.
    NULL words and all other columns are ignored; an empty table gives no rows.
    """
    vocab = written(words.where(F.length(word) >= least_length).groupBy(F.col(word).alias("word")).agg(F.count(F.lit(1)).alias("n"))
                    .where(F.col("n") >= least_count), "variant-words")
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("other"))).alias("best")
    found = near_words(vocab).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    strong = -F.col("best.n") >= factor * F.col("n")
    judged = written(vocab.join(found, "word", "left").select(
        "word", "n", F.when(strong, F.col("best.other")).alias("form"), F.when(strong, -F.col("best.n")).alias("form_n"),
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near")), "variant-forms")
    ends = roots(judged.where(F.col("form").isNotNull()))
    return judged.join(ends, "word", "left").select("word", "n", "form", "form_n", "n_near", F.coalesce("root", "word").alias("root"))
