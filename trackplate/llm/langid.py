"""Language of whole texts: multinomial naive Bayes over hashed character n-grams.

Texts are folded to lower-case letters with single spaces between runs. Every n-gram of
one to three characters is hashed to a bucket; a batch of texts is a sparse matrix of
buckets in row order, multiplied by the broadcast log-probability matrix with a gather
and a sum per row. Counts are gathered over all training rows, summed in each task first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import written
from .common import fresh

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
ALPHA = 0.1
CELLS = 1 << 23               #: of the matrix (34 MB as float32); beyond 256 languages buckets are halved to stay below
PIECE = 1 << 20               #: characters handled at once; longer texts go in pieces
UNKNOWN = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")


def fold(text: str | None) -> str:
    """Lower-case letters, single spaces around and between runs; blank without a letter."""
    bare = NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return f" {bare} " if any(map(str.isalpha, set(bare))) else ""


def buckets(codes: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each position; the last n-1 run into what follows."""
    h = np.full(len(codes), 0x9E3779B1 * n & 0xFFFFFFFF, np.uint32)
    for k in range(n):
        h[:len(codes) - k] += codes[k:]
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    return (h >> np.uint32(17)).astype(np.int32)


def slices(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, starts, limits, row numbers) of groups of pieces up to about PIECE characters.

    A piece holds the characters that n-grams starting before its limit need.
    """
    tail = max(ORDERS) - 1
    held: list[tuple[str, int, int]] = []
    size = 0
    for row, t in enumerate(texts):
        for at in range(0, len(t), PIECE):
            piece = t[at:at + PIECE + tail]
            held.append((piece, min(PIECE, len(t) - at), row))
            size += len(piece)
            if size >= PIECE:
                yield _pack(held)
                held, size = [], 0
    if held:
        yield _pack(held)


def _pack(held):
    codes = np.frombuffer("".join([p for p, _, _ in held]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(p) for p, _, _ in held])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return codes, starts, np.array([x for _, x, _ in held]), np.array([r for _, _, r in held])


def grams(codes: np.ndarray, starts: np.ndarray, limits: np.ndarray, n: int) -> np.ndarray:
    """Buckets of all n-grams; BUCKETS marks positions where none of this piece starts."""
    h = buckets(codes, n)
    ends = np.append(starts[1:], len(codes))
    stop = starts + np.minimum(limits, ends - starts - n + 1)
    for k in range(max(ORDERS) - 1):
        at = ends - 1 - k
        at = at[(at >= stop) & (at >= starts)]
        h[at] = BUCKETS
    return h


def gram_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, bucket, n) over all rows; bucket -1 counts the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def out():
            for name, c in sums.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(at), pa.string()), pa.array(np.where(at == BUCKETS, -1, at).astype(np.int32)), pa.array(c[at])],
                    ["lang", "bucket", "n"])

        for b in batches:
            rows = [(f, x) for t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (f := fold(t))]
            by: dict[str, list[str]] = {}
            for f, x in rows:
                by.setdefault(x, []).append(f)
            for x, texts in by.items():
                c = sums.setdefault(x, np.zeros(BUCKETS + 1, np.int64))
                for codes, starts, limits, _ in slices(texts):
                    for n in ORDERS:
                        c[:BUCKETS] += np.bincount(grams(codes, starts, limits, n), minlength=BUCKETS + 1)[:BUCKETS]
                c[BUCKETS] += len(texts)
            if len(sums) > 64:
                yield from out()
                sums = {}
        yield from out()

    return (docs.select(text, lang).mapInArrow(count, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))


class Model:
    """Language names in code-point order, log priors, log probabilities per bucket.

    A row of `weights` has a power of two of buckets, and a zero for positions without an n-gram.
    """

    def __init__(self, names: list[str], prior: np.ndarray, weights: np.ndarray):
        self.names, self.prior, self.weights = names, prior, weights

    def scores(self, texts: list[str]) -> np.ndarray:
        width = self.weights.shape[1] - 1
        total = np.tile(self.prior, (len(texts), 1))
        for codes, starts, limits, rows in slices(texts):
            for n in ORDERS:
                h = grams(codes, starts, limits, n)
                if width < BUCKETS:
                    h = np.where(h == BUCKETS, width, h % width)
                for k, w in enumerate(self.weights):
                    np.add.at(total[:, k], rows, np.add.reduceat(w[h], starts, dtype=np.float64))
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        folded = [fold(t) for t in texts]
        if not self.names or not folded:
            return [UNKNOWN] * len(folded), np.zeros(len(folded))
        s = self.scores(folded)
        best = s.argmax(1)
        p = 1 / np.exp(s - s.max(1, keepdims=True)).sum(1)
        known = np.array([bool(f) for f in folded])
        return [self.names[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, p, 0.0)


def width_for(langs: int) -> int:
    """Buckets of a model of so many languages: BUCKETS, halved while the matrix has more than CELLS."""
    width = BUCKETS
    while width > 1 and langs * width > CELLS:
        width //= 2
    return width


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Model of all rows with a language and a letter; about CELLS counts reach the driver however many languages there are."""
    counts = written(gram_counts(docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()), text, lang), "grams")
    docs_of = {r["lang"]: r["n"] for r in counts.where("bucket = -1").collect()}
    width = width_for(len(docs_of))
    folded = counts.withColumn("bucket", F.when(F.col("bucket") >= 0, F.col("bucket") % width).otherwise(F.col("bucket")))
    found = (folded.where("bucket >= 0").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
             .groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c"))).collect()
    rows = {}
    for r in found:
        c = np.zeros(width)
        for b, n in r["c"]:
            c[b] = n
        rows[r["lang"]] = np.append(np.log((c + ALPHA) / (c.sum() + ALPHA * width)), 0.0).astype(np.float32)
    names = sorted(docs_of)
    prior = np.log(np.array([docs_of[x] for x in names]) / sum(docs_of.values())) if names else np.zeros(0)
    return Model(names, prior, np.array([rows[x] for x in names], np.float32).reshape(len(names), width + 1))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add `lang_pred` and `score` (posterior of that language) from the text alone.

    A NULL text or one without a letter gets `und` and 0. Equal scores go to the name that
    is first by code point. Columns of those names are replaced, all others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in series:
            names, p = shared.value.predict(s.tolist())
            yield pd.DataFrame({"lang_pred": names, "score": p})

    tmp = fresh(docs, "lang")
    made = docs.withColumn(tmp, run(F.col(text).cast("string")))
    return made.withColumns({"lang_pred": F.col(tmp)["lang_pred"], "score": F.col(tmp)["score"]}).drop(tmp)
