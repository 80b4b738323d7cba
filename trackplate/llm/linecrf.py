"""Text quality from its lines: a linear-chain conditional random field, good or bad per line.

A line is described by its own shape and by its neighbours'. The chain's forward-backward
marginals, weighted with line lengths, average to the document's quality. The chain is
fitted on a bounded sample of labelled documents, whose lines take the document's label.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

SAMPLE_DOCS = 3000            #: labelled documents that the chain is fitted on at most
SAMPLE_LINES = 500            #: documents with more lines are not drawn into that sample
STEPS, RATE, DECAY = 150, 0.08, 1e-3
GROUP = 1 << 20               #: characters whose features are made at once
TABLE = 0x250                 #: code points from here on count as letters
SYMBOLS = "#*$%&|<>!@^~=+\\{}[]_"


def _classes() -> np.ndarray:
    """Rows letter, upper case, digit, symbol, sentence mark, blank; a column per code point."""
    t = np.zeros((6, TABLE + 1), np.uint8)
    for i in range(TABLE):
        c = chr(i)
        t[:, i] = c.isalpha(), c.isupper(), c.isdigit(), c in SYMBOLS, c in ".,;:?", c.isspace()
    t[0, TABLE] = 1
    return t


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, line lengths, lines per text) of the \\n-split lines of non-NULL texts."""
    lines_of = [t.split("\n") for t in texts]
    per = np.array([len(x) for x in lines_of])
    lines = [x for own in lines_of for x in own]
    n = len(lines)
    codes = np.minimum(np.frombuffer("\n".join([*lines, ""]).encode("utf-32-le", "surrogatepass"), np.uint32), TABLE)
    size = np.array([len(x) for x in lines])
    starts = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    letter, upper, digit, symbol, mark, blank = (np.add.reduceat(c[codes], starts, dtype=np.int64) for c in _classes())
    blank -= 1                                    # the line end
    shape = np.zeros((n, 4))
    k = 0
    for own in lines_of:
        seen: set[str] = set()
        for x in own:
            w = x.split()
            shape[k] = len(w), len(set(w)), sum(map(eq, w, w[1:])), x in seen and bool(w)
            seen.add(x)
            k += 1
    words = np.maximum(shape[:, 0], 1)
    some = np.maximum(size, 1)
    own = np.column_stack([
        letter / some, upper / np.maximum(letter, 1), digit / some, 4 * symbol / some, 8 * mark / some, 4 * blank / some,
        np.log1p(size) / 8, np.minimum((size - blank) / words, 30) / 10,
        shape[:, 1] / words, shape[:, 2] / words, shape[:, 3], shape[:, 0] < 3])
    heads = np.concatenate([[0], np.cumsum(per)[:-1]])
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[heads], last[heads + per - 1] = True, True
    watch = own[:, [1, 3, 6, 8, 9]]
    back, ahead = np.roll(watch, 1, 0), np.roll(watch, -1, 0)
    back[first], ahead[last] = watch[first], watch[last]
    x = np.column_stack([np.ones(n), own, back, ahead, np.abs(own[:, 6] - back[:, 2]), first, last])
    return x.astype(np.float32), size, per


class Chain:
    """Weights of the line features for `good` against `bad`, and the 2 x 2 transition weights."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def _run(self, x: np.ndarray, per: np.ndarray):
        """Marginals of good per line, and summed pair marginals, over chains of any lengths.

        Chains are stepped together, longest first, so step t works on those that reach it.
        """
        order = np.argsort(-per, kind="stable")
        heads = np.concatenate([[0], np.cumsum(per)[:-1]])[order]
        lengths = per[order]
        e = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
        psi = np.column_stack([1 - e, e])
        a = np.exp(self.moves - self.moves.max())
        alpha, beta = np.empty_like(psi), np.ones_like(psi)
        steps = int(lengths[0]) if len(lengths) else 0
        live = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")   # chains with more than t lines
        for t in range(steps):
            at = heads[:live[t]] + t
            v = psi[at] if t == 0 else (alpha[at - 1] @ a) * psi[at]
            alpha[at] = v / v.sum(1, keepdims=True)
        pairs = np.zeros((2, 2))
        for t in range(steps - 1, 0, -1):
            at = heads[:live[t]] + t
            inner = psi[at] * beta[at]
            v = inner @ a.T
            beta[at - 1] = v / v.sum(1, keepdims=True)
            xi = alpha[at - 1][:, :, None] * a[None] * inner[:, None, :]
            pairs += (xi / xi.sum((1, 2), keepdims=True)).sum(0)
        m = alpha * beta
        return (m / m.sum(1, keepdims=True))[:, 1], pairs

    def score(self, texts: list[str | None]) -> np.ndarray:
        out, held, size = np.zeros(len(texts)), [], 0
        for k, t in enumerate(texts):
            held.append((k, t or ""))
            size += len(t or "")
            if size >= GROUP or k == len(texts) - 1:
                x, length, per = line_features([t for _, t in held])
                good, _ = self._run(x, per)
                heads = np.concatenate([[0], np.cumsum(per)[:-1]])
                weight = np.maximum(length, 1)
                out[[k for k, _ in held]] = np.add.reduceat(good * weight, heads) / np.add.reduceat(weight, heads)
                held, size = [], 0
        return np.clip(out, 0.0, 1.0)

    @classmethod
    def fit(cls, x: np.ndarray, per: np.ndarray, label: np.ndarray) -> Chain:
        """Penalised likelihood by Adam steps; `label` is 0 or 1 per chain."""
        chain = cls(np.zeros(x.shape[1]), np.zeros((2, 2)))
        if not len(per):
            return chain
        y = np.repeat(label, per).astype(float)
        seen = np.zeros((2, 2))
        for k in (0, 1):
            seen[k, k] = (per[label == k] - 1).sum()
        x = x.astype(np.float64)
        theta, m, v = np.zeros(x.shape[1] + 4), 0.0, 0.0
        for step in range(1, STEPS + 1):
            good, pairs = chain._run(x, per)
            g = np.concatenate([x.T @ (y - good), (seen - pairs).ravel()]) / len(y) - DECAY * theta
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta + RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
            chain = cls(theta[:-4], theta[-4:].reshape(2, 2))
        return chain


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
          sample: int = SAMPLE_DOCS) -> Chain:
    """Chain fitted on at most `sample` labelled documents, drawn by a hash of their id.

    Rows of one id that disagree on the label are left out, and so are NULL ids and labels. Of the
    texts of one id the smallest is taken, so at most `sample` rows reach the driver.
    Without both labels the chain says 0.5 everywhere.
    """
    agreed = (labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("_id"))
              .agg(F.min(label).alias("_y"), F.max(label).alias("_z")).where("_y = _z"))
    drawn = agreed.orderBy(F.xxhash64("_id"), "_id").limit(sample).select("_id", F.col("_y").cast("int").alias("_y"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, y, *line_features([t])) for i, y, t in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()),
                                              pa.array([r[2].tobytes() for r in rows], pa.binary())], ["i", "y", "x"])

    short = F.length(F.regexp_replace(F.col(text), "[^\n]+", "")) < SAMPLE_LINES
    rows = (docs.where(F.col(text).isNotNull() & short).select(F.col(doc_id).alias("_id"), F.col(text).alias("_t"))
            .join(F.broadcast(drawn), "_id").groupBy("_id", "_y").agg(F.min("_t").alias("_t"))    # `drawn` has `sample` rows at most
            .select(F.col("_id").cast("string"), "_y", "_t")
            .mapInArrow(extract, "i string, y int, x binary").collect())
    rows = sorted(rows, key=lambda r: (r["i"], bytes(r["x"])))
    width = line_features([""])[0].shape[1]
    xs = [np.frombuffer(bytes(r["x"]), np.float32).reshape(-1, width) for r in rows]
    y = np.array([r["y"] for r in rows], int)
    if len(set(y.tolist())) < 2:
        return Chain(np.zeros(width), np.zeros((2, 2)))
    return Chain.fit(np.concatenate(xs), np.array([len(x) for x in xs]), y)


def quality(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """Add `score` (0 to 1, higher is better) and `predicted` (1 from 0.5 on) from the text alone.

    NULL counts as an empty text, which is one empty line. Columns of those names are
    replaced, all others stay.
    """

    @F.pandas_udf("double")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            yield pd.Series(chain.score(s.tolist()))

    tmp = fresh(docs, "quality")
    made = docs.withColumn(tmp, run(F.col(text).cast("string")))
    return made.withColumns({"score": F.col(tmp), "predicted": (F.col(tmp) >= 0.5).cast("int")}).drop(tmp)
