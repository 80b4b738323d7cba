"""Language-model scores by Brown class-based bigrams: P(w | v) = P(class(w) | class(v)) * P(w | class(w)).

Words get their classes by exchange clustering. The core, at most CORE of the most frequent training
words, is exchanged in rounds: Spark gathers each word's counts of preceding and following classes
from the table of core bigrams; words move one after the other to the class that raises the
likelihood of the class bigrams most. Every other training word then goes, in one distributed sweep,
to the class in which its own contexts are likeliest.

Texts become numbers once: a block of documents is a stream of core numbers, where other words are
marked and numbered by the block's own dictionary. Later steps read that table, not the texts, and
the dictionaries are resolved by a shuffle on the word, so nothing of the vocabulary but
the core is broadcast.

Smoothing: emissions are discounted by Ney's estimate, and what a class gives up is its
chance of an unknown word; transitions are drawn towards the class frequencies. The
probabilities of all known words and of the unknown one add up to 1 after every history.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import written
from .common import most_frequent

CORE = 1 << 13                #: most words that are exchanged round by round, and broadcast
CLASSES = 64                  #: exchanged classes
ROUNDS = 9                    #: each moves a third of the core
PULL = 50.0                   #: pseudo-tokens of the class frequencies in each transition row
HELD = 300_000                #: distinct words that a task counts before it passes them on
BLOCK = 1 << 24               #: bytes of text in a block, about
SLICE = 1 << 19               #: tokens handled at once
GROUP = 64                    #: first words of bigrams that lie in one row
PIECE = 1 << 18               #: dictionary entries that a task holds before it passes them on by block
ENTRY = np.dtype([("number", "<i4"), ("cls", "u1"), ("n", "<i8")])

END, OTHER = CLASSES, CLASSES + 1            #: classes of the end of a text, and of a word outside the core or unknown
WIDE = CLASSES + 2
END_WORD = b""


def tokens(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case; bytes know no other space or letter."""
    return (text or b"").lower().split()


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(word binary, n) over all rows; the empty word is the end of a text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), pa.array(list(sums.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for t in b.column(0):
                sums.update(tokens(t.as_py()))
                sums[END_WORD] += 1
                if len(sums) > HELD:
                    yield out()
                    sums = Counter()
        yield out()

    return docs.select(F.col(text).cast("binary")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def encode(docs: DataFrame, learn: Column, doc_id: str, text: str, core: list[bytes]) -> DataFrame:
    """(block, ids, learned, stream, others, words): documents as core numbers (2 bytes), each closed by the end's number.

    In `stream` len(core) marks another word; `others` (4 bytes) has its number in the block's `words`.
    """
    shared, n = docs.sparkSession.sparkContext.broadcast(core), len(core)
    kind = docs.schema[doc_id].dataType

    class Numbering(dict):
        def __missing__(self, word):
            self[word] = number = len(self)
            return number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = {w: k for k, w in enumerate(shared.value)}
        part, seq = TaskContext.get().partitionId(), 0
        numbers, ids, learned, pieces, size = Numbering(first), [], [], [], 0

        def out():
            all_ = np.concatenate(pieces)
            stream = np.where(all_ < 0, n + 1, np.minimum(all_, n)).astype(np.uint16)
            return pa.RecordBatch.from_arrays([
                pa.array([part << 24 | seq], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([learned], pa.list_(pa.bool_())),
                pa.array([stream.tobytes()], pa.binary()), pa.array([(all_[all_ >= n] - n).astype(np.int32).tobytes()], pa.binary()),
                pa.array([list(numbers)[n:]], pa.list_(pa.binary()))], ["block", "ids", "learned", "stream", "others", "words"])

        for b in batches:
            id_type = b.column(0).type
            for i, t, x in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                t = t.as_py()                            # one text at a time
                w = tokens(t)
                pieces += [np.fromiter(map(numbers.__getitem__, w), np.int32, len(w)), np.array([-1], np.int32)]
                ids.append(i)
                learned.append(x)
                size += len(t or b"") + 1
                if size >= BLOCK:
                    yield out()
                    seq += 1
                    numbers, ids, learned, pieces, size = Numbering(first), [], [], [], 0
        if ids:
            yield out()

    return docs.select(F.col(doc_id), F.col(text).cast("binary").alias("_text"), F.coalesce(learn, F.lit(False)).alias("_learn")).mapInArrow(
        run, f"block long, ids array<{kind.simpleString()}>, learned array<boolean>, stream binary, others binary, words array<binary>")


def opened(stream: bytes, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a block and where its documents begin."""
    s = np.frombuffer(stream, np.uint16)
    ends = np.flatnonzero(s == end)
    return s, np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)


def sliced(starts: np.ndarray, n: int) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """(tokens, documents, where in the slice these begin): a block in slices, which may cut documents."""
    for a in range(0, n, SLICE):
        b = min(n, a + SLICE)
        docs = slice(int(np.searchsorted(starts, a, "right")) - 1, int(np.searchsorted(starts, b, "left")))
        yield slice(a, b), docs, np.maximum(starts[docs] - a, 0)


def after_end(numbers: np.ndarray, tokens: slice, end: int) -> np.ndarray:
    """What stands before each token of the slice, as long numbers; the end before the first of all."""
    return np.concatenate([[end if tokens.start == 0 else int(numbers[tokens.start - 1])], numbers[tokens.start:tokens.stop - 1]]).astype(np.int64)


def of_tokens(per_document, starts: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(np.asarray(per_document), np.diff(np.append(starts, n)))


def core_bigrams(blocks: DataFrame, n_core: int) -> DataFrame:
    """(grp, codes, counts): counts of all bigrams of training texts over the core, the mark of other words and the end."""
    wide = n_core + 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for stream, learned in zip(b.column(0), b.column(1).to_pylist()):
                s, starts = opened(stream.as_py(), n_core + 1)
                on, found = of_tokens(learned, starts, len(s)), []
                for at, _, _ in sliced(starts, len(s)):
                    found.append(np.unique((after_end(s, at, n_core + 1) * wide + s[at])[on[at]], return_counts=True))
                codes, same = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
                counts = np.bincount(same, np.concatenate([f[1] for f in found]), len(codes))
                groups, at = np.unique(codes // (GROUP * wide), return_index=True)
                cut = [*zip(at, np.append(at[1:], len(codes)))]
                yield pa.RecordBatch.from_arrays([
                    pa.array(groups.astype(np.int32)), pa.array([codes[x:y].astype(np.uint32).tobytes() for x, y in cut], pa.binary()),
                    pa.array([counts[x:y].astype(np.int64).tobytes() for x, y in cut], pa.binary())], ["grp", "codes", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sums = None, None

        def out():
            at = np.flatnonzero(sums)
            return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([(at + group * GROUP * wide).astype(np.uint32).tobytes()], pa.binary()),
                                               pa.array([sums[at].tobytes()], pa.binary())], ["grp", "codes", "counts"])

        for b in batches:
            for g, codes, counts in zip(*(b.column(c) for c in range(3))):
                if g.as_py() != group:
                    if group is not None:
                        yield out()
                    group, sums = g.as_py(), np.zeros(GROUP * wide, np.int64)
                sums[np.frombuffer(codes.as_py(), np.uint32).astype(np.int64) - group * GROUP * wide] += np.frombuffer(counts.as_py(), np.int64)
        if group is not None:
            yield out()

    kind = "grp int, codes binary, counts binary"
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.select("stream", "learned").mapInArrow(count, kind).repartition(n, "grp").sortWithinPartitions("grp").mapInArrow(merge, kind)


def contexts(bigrams: DataFrame, classes: np.ndarray, third: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class bigram counts; of the core words of this third: counts of classes before, of classes after, and of themselves.

    The sums have 3 * (CORE / 3) * WIDE cells at most whatever the corpus.
    """
    n = len(classes) - 2
    shared = bigrams.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        matrix, table = np.zeros(WIDE * WIDE), np.zeros((n + 2) * (2 * WIDE + 1))
        for b in batches:
            for codes, counts in zip(b.column(0), b.column(1)):
                x, y = np.divmod(np.frombuffer(codes.as_py(), np.uint32).astype(np.int64), n + 2)
                k = np.frombuffer(counts.as_py(), np.int64)
                matrix += np.bincount(c[x] * WIDE + c[y], k, WIDE * WIDE)
                for word, slot in ((y, c[x]), (x, WIDE + c[y]), (x, np.full(len(x), 2 * WIDE))):
                    on = (word % 3 == third) & (word < n) & ((slot < 2 * WIDE) | (x == y))
                    table += np.bincount(word[on] * (2 * WIDE + 1) + slot[on], k[on], len(table))
        for first, cells in ((0, table), (len(table), matrix)):
            at = np.flatnonzero(cells)
            yield pa.RecordBatch.from_arrays([pa.array(at + first), pa.array(cells[at].astype(np.int64))], ["cell", "n"])

    sums = bigrams.select("codes", "counts").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells = np.zeros((n + 2) * (2 * WIDE + 1) + WIDE * WIDE)
    cells[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    table = cells[:-WIDE * WIDE].reshape(n + 2, -1)
    return cells[-WIDE * WIDE:].reshape(WIDE, WIDE), table[:n, :WIDE], table[:n, WIDE:-1], table[:n, -1]


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(matrix: np.ndarray) -> float:
    """Of the class bigrams given the class frequencies; what exchange raises."""
    return float(xlogx(matrix).sum() - xlogx(matrix.sum(0)).sum() - xlogx(matrix.sum(1)).sum())


def moved(classes: np.ndarray, third: int, matrix: np.ndarray, before: np.ndarray, after: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The classes after each word of the third has gone to its best class, one word after the other."""
    classes, m = classes.copy(), matrix.copy()
    k = np.arange(CLASSES)
    for w in range(third, len(classes) - 2, 3):
        c, x, y, s = classes[w], before[w].copy(), after[w].copy(), own[w]
        x[c] -= s
        y[c] -= s
        m[:, c] -= x
        m[c, :] -= y
        m[c, c] -= s
        np.maximum(m, 0, out=m)
        to, of = m[:, :CLASSES].T, m[:CLASSES]
        gain = xlogx(to + x) - xlogx(to) + xlogx(of + y) - xlogx(of)
        d = m[k, k]
        total = gain.sum(1) - gain[k, k] + xlogx(d + x[k] + y[k] + s) - xlogx(d)
        a, b = m.sum(0)[:CLASSES], m.sum(1)[:CLASSES]
        total -= xlogx(a + x.sum() + s) - xlogx(a) + xlogx(b + y.sum() + s) - xlogx(b)
        best = int(total.argmax()) if total.max() > total[c] + 1e-9 else c
        m[:, best] += x
        m[best, :] += y
        m[best, best] += s
        classes[w] = best
    return classes


def exchange(bigrams: DataFrame, n_core: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The class of each core word, of the mark and of the end, and the class bigram counts."""
    classes = np.append(np.arange(n_core) % CLASSES, [OTHER, END])
    best, top, made = classes, -np.inf, np.zeros((WIDE, WIDE))
    for r in range(rounds + 1):
        matrix, *rest = contexts(bigrams, classes, r % 3)
        if likelihood(matrix) > top:                 # words of a third move at once, so a round may also lose
            best, top, made = classes, likelihood(matrix), matrix
        if r < rounds:
            classes = moved(classes, r % 3, matrix, *rest)
    return best, made


def other_words(blocks: DataFrame, classes: np.ndarray, matrix: np.ndarray) -> DataFrame:
    """Rows (block, packed) with class and training count of dictionary entries, as ENTRY, and a row (word, cls, n) per training word.

    A word goes to the class in which the classes before and after it are likeliest, weighed by their
    counts; a word that no training text has gets the class OTHER and n = 0.
    """
    n_core = len(classes) - 2
    m = matrix + 0.5
    lift = np.log(m * m.sum() / (m.sum(0) * m.sum(1)[:, None]))
    weights = np.concatenate([lift[:, :CLASSES], lift[:CLASSES].T])
    shared = blocks.sparkSession.sparkContext.broadcast((classes.astype(np.uint8), weights))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value[0]
        for b in batches:
            for block, learned, stream, others, words in zip(*(b.column(k) for k in range(5))):
                s, starts = opened(stream.as_py(), n_core + 1)
                at = np.flatnonzero(s == n_core)
                number = np.frombuffer(others.as_py(), np.int32)
                on = of_tokens(learned.as_py(), starts, len(s))[at]
                at, number = at[on], number[on]
                order = np.argsort(number, kind="stable")
                cls = c[np.concatenate([[n_core + 1], s])]
                pair = np.stack([cls[at[order]], cls[at[order] + 2]], 1).astype(np.uint8)     # the row before, the row after
                n = len(words.values)
                offsets = np.concatenate([[0], 2 * np.cumsum(np.bincount(number, minlength=n))]).astype(np.int32)
                around = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(pair.tobytes())])
                for k in range(0, n, 10_000):
                    m = min(10_000, n - k)
                    yield pa.RecordBatch.from_arrays([words.values.slice(k, m), pa.array(np.full(m, block.as_py())), pa.array(np.arange(k, k + m, dtype=np.int32)),
                                                      around.slice(k, m)], ["word", "block", "number", "around"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, names = shared.value[1], ["block", "packed", "word", "cls", "n"]
        word, sums, held = None, np.zeros(2 * WIDE), []             # the last word so far: its sums and its rows

        waiting: list[list[np.ndarray]] = []

        def out(words, table, rows, group):
            n = table[:, :WIDE].sum(1).astype(np.int64)
            cls = np.where(n > 0, (table @ weights).argmax(1), OTHER).astype(np.int32)
            waiting.append([rows[0], rows[1], cls[group], n[group]])
            own = np.flatnonzero(n > 0)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(own), pa.int64()), pa.nulls(len(own), pa.binary()), pa.array([words[k] for k in own], pa.binary()),
                                              pa.array(cls[own]), pa.array(n[own])], names)
            if sum(len(w[0]) for w in waiting) >= PIECE:
                yield from pieces()

        def pieces():
            if not waiting:
                return
            block, *values = (np.concatenate(c) for c in zip(*waiting))
            waiting.clear()
            order = np.argsort(block, kind="stable")
            block, entries = block[order], np.empty(len(block), ENTRY)
            for name, v in zip(ENTRY.names, values):
                entries[name] = v[order]
            cuts = np.flatnonzero(np.diff(block, prepend=block[0] - 1))
            k = len(cuts)
            yield pa.RecordBatch.from_arrays([pa.array(block[cuts]), pa.array([e.tobytes() for e in np.split(entries, cuts[1:])], pa.binary()),
                                              pa.nulls(k, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64())], names)

        def rest():
            rows = [np.concatenate([h[k] for h in held]) for k in (0, 1)]
            return out([word], sums[None], rows, np.zeros(len(rows[0]), np.int64))

        for b in batches:
            if not b.num_rows:
                continue
            words, block, number = b.column(0).to_pylist(), b.column(1).to_numpy(), b.column(2).to_numpy()
            around = b.column(3)
            new = np.array([True, *(x != y for x, y in zip(words[1:], words))])
            group = np.cumsum(new) - 1
            lengths = np.fromiter(map(len, around.to_pylist()), np.int64, b.num_rows)
            flat = np.frombuffer(b"".join(around.to_pylist()), np.uint8).astype(np.int64)
            slot = flat + WIDE * (np.arange(len(flat)) % 2) + np.repeat(group, lengths) * 2 * WIDE
            table = np.bincount(slot, minlength=(group[-1] + 1) * 2 * WIDE).reshape(-1, 2 * WIDE).astype(float)
            first = [words[k] for k in np.flatnonzero(new)]
            if held and word == first[0]:
                table[0] += sums
            elif held:
                yield from rest()
                held = []
            last = int(np.flatnonzero(new)[-1])
            if len(first) > 1:
                k = last
                rows = [np.concatenate([*(h[x] for h in held), v[:k]]) for x, v in ((0, block), (1, number))]
                yield from out(first[:-1], table[:-1], rows, np.concatenate([np.zeros(len(rows[0]) - k, np.int64), group[:k]]))
                held = []
            word, sums = first[-1], table[-1]
            held.append((block[last:], number[last:]))
        if held:
            yield from rest()
        yield from pieces()

    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = blocks.select("block", "learned", "stream", "others", "words").mapInArrow(seen, "word binary, block long, number int, around binary")
    return rows.repartition(n, "word").sortWithinPartitions("word").mapInArrow(judge, "block long, packed binary, word binary, cls int, n long")


class Numbers:
    """What scoring needs: counts of core words, class sizes, discount, totals."""

    def __init__(self, core_n: np.ndarray, classes: np.ndarray, others: DataFrame, totals):
        n_core = len(classes) - 2
        self.tokens, self.types, self.texts = (int(totals[k] or 0) for k in ("tokens", "types", "texts"))
        once, twice = int(totals["once"] or 0), int(totals["twice"] or 0)
        self.discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.05
        self.size, self.words = np.zeros(WIDE), np.zeros(WIDE)
        np.add.at(self.size, classes[:n_core], core_n)
        np.add.at(self.words, classes[:n_core], 1)
        for r in others.where("word is not null").groupBy("cls").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect():
            self.size[r["cls"]] += r["n"]
            self.words[r["cls"]] += r["k"]
        self.size[END], self.words[END] = self.texts, min(1, self.texts)

    def transitions(self, counts: np.ndarray) -> np.ndarray:
        """log10 of P(class | class before), with a column and a row for the unknown word."""
        k = END + 1
        share = self.size[:k] / max(1, self.tokens)
        given_up = self.discount * self.words[:k] / np.maximum(1, self.size[:k])
        t = np.zeros((WIDE, WIDE))
        t[:k, :k] = (counts[:k, :k] + PULL * share) / (counts[:k, :k].sum(1, keepdims=True) + PULL)
        q = share * given_up
        t[OTHER, :k] = q @ t[:k, :k] / q.sum() if q.sum() else share
        t[:, OTHER] = t[:, :k] @ given_up
        return np.log10(np.maximum(t, 1e-300))


def sequences(blocks: DataFrame, others: DataFrame, classes: np.ndarray, core_n: np.ndarray, numbers: Numbers) -> DataFrame:
    """(ids, learned, seq, n_tokens, n_known, base, emitted): a block's classes as bytes, and sums of each document."""
    n_core = len(classes) - 2
    shared = blocks.sparkSession.sparkContext.broadcast((classes, core_n, numbers.texts, numbers.size, numbers.discount, numbers.tokens + numbers.types + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, core_n, texts, size, discount, room = shared.value
        for b in batches:
            for ids, learned, stream, other, dictionary in zip(*(b.column(k) for k in range(5))):
                s, starts = opened(stream.as_py(), n_core + 1)
                # the block's own numbering: core words, the mark, the end, then its dictionary
                of = np.append(classes[:n_core], [OTHER, END if texts else OTHER]).astype(np.uint8)
                n = np.concatenate([core_n, [0, texts]]).astype(np.int64)
                if dictionary.is_valid:
                    entries = np.frombuffer(b"".join(dictionary.as_py()), ENTRY)
                    order = np.argsort(entries["number"])
                    of, n = np.concatenate([of, entries["cls"][order]]), np.concatenate([n, entries["n"][order]])
                emit = np.where(n > 0, np.log10(np.maximum(n - discount, 1e-300) / np.maximum(1, size[of])), 0.0)
                base, k = np.log10((n + 1) / room), np.frombuffer(other.as_py(), np.int32)
                seq, used = np.empty(len(s), np.uint8), 0
                sums = np.zeros(len(starts), np.int64), np.zeros(len(starts)), np.zeros(len(starts))
                for at, docs, begin in sliced(starts, len(s)):
                    w = s[at].astype(np.int64)
                    mark = np.flatnonzero(w == n_core)
                    w[mark] = k[used:used + len(mark)] + n_core + 2
                    used += len(mark)
                    seq[at] = of[w]
                    for total, v in zip(sums, ((n[w] > 0).astype(np.int64), base[w], emit[w])):
                        total[docs] += np.add.reduceat(v, begin)
                lengths = np.diff(np.append(starts, len(s)))
                yield pa.RecordBatch.from_arrays([
                    pa.ListArray.from_arrays([0, len(starts)], ids.values), pa.ListArray.from_arrays([0, len(starts)], learned.values),
                    pa.array([seq.tobytes()], pa.binary()), *(pa.ListArray.from_arrays([0, len(starts)], pa.array(v)) for v in (lengths, *sums))],
                    ["ids", "learned", "seq", "n_tokens", "n_known", "base", "emitted"])

    found = others.where("block is not null").groupBy("block").agg(F.collect_list("packed").alias("dictionary"))
    ids = blocks.schema["ids"].dataType.simpleString()
    return (blocks.drop("words").join(found, "block", "left").select("ids", "learned", "stream", "others", "dictionary")
            .mapInArrow(run, f"ids {ids}, learned array<boolean>, seq binary, n_tokens array<long>, n_known array<long>, base array<double>, emitted array<double>"))


def class_bigrams(seqs: DataFrame) -> np.ndarray:
    """WIDE x WIDE counts over the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(WIDE * WIDE, np.int64)
        for b in batches:
            for seq, learned, lengths in zip(*(b.column(k) for k in range(3))):
                c, n = np.frombuffer(seq.as_py(), np.uint8), lengths.values.to_numpy()
                on = np.repeat(np.array(learned.as_py(), bool), n)
                for at, _, _ in sliced(np.cumsum(n) - n, len(c)):
                    sums += np.bincount((after_end(c, at, END) * WIDE + c[at])[on[at]], minlength=WIDE * WIDE)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["cell", "n"])

    counts = np.zeros(WIDE * WIDE)
    for r in seqs.select("seq", "learned", "n_tokens").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[r["cell"]] = r["n"]
    return counts.reshape(WIDE, WIDE)


class Fit:
    """A model and the encoded documents it was made with.

    words: DataFrame (word, cls, n) of all training words; transitions: log10 probabilities.
    """

    def __init__(self, docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text"):
        counts = written(word_counts(docs.where(learn), text), "brown-counts")
        ending = F.length("word") == 0
        totals = counts.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("types"), F.sum(F.when(ending, F.col("n"))).alias("texts"),
                            F.count(F.when(F.col("n") == 1, 1)).alias("once"), F.count(F.when(F.col("n") == 2, 1)).alias("twice")).first()
        core = [(bytes(w), n) for w, n in most_frequent(counts.where(~ending), CORE)]
        core_n = np.array([n for _, n in core], np.int64)
        blocks = written(encode(docs, learn, doc_id, text, [w for w, _ in core]), "brown-blocks")
        classes, matrix = exchange(written(core_bigrams(blocks, len(core)), "brown-bigrams"), len(core))
        others = written(other_words(blocks, classes, matrix), "brown-others")
        self.numbers = Numbers(core_n, classes, others, totals)
        self.sequences = written(sequences(blocks, others, classes, core_n, self.numbers), "brown-sequences")
        self.transitions = self.numbers.transitions(class_bigrams(self.sequences))
        named = docs.sparkSession.createDataFrame([(w.decode("utf-8", "replace"), int(classes[k]), n) for k, (w, n) in enumerate(core)], "word string, cls int, n long")
        self.words = named.unionByName(others.where("word is not null").select(F.col("word").cast("string"), "cls", "n"))


def class_scores(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, learned, n_tokens, n_known, train_tokens, base_score, score) of every row, learning from those where `learn` is true.

    base_score is the add-one unigram log10 probability, score the model's. A NULL or blank text is its end alone; a NULL
    `learn` is false; repeated rows are scored and learned from each; without training texts both scores are 0.
    Other columns are not carried.
    """
    fit = Fit(docs, learn, doc_id, text)
    shared = docs.sparkSession.sparkContext.broadcast(fit.transitions)
    kind, known = docs.schema[doc_id].dataType.simpleString(), fit.numbers.tokens > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value.ravel()
        for b in batches:
            for ids, learned, seq, lengths, n_known, base, emitted in zip(*(b.column(k) for k in range(7))):
                c, n, total = np.frombuffer(seq.as_py(), np.uint8), lengths.values.to_numpy(), emitted.values.to_numpy().copy()
                for at, docs, begin in sliced(np.cumsum(n) - n, len(c)):
                    total[docs] += np.add.reduceat(t[after_end(c, at, END) * WIDE + c[at]], begin)
                columns = [ids.values, learned.values, lengths.values, n_known.values, base.values, pa.array(total if known else np.zeros(len(n)))]
                for k in range(0, len(n), 10_000):
                    yield pa.RecordBatch.from_arrays([v.slice(k, 10_000) for v in columns], ["doc_id", "learned", "n_tokens", "n_known", "base_score", "score"])

    rows = fit.sequences.select("ids", "learned", "seq", "n_tokens", "n_known", "base", "emitted").mapInArrow(
        run, f"doc_id {kind}, learned boolean, n_tokens long, n_known long, base_score double, score double")
    return rows.select(F.col("doc_id").alias(doc_id), "learned", "n_tokens", "n_known", F.lit(fit.numbers.tokens).cast("long").alias("train_tokens"), "base_score", "score")
