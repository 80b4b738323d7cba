"""BPE encoding and decoding of whole texts with a public word-end vocabulary.

The corpus is counted once; its most frequent words are compiled into a shared-suffix
transducer (`lexicon`) whose outputs are their ids, written to the shared folder, fetched
by every executor and memory-mapped there. A batch resolves each of its distinct
space-free chunks once and remembers it: special tokens are cut out, the rest is normalised and split into
words, each word is looked up in the transducer and, where it is unknown, merged exactly.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import scratch_folder, written
from .common import fresh, most_frequent, put_file
from .lexicon import Lexicon, compile_lexicon

LEXICON_WORDS = 1 << 17        #: words that the transducer holds at most
LEXICON_MIN_COUNT = 2          #: rarer words are merged when they are met
SHORT = 48                     #: up to this length a scan for the best pair beats a heap
FLUSH = 1 << 18                #: distinct words that a counting task keeps before it hands them on
MEMO = 1 << 19                 #: distinct chunks that an encoding task remembers

NO_MERGE = (1 << 31, -1)

#: White space in the vocabulary's sense; str.split would also cut at U+001C to U+001F.
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
ODD = re.compile("[\x1c-\x1f]")


class Vocabulary:
    """Tables of a tokenizer file: ids of bytes inside and at the end of a word, merges, strings."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + suffix] for c in letters]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        self.strings = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of lowest rank joins first, the leftmost of equals."""
        ids = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]]
        return self._merge_short(ids) if len(ids) <= SHORT else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        get, n = self.merges.get, len(ids) - 1
        found = [get((ids[k], ids[k + 1]), NO_MERGE) for k in range(n)]       # of each pair: rank, joint id
        while found:
            best = min(found)
            if best is NO_MERGE:
                break
            k = found.index(best)
            ids[k:k + 2] = [best[1]]
            del found[k]
            if k:
                found[k - 1] = get((ids[k - 1], ids[k]), NO_MERGE)
            if k < len(found):
                found[k] = get((ids[k], ids[k + 1]), NO_MERGE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        get, n = self.merges.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], k, ids[k], ids[k + 1], m[1]) for k in range(n - 1) if (m := get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, new = heapq.heappop(heap)
            nxt = after[k]
            if ids[k] != a or nxt >= n or ids[nxt] != b:
                continue                       # one of the two has been merged since
            ids[k], ids[nxt] = new, -1
            after[k] = after[nxt]
            if after[k] < n:
                before[after[k]] = k
                if m := get((new, ids[after[k]])):
                    heapq.heappush(heap, (m[0], k, new, ids[after[k]], m[1]))
            if (p := before[k]) >= 0 and (m := get((ids[p], new))):
                heapq.heappush(heap, (m[0], p, ids[p], new, m[1]))
        return [i for i in ids if i >= 0]


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself, or the next free one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def chunks(text: str) -> list[str]:
    """Runs free of white space; no word of the vocabulary's pattern crosses them."""
    return [c for c in SPACE.split(text) if c] if ODD.search(text) else text.split()


class Splitter:
    """Special-token ids and normalised words of a chunk."""

    def __init__(self, pattern: str, special: dict[str, int]):
        import regex

        self.find = regex.compile(pattern).findall
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def words(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")   # no final-sigma rule
        return self.find(text.lower())

    def parts(self, chunk: str) -> Iterator[int | str]:
        if self.cut is None or not (pieces := self.cut.split(chunk))[1:]:
            yield from self.words(chunk)
            return
        for piece in pieces:
            if piece in self.special:
                yield self.special[piece]
            elif piece:
                yield from self.words(piece)


def word_counts(docs: DataFrame, splitter_of, text: str = "text") -> DataFrame:
    """(word, n) over all texts, summed in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, seen = splitter_of(), Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
                                              ["word", "n"])

        for batch in batches:
            raw: Counter = Counter()
            for t in batch.column(0).to_pylist():
                if t:
                    raw.update(chunks(t))
            for chunk, n in raw.items():
                for w in splitter.parts(chunk):
                    if isinstance(w, str):
                        seen[w] += n
            if len(seen) > FLUSH:
                yield out()
                seen = Counter()
        yield out()

    return docs.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocab: Vocabulary, text: str = "text", size: int = LEXICON_WORDS,
                  min_count: int = LEXICON_MIN_COUNT) -> bytes:
    """Transducer image over the most frequent words, at most `size`.

    At most `size` words reach the driver, however large the corpus is.
    """
    pattern, special = vocab.pattern, vocab.special
    counts = word_counts(docs, lambda: Splitter(pattern, special), text).where(F.col("n") >= min_count)
    words = sorted(w.encode() for w, _ in most_frequent(written(counts, "bpe-words"), size))
    return compile_lexicon((w, vocab.merge(w)) for w in words)


class Encoder:
    """Encodes texts with a transducer in front of the exact merge; one per task."""

    def __init__(self, vocab: Vocabulary, lexicon: Lexicon):
        self.vocab, self.lexicon = vocab, lexicon
        self.splitter = Splitter(vocab.pattern, vocab.special)

    def ids(self, chunk: str) -> list[int]:
        out: list[int] = []
        for part in self.splitter.parts(chunk):
            if isinstance(part, int):
                out.append(part)
            else:
                word = part.encode()
                known = self.lexicon.get(word)
                out.extend(self.vocab.merge(word) if known is None else known)
        return out

    def decode(self, ids: list[int]) -> str:
        strings = self.vocab.strings
        return " ".join([strings[i] for i in ids if i in strings])


class Memo(dict):
    """What a task needs of each distinct chunk, made when it is first met; emptied when it holds MEMO of them."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, chunk: str):
        if len(self) >= MEMO:
            self.clear()
        value = self[chunk] = self.make(chunk)
        return value


def _shared(docs: DataFrame, path: str, text: str, size: int):
    spark = docs.sparkSession
    vocab = Vocabulary.read(path)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    place = f"{scratch_folder(spark, 'bpe')}/{name}"
    put_file(spark, place, build_lexicon(docs, vocab, text, size))
    spark.sparkContext.addFile(place)
    return spark.sparkContext.broadcast(vocab), name


def encode(docs: DataFrame, path: str, text: str = "text", size: int = LEXICON_WORDS, decoded: bool = True) -> DataFrame:
    """Add `token_ids` (array<int>) and, if asked, `decoded` to every row; the vocabulary file bounds the broadcast.

    NULL and blank texts have no ids and decode to an empty text. Rows are independent, so
    repeated rows and ids stay; an existing column of either name is replaced.
    """
    shared, name = _shared(docs, path, text, size)

    @F.arrow_udf("token_ids array<int>, decoded string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = Encoder(shared.value, Lexicon.mapped(SparkFiles.get(name)))
        memo = Memo(lambda c: array("i", enc.ids(c)))
        for texts in batches:
            flat, ends, back = array("i"), array("i", [0]), []           # four bytes an id
            for t in texts:
                start = len(flat)
                for c in chunks(t.as_py() or ""):
                    flat.extend(memo[c])
                ends.append(len(flat))
                back.append(enc.decode(flat[start:]) if decoded else None)
            ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int32)))
            yield pa.StructArray.from_arrays([ids, pa.array(back, pa.string())], ["token_ids", "decoded"])

    tmp = fresh(docs, "bpe")
    made = docs.withColumn(tmp, run(F.col(text).cast("string")))
    return made.withColumns({c: F.col(tmp)[c] for c in ("token_ids", *(["decoded"] if decoded else []))}).drop(tmp)


def encode_digests(docs: DataFrame, path: str, text: str = "text", size: int = LEXICON_WORDS) -> DataFrame:
    """Add `n_tokens`, `ids_sha256` and `decoded_sha256`: `encode` without shipping the ids back."""
    import hashlib

    shared, name = _shared(docs, path, text, size)

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = Encoder(shared.value, Lexicon.mapped(SparkFiles.get(name)))

        def make(chunk: str) -> tuple[int, str, str]:
            ids = enc.ids(chunk)
            return len(ids), " ".join(map(str, ids)), enc.decode(ids)

        memo = Memo(make)
        for texts in batches:
            columns = [], [], []
            for t in texts:
                own = [m for c in chunks(t.as_py() or "") if (m := memo[c])[0]]
                columns[0].append(sum(m[0] for m in own))
                for k in (1, 2):
                    columns[k].append(hashlib.sha256(" ".join([m[k] for m in own]).encode()).hexdigest())
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()))],
                                             ["n_tokens", "ids_sha256", "decoded_sha256"])

    tmp = fresh(docs, "bpe")
    made = docs.withColumn(tmp, run(F.col(text).cast("string")))
    return made.withColumns({c: F.col(tmp)[c] for c in ("n_tokens", "ids_sha256", "decoded_sha256")}).drop(tmp)
