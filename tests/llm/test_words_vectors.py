"""Spelling variants, class-based scores and hard negatives, against brute force on small tables."""

import collections
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import odd_documents
from trackplate.llm import brown, catalog, hardneg, variants

SF = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


# --- spelling variants ---------------------------------------------------------------

def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_groups(occurrences, least_length=5, least_count=3, factor=2):
    n = {w: c for w, c in collections.Counter(w for w in occurrences if w is not None and len(w) >= least_length).items() if c >= least_count}
    form, near = {}, {}
    for w in n:
        o = [v for v in n if one_edit(v, w)]
        near[w] = len(o)
        best = min(o, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (n[w], form[w], n.get(form[w]), near[w], root(w)) for w in n}


def some_words(seed, n):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abéxyz") for _ in range(rnd.choice([5, 6, 7, 9, 12]))) for _ in range(n)]
    out = []
    for w in base:
        out += [w] * rnd.choice([3, 9, 40])
        for _ in range(4):
            k = rnd.randrange(len(w))
            out += [rnd.choice([w[:k] + w[k + 1:], w[:k] + "q" + w[k:], w[:k] + "z" + w[k + 1:]])] * rnd.choice([1, 3, 5, 12])
    return out


def grouped(df, **kw):
    return {r["word"]: (r["n"], r["form"], r["form_n"], r["n_near"], r["root"]) for r in variants.group_variants(df, **kw).collect()}


@pytest.mark.parametrize("tile", [1024, 2])
def test_variants_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(variants, "TILE", tile)                       # 2: every block is split
    words = some_words(3, 60)
    want = plain_groups(words)
    got = grouped(spark.createDataFrame([(w,) for w in words], "word string"))
    assert got == want and any(x[1] for x in want.values()) and any(want[x[1]][1] for x in want.values() if x[1])


def test_lists_of_words_are_never_broadcast(spark):
    """Whatever a table of word lists takes on disk, a join by broadcast holds it, and its copies for the blocks met, in the driver."""
    vocab = spark.createDataFrame([(w, 3) for w in set(some_words(4, 20))], "word string, n long")
    lines = variants.near_words(vocab)._jdf.queryExecution().sparkPlan().toString().splitlines()
    depth = [len(re.match(r"[\s:|+-]*", x)[0]) for x in lines]
    assert any("words" in x for x in lines)
    for k, x in enumerate(lines):
        if "BroadcastHashJoin" in x or "BroadcastNestedLoopJoin" in x:
            under = itertools.takewhile(lambda j: depth[j] > depth[k], range(k + 1, len(lines)))
            assert not any("words" in lines[j] for j in under), x


def test_variants_of_odd_words(spark):
    long = "ab" * 2500
    words = (["aaaaa"] * 3 + ["aaaaaa"] * 6 + ["aaaaaaa"] * 12 + ["tiess"] * 4 + ["tiesa"] * 8 + ["tiesb"] * 8 + ["short"] * 2 + ["four"] * 9
             + [long] * 4 + [long + "a"] * 8 + [long[:70] + "c" + long[71:]] * 3 + ["漢字漢字漢"] * 3 + ["漢字漢字漢😀"] * 6)
    df = spark.createDataFrame([(w, "x", "y") for w in [*words, None]], "word string, n string, root string")
    got = grouped(df)
    assert got == plain_groups(words)
    assert got["aaaaa"][1] == "aaaaaa" and got["aaaaa"][4] == "aaaaaaa" and got["tiess"][1] == "tiesa" and got[long][1] == long + "a"
    assert grouped(df.limit(0)) == {} and grouped(spark.createDataFrame([("alone",)] * 3, "word string")) == {"alone": (3, None, None, 0, "alone")}


def test_letters_on_the_rim_of_a_block():
    full = (1 << variants.BITS) - 1
    for a, b in (("a" * full, "a" * (full + 1)), ("a" * (full + 1) + "b", "a" * (full + 1) + "c"), ("b" * full + "a", "b" * (full + 1)), ("abcde", "abcd"), ("abcde", "abfde")):
        step = int(variants.block_of([a])[0] - variants.block_of([b])[0])
        assert step in variants.MEETS or -step in variants.MEETS
        i, j = variants.near(variants.Tile([a]), variants.Tile([b]))
        assert len(i) == 1 and one_edit(a, b)


def test_runs_of_odd_documents(spark):
    df = odd_documents(spark)
    got = sorted(map(repr, ((r["doc"], r["run"]) for r in variants.runs(df).collect())))
    low = str.maketrans(variants.UPPER, variants.LOWER)
    want = sorted(repr((r["doc_id"], w.translate(low))) for r in df.collect() for w in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""))
    assert got == want


@given
def test_variants_query_deletes_letters_by_hash(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    low, words, deleted = str.maketrans(variants.UPPER, variants.LOWER), [], 0
    for r in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            w = w.translate(low)
            h = zlib.crc32(f"{r['doc_id']}:{w}".encode())
            if h % 97 == 0:
                w, deleted = w[:h % len(w)] + w[h % len(w) + 1:], deleted + 1
            words.append(w)
    got = {r["word"]: (r["n"], r["form"], r["form_n"], r["n_near"], r["root"]) for r in catalog.op11_spelling_variants(spark, SF).collect()}
    n = collections.Counter(w for w in words if len(w) >= 5)
    assert deleted and {w: x[0] for w, x in got.items()} == {w: c for w, c in n.items() if c >= 3}
    want = plain_groups([w for w in words if n[w] >= 12], least_count=12)
    assert {w: x for w, x in want.items()}.keys() <= got.keys()
    for w, x in want.items():                                   # the frequent words alone: their near words are among the found ones
        assert got[w][3] >= x[3] and (x[1] is None or got[w][1] is not None)


# --- class-based scores ------------------------------------------------------------------

def plain_base(rows):
    """doc -> (n_tokens, n_known, N, base) by definition."""
    tok = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b""]
    c = collections.Counter(w for _, t, learn in rows if learn for w in tok(t))
    n, v = sum(c.values()), len(c)
    return [(i, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for i, t, _ in rows for w in [tok(t)]]


def two_languages(n, seed=5):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        noun, verb = ([f"n{j}" for j in range(40)], [f"v{j}" for j in range(40)]) if k % 2 else ([f"s{j}" for j in range(40)], [f"t{j}" for j in range(40)])
        out.append(" ".join(x for _ in range(rnd.randrange(5, 30)) for x in (rnd.choice(noun), rnd.choice(verb))))
    return out


def test_class_scores_base_and_gain(spark, monkeypatch):
    monkeypatch.setattr(brown, "SLICE", 50)
    monkeypatch.setattr(brown, "BLOCK", 700)                            # many blocks, documents cut by slices
    rows = [(k, t, k % 4 != 1) for k, t in enumerate(two_languages(200))] + [(500, "never seen Words here", False), (501, None, True), (502, " \t ", False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, learn boolean")
    got = {r["doc_id"]: r for r in brown.class_scores(df, df["learn"]).collect()}
    assert len(got) == len(rows)
    for i, n, known, total, base in plain_base(rows):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total) and r["base_score"] == pytest.approx(base)
    held = [got[i] for i, _, learn in rows if not learn and i < 500]
    gain = sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held)
    assert gain > 0.4                          # the words alternate between two classes of 40 within a language


def test_model_is_a_distribution_and_scores_follow_it(spark, monkeypatch):
    monkeypatch.setattr(brown, "CORE", 30)                              # most words go through the sweep
    rows = [(k, t, True) for k, t in enumerate(two_languages(60))]
    df = spark.createDataFrame([*rows, (900, "n1 unheard v2", False)], "doc_id long, text string, learn boolean")
    fit = brown.Fit(df, df["learn"])
    words = {r["word"]: (r["cls"], r["n"]) for r in fit.words.collect()}
    count = collections.Counter(w for _, t, _ in rows for w in t.split())
    assert {w: n for w, (_, n) in words.items()} == dict(count) and len({c for c, _ in words.values()}) > 3
    d, size, t = fit.numbers.discount, collections.Counter(), 10 ** fit.transitions
    for c, n in words.values():
        size[c] += n
    words[""] = brown.END, len(rows)
    size[brown.END] = len(rows)

    def p(word, before):
        if word not in words:
            return t[before, brown.OTHER]
        c, n = words[word]
        return t[before, c] * (n - d) / size[c]

    for before in [*{c for c, _ in words.values()}, brown.OTHER]:
        assert sum(p(w, before) for w in words) + p(None, before) == pytest.approx(1, abs=1e-9)
    got = {r["doc_id"]: r["score"] for r in brown.class_scores(df, df["learn"]).collect()}
    for i, text, _ in [*rows[:5], (900, "n1 unheard v2", False)]:
        before, want = brown.END, 0.0
        for w in [*text.split(), ""]:
            want += math.log10(p(w, before))
            before = words[w][0] if w in words else brown.OTHER
        assert got[i] == pytest.approx(want)


def test_moving_a_word_adds_up():
    """The likelihood after a round equals that of the counts made anew from the moved classes."""
    rnd = np.random.default_rng(2)
    n = 90
    pairs = rnd.integers(0, 40, (n + 2, n + 2)) * (rnd.random((n + 2, n + 2)) < 0.2)
    classes = np.append(np.arange(n) % brown.CLASSES, [brown.OTHER, brown.END])

    def sums(classes):
        one = np.eye(brown.WIDE)[classes]
        return one.T @ pairs @ one, (pairs.T @ one)[:n], (pairs @ one)[:n], np.diag(pairs)[:n].astype(float)

    before = brown.likelihood(sums(classes)[0])
    for w in range(3):                                   # one word at a time, so that its counts are exact
        new = brown.moved(np.append(classes[:w + 1], classes[-2:]), w, *sums(classes))
        classes = np.concatenate([new[:w + 1], classes[w + 1:]])
        after = brown.likelihood(sums(classes)[0])
        assert after >= before - 1e-6
        before = after
    m, *rest = sums(classes)
    assert brown.likelihood(sums(brown.moved(classes, 0, m, *rest))[0]) > before


def test_class_scores_of_odd_documents(spark):
    df = odd_documents(spark)
    rows = brown.class_scores(df, df["doc_id"] % 2 == 1).collect()
    assert len(rows) == df.count() and rows[0].asDict().keys() == {"doc_id", "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score"}
    assert all(np.isfinite(r["score"]) and r["score"] <= 1e-9 for r in rows)
    twice = [r["score"] for r in rows if r["doc_id"] == 3]
    assert len(twice) == 2 and twice[0] == twice[1] and [r["n_tokens"] for r in rows if r["doc_id"] in (4, 5, 6)] == [1, 1, 1]
    assert brown.class_scores(df.limit(0), df["doc_id"] > 0).count() == 0
    none = brown.class_scores(df, df["doc_id"] > 10 ** 6).collect()
    assert len(none) == df.count() and all(r["score"] == r["base_score"] == 0 and r["train_tokens"] == r["n_known"] == 0 for r in none)


# --- hard negatives --------------------------------------------------------------------------

def plain_negatives(rows, anchors, n_pos=5, n_neg=10):
    out = []
    for i, lab, q in rows:
        if i % anchors:
            continue
        s = sorted(((-sum(x * y for x, y in zip(q, p)), j, m) for j, m, p in rows if j != i and len(p) == len(q)), key=lambda t: t[:2])
        for x, j, _ in [t for t in s if t[2] == lab][:n_pos]:
            fit = [t for t in s if t[2] != lab and 30 * -x <= 100 * -t[0] <= 90 * -x][:n_neg]
            out += [(i, j, k + 1, t[1], -x, -t[0]) for k, t in enumerate(fit)]
    return sorted(out)


def vectors(seed, n, scale=100):
    rnd = np.random.default_rng(seed)
    centre = rnd.normal(size=(4, 12))
    lab = rnd.integers(0, 4, n)
    x = centre[lab] + 0.8 * rnd.normal(size=(n, 12)) + 0.7 * centre[(lab + rnd.integers(0, 2, n)) % 4]
    return [(i, int(lab[i]), [int(v) for v in np.floor(scale * x[i] * rnd.uniform(0.2, 3))]) for i in range(n)]


@pytest.mark.parametrize("bucket", [2048, 16])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(hardneg, "BUCKET", bucket)
    monkeypatch.setattr(hardneg, "SLAB", 2)
    monkeypatch.setattr(hardneg, "ANCHORS", 7)
    rows = vectors(4, 400)
    rows += [(1000 + k, 1, rows[3][2]) for k in range(30)] + [(2000 + k, 2, rows[3][2]) for k in range(30)]       # ties
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<int>")
    got = sorted(map(tuple, hardneg.hard_negatives(df, df["vec_id"] % 10 == 0).collect()))
    assert got == plain_negatives(rows, 10) and len(got) > 500


def test_hard_negatives_keep_a_vector_a_row(spark, monkeypatch):
    """Readers and aggregates hold thousands of rows at once, so none may be a whole bucket."""
    longest, kept = [], hardneg.written

    def watched(df, name):
        out = kept(df, name)
        lists = [c for c, kind in out.dtypes if kind == "array<int>"]
        longest.extend(out.select(F.max(F.size(c))).head()[0] for c in lists)
        return out

    monkeypatch.setattr(hardneg, "written", watched)
    rows = vectors(5, 300)
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<int>")
    assert sorted(map(tuple, hardneg.hard_negatives(df, df["vec_id"] % 10 == 0).collect())) == plain_negatives(rows, 10)
    assert longest and max(longest) == len(rows[0][2])


def test_hard_negatives_of_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [0.9, 0.4]), (2, 2, [0.5, 0.4]), (3, None, [1.0, 1.0]), (4, 1, None), (5, 2, [None, 1.0]), (6, 2, [inf, 1.0]), (7, 2, [nan, 1.0]),
            (8, 1, [0.0, 0.0]), (9, 2, [0.0, 0.0]), (10, 3, [1.0, 2.0, 3.0]), (11, 3, []), (12, 2, [1e30, -1e30]), (None, 2, [0.5, 0.4]), (2, 2, [0.5, 0.4]), (0, 1, [1.0, 0.5])]
    df = hardneg.whole_numbers(spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, label int, vector array<double>, row string, rank string"), "vector", 256)
    q = {tuple(r["vector"]) for r in df.collect() if r["vector"] is not None and r["vec_id"] == 12}
    assert q == {(hardneg.LARGEST, -hardneg.LARGEST)}
    plain = [(r["vec_id"], r["label"], r["vector"]) for r in df.collect() if None not in (r["vec_id"], r["label"], r["vector"])]
    got = sorted(map(tuple, hardneg.hard_negatives(df, df["vec_id"] % 10 == 0).collect()))
    assert got == plain_negatives(plain, 10) and got
    assert hardneg.hard_negatives(df, df["vec_id"] > 100).count() == 0 and hardneg.hard_negatives(df.limit(0), df["vec_id"] == 0).count() == 0


def test_feasible_ranges_lose_no_row():
    rnd = np.random.default_rng(8)
    q = rnd.normal(size=(500, 16))
    q = np.rint(1000 * q / np.sqrt((q ** 2).sum(1))[:, None]).astype(int)
    bucket = hardneg.Bucket(np.arange(500), np.zeros(500, int), q)
    for a in q[:40]:
        scores, length = q @ a, float(np.sqrt((a.astype(float) ** 2).sum()))
        for least in (1.0, 2e5, 5e5, 8e5, float(scores.max())):
            at = bucket.candidates(a, length, np.argsort(-np.abs(a), kind="stable")[:hardneg.FOCUS], least)
            assert set(np.flatnonzero(scores >= least)) <= set(at.tolist())
    assert len(at) < 60
