"""Operators that work row by row on texts."""

import hashlib
import os
import random
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import odd_documents, prose
from trackplate.llm import bpe, langid, linecrf, secrets
from trackplate.llm.lexicon import Lexicon, compile_lexicon

SF = "/root/testdata/sf0.01"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
FILE = public_tokenizers.path("word_bpe_49k.json")
ASSIGN = re.compile("((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def plain_secrets(text):
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    for k, r in enumerate(secrets.MORE):
        out += [(m.start(), m.end(), k + 3) for m in re.finditer(f"({r.head})(?P<body>{r.body})", text) if len(m["body"]) >= r.least]
    return sorted(out, key=lambda x: (x[0], x[2]))


@pytest.fixture(scope="module")
def scanner():
    return secrets.Scanner()


def test_secrets_equal_plain_regexes(scanner):
    rnd = random.Random(3)
    pool = ["password", "Token", "api_key", "SECRET", "=", ":", " ", "'", '"', "abc", "12345678", "AKIA", "ABCDEFGH", "deadbeef" * 4, "é", "\n",
            "ghp_", "a" * 36, "AIza", "xoxb-", "eyJ", ".", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "sk_live_", "-", "ſ", "😀"]
    for _ in range(4000):
        t = "".join(rnd.choices(pool, k=rnd.randint(0, 25)))
        assert scanner.find(t) == plain_secrets(t)


def test_secrets_consumed_text_is_not_matched_again(scanner):
    assert scanner.find("secret=token:abcdefghij") == []
    assert scanner.find("token=tok;secret=abcdefghij") == [(10, 27, 0)]
    assert scanner.find("password=" + "a" * 100_000)[0][:2] == (0, 100_009)


def test_a_rule_that_needs_backtracking_is_refused():
    with pytest.raises(ValueError):
        secrets.Scanner([secrets.Rule("odd", "", "ab(cd)*")])


def test_secrets_of_odd_documents(spark):
    df = secrets.scan(odd_documents(spark))
    rows = {r["doc_id"]: r["spans"] for r in df.collect()}
    assert df.columns.count("spans") == 1 and "size" in df.columns
    assert rows[5] == [] and rows[4] == [] and [tuple(x) for x in rows[13]] == [("assign", 9, 27)]
    assert secrets.scan(odd_documents(spark).limit(0)).count() == 0


def test_lexicon_knows_its_words_only():
    rnd = random.Random(1)
    entries = {bytes(rnd.choices(b"abc\xff", k=rnd.randint(1, 6))): [rnd.randrange(99) for _ in range(rnd.randint(0, 4))] for _ in range(300)}
    lex = Lexicon(compile_lexicon(sorted(entries.items())))
    for w in [*entries, b"", b"zzz", b"abcabcabc"]:
        assert lex.get(w) == entries.get(w)
    chain = Lexicon(compile_lexicon([(x + b"ing", [1]) for x in (b"a", b"b", b"c")]))
    assert len(chain.first) - 1 == 5                    # one shared suffix: root, i, n, g, end
    assert Lexicon(compile_lexicon([])).get(b"a") is None


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def texts():
    rnd = random.Random(5)
    pool = [*"abXYZ \t\n\x1c\x1f\x85\xa0'sdmtrel09½①éÉßİΣς漢😀ǅﬁ\x00", "<|endoftext|>", "'ll", " the ", "́"]
    return ["".join(rnd.choices(pool, k=rnd.randint(0, 50))) for _ in range(1500)] + ["a" * 3000, "", "  ", prose(1, 500)]


def test_bpe_equals_the_library(library):
    vocab = bpe.Vocabulary.read(FILE)
    lex = Lexicon(compile_lexicon((w, vocab.merge(w)) for w in sorted({b"the", b"of", "é".encode(), b"abe"})))
    enc = bpe.Encoder(vocab, lex)
    for t, want in zip(texts(), library.encode_batch(texts(), add_special_tokens=False)):
        ids = [i for c in bpe.chunks(t) for i in enc.ids(c)]
        assert ids == want.ids and enc.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_both_ways_of_merging_agree():
    vocab, rnd = bpe.Vocabulary.read(FILE), random.Random(2)
    for _ in range(500):
        ids = [vocab.inner[b] for b in bytes(rnd.choices(b"aeinorst", k=rnd.randint(1, 40)))]
        assert vocab._merge_short(list(ids)) == vocab._merge_long(list(ids))


def test_bpe_of_odd_documents(spark, library):
    df = odd_documents(spark)
    want = {(r["doc_id"], r["text"]): library.encode(r["text"] or "", add_special_tokens=False).ids for r in df.collect()}
    for r in bpe.encode(df, FILE).collect():
        assert r["token_ids"] == want[r["doc_id"], r["text"]]
    for r in bpe.encode_digests(df, FILE).collect():
        ids = want[r["doc_id"], r["text"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode(df.limit(0), FILE).count() == 0


def test_language_pieces_do_not_change_scores(monkeypatch):
    model = langid.Model(["a", "b"], __import__("numpy").log([0.5, 0.5]), __import__("numpy").random.default_rng(1).normal(size=(2, langid.BUCKETS + 1)))
    model.weights[:, -1] = 0
    long = langid.fold(prose(1, 3000))
    whole = model.scores([long, " ab "])
    monkeypatch.setattr(langid, "PIECE", 100)
    assert abs(model.scores([long, " ab "]) - whole).max() < 1e-6


def test_language_of_odd_documents(spark):
    df = odd_documents(spark)
    out = langid.identify(df, langid.train(df))
    rows = {r["doc_id"]: r for r in out.collect()}
    assert len(rows) == out.select("doc_id").distinct().count() and out.count() == df.count()
    assert rows[5]["lang_pred"] == rows[4]["lang_pred"] == rows[14]["lang_pred"] == "und" and rows[5]["score"] == 0
    assert rows[1]["lang_pred"] in ("en", "fr") and all(0 <= r["score"] <= 1 for r in rows.values())
    empty = langid.train(df.limit(0))
    assert {r["lang_pred"] for r in langid.identify(df, empty).collect()} == {"und"}


def plain_language(train, text, width):
    """(language, posterior) by counting grams one at a time."""
    import math

    import numpy as np

    def grams_of(t):
        t = langid.fold(t)
        return [int(langid.buckets(np.array([ord(c) for c in t[k:k + n]], np.uint32), n)[0]) % width
                for n in langid.ORDERS for k in range(len(t) - n + 1)]

    counts, docs = {}, {}
    for t, lang in train:
        if lang is not None and langid.fold(t):
            docs[lang] = docs.get(lang, 0) + 1
            c = counts.setdefault(lang, [0] * width)
            for g in grams_of(t):
                c[g] += 1
    if not langid.fold(text):
        return "und", 0.0
    found = grams_of(text)
    score = {x: math.log(docs[x] / sum(docs.values())) + sum(math.log((c[g] + langid.ALPHA) / (sum(c) + langid.ALPHA * width)) for g in found)
             for x, c in counts.items()}
    best = max(score.values())
    return min(x for x, v in score.items() if v > best - 1e-3), 1 / sum(math.exp(v - best) for v in score.values())


@pytest.mark.parametrize("cells", [1 << 23, 4 * 4096])
def test_languages_equal_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(langid, "CELLS", cells)
    rows = [(k, prose(k % 3 + 1, 40) + f" {'xyz'[k % 3] * 4}", ["fr", "en", None, "de"][k % 4]) for k in range(16)] + [(16, None, "en"), (17, "12", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    assert model.weights.shape[1] - 1 == langid.width_for(3) <= cells // 3
    for r in langid.identify(df, model).collect():
        lang, p = plain_language([x[1:] for x in rows], r["text"], langid.width_for(3))
        assert r["lang_pred"] == lang and abs(r["score"] - p) < 1e-2


def test_three_hundred_languages(spark):
    rows = [(k, f"{chr(0x4e00 + k % 300) * 3} {chr(0x5e00 + k % 300) * 2}", f"l{k % 300:03}") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    assert len(model.names) == 300 and model.weights.shape == (300, langid.BUCKETS // 2 + 1)
    assert langid.identify(df, model).where("lang_pred = lang").count() == 600


@given
def test_language_on_held_out_documents(spark):
    from trackplate import llm

    df = llm.queries()["op7_language_id"](spark, SF).where("held_out")
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    right = df.join(truth, "doc_id").selectExpr("avg(int(lang = lang_pred)) as a").first()["a"]
    assert right > 0.98


def test_chain_marginals_equal_enumeration():
    import itertools

    import numpy as np

    chain = linecrf.Chain(np.array([1.0, -2.0]), np.array([[0.5, -0.2], [0.1, 0.7]]))
    x, per = np.random.default_rng(0).normal(size=(7, 2)), np.array([4, 1, 2])
    good, _ = chain._run(x, per)
    at = 0
    for n in per:
        own, total, marg = x[at:at + n], 0.0, np.zeros(n)
        for path in itertools.product((0, 1), repeat=int(n)):
            e = sum(own[k] @ chain.weights * y for k, y in enumerate(path)) + sum(chain.moves[a, b] for a, b in zip(path, path[1:]))
            total += np.exp(e)
            marg += np.exp(e) * np.array(path)
        assert np.allclose(good[at:at + n], marg / total)
        at += n


def test_quality_of_odd_documents(spark):
    df = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1), (3, 1), (12, 0), (7, None), (None, 1), (10, 1), (10, 0), (2, 1), (14, 0)], "doc_id long, quality int")
    out = linecrf.quality(df, linecrf.train(df, labels))
    rows = out.collect()
    assert len(rows) == df.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert {r["score"] for r in linecrf.quality(df, linecrf.train(df, labels.limit(0))).collect()} == {0.5}


def test_fit_takes_one_row_of_a_repeated_id(spark):
    import numpy as np

    rows = [(1, "b"), (1, "a good line"), (1, "b"), (2, "x $$ %%"), (None, "y")]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    some = linecrf.train(spark.createDataFrame(rows * 50, "doc_id long, text string"), labels)
    once = linecrf.train(spark.createDataFrame([(1, "a good line"), (2, "x $$ %%")], "doc_id long, text string"), labels)
    assert np.allclose(some.weights, once.weights) and np.allclose(some.moves, once.moves)


@given
def test_quality_on_held_out_documents(spark):
    from trackplate import llm

    df = llm.queries()["op9_line_quality"](spark, SF).where("held_out")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    assert df.join(labels, "doc_id").selectExpr("avg(int(quality = predicted)) as a").first()["a"] > 0.93
