"""Operators that compare rows, against brute force on small tables."""

import os
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from tests.llm.helpers import components, odd_documents, prose, words
from trackplate.llm import hostrules, jaccard, linededup, mixing, vectordup, warc
from trackplate.llm.common import with_twin

SF = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def shingles(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k:k + 5]) for k in range(len(w) - 4)])


def changed(text, every, mark):
    w = text.split(" ")
    return " ".join(f"{mark}{k}" if k % every == every - 1 else x for k, x in enumerate(w))


def family(n):
    """Texts of many sizes with near copies around the limit."""
    out = []
    for k in range(n):
        base = prose(100 + k, [6, 9, 12, 20, 35, 60, 150, 400][k % 8])
        out += [base, base + " tail", changed(base, 40, "x"), changed(base, 25, "y"), base.upper(), prose(100 + k, 5) + " " + base]
    return out


def test_jaccard_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SALT_ROWS", 3)                # every list of some length is split
    texts = family(24)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a, b in combinations(range(len(texts)), 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(range(len(texts)), links)
    rows = jaccard.jaccard_components(df).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == want and len(set(want.values())) < len(texts)
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) for r in rows)


def test_jaccard_join_of_odd_documents(spark):
    df = odd_documents(spark)
    rows = jaccard.jaccard_components(df).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == df.count() and got[None]["component_id"] is None
    assert got[2]["component_id"] == 1 and got[8]["component_id"] == got[9]["component_id"] == 7 and got[11]["component_id"] == 3
    assert got[4]["component_id"] == 4 and got[5]["n_shingles"] == 0 and got[6]["component_id"] == 6
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


def test_parities_bound_the_difference():
    rnd = np.random.default_rng(1)
    for n in (1, 300, 700, 3000):
        a = np.unique(rnd.integers(0, 2 ** 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 9:], rnd.integers(0, 2 ** 63, n // 9).astype(np.uint64)]))
        import pandas as pd

        one = lambda x: pd.Series([x])
        assert jaccard.may_be_similar(one(jaccard.parities(a)), one(jaccard.parities(b)), one(len(a)), one(len(b)))[0]


def test_shingles_keep_few_words_and_take_slices():
    """A task holds a bounded number of words and of texts, whatever a batch brings."""
    import pyarrow as pa

    memo = jaccard.WordHash()
    a = jaccard.shingle_set(" ".join(f"w{i}" for i in range(jaccard.MEMO + 100)), memo)
    assert len(memo) <= jaccard.MEMO and (a == jaccard.shingle_set(" ".join(f"w{i}" for i in range(jaccard.MEMO + 100)), jaccard.WordHash())).all()
    got = [b.num_rows for b in jaccard.slices(iter([pa.RecordBatch.from_pydict({"t": [str(k) for k in range(1300)]})]))]
    assert sum(got) == 1300 and max(got) <= jaccard.SLICE


def plain_dedup(rows):
    """Lines that stay, by definition: no earlier line has a word set of similarity 4/5."""
    lines = [(i, k, frozenset(words(t.lower()))) for i, text in rows for k, t in enumerate((text or "").split("\n"))]
    lines = sorted((x for x in lines if x[2]), key=lambda x: x[:2])
    return {(i, k) for n, (i, k, s) in enumerate(lines) if not any(9 * len(s & o) >= 4 * (len(s) + len(o)) for _, _, o in lines[:n])}


def test_line_dedup_equals_definition(spark):
    rows = [(k, t) for k, t in enumerate(family(8))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in linededup.kept_lines(df).collect()} == plain_dedup(rows)


def test_near_copies_of_a_line_meet_their_first_one(spark, monkeypatch):
    """A group of near copies takes a few comparisons per member, not one per pair of members."""
    rows = [(k, " ".join(f"word{i}" for i in range(40) if i != k % 30) + f" own{k}") for k in range(60)] + [(60 + k, prose(k, 40)) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made, write = [], linededup.written
    monkeypatch.setattr(linededup, "written", lambda t, name: (made.append(w.count() if name in ("line-led", "line-pairs") else 0), w)[1] if (w := write(t, name)) else w)
    assert {tuple(r) for r in linededup.kept_lines(df).collect()} == plain_dedup(rows)
    assert sum(made) < 8 * len(rows)


def test_white_space_of_lines(spark):
    rows = [(0, "a\tb\x0bc\x0cd e"), (1, "A b\r c  d\te\r\nf \xa0 g h i"), (2, "\t \r\n\x0b"), (3, "f\t\xa0\x0bg h i x\ny")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in linededup.kept_lines(df).collect()} == plain_dedup(rows)


def test_line_dedup_of_rows_that_share_an_id(spark):
    """Rows of one id, or of none, keep each their own lines: nothing found once is lost, nothing found twice stays."""
    lone = "found nowhere else at all"
    rows = [(1, prose(40, 60)), (7, prose(40, 60) + "\n" + prose(41, 50)), (7, lone), (7, lone), (7, ""), (7, None), (None, prose(42, 60)), (None, prose(41, 50) + "\nown line of a nameless row"),
            (None, None), (None, "line of a row without a name"), (3, prose(42, 60).upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    named = {}
    for r in with_twin(df, "doc_id", "text", "twin").collect():
        named.setdefault((r["doc_id"] is not None, r["doc_id"] or 0, r["twin"]), r["text"])
    texts = [named[k] for k in sorted(named)]
    keep = plain_dedup(list(enumerate(texts)))
    want = {t: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) in keep or not x.strip()) for i, t in enumerate(texts)}
    got = linededup.dedup_lines(df).collect()
    by_id = sorted(repr((r["doc_id"], r["text"])) for r in got)
    assert by_id == sorted(repr((i, want[t])) for i, t in rows)
    assert sum(r["n_removed"] for r in got) > 5 and [r["text"] for r in got if r["doc_id"] == 7].count(lone) == 2



def test_line_dedup_of_odd_documents(spark):
    df = odd_documents(spark)
    out = linededup.dedup_lines(df)
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == df.count() and set(df.columns) <= set(out.columns)
    assert got[5]["text"] is None and got[4]["text"] == "" and got[6]["text"] == " \n\t \n"
    assert got[12]["text"] == "same line again" and got[12]["n_removed"] == 39
    assert got[8]["text"] == "" and got[7]["text"] == "one two"
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def plain_repeats(w):
    windows = defaultdict(list)
    for k in range(len(w) - 2):
        windows[tuple(w[k:k + 3])].append(k)
    return len({k + d for at in windows.values() if len(at) > 1 for k in at for d in range(3)})


def test_host_rules_of_odd_documents(spark):
    df = odd_documents(spark)
    rows = hostrules.judge(df).collect()
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    assert len(rows) == df.count()
    for r in rows:
        w = words(texts[r["doc_id"]])
        assert r["n_words"] == len(w) and r["word_chars"] == sum(map(len, w)) and r["n_repeat_words"] == plain_repeats(w)
        assert r["base_failed"] == (len(w) < 50 or 100 * plain_repeats(w) > 50 * len(w)) and not (r["kept"] and r["base_failed"])
    assert hostrules.judge(df.limit(0)).count() == 0


def test_bad_hosts_bind_their_documents(spark):
    junk = " ".join(f"w{k}$$" for k in range(80))
    rows = [(k, junk if k % 10 else prose(k, 90), "bad") for k in range(60)] + [(100 + k, prose(k, 90), "good") for k in range(60)] + [(300, junk, "good")]
    got = {r["doc_id"]: r["kept"] for r in hostrules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[1] and got[0] and got[300] and got[100]


def plain_verdicts(rows):
    """{doc_id: kept} of (doc_id, text, source), by the rules as they are written."""
    def failed(t):
        w, lines = words(t), [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\f\r")]
        chars, rep = sum(map(len, w)), plain_repeats(w)
        return {"symbols": 10 * sum(c in "#*$%&|<>" for c in t or "") > len(w), "word_length": chars < 3 * len(w) or chars > 12 * len(w),
                "dup_lines": 10 * (len(lines) - len(set(lines))) > 3 * len(lines), "repeats": 100 * rep > 30 * len(w),
                "base": len(w) < 50 or 100 * rep > 50 * len(w)}
    fails = {i: failed(t) for i, t, _ in rows}
    hosts, binds = {s for _, _, s in rows}, {}
    for name in hostrules.RATED:
        n = {h: [fails[i][name] for i, _, s in rows if s == h] for h in hosts}
        rates = [sum(v) / len(v) for v in n.values()]
        mean, var = np.mean(rates), np.var(rates)
        strength = min(1000, max(2, mean * (1 - mean) / var - 1)) if var > 0 else 1000
        limit = min(hostrules.HOST_LIMIT, mean + hostrules.HOST_SPREADS * np.sqrt(mean * (1 - mean) / (strength + 1)))
        for h, v in n.items():
            binds[h, name] = (sum(v) + mean * strength) / (len(v) + strength) > limit
    return {i: not fails[i]["base"] and not any(fails[i][r] and (binds[s, r] or binds[s, "base"]) for r in hostrules.RULES) for i, _, s in rows}


def test_mixed_hosts_equal_brute_force(spark):
    signs = lambda k, n: " ".join(f"w{k}x{j}$$" for j in range(n))
    longish = lambda k, n: " ".join(f"averylongword{k}x{j}" for j in range(n))
    rows = []
    for h in range(12):
        for j in range(40):
            k = 1000 * h + j
            text = prose(k, 90)
            if j < (14 if h == 0 else 1 + h % 2):
                text = signs(k, 80)                      # host 0 fails the rule of symbols far more often than the rest
            elif j < (30 if h == 1 else 2):
                text = prose(k, 20)                      # host 1 fails the base rules
            elif j == 39:
                text = longish(k, 70)                    # one soft failure on every host
            rows.append((k, text, None if h == 11 else f"host{h}"))
    got = {r["doc_id"]: r["kept"] for r in hostrules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == plain_verdicts(rows)
    assert not got[0] and got[39]                        # on host 0 the symbols bind, the long words do not
    assert not got[1039] and got[1035]                   # host 1 is bad as a whole: its soft failures go, its clean texts stay
    assert got[2000] and got[2039]                       # elsewhere a soft failure alone decides nothing


def test_repeated_windows_of_a_long_text(spark):
    text = " ".join(f"w{k}" for k in range(200_000)) + " w5 w6 w7"
    row = hostrules.document_counts(spark.createDataFrame([(text,)], "text string")).first()
    assert row["n_words"] == 200_003 and row["n_repeat_words"] == 6


def plain_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > 2 * sizes[s]}
        if not full:
            return target | {s: level * w[s] for s in open_}
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return target


def test_mixing_of_odd_documents(spark):
    df = odd_documents(spark)
    rows = mixing.mix(df).collect()
    texts = [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    sizes = Counter()
    for _, t, s in texts:
        sizes[s] += len(words(t))
    want, taken = plain_targets(sizes), Counter()
    by_source = {r["source"]: r for r in rows}
    assert len(rows) == len(texts)
    for r in rows:
        assert r["size"] == len(words(r["text"])) and 0 <= r["taken"] <= 2 * r["size"] and abs(r["target"] - want[r["source"]]) < 1e-6
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 2 for s in by_source)
    assert sorted((r["doc_id"] or -1, r["taken"]) for r in rows) == sorted((r["doc_id"] or -1, r["taken"]) for r in mixing.mix(df).collect())
    copies = mixing.repeated(mixing.mix(df)).collect()
    assert sum(len(words(r["text"])) for r in copies) == sum(taken.values())
    assert mixing.mix(df.limit(0)).count() == 0


def plain_links(vectors, least=0.95):
    ok = {i: np.array(v, float) for i, v in vectors.items() if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    return [(a, b) for a, b in combinations(sorted(ok), 2) if len(ok[a]) == len(ok[b])
            and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= least]


def test_near_vectors_of_odd_rows(spark):
    rnd = np.random.default_rng(4)
    base = rnd.normal(size=(12, 16))
    vectors = {k: (base[k % 12] + rnd.normal(size=16) * 0.05 * (k // 12)).tolist() for k in range(48)}
    vectors |= {50: None, 51: [], 52: [0.0] * 16, 53: [float("nan")] * 16, 54: [None] * 16, 55: [1.0] * 4, 56: [2.0] * 4, 57: vectors[3], 58: vectors[3]}
    df = spark.createDataFrame([(k, v, 1) for k, v in vectors.items()], "vec_id long, embedding array<float>, n_links int")
    links = plain_links({k: v and [None if x is None else float(np.float32(x)) for x in v] for k, v in vectors.items()})
    want, count = components(vectors, links), Counter(x for pair in links for x in pair)
    for r in vectordup.near_vectors(df).collect():
        assert (r["n_links"], r["component_id"], r["kept"]) == (count[r["vec_id"]], want[r["vec_id"]], want[r["vec_id"]] == r["vec_id"])
    assert vectordup.near_vectors(df.limit(0)).count() == 0


def test_near_vector_recall_in_a_large_group(spark):
    """A group wider than the window, and scattered pairs near the limit."""
    rnd = np.random.default_rng(5)
    hub = rnd.normal(size=32)
    x = np.concatenate([hub + rnd.normal(size=(900, 32)) * 0.12, rnd.normal(size=(3000, 32))])
    x = np.concatenate([x, x[1000:1400] + rnd.normal(size=(400, 32)) * 0.2]).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    truth = ((u @ u.T >= 0.95).sum(1) - 1).sum()
    found = vectordup.near_vectors(df).selectExpr("sum(n_links) as n").first()["n"]
    assert 0.95 * truth <= found <= truth


def test_near_vector_recall_does_not_hang_on_the_partitions(spark):
    """Many more partitions than rows need; strips shorter than the table."""
    rnd = np.random.default_rng(5)
    x = np.concatenate([rnd.normal(size=32) + rnd.normal(size=(50, 32)) * 0.12, rnd.normal(size=(450, 32))]).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    links = plain_links({k: v.tolist() for k, v in enumerate(x)})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        found = vectordup.near_vectors(df).selectExpr("sum(n_links) as n").first()["n"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(links) > 1000 and 0.98 * 2 * len(links) <= found <= 2 * len(links)


def test_near_vectors_meet_across_strips(spark, monkeypatch):
    """Neighbours on two sides of a strip's border are compared once, copies not with each other."""
    monkeypatch.setattr(vectordup, "STRIP", 8)
    rnd = np.random.default_rng(6)
    x = rnd.normal(size=16) + rnd.normal(size=(40, 16)) * 0.01
    classes = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "c long, v array<double>, m long").selectExpr("*", "array(-1L, -1L) as runs")
    rows = spark.createDataFrame([(16, k // 20, k, k % 20, k) for k in range(40)], "dim int, pass int, code long, c long, pos long")
    pairs = sorted((r["a"], r["b"]) for r in vectordup.window_pairs(rows, classes, window=5).collect())
    assert pairs == [(a, b) for a in range(20) for b in range(a + 1, min(a + 6, 20))]


def test_near_vector_recall_in_a_group_of_thousands(spark):
    """A group many times the window, some rows of it twice, is linked as a whole."""
    rnd = np.random.default_rng(5)
    x = np.concatenate([rnd.normal(size=32) + rnd.normal(size=(3000, 32)) * 0.12, rnd.normal(size=(5000, 32))]).astype(np.float32)
    x = np.concatenate([x, x[:40]])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = (u @ u.T >= 0.95).sum(1) - 1
    got = vectordup.near_vectors(df).collect()
    assert all(r["n_links"] <= links[r["vec_id"]] for r in got)
    assert sum(r["n_links"] for r in got) >= 0.99 * links.sum()
    assert {r["component_id"] for r in got if r["vec_id"] < 3000 and links[r["vec_id"]]} == {0}


def test_links_of_blocks_count_once():
    """Every pair of a run in one block pair, and in the first pass whose run it shares."""
    rnd = np.random.default_rng(8)
    x = rnd.normal(size=(6, 12))[rnd.integers(0, 6, 700)] + rnd.normal(size=(700, 12)) * 0.1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, m = rnd.permutation(700).astype(np.int64), rnd.integers(1, 4, 700)
    runs = np.stack([rnd.integers(-1, 2, 700), np.zeros(700, int)], 1)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    near &= ~((runs[:, :1] == runs[:, 0]) & (runs[:, :1] >= 0))
    cut, got, edges = [np.arange(0, 300), np.arange(300, 700)], Counter(), []
    for p, q in ((0, 0), (0, 1), (1, 1)):
        for c, root, others in zip(*vectordup.block_links(ids, m, x, runs, 1, cut[p], cut[q])):
            got[c] += others
            edges.append((c, root))
    want = near @ m
    assert got == Counter({ids[k]: n for k, n in enumerate(want) if n})
    assert components(ids, edges) == components(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(near))])


def test_loser_tree_merges_runs():
    rnd = np.random.default_rng(0)
    for k in (0, 1, 2, 3, 7, 16, 33):
        runs = [sorted((int(v), i) for i, v in enumerate(rnd.integers(0, 50, rnd.integers(0, 30)))) for _ in range(k)]
        assert [x for _, x in warc.LoserTree([iter(r) for r in runs])] == sorted(x for r in runs for x in r)


def test_archives_of_odd_pages(spark):
    big = "é" * 600
    rows = [(1, "http://www.B.com/x?Q=1", big), (5, "https://b.com:8080/", big), (3, None, big), (4, "no url\r\nat all", "a\r\n\r\nb"), (6, "http://a.org", None),
            (7, "http://a.org", ""), (8, "http://[", "small"), (9, "http://a.org", "small"), (None, "http://a.org", big), (5, "https://b.com:8080/", big)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, value string")
    out = warc.archive_round_trip(df)
    got = out.collect()
    keys = [(r["url_key"], r["captured"], r["page_id"] or -1) for r in got]
    assert len(got) == len(rows) and keys == sorted(keys)
    by = {r["page_id"]: r for r in got}
    assert by[5]["record_type"] == "response" and by[1]["refers_to"] == by[3]["refers_to"] == by[None]["refers_to"] == 5
    assert by[1]["payload_bytes"] == 1200 and by[1]["payload_digest"] == by[5]["payload_digest"] and by[4]["payload_bytes"] == 6
    assert by[6]["payload_bytes"] == 0 and by[8]["record_type"] == by[9]["record_type"] == "response" and by[1]["url_key"] == "com,b)/x?q=1"
    assert warc.archive_round_trip(df.limit(0)).count() == 0


@given
@pytest.mark.parametrize("name", ["op2_line_dedup", "op3_host_rules", "op6_warc_merge", "op8_source_mix"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    from trackplate import llm

    db = duckdb.connect()
    for f in os.listdir(SF):
        db.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df, rel = llm.queries()[name](spark, SF), db.sql(llm.oracles()[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    pick = lambda rows, names: sorted(repr([r[names.index(c)] for c in cols]) for r in rows)
    assert pick([tuple(r) for r in df.collect()], df.columns) == pick(rel.fetchall(), rel.columns)
