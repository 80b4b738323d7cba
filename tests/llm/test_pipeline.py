"""The corpus pipeline's stages on a table with odd rows."""

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import odd_documents, prose, words
from trackplate.llm import bpe, mixing
from trackplate.llm.catalog import vocabulary_file


def test_stages_keep_columns_and_whole_texts(spark):
    docs = odd_documents(spark).cache()
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "").cache()
        if name != "bpe":
            assert out.columns == columns and out.dtypes == docs.dtypes
        if name == "language_id":
            assert {r["doc_id"] for r in out.collect()} == {1, 2, 3, 7, 8, 9, 10, 11, 12, None, 13, 15}
        if name == "line_dedup":
            assert out.count() == docs.count()
        docs = out
    rows = docs.collect()
    assert rows and all(r["n_tokens"] == len(r["token_ids"]) and (words(r["text"]) or not r["token_ids"]) for r in rows)


def test_one_document_of_a_group_stays(spark):
    ids = [r["doc_id"] for r in corpus_pipeline.near_copies(spark, odd_documents(spark), "").collect()]
    assert sorted(ids, key=lambda i: i or -1) == [None, 1, 3, 4, 5, 6, 7, 10, 12, 13, 14, 15]


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    """Only near copies go, whatever ids they share; of equal rows one stays."""
    base = prose(50, 200)
    rows = [(1, base), (7, base + " word"), (7, prose(51, 200)), (7, prose(51, 200)), (None, base + " other"), (None, prose(52, 200)), (None, None), (4, prose(52, 200) + " tail"), (9, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(repr((r["doc_id"], r["text"])) for r in corpus_pipeline.near_copies(spark, df, "").collect())
    assert got == sorted(map(repr, [(1, base), (7, prose(51, 200)), (4, prose(52, 200) + " tail"), (None, None), (9, "")]))


def test_mixture_keeps_texts_whole(spark):
    """Every copy has the document's own text; each source's words are within half a document of its target."""
    docs = odd_documents(spark)
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["source"], set()).add((r["doc_id"], r["text"]))
    target = {r["source"]: r["target"] for r in mixing.mix(docs.select("doc_id", "text", "source")).collect()}
    got = dict.fromkeys(target, 0)
    for r in corpus_pipeline.mixture(spark, docs, "").collect():
        assert (r["doc_id"], r["text"]) in texts[r["source"]]
        got[r["source"]] += len(words(r["text"]))
    for s, n in got.items():
        assert abs(n - target[s]) <= max(len(words(t)) for _, t in texts[s]) / 2 + 1


def test_last_stage_decodes(spark):
    """Each row carries the text its ids decode to, as the operator's digest has it."""
    docs = odd_documents(spark).select("doc_id", "text")
    got = corpus_pipeline.encoded(spark, docs, "").select("text", F.sha2("decoded", 256).alias("h"), "n_tokens")
    want = bpe.encode_digests(docs, vocabulary_file()).select("text", "decoded_sha256", "n_tokens")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))


def test_empty_table(spark):
    docs = odd_documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
