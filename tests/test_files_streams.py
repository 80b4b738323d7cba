"""Inventories, reuse, sources, sinks and streams."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from trackplate.operators import files
from trackplate.sources import files as file_source
from trackplate.sources import scores, sessions, sinks, tracks
from trackplate.streaming import jobs


def test_reuse_cases(spark):
    inv = spark.createDataFrame([("f", "a", 1, 1.0), ("f", "b", 2, 1.0), ("f", "new", 3, 1.0), ("g", "a", 1, 1.0)], "folder string, rel string, size long, mtime double")
    cols = "folder string, rel string, run_id int, written long, digest string, reusable boolean, has_covered boolean, size long, mtime double, covered boolean, errored boolean"
    rows = [("f", "a", 1, 10, "d", True, True, 1, 1.001, True, False), ("f", "b", 1, 10, "d", True, True, 9, 1.0, True, False),
            ("f", "b", 2, 20, "d", True, True, 9, 1.0, True, False),                 # newest, but no hit
            ("f", "b", 3, 30, "other", True, True, 2, 1.0, True, False), ("f", "b", 4, 40, "d", True, False, 2, 1.0, True, False),
            ("g", "a", 1, 10, "d", False, True, 1, 1.0, True, False)]
    got = {(r.folder, r.rel): r.run_id for r in files.reuse_plan(inv, spark.createDataFrame(rows, cols), F.lit("d")).collect()}
    assert got == {("f", "a"): 1, ("f", "b"): None, ("f", "new"): None, ("g", "a"): None}


def test_digest_ignores_prose_and_alpha(spark):
    def of(settings, tag="a"):
        return spark.createDataFrame([(settings,)], "m map<string,string>").select(files.row_digest(F.col("m"), tag)).first()[0]

    base = {"_README": "x", "overlap": "0.3", "rescore_alpha": "0.0", "ref": "0.5"}
    assert of(base) == of({**base, "_README": "y", "rescore_alpha": "1.0", "overlap": "0.30000000001"})
    assert len({of(base), of({**base, "ref": "0.6"}), of({**base, "new": "1"}), of(base, "b")}) == 4


def test_retention_tiers(spark):
    now, day = 10_000_000, 86400
    rows = [("old", 100, now - 40 * day, True, now - day, False), ("t1", 50, now - 3 * day, False, None, True), ("t2", 50, now - 2 * day, False, None, True),
            ("k1", 70, now - day, True, now - 9, False), ("k2", 70, now - day, True, now - 5, False), ("un", 70, now - 60 * day, False, None, False)]
    df = spark.createDataFrame(rows, "relative_path string, size_bytes long, mtime long, acked boolean, acked_at long, in_trash boolean")
    for target, want in ((0, {"old"}), (101, {"old", "t1"}), (151, {"old", "t1", "t2"}), (201, {"old", "t1", "t2", "k1"}), (10**9, {"old", "t1", "t2", "k1", "k2"})):
        assert {r.relative_path for r in files.retention_list(df, now, 0, target).collect()} == want
    assert {r.relative_path for r in files.expired_trash(df, now, 2.5).collect()} == {"t1"}
    young = df.where("relative_path <> 'old'")
    assert files.retention_list(young, now, 500, 10**9, minimum=500).count() == 0 and files.retention_list(young, now, 499, 10**9, minimum=500).count() == 4


def test_names_and_reusability(spark):
    s = spark.createDataFrame([("abcdefgh", "E:1"), ("zyxwvuts", "E/1"), ("q", None)], "session_id string, experiment_name string")
    assert {r.session_id: r.folder for r in files.session_names(s).collect()} == {"abcdefgh": "E_1 (abcdef)", "zyxwvuts": "E_1 (zyxwvu)", "q": "q"}
    im = spark.createDataFrame([("r", "a", "x", True), ("r", "b", "x", True), ("r", "b", "x", False), ("r", "c", "y", False), ("r", "d", "z", True)], "run_id string, folder string, base_name string, covered boolean")
    fo = spark.createDataFrame([("r", "a", "n1", 0.0, 1), ("r", "b", "n2", 0.0, 2), ("r", "c", "n3", 0.0, 3), ("r", "d", "n1", 0.0, 4)], "run_id string, folder string, name string, tp double, seq int")
    got = {r.folder: r.reason for r in files.reusability(im, fo).collect()}
    assert got == {"a": None, "b": "duplicate filename", "c": "uncovered images", "d": "repeated name and timepoint"}


def test_file_scan_and_hash(spark, tmp_path):
    for name in ("a.PNG", "p/b.tif", "c/p/d.jpg", "c/p/q/deep.png", "_out/x.png", ".hid/x.png", "p/n.txt", "p/b.tif.sha256"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(name.encode())
    got = {r.relative_path for r in file_source.scan_files(spark, str(tmp_path)).collect()}
    assert got == {"a.PNG", "p/b.tif", "c/p/d.jpg"}
    plan = file_source.scan_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    h = {r.relative_path: r.sha256 for r in file_source.hash_files(spark, str(tmp_path)).collect()}
    assert h["p/b.tif"] == hashlib.sha256(b"p/b.tif").hexdigest() and "p/b.tif.sha256" not in h


def test_sessions_and_scores(spark, tmp_path):
    doc = {"id": "s1", "name": "E", "assay_mode": "survival", "plates": [{"id": "p", "condition_id": "0J", "name": "st", "plate_number": 3, "condition_name": None}]}
    (tmp_path / "s1.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "bad.json").write_text("{nope")
    r = sessions.read_sessions(spark, str(tmp_path)).collect()
    assert [(x.session_id, x.folder_name, x.condition_name) for x in r] == [("s1", "0J_st_plate03", "st 0J")]
    csv = tmp_path / "soft.csv"
    csv.write_text("folder,timepoint_h,image,hard_call,raw_L1,raw_L2\nf,0,i.png,L1,0.5,0.25\nf,0,i.png\n")
    r = scores.read_soft_scores(spark, str(csv)).collect()
    assert len(r) == 1 and r[0].raw == {"L1": 0.5, "L2": 0.25}
    assert scores.soft_scores(spark.createDataFrame([("a",)], "folder string")) is None


def test_tracks_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("v", 1, 0, float("nan"), 1.0), ("v", 1, 1, float("inf"), 2.0)], "video_id string, track_id long, frame long, x double, y double")
    df.write.parquet(str(tmp_path / "t"))
    t = tracks.read_tracks(spark, str(tmp_path / "t"))
    assert t.where("x is not null").count() == 0 and "has_skeleton" in t.columns
    assert tracks.clean_tracks(df.drop("x"), tracks.POINTS_NEEDED, tracks.POINTS_OPTIONAL).count() == 0
    rows = spark.createDataFrame([("c", 1.23456), ("d", 2.0)], "condition string, v double")
    out = sinks.write_results({"per": rows}, str(tmp_path / "runs"), "r1", {"k": "v"}, {"per": ["condition"]})
    assert {r.v for r in spark.read.parquet(f"{out}/per").collect()} == {1.2346, 2.0}
    with pytest.raises(AnalysisException):
        sinks.write_results({"per": rows}, str(tmp_path / "runs"), "r1")


def test_result_sets_keep_order_and_counts(spark, tmp_path):
    rows = spark.createDataFrame([("hot" if k % 3 else "c", (k * 7919) % 5000, k) for k in range(5000)], "condition string, v long, k long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")      # so that a small table has several files
    try:
        out = sinks.write_results({"per": rows, "other": rows.limit(0)}, str(tmp_path / "runs"), "r2", {"reused": "3"}, {"per": ["condition"]}, {"per": [F.desc("v")]})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = spark.read.parquet(f"{out}/per").where("condition = 'hot'").select("v", F.input_file_name().alias("f")).toPandas()
    assert back.f.nunique() > 1 and sorted(back.v) == sorted((k * 7919) % 5000 for k in range(5000) if k % 3)
    spans = sorted((g.v.min(), g.v.max(), g.v.is_monotonic_decreasing) for _, g in back.groupby("f"))
    assert all(d for *_, d in spans) and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert {(r.name, r.n_rows, r.settings["reused"]) for r in sinks.provenance(spark, out).collect()} == {("per", 5000, "3"), ("other", 0, "3")}


def test_sheet_names_of_repeats(spark):
    names = ["a/b", "a:b", None, "x" * 40, "x" * 31 + "tail", "", "a_b"] + ["x" * 35] * 10
    d = spark.createDataFrame(list(enumerate(names)), "i long, name string")
    got = {r.i: r.sheet for r in files.sheet_names(d, "name", ["i"]).collect()}
    assert [got[k] for k in range(7)] == ["a_b", "a_b_2", None, "x" * 31, "x" * 29 + "_2", "", "a_b_3"]
    assert got[16] == "x" * 28 + "_12" and files.sheet_names(d.limit(0), "name", ["i"]).count() == 0


def test_stream_ingest_is_idempotent(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    schema = "relative_path string, sha256 string, content string, size_bytes long"

    def add(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / name))

    def go():
        s = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(src))
        jobs.finish(jobs.ingest_stream(s, out, f"{out}/_state"))

    sha = hashlib.sha256(b"x").hexdigest()
    add("one", [("a", sha, "x", 1), ("b", "0" * 64, "x", 1), ("c", None, "x", 1)])
    go()
    add("two", [("a", sha, "x", 1), ("d", sha.upper(), "x", 1), ("d", sha.upper(), "x", 1)])
    go()
    go()
    assert sorted(r.relative_path for r in spark.read.parquet(f"{out}/landed").collect()) == ["a", "d"]
    assert [r.relative_path for r in spark.read.parquet(f"{out}/refused").collect()] == ["b"]
    assert spark.read.parquet(f"{out}/acks").count() == 2


def test_stream_counts_equal_batch_and_latest(spark, tmp_path):
    schema = "condition string, path string, sha256 string, n long, ts timestamp"
    rows = [("c1", "a", "1", 2, "2024-01-01 00:00:00"), ("c1", "b", "2", 3, "2024-01-01 01:00:00"), ("c2", "a", "9", 5, "2024-01-01 02:00:00")]
    src, out = tmp_path / "s", str(tmp_path / "o")
    for i, part in enumerate([rows[:2], [rows[1], rows[2]], [rows[0], ("c1", "late", "3", 7, "2019-01-01 00:00:00")]]):
        d = spark.createDataFrame(part, "condition string, path string, sha256 string, n long, ts string").withColumn("ts", F.to_timestamp("ts"))
        d.coalesce(1).write.parquet(str(src / str(i)))
        s = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(src))
        jobs.finish(jobs.streaming_counts(s, f"{out}/t", f"{out}/_state"))
    got = {r.condition: (r.n_images, r.n_animals) for r in jobs.latest_counts(spark, f"{out}/t").collect()}
    assert got == {"c1": (3, 12), "c2": (1, 5)}

    src, out = tmp_path / "d", str(tmp_path / "e")
    for i, part in enumerate([[("x", 1, "p"), ("x", 3, "q")], [("x", 2, "late"), ("y", 1, "r")], [("x", 3, "again")]]):
        spark.createDataFrame(part, "device string, seq long, item string").coalesce(1).write.parquet(str(src / str(i)))
        s = spark.readStream.schema("device string, seq long, item string").option("recursiveFileLookup", "true").parquet(str(src))
        jobs.finish(jobs.latest_per_device(s, f"{out}/m", f"{out}/_state"))
    assert sorted((r.device, r.seq, r.item) for r in spark.read.parquet(f"{out}/m").collect()) == [("x", 3, "q"), ("y", 1, "r")]


def test_csv_rows_do_not_depend_on_the_columns_read(spark, tmp_path):
    from trackplate.sources.scores import read_soft_scores

    (tmp_path / "s.csv").write_text('folder,timepoint_h,image,hard_call,raw_a\nf,24,i1,egg,0.5\nf,24,"i,2",egg\nf,24,"i,3",egg,0.25\nf,24,i4,egg,0.1,extra\n')
    d = read_soft_scores(spark, str(tmp_path / "s.csv"))
    want = ["i,3", "i1", "i4"]
    assert d.count() == 3 and sorted(r.image for r in d.select("image").collect()) == want and sorted(r.image for r in d.collect()) == want


def test_rows_without_a_number_get_their_place(spark, tmp_path):
    from trackplate.sources.tracks import attach_by_row, clean_tracks, read_tracks

    rows = [(1, 1, 1, 2.0, 3.0)] * 3
    cols = "video_id long, track_id long, frame long, x double, y double"
    for k in range(2):
        spark.createDataFrame(rows, cols).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    d = read_tracks(spark, str(tmp_path / "t"))
    assert sorted(r.row_id for r in d.collect()) == [0, 1, 2, 3, 4, 5]
    extra = d.select("video_id", "row_id").withColumn("v", F.lit(1))
    assert attach_by_row(d, extra.union(extra), ["v"]).count() == 6
    with pytest.raises(ValueError):
        clean_tracks(spark.createDataFrame(rows, cols), cols.replace(" long", "").replace(" double", "").split(", "), {"row_id": "bigint"})


def test_streams_over_many_batches_with_late_and_repeated_items(spark, tmp_path):
    """Twelve batches in one run: each item comes up to three times, in any order."""
    rng = np.random.default_rng(9)
    items = [(f"d{i % 7}", int(i), f"p{i % 50}", f"h{i % 90}", int(i % 5)) for i in range(300)]
    feed = [items[i] for i in rng.permutation(np.repeat(np.arange(300), 3))[:700]]
    src, schema = str(tmp_path / "s"), "device string, seq long, path string, sha256 string, n long"
    for i in range(12):
        spark.createDataFrame(feed[i::12], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)

    query = jobs.latest_per_device(stream.select("device", "seq", "n"), str(tmp_path / "l"), str(tmp_path / "ls"))
    jobs.finish(query)
    got = spark.read.parquet(str(tmp_path / "l"))
    assert len(query.recentProgress) >= 12 and got.count() == got.select("device", "seq").distinct().count()
    newest = {}
    for d, q, _, _, n in feed:
        newest[d] = max(newest.get(d, (-1, 0)), (q, n))
    assert {r.device: (r.seq, r.n) for r in got.groupBy("device").agg(F.max("seq").alias("seq"), F.max_by("n", "seq").alias("n")).collect()} == newest

    jobs.finish(jobs.streaming_counts(stream.select(F.lit("c").alias("condition"), "path", "sha256", F.lit(2).alias("n")), str(tmp_path / "c"), str(tmp_path / "cs")))
    keys = {(p, h) for _, _, p, h, _ in feed}
    r = jobs.latest_counts(spark, str(tmp_path / "c")).first()
    assert (r.n_images, r.n_animals) == (len(keys), 2 * len(keys))
    assert not any(p.name == "seen" for p in tmp_path.rglob("*"))


def test_training_names_beyond_four_digits(spark, tmp_path):
    """Files beyond the 9999th of a folder keep names of their own; the query cuts the number as its SQL does."""
    import datetime

    import duckdb
    import pandas as pd

    import __spark_entry__ as contract
    from trackplate.operators.datasets import training_names

    k = 2 + 924 * np.arange(10_050)
    o = pd.DataFrame({"o_orderkey": k, "o_custkey": 0, "o_orderdate": datetime.datetime(1996, 1, 2)}).astype({"o_orderdate": "datetime64[us]"})
    o.to_parquet(tmp_path / "orders.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    want = db.sql(contract.oracle_sql()["training_names"]).fetchall()
    got = [tuple(r) for r in contract.queries()["training_names"](spark, str(tmp_path)).select("png", "file_id").collect()]
    assert len(got) == 9999 and sorted(got) == sorted(want)
    paths = spark.createDataFrame([(int(i), f"N2 J/plate3/{i:06}.png") for i in range(10_050)], "file_id long, path string")
    names = {r.file_id: r.png for r in training_names(paths, "L1").collect()}
    assert len(names) == 10_050 and names[10_049] == "N2_L1_J_p03_10050.png"
