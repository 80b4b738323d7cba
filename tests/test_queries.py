"""Registered queries against their oracle on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
PICK = ["fragment_adjacency", "successor_links", "kinematics", "detrend_peaks", "turn_events", "reversals", "merge_detections",
        "duplicate_pairs", "condition_rollup", "qc", "timepoints", "log_histogram", "contrast", "reuse_plan", "retention_list",
        "ingest_stream", "streaming_counts", "report_payload"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def test_contract():
    q, o = contract.queries(), contract.oracle_sql()
    assert len(q) > 120 and set(o) <= set(q)


def test_entry(spark):
    df = contract.entry(spark)
    assert "bpm_median_long" in df.columns and df.count() > 0


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", PICK)
def test_matches_oracle(spark, db, name):
    df = contract.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = db.sql(contract.oracle_sql()[name])
    assert sorted(rel.columns) == cols

    def rows(data, names):
        at = [names.index(c) for c in cols]
        return sorted(repr([r[i] for i in at]) for r in data)

    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(rel.fetchall(), rel.columns)
