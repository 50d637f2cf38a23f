"""A spread of registered queries against their SQL on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import check  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "day_grid", "stores_per_day", "returned_after_absence", "asof_value", "next_event_duration", "change_events", "import_monthly_facts", "unpack_columnar_json",
    "selling_runs", "drawing_odds", "price_percentile", "token_match", "maker_match", "local_answer", "store_ranking", "digest_match", "intent_reconcile",
    "select_targets", "sessionize", "source_engagement", "return_cohorts", "top_breakdowns", "check_quality", "stratified_sample", "stream_sessions",
    "stream_change_events", "index_refresh", "recommend", "eligibility_counts", "geo_device_mix", "run_gap_stats", "rating_reasons", "watch_attribution",
]


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in check.TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, oracle, name):
    df = entry.queries()[name](spark, FOLDER)
    res = oracle.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(res.columns)
    order = sorted(df.columns)
    got = sorted(tuple(check.norm(r[c]) for c in order) for r in df.collect())
    at = [res.columns.index(c) for c in order]
    want = sorted(tuple(check.norm(r[i]) for i in at) for r in res.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
