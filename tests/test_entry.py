import os

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = ["events", "conversations", "documents", "pages", "labels", "benchmark"]


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert [r["period"] for r in rows] and set(df.columns) == {"period", "msgs", "input", "output", "cost_cents"}


def test_every_query_has_an_oracle():
    from tokentally.catalog import QUERIES
    assert set(QUERIES) <= set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF, t + '.parquet')}')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    idx = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(r[i] for i in idx) for r in rel.fetchall()), key=repr)
    assert got == want


TIME_SENSITIVE = ["period_summary", "usage_series", "humanize", "live_append", "transcript_span",
                  "incremental_sync", "import_per_line", "top_sessions"]


@pytest.mark.parametrize("tz", ["America/Los_Angeles", "Asia/Kolkata"])
def test_results_do_not_depend_on_session_time_zone(spark, con, tz):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", tz)
    try:
        for name in TIME_SENSITIVE:
            test_query_matches_oracle(spark, con, name)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
