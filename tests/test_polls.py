"""Polls of a feed that never succeeds, against the queries' own SQL on a table in which every hour has many errors."""

import duckdb
import pytest

from factledger.operators import ledger
from factledger.plans.queries import ORACLES, QUERIES

HOUR = 3_600_000
NOW = 1_706_655_600_000


def rows_of(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def failing(tmp_path_factory):
    d = tmp_path_factory.mktemp("failing")
    start = (NOW - 6 * HOUR) * 1000
    sql = f"SELECT i AS event_id, make_timestamp({start} + i * 600000000) AS ts, i % 3 AS user_id, 'error' AS event_type, i * 1.5 AS value, '' AS props FROM range(36) r(i)"
    duckdb.connect().execute(f"COPY ({sql}) TO '{d}/events.parquet' (FORMAT parquet)")
    return str(d)


def same_as_sql(spark, d, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet'")
    cur = con.execute(ORACLES[name])
    cols = [c[0] for c in cur.description]
    want = sorted(cur.fetchall())
    assert rows_of(QUERIES[name](spark, d), cols) == want
    return want


def test_freshness_of_a_feed_that_was_never_confirmed(spark, failing):
    assert same_as_sql(spark, failing, "freshness") == [("events", NOW, None, 0, "fresh")]


def test_failures_before_any_confirmation_count_unless_left_out(spark):
    obs = spark.createDataFrame([(i, "never", NOW - i, "failed", "network") for i in range(5)], "id long, source string, observed_at_ms long, outcome string, failure_class string")
    got = [ledger.freshness(obs, NOW, ["source"], unconfirmed=u).first() for u in (True, False)]
    assert [(r["failing"], r["status"]) for r in got] == [(5, "failing"), (0, "fresh")]


def test_a_feed_without_any_etag_has_a_row(spark, failing):
    assert same_as_sql(spark, failing, "last_etag") == [("events", None)]


def test_the_last_value_that_is_not_null(spark):
    obs = spark.createDataFrame([(1, "a", 1, "x"), (2, "a", 2, "y"), (3, "a", 3, None), (4, "b", 1, None)], "id long, source string, observed_at_ms long, etag string")
    assert rows_of(ledger.last_non_null(obs, "etag", ["source"]), ["source", "etag"]) == [("a", "y"), ("b", None)]
