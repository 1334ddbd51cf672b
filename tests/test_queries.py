"""Every election query against its SQL in DuckDB."""

import math

import duckdb
import pytest

from seatloom.plans import layouts  # noqa: F401
from seatloom.plans.queries import ORACLES, QUERIES
from seatloom.sources.readers import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) and not math.isnan(value) else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    found = QUERIES[name](spark, SF)
    cursor = con.execute(ORACLES[name])
    columns = sorted(d[0] for d in cursor.description)
    at = [[d[0] for d in cursor.description].index(c) for c in columns]
    assert sorted(found.columns) == columns
    want = sorted(repr([plain(row[i]) for i in at]) for row in cursor.fetchall())
    assert sorted(repr([plain(row[c]) for c in columns]) for row in found.collect()) == want


def test_stream_replays_like_batch(spark):
    rows = {(r.seq, r.event) for r in QUERIES["streaming_replay"](spark, SF).collect()}
    batch = {r.event for r in QUERIES["change_events"](spark, SF).collect()}
    assert {e for _, e in rows} == batch | {"first"}
