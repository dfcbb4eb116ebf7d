"""Every catalog query against DuckDB on the same tables, all rows and values."""

import os

import duckdb
import pytest

from tidewell.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toArrow()
    want = duck.sql(catalog.ORACLES[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    want = want.select(got.column_names)
    assert got.num_rows == want.num_rows
    assert [str(t) for t in got.schema.types] == [str(t) for t in want.schema.types]
    duck.register("got", got)
    duck.register("want", want)
    for a, b in (("got", "want"), ("want", "got")):
        assert duck.sql(f"select count(*) from (select * from {a} except all select * from {b})").fetchall() == [(0,)]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_streams_bill_each_event_once(spark):
    stored, unique, billed = catalog.QUERIES["exactly_once_replay"](spark, SF).first()
    assert stored == unique == billed > 0


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
