"""The registry is consistent, and a sample of queries equals its SQL on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry
from orderloom.plans import oracles, queries as registry

SF = "/root/testdata/sf0.001"
SAMPLE = ["a11_arrival_ordinal", "b05_session_calendar", "c02_emission_order", "d09_value_area", "d15_cvd_candles", "d22_letter_strings",
          "e06_modifies", "e17_bbo_series", "e22_queue_position", "e23_flow_series", "e30_iceberg_census", "f03_state_from_snapshot",
          "f04_ladder", "h03_half_hour_volume"]


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(oracles.all_sql())
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    got = entry.queries()[name](spark, SF).toArrow()
    rel = con.sql(entry.oracle_sql()[name])
    cols = sorted(rel.columns)
    assert sorted(got.column_names) == cols
    key = lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r)
    a = sorted(zip(*[got.column(c).to_pylist() for c in cols]), key=key)
    b = sorted(rel.project(", ".join(f'"{c}"' for c in cols)).fetchall(), key=key)
    assert a == b


def test_filters_do_not_parse_json_again(spark):
    """The conditions of the raw-row queries are not rewritten in terms of the JSON field."""
    for name in ("a04_event_time", "b11_off_grid"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("get_json_object") == 1, name
