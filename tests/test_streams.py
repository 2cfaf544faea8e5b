"""Totals of days over several batches."""

from __future__ import annotations

import datetime as dt

import duckdb
import pytest

from meterlake.plans import all_oracles, all_queries
from meterlake.streaming import jobs

SCHEMA = "point_id long, tenant_id string, source_id string, metric_type string, timestamp timestamp_ntz, value double, is_total boolean, arrived_at timestamp"


def row(k, day, value, total=False, hour=1, source="s", after=0):
    """A point that arrives ``after`` hours, in the order of ids."""
    return (k, "t", source, "steps", None if day is None else dt.datetime(2024, 1, day, hour), value, total, dt.datetime(2024, 2, 1) + dt.timedelta(hours=after, minutes=k))


def run(spark, folder, batches, **more):
    schema = spark.createDataFrame([], SCHEMA).schema
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        jobs.appended(jobs.day_totals(spark.readStream.schema(schema).parquet(f"{folder}/in"), **more), f"{folder}/totals")
    return [(r.source_id, int(r.day[-2:]), r.revision, r.value, r.is_provider_total, r.samples) for r in spark.read.schema(jobs.DAY_TOTALS).parquet(f"{folder}/totals/out").collect()]


def test_days_open_again(spark, tmp_path):
    batches = [
        [row(1, 1, 5.0), row(2, 1, 2.0), row(3, 2, 1.0), row(4, 1, None), row(5, 1, float("nan")), row(6, None, 3.0), row(7, 1, 4.0, None)],
        [row(8, 1, 10.0), row(9, 3, 1.0)],  # a late sample
        [row(10, 1, 99.0, True, 5), row(11, 1, 98.0, True, 4), row(12, 1, 1.0)],  # late totals, of which the latest in time counts
        [row(13, 4, 1.0), row(14, 9, 1.0, source="other"), row(15, 1, None, True, 9)],  # a total without a value is none
    ]
    told = run(spark, tmp_path, batches)
    assert sorted(told) == [("s", 1, 1, 11.0, False, 3), ("s", 1, 2, 21.0, False, 4), ("s", 1, 3, 99.0, True, 5), ("s", 2, 1, 1.0, False, 1), ("s", 3, 1, 1.0, False, 1)]


def test_a_quiet_source_is_closed_by_its_timer(spark, tmp_path):
    told = run(spark, tmp_path, [[row(1, 1, 5.0)], [row(2, 1, 5.0, source="other", after=2)], [row(3, 1, 1.0, after=2)]], quiet_ms=3_600_000)
    assert sorted(told) == [("s", 1, 1, 5.0, False, 1)]


def test_days_are_forgotten_after_a_time(spark, tmp_path):
    batches = [[row(1, 1, 5.0), row(2, 2, 5.0)], [row(3, 1, 1.0, after=1)], [row(4, 3, 1.0, source="other", after=30)], [row(5, 1, 7.0, after=31)]]
    told = run(spark, tmp_path, batches, keep_ms=24 * 3_600_000)
    assert sorted(x for x in told if x[:2] == ("s", 1)) == [("s", 1, 1, 5.0, False, 1), ("s", 1, 1, 7.0, False, 1), ("s", 1, 2, 6.0, False, 2)]


@pytest.fixture(scope="module")
def many_unknown(tmp_path_factory):
    """Events of one source under 130 names, and more than 100,000 events of another one under one name."""
    folder = tmp_path_factory.mktemp("unknown")
    table = f"{folder}/events.parquet"
    at = "TIMESTAMP '2024-01-01' + to_minutes(CAST(event_id * 13 % 41000 AS BIGINT))"
    rows = "SELECT range AS event_id, CASE WHEN range < 1300 THEN 4 ELSE 8 END AS user_id, CASE WHEN range < 1300 THEN 'odd_' || range % 130 ELSE 'view' END AS event_type FROM range(103000)"
    duckdb.sql(f"COPY (SELECT event_id, {at} AS ts, CAST(user_id AS BIGINT) AS user_id, event_type, event_id % 7 + 0.5::DOUBLE AS value, '{{}}' AS props FROM ({rows})) TO '{table}'")
    return folder, table


@pytest.mark.parametrize("name", ["stream_side_outputs", "stream_run_counts"])
def test_quarantine_of_the_queries_has_no_bounds(spark, many_unknown, name):
    folder, table = many_unknown
    got = all_queries()[name](spark, str(folder))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{table}'")
    want = duck.sql(all_oracles()[name])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
