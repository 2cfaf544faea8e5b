"""Records, counters, metadata, sketches and distances by hand."""

from __future__ import annotations

import datetime as dt
import json
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from meterlake.operators import sessions
from meterlake.operators.ingest import bounded_metadata, with_provenance
from meterlake.operators.sessions import ellipsoid_distance, haversine, track_length
from meterlake.operators.statistics import merged_quantiles, quantile, quantile_states
from meterlake.plans import all_oracles, all_queries
from meterlake.sources import providers


def one(spark, payload):
    return spark.createDataFrame([(json.dumps(payload),)], "payload string")


def told(events):
    return {(r.metric_type, round(r.value, 6), r.unit) for r in events.collect()}


def test_records_of_workouts(spark):
    zones = {"zone_zero_milli": 10, "zone_one_milli": 30, "zone_three_milli": 60}
    record = {"id": "1", "score_state": "SCORED", "start": "2026-05-01T10:00:00.000Z", "end": "2026-05-01T10:45:30Z", "score": {"strain": 8.5, "kilojoule": 1000, "zone_duration": zones}}
    other = record | {"end": record["start"], "score": {"strain": 1, "zone_duration": {"zone_one_milli": 0}}}
    got = told(providers.recovery(one(spark, [record, other, record | {"score_state": "PENDING"}]), "workout"))
    assert got == {
        ("whoop_workout_strain", 8.5, "index"), ("workout_energy", 239.0, "kcal"), ("workout_duration", 45.5, "min"),
        ("workout_heart_rate_zone_1", 30.0, "%"), ("workout_heart_rate_zone_3", 60.0, "%"), ("whoop_workout_strain", 1.0, "index"),
    }
    cycle = {"score_state": "SCORED", "start": "2026-05-01T10:00:00Z", "score": {"kilojoule": 8000.0, "max_heart_rate": 170}}
    assert told(providers.recovery(one(spark, [cycle]), "cycle")) == {("energy_total", 1912.0, "kcal"), ("heart_rate_max", 170.0, "bpm")}


def test_halves_of_a_decimal_of_energy_go_down(spark):
    """5.23 kJ are 1.25 kcal, and so on: each a tie, for which 1/4.184 in doubles went up or down."""
    joules = [5.23, 15.69, 26.15, 36.61, 5.24, 100.0, None]
    records = [{"score_state": "SCORED", "start": "2026-05-01T10:00:00Z", "score": {"kilojoule": v}} for v in joules]
    assert sorted(r.value for r in providers.recovery(one(spark, records), "cycle").collect()) == [1.2, 1.3, 3.7, 6.2, 8.7, 23.9]


def test_counters_of_repositories(spark):
    repositories = [
        {"name_with_owner": "A/x.y", "commits_by_day": {"2026-08-10": 2}, "additions_by_day": {"2026-08-10": 10}, "deletions_by_day": {"2026-08-10": 1}},
        {"name_with_owner": "b/z", "commits_by_day": {"2026-08-10": 1, "2026-08-11": 0}, "additions_by_day": {"2026-08-10": 5}},
    ]
    window = {"login": "a", "commits_by_day": {"2026-08-10": 3, "2026-08-12": 4}, "reviews_by_day": {"2026-08-11": 1}, "repositories": repositories}
    by = {(r.metric_type, f"{r.timestamp:%d}"): r.value for r in providers.commits(one(spark, window), "2026-08-10", "2026-08-12").collect()}
    assert {d: by.get(("code_lines_added", d)) for d in ("10", "11", "12")} == {"10": 15.0, "11": 0.0, "12": None}
    assert [by[m, "10"] for m in ("code_commits", "code_repositories_touched", "code_lines_removed", "code_reviews_submitted")] == [3.0, 2.0, 1.0, 0.0]
    assert {m: v for m, v in by.items() if m[0].startswith("github_")} == {("github_a_x_y_commits", "10"): 2.0, ("github_b_z_commits", "10"): 1.0}
    cut = window | {"repositories": [repositories[0] | {"commits_truncated": True}]}
    assert ("code_lines_added", "11") not in {(r.metric_type, f"{r.timestamp:%d}") for r in providers.commits(one(spark, cut), "2026-08-10", "2026-08-12").collect()}


def test_metadata_is_bounded(spark):
    large = json.dumps({"provider_value": 7, "units": "kg", "x": "y" * 40_000})
    rows = [('{"a": 1}', 1.0), (large, 1.0), (json.dumps({"provider_value": "no", "units": "u" * 65, "x": "ä" * 20_000}), 2.0), ("no json", None)]
    got = [r.m for r in spark.createDataFrame(rows, "metadata string, value double").select(bounded_metadata(F.col("metadata"), F.col("value")).alias("m")).collect()]
    assert got[0] == '{"a": 1}'
    assert [json.loads(m) for m in got[1:]] == [{"provider_value": v, "units": u, "metadata_truncated": True} for v, u in ((7.0, "kg"), (2.0, None), (None, None))]


def test_mapped_events_say_where_they_come_from(spark):
    rows = [("map", 'Body "W"', '{"a":1}'), ("adopt", "x", "{}"), ("accept", "steps", '{"a":1}'), ("map", "y", None)]
    got = with_provenance(spark.createDataFrame([(*r, 1.0) for r in rows], "action string, raw_metric_type string, metadata string, value double")).collect()
    assert [json.loads(r.metadata) for r in got] == [{"mapped_from": 'Body "W"', "mapping_action": "map", "a": 1}, {"mapped_from": "x", "mapping_action": "adopt"}, {"a": 1}, {"mapped_from": "y", "mapping_action": "map"}]


def test_sketches_merge(spark):
    rows = spark.range(60_000).selectExpr("id % 7 AS day", "'big' AS k", "CAST((id * 7919) % 60000 AS DOUBLE) AS value").unionByName(spark.range(301).selectExpr("id % 7 AS day", "'small' AS k", "CAST(id AS DOUBLE) AS value"))
    whole = {r.k: (r.m, r.n) for r in quantile_states(rows, "k").select("k", "n", quantile(0.5).alias("m")).collect()}
    merged = {r.k: (r.m, r.n) for r in merged_quantiles(quantile_states(rows, "k", "day"), "k").select("k", "n", quantile(0.5).alias("m")).collect()}
    assert whole["small"] == merged["small"] == (150.0, 301)
    assert abs(whole["big"][0] - 30_000) < 900 and abs(merged["big"][0] - 30_000) < 900 and merged["big"][1] == 60_000


@pytest.mark.parametrize(("a", "b", "meters", "within"), [
    ((-(37 + 57 / 60 + 3.72030 / 3600), 144 + 25 / 60 + 29.52440 / 3600), (-(37 + 39 / 60 + 10.15610 / 3600), 143 + 55 / 60 + 35.38390 / 3600), 54_972.271, 0.002),
    ((0.0, 0.0), (0.0, 1.0), 111_319.4908, 0.001), ((0.0, 5.0), (90.0, 5.0), 10_001_965.7293, 0.001), ((48.1, 11.5), (48.1, 11.5), 0.0, 1e-9),
    ((0.0, 0.0), (0.5, 179.7), 19_944_127.0, 100_000), ((0.0, 0.0), (0.0, 180.0), 20_003_931.0, 100_000), ((0.0, 179.5), (0.0, -179.5), 111_319.4908, 0.001),
])
def test_distances_on_the_ellipsoid(spark, a, b, meters, within):
    assert spark.range(1).select(ellipsoid_distance(*[F.lit(x) for x in (*a, *b)]).alias("m")).first().m == pytest.approx(meters, abs=within)


@pytest.mark.parametrize("files", [1, 3])
def test_the_first_row_of_an_order_states_a_meal(spark, tmp_path, files):
    """Orders with several first lines on one day: that which comes first in the table stays, over files and row groups as well."""
    duck = duckdb.connect()
    duck.sql("SET threads = 1")
    rows = "SELECT i // 40 AS l_orderkey, 1 AS l_linenumber, i * 7919 % 1009 + 0.25 AS l_extendedprice, 1.0::DOUBLE AS l_quantity, CAST(i % 3 AS BIGINT) AS l_suppkey, ['A', 'N', 'R'][i % 3 + 1] AS l_returnflag, TIMESTAMP '1995-01-01' + to_days(CAST(i % 2 AS INTEGER)) AS l_shipdate FROM range(6000) r(i)"
    place = f"{tmp_path}/lineitem.parquet"
    (tmp_path / "lineitem.parquet").mkdir()
    for k in range(files):
        duck.sql(f"COPY (SELECT * REPLACE (CAST(l_extendedprice AS DOUBLE) AS l_extendedprice) FROM ({rows}) WHERE (l_orderkey + l_extendedprice::INTEGER) % {files} = {k}) TO '{place}/{k}.parquet' (ROW_GROUP_SIZE 2048)")
    duck.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{place}/*.parquet'")
    want = duck.sql(all_oracles()["diary_by_meal"])
    got = all_queries()["diary_by_meal"](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_many_distances_on_the_ellipsoid_take_seconds(spark):
    place = [(F.col("id") * k % (20 * most) / 10 - most).alias(c) for k, c, most in ((7, "a", 89), (11, "b", 180), (13, "c", 89), (17, "d", 180))]
    pairs = spark.range(1, 100_001, numPartitions=4).select(*place)
    begun = time.monotonic()
    got = pairs.select(*[d(*[F.col(c) for c in "abcd"]).alias(n) for n, d in (("m", ellipsoid_distance), ("h", haversine))]).agg(F.count("*"), F.max(F.abs(F.col("m") - F.col("h")) - F.col("h") * 0.006)).first()
    assert got[0] == 100_000 and got[1] < 1
    assert time.monotonic() - begun < 20


def test_tracks_over_several_days(spark):
    """The days' parts and the steps between them make the whole track; fixes without a place or a time count and break it."""
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    along = [("a", at(9 * k), k, 48.0, 10.0 + k / 10) for k in range(12)] + [("a", at(400), 12, 48.0, 11.2), ("b", at(1), 1, 48.0, 10.0)]
    broken = [("c", at(1), 1, 48.0, 10.0), ("c", at(23), 2, None, 10.1), ("c", at(25), 3, 48.0, 10.2), ("c", at(50), 4, 48.0, 10.3), ("c", None, 5, 48.0, 9.9)]
    fixes = spark.createDataFrame(along + broken, "track string, timestamp timestamp_ntz, point_id long, latitude double, longitude double")
    one = spark.range(1).select(ellipsoid_distance(F.lit(48.0), F.lit(10.0), F.lit(48.0), F.lit(10.1))).first()[0]
    got = {r.track: (r.fixes, r.meters) for r in track_length(fixes, "track", distance=ellipsoid_distance).collect()}
    assert got == {"a": (13, pytest.approx(12 * one, rel=1e-9)), "b": (1, 0.0), "c": (5, pytest.approx(2 * one, rel=1e-9))}
    windows = track_length(fixes, "track", distance=ellipsoid_distance)._jdf.queryExecution().analyzed().toString()
    assert "windowspecdefinition(track" in windows and "_day" in windows


def test_windows_are_measured_without_pairs(spark, monkeypatch):
    """Against pairs by brute force: long and equal windows, nulls, NaN, times before 1970, cells in several parts."""
    monkeypatch.setattr(sessions, "TOGETHER", 64)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    draw = random.Random(5)
    at = lambda: dt.datetime(1969, 12, 30) + dt.timedelta(seconds=draw.randrange(4 * 86400), microseconds=draw.choice([0, 1, 999_999]))
    value = lambda: draw.choice([None, float("nan"), 0.0, draw.uniform(-5, 5)])
    rows = [(draw.choice(["a", "b", "c", None]), draw.choice([at(), at(), None]), draw.choice(["x", "y", None]), value()) for _ in range(3000)]
    points = spark.createDataFrame(rows, "tenant_id string, timestamp timestamp_ntz, metric_type string, value double").repartition(3)
    begun = [(draw.choice(["a", "b", "none"]), f"s{k % 90}", at(), draw.choice([1, 60, 5000, 7200, 7201, 200_000, -900])) for k in range(100)]
    spans = spark.createDataFrame([(t, k, a, a + dt.timedelta(seconds=n)) for t, k, a, n in begun], "tenant_id string, session string, start timestamp_ntz, end timestamp_ntz")
    counted = sessions.within_windows(spans, points, pad_seconds=30).groupBy("tenant_id", "session", "metric_type").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    found = sessions.measured_within(spans, points, pad_seconds=30)
    want = sorted(map(repr, counted.collect()))
    got = sorted(map(repr, found.select(*counted.columns).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(want) > 100 and got == want
    made = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in made


def test_a_dense_hour_is_measured_in_seconds(spark):
    """20,000 windows over 100,000 points: 2,000,000,000 pairs."""
    points = spark.range(100_000).select(F.lit("t").alias("tenant_id"), F.timestamp_add("SECOND", (F.col("id") % 3600).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("timestamp"), F.lit("m").alias("metric_type"), F.col("id").cast("double").alias("value"))
    spans = spark.range(20_000).select(F.lit("t").alias("tenant_id"), F.col("id").alias("session"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("start"), F.lit("2024-01-01 02:00:00").cast("timestamp_ntz").alias("end"))
    begun = time.monotonic()
    got = sessions.measured_within(spans, points).agg(F.count("*"), F.min("n"), F.max("n"), F.min("least"), F.max("most")).first()
    assert tuple(got) == (20_000, 100_000, 100_000, 0.0, 99_999.0) and time.monotonic() - begun < 60
