"""Answers worked out by hand."""

from __future__ import annotations

import datetime as dt
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.functions import registry as G
from meterlake.functions.significance import incomplete_beta, two_sided_p, with_q_values
from meterlake.functions.text import numeric_state, parsed_timestamp
from meterlake.operators import ingest, intervals, rollups, series, sessions, statistics
from meterlake.operators.points import json_number
from meterlake.sources import providers
from meterlake.streaming import jobs

POINT = "point_id long, tenant_id string, source_id string, metric_type string, timestamp timestamp_ntz, value double, metadata string"


def at(text):
    return dt.datetime.fromisoformat(text)


def points(spark, *rows):
    return spark.createDataFrame([(k, "t", s, m, at(t), v, "{}") for k, (s, m, t, v) in enumerate(rows)], POINT)


def test_registry():
    assert len(G.metrics()) == 145 and len(G.unit_factors()) == 42
    assert G.metrics()["workout_heart_rate"].retention_days == 365 and G.metrics()["workout_steps"].retention_days is None
    assert sum(len(m.aliases) for m in G.metrics().values()) == 151


def test_minute_average(spark):
    own = points(spark, ("s", "heart_rate", "2026-05-01 10:00:01", 60.0), ("s", "heart_rate", "2026-05-01 10:00:59", 80.0))
    row = rollups.rollup(own, "minute").first()
    assert (row.value, row.sample_count, row.bucket_start) == (70.0, 2, at("2026-05-01 10:00:00"))


def test_each_aggregation_in_a_dense_series(spark):
    own = points(
        spark,
        ("s", "steps", "2026-05-01 08:00:00", 100.0), ("s", "steps", "2026-05-01 09:00:00", 250.0), ("s", "steps", "2026-05-03 09:00:00", 40.0),
        ("s", "heart_rate", "2026-05-01 08:00:00", 60.0), ("s", "heart_rate", "2026-05-01 09:00:00", 80.0),
        ("s", "body_weight", "2026-05-01 08:00:00", 70.0), ("s", "body_weight", "2026-05-01 09:00:00", 72.0),
        ("s", "heart_rate_max", "2026-05-01 08:00:00", 100.0), ("s", "heart_rate_max", "2026-05-01 09:00:00", 90.0),
        ("s", "steps", "2026-05-01 10:00:00", None),
    )
    dense = series.dense(rollups.rollup(own, "day"), "2026-05-01", "2026-05-04", "day", "metric_type")
    got = {(r.metric_type, r.bucket_start.day): (r.value, r.is_gap) for r in dense.collect()}
    assert got["steps", 1] == (350.0, False) and got["steps", 2] == (None, True) and got["steps", 3] == (40.0, False)
    assert got["heart_rate", 1][0] == 70.0 and got["body_weight", 1][0] == 72.0 and got["heart_rate_max", 1][0] == 100.0


def test_merged_states_are_those_of_all_points(spark):
    r = random.Random(1)
    rows = [("s", r.choice(["steps", "heart_rate", "body_weight"]), f"2026-05-0{r.randint(1, 3)} {r.randint(0, 23):02}:{r.randint(0, 59):02}:{k % 60:02}", float(r.randint(1, 99))) for k in range(200)]
    own = points(spark, *rows)
    once = rollups.rollup(own, "day", "tenant_id", "metric_type").select("metric_type", "bucket_start", "sum_value", "min_value", "max_value", "last_value", "sample_count")
    hours = rollups.rollup(own, "hour", "tenant_id", "metric_type").withColumn("bucket_start", F.date_trunc("day", "bucket_start").cast("timestamp_ntz"))
    again = rollups.merge(hours.drop("value", "aggregation"), "metric_type", "bucket_start").select(once.columns)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect()))


def test_a_total_replaces_samples(spark):
    own = points(spark, ("s", "steps", "2026-05-01 08:00:00", 2.0), ("s", "steps", "2026-05-01 09:00:00", 3.0), ("s", "steps", "2026-05-01 07:00:00", 100.0))
    told = ingest.preaggregated(own.withColumn("is_total", F.col("value") == 100), "minute").collect()
    assert [(r.value, r.bucket_start, r.provider_total) for r in told] == [(100.0, at("2026-05-01 00:00:00"), True)]


def test_primary_source(spark):
    covered = spark.createDataFrame([("t", "steps", "a", 5), ("t", "steps", "b", 9), ("t", "vo2_max", "a", 1)], "tenant_id string, metric_type string, source_id string, samples long")
    pick = lambda p: {r.metric_type: (r.source_id, r.reason) for r in series.primary_source(covered, p).collect()}
    assert pick(None) == {"steps": ("b", "coverage"), "vo2_max": ("a", "only_source")}
    wanted = spark.createDataFrame([("t", "steps", "a")], "tenant_id string, metric_type string, primary_source_id string")
    assert pick(wanted)["steps"] == ("a", "preference")


def test_units_and_names(spark):
    rows = spark.createDataFrame([(1000.0, "kJ", "kcal"), (1.0, "kg", "kg"), (1.0, "kg", "m")], "v double, a string, b string")
    assert [None if r.c is None else round(r.c, 1) for r in G.converted(rows, "v", "a", "b", "c").orderBy("a", "b").collect()] == [239.0, 1.0, None]
    names = spark.createDataFrame([(" steps ",), ("step_count",), ("custom_x",), ("custom_",), ("odd",)], "metric_type string")
    assert {r.metric_type: r.canonical for r in G.canonical(names).collect()} == {" steps ": "steps", "step_count": "steps", "custom_x": "custom_x", "custom_": None, "odd": None}


def test_scalars(spark):
    row = spark.sql("SELECT 1").select(
        numeric_state(F.lit("Home")).alias("a"), numeric_state(F.lit("nan")).alias("b"), numeric_state(F.lit(" 2.5 ")).alias("c"),
        parsed_timestamp(F.lit("2026-08-02 00:30:00 +0200")).alias("d"), parsed_timestamp(F.lit("soon")).alias("e"),
        sessions.one_rep_max(F.lit(100.0), F.lit(5.0)).alias("f"), sessions.one_rep_max(F.lit(140.0), F.lit(1.0)).alias("g"), sessions.one_rep_max(F.lit(100.0), F.lit(11.0)).alias("h"),
        sessions.decode_key(sessions.encode_key(F.lit("v1|s|12|äß"))).alias("k"),
    ).first()
    assert (row.a, row.b, row.c, row.e) == (1.0, None, 2.5, None) and row.d == at("2026-08-01 22:30:00")
    assert round(row.f, 3) == 116.667 and row.g == 140.0 and row.h is None and row.k == "v1|s|12|äß"


def test_json_numbers_are_not_text(spark):
    rows = spark.createDataFrame([('{"k": 3}',), ('{"k": "3"}',), ('{"j": 3}',), (None,), ('{"o": {"k": "a"}, "k": 5.5}',), ('{"k": true}',), ("no json",), ('{"k": 1e300}',)], "metadata string")
    assert [r.n for r in rows.select(json_number("k").alias("n")).collect()] == [3.0, None, None, None, 5.5, None, None, 1e300]


def test_a_stated_null_keeps_points_for_good(spark):
    own = points(spark, ("s", "steps", "2020-01-01 00:00:00", 1.0), ("s", "heart_rate", "2020-01-01 00:00:00", 1.0))
    override = spark.createDataFrame([("t", "steps", None)], "tenant_id string, metric_type string, raw_retention_days int")
    assert [r.metric_type for r in ingest.purgeable(own, "2026-01-01", override).collect()] == ["heart_rate"]


def test_ties_in_time_merge_by_point_id(spark):
    rows = [(k, "t", "s", "body_weight", at("2026-05-01 08:00:00"), float(k), "{}") for k in range(40)]
    states = [rollups.rollup(spark.createDataFrame(rows[a : a + 10], POINT), "day") for a in (20, 0, 30, 10)]
    every = states[0].unionByName(states[1]).unionByName(states[2]).unionByName(states[3]).drop("value", "aggregation")
    row = rollups.merge(every, "metric_type", "bucket_start").first()
    assert (row.first_value, row.last_value, row.value) == (0.0, 39.0, 39.0)


def test_each_key_has_its_densest_metrics(spark):
    rows = [("a", m, f"2026-05-01 0{k}:00:00", 1.0) for m in ("x", "y") for k in range(9)] + [("b", m, f"2026-05-01 0{k}:00:00", 1.0) for m, n in (("x", 4), ("z", 7)) for k in range(n)]
    got = sessions.decimate(points(spark, *rows), 86_400, "source_id", most=1).collect()
    assert sorted((r.source_id, r.metric_type, r.n) for r in got) == [("a", "x", 9), ("b", "z", 7)]


def test_a_streak_counts_days_with_something(spark):
    days = [(u, at(f"2026-05-0{d}").date(), n) for u, d, n in (("a", 1, 2), ("a", 2, 0), ("a", 3, 1), ("a", 4, 5), ("b", 4, 0))]
    got = intervals.current_streak(spark.createDataFrame(days, "user string, day date, count int"), "2026-05-04", "user").collect()
    assert {r.user: r.streak for r in got} == {"a": 2, "b": 0}


def test_gaps_of_a_window(spark):
    own = points(spark, *[("s", "heart_rate", f"2026-05-01 {h:02}:00:00", 1.0) for h in (5, 6, 7, 8, 14, 15)], ("q", "heart_rate", "2026-04-01 00:00:00", 1.0), ("one", "heart_rate", "2026-05-01 09:00:00", 1.0))
    got = sorted((r.source_id, r.start.hour, r.end.hour) for r in intervals.cadence_gaps(own, "2026-05-01 00:00:00", "2026-05-01 20:00:00", "source_id").collect())
    assert got == [("q", 0, 20), ("s", 0, 5), ("s", 8, 14), ("s", 15, 20)]


def test_deltas_cross_days(spark):
    times = ["2026-05-01 08:00:00", "2026-05-01 23:59:59", "2026-05-02 00:00:01", "2026-05-05 00:00:01"]
    own = points(spark, *[("s", "heart_rate", t, 1.0) for t in times])
    assert sorted(r.seconds for r in intervals.deltas(own, "source_id").collect() if r.previous) == [2.0, 57599.0, 259200.0]


def test_an_anomaly_where_most_days_are_equal(spark):
    day = dt.date(2026, 5, 1)
    rows = [("a", day + dt.timedelta(days=k), 50.0 if k == 7 else 0.0) for k in range(20)] + [("b", day + dt.timedelta(days=k), 1.0) for k in range(20)]
    got = statistics.anomalies(spark.createDataFrame(rows, "metric_type string, day date, value double"), "metric_type").collect()
    assert [(r.metric_type, r.value) for r in got] == [("a", 50.0)]


def test_what_is_covered_by_all(spark):
    day = at("2026-05-01 00:00:00")
    hour = lambda k: day + dt.timedelta(hours=k)
    rows = [("k", "a", hour(0), hour(10)), ("k", "b", hour(2), hour(4)), ("k", "b", hour(3), hour(6)), ("k", "b", hour(8), hour(9))]
    ranges = spark.createDataFrame(rows, "key string, metric_type string, start timestamp_ntz, end timestamp_ntz")
    more = ranges.select("key", "metric_type").unionByName(spark.createDataFrame([("k", "c")], "key string, metric_type string"))
    got = intervals.covered_by_all(ranges, ranges, "metric_type", "key").collect()
    assert sorted((r.start, r.end) for r in got) == [(hour(2), hour(6)), (hour(8), hour(9))]
    assert intervals.covered_by_all(ranges, more, "metric_type", "key").collect() == []


@pytest.mark.parametrize(("hours", "want"), [(1, 2), (3, 6), (6, 12), (12, 24), (24, 48), (168, 72), (0, 2)])
def test_overlap(hours, want):
    assert intervals.overlap_hours(hours) == want


def test_local_days(spark):
    own = points(spark, ("s", "steps", "2026-08-01 22:30:00", 1.0))
    missing = lambda offset: [str(r.day) for r in intervals.daily_gaps(own, "2026-08-01", "2026-08-02", "metric_type", offset_minutes=offset).collect()]
    assert missing(0) == ["2026-08-02"] and missing(120) == ["2026-08-01"]


def test_ranges_are_sets_of_hours(spark):
    r = random.Random(5)
    day = at("2026-01-01 00:00:00")
    hour = lambda k: day + dt.timedelta(hours=k)
    cells = lambda ranges: {k for a, b in ranges for k in range(a, b)}
    a, b = ([(s, s + r.randint(1, 5)) for s in (r.randint(0, 40) for _ in range(9))] for _ in range(2))
    frame = lambda ranges: spark.createDataFrame([("k", hour(s), hour(e)) for s, e in ranges], "key string, start timestamp_ntz, end timestamp_ntz")
    back = lambda df: sorted(((x.start - day) // dt.timedelta(hours=1), (x.end - day) // dt.timedelta(hours=1)) for x in df.collect())
    merged_a, merged_b = intervals.merge_adjacent(frame(a), "key"), intervals.merge_adjacent(frame(b), "key")
    assert cells(back(merged_a)) == cells(a) and all(x[1] < y[0] for x, y in zip(back(merged_a), back(merged_a)[1:], strict=False))
    assert cells(back(intervals.subtract(frame([(5, 38)]), frame(a), "key"))) == set(range(5, 38)) - cells(a)
    assert cells(back(intervals.intersect(merged_a, merged_b, "key"))) == cells(a) & cells(b)
    assert back(intervals.subtract(frame([(5, 38)]), frame([]), "key")) == [(5, 38)]


def test_p_values():
    assert float(incomplete_beta(2.0, 3.0, 0.4)) == pytest.approx(0.5248)
    assert two_sided_p([2.0], [10]) == pytest.approx([0.07338803], abs=1e-7)
    n, r = 365, 0.0001
    assert float(two_sided_p([r * math.sqrt((n - 2) / (1 - r * r))], [n - 2])[0]) == pytest.approx(0.9985, abs=1e-3)
    assert np.all(np.diff(two_sided_p(np.linspace(0, 5, 50), np.full(50, 7.0))) < 0)


def test_q_values(spark):
    p = [0.01, 0.04, 0.03, 0.2, 0.04]
    got = with_q_values(spark.createDataFrame([(k, x) for k, x in enumerate(p)], "k int, p double"), "p").orderBy("k").collect()
    assert [round(r.q_value, 6) for r in got] == [0.05, 0.05, 0.05, 0.2, 0.05]


def test_correlation_of_a_line(spark):
    day = dt.date(2026, 5, 1)
    rows = [("t", m, day + dt.timedelta(days=k), v) for k in range(20) for m, v in (("a", float(k)), ("b", float(k)), ("c", -float(k)), ("d", 1.0))] + [("t", "e", day + dt.timedelta(days=k), float(k)) for k in range(9)]
    told = statistics.tested_correlations(spark.createDataFrame(rows, "tenant_id string, metric_type string, day date, value double"), "tenant_id")
    got = {(r.metric_a, r.metric_b): (round(r.pearson, 9), round(r.spearman, 9)) for r in told.collect()}
    assert got["a", "b"] == (1, 1) and got["a", "c"] == (-1, -1) and got["a", "d"] == (0, 0) and ("a", "e") not in got


def test_providers(spark):
    one = lambda payload: spark.createDataFrame([(json.dumps(payload),)], "payload string")
    told = lambda df: sorted((r.metric_type, round(r.value, 3)) for r in df.collect())
    hourly = {"hourly": {"time": ["2026-05-01T00:00", "2026-05-01T01:00"], "temperature_2m": [1.5, None], "uv_index": [0.0, 2.0]}}
    assert told(providers.weather(one(hourly))) == [("weather_temperature", 1.5), ("weather_uv_index", 0.0), ("weather_uv_index", 2.0)]
    assert told(providers.home_states(one([[{"entity_id": "light.Desk", "state": "on", "last_changed": "2026-05-01T00:00:00Z"}, {"entity_id": "x", "state": "unavailable"}]]))) == [("home_assistant_desk", 1.0)]
    night = {"data": {"metrics": [{"name": "sleep_analysis", "units": "hr", "data": [{"qty": 7, "date": "2026-05-01 00:00:00 +0000", "deep": 1, "rem": 2, "core": 4, "awake": 0.5}]}, {"name": "heart_rate", "units": "bpm", "data": [{"Avg": 61, "date": "2026-05-01 00:00:00 +0000"}]}]}}
    assert told(providers.health_export(one(night))) == [("heart_rate", 61), ("sleep_duration", 420), ("sleep_duration_awake", 30), ("sleep_duration_deep", 60), ("sleep_duration_light", 240), ("sleep_duration_rem", 120)]
    log = {"workouts": [{"id": "w", "title": "Push", "createdAt": "2026-05-01T10:00:00Z", "sets": [{"id": "1", "setNumber": 1, "weight": 50, "reps": 10, "maxPulse": 150, "createdAt": "2026-05-01T10:00:00Z", "exercise": {"id": "e", "title": "Bench", "category": "chest"}}]}]}
    assert len(told(providers.strength_log(one(log)))) == 6
    scored = [{"id": "r", "score_state": "SCORED", "start": "2026-05-01T06:00:00Z", "score": {f: 50.0 for f in providers.RECOVERY}}, {"id": "q", "score_state": "PENDING", "start": "2026-05-02T06:00:00Z"}]
    assert len(told(providers.recovery(one(scored)))) == 5
    assert len(told(providers.gps_fixes(one([{"id": 1, "latitude": "48.1", "longitude": "11.5", "timestamp": 1770000000}, {"id": 2, "latitude": "x", "longitude": "1"}])))) == 3
    pair = [{"id": 1, "latitude": 48.1, "longitude": 11.5, "timestamp": 1770000000}, {"id": 2, "latitude": 48.2, "longitude": 11.6, "timestamp": 1770000000}]
    events = providers.gps_fixes(one(pair)).collect()
    assert len(events) == 6 and {json.loads(r.metadata)["latitude"] for r in events if r.value in (48.2, 11.6)} == {48.2}
    window = providers.commits(one({"login": "a", "commits_by_day": {"2026-08-11": 4}}), "2026-08-10", "2026-08-12")
    assert told(window.where("metric_type = 'code_commits'")) == [("code_commits", 0), ("code_commits", 0), ("code_commits", 4)]


def test_files(spark, tmp_path):
    (tmp_path / "cycles.csv").write_text("Startzeit des Zyklus,Erholungswert %,Anderes\n2026-05-01 06:00:00,66,x\n2026-05-02 06:00:00,,y\n", encoding="utf-8")
    assert [(r.metric_type, r.value) for r in providers.recovery_csv(spark, str(tmp_path / "cycles.csv")).collect()] == [("whoop_recovery_score", 66.0)]
    (tmp_path / "export.xml").write_text('<HealthData><Record type="HKQuantityTypeIdentifierStepCount" startDate="2026-05-01 10:00:00 +0200" value="12" unit="count" sourceName="Watch"/><Record type="HKCategoryTypeIdentifierSleep" startDate="2026-05-01 10:00:00 +0200" value="Asleep" sourceName="Watch"/></HealthData>')
    assert [(r.metric_type, r.value, r.timestamp) for r in providers.health_records(spark, str(tmp_path / "export.xml")).collect()] == [("step_count", 12.0, at("2026-05-01 08:00:00"))]


def test_store_new_is_idempotent_over_batches(spark, tmp_path):
    folder, source = str(tmp_path / "out"), tmp_path / "in"
    for k in range(3):
        rows = spark.range(10 * k, 10 * k + 15).selectExpr("id AS point_id", "timestamp_ntz '2024-01-01' + make_dt_interval(CAST(id % 4 AS INT)) AS timestamp")
        rows.coalesce(1).write.mode("append").parquet(str(source))
    jobs.store_new(jobs.event_stream(spark, str(source), files_per_trigger=1), folder, "point_id")
    jobs.store_new(jobs.event_stream(spark, str(source), files_per_trigger=1), folder, "point_id")
    ids = [r.point_id for r in spark.read.parquet(f"{folder}/points").collect()]
    assert sorted(ids) == list(range(35))
