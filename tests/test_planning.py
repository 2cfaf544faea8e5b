"""Plans, rules, policies and calendars worked out by hand."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest

from meterlake.operators import mapping, planning
from meterlake.sources.calendars import occurrences

DAY = dt.datetime(2026, 5, 1)


def hour(k):
    return DAY + dt.timedelta(hours=k)


def test_a_plan_covers_its_window_and_skips_nothing_else():
    r = random.Random(2)
    for _ in range(200):
        covered = [(hour(a), hour(a + r.randint(0, 5))) for a in (r.randint(-5, 30) for _ in range(r.randint(0, 5)))]
        plan = planning.plan_import((hour(0), hour(24)), covered)
        cells = lambda ranges: {k for a, b in ranges for k in range(-10, 40) if a <= hour(k) < b}
        assert cells(plan.import_ranges) | cells(plan.skipped_ranges) == set(range(24))
        assert not cells(plan.import_ranges) & cells(covered) and cells(plan.skipped_ranges) <= cells(covered)
    assert planning.plan_import((hour(0), hour(2)), None).import_ranges == [(hour(0), hour(2))]
    assert planning.plan_import((hour(0), hour(2)), [(hour(0), hour(2))], "force").import_ranges == [(hour(0), hour(2))]


def test_sync_window():
    month = dt.timedelta(days=30)
    assert planning.sync_window(hour(0), 6, month) == ((hour(0) - month, hour(0)), "first_sync")
    assert planning.sync_window(hour(0), 6, month, hour(-1)) == ((hour(-13), hour(0)), "overlap")
    assert planning.sync_window(hour(0), 6, month, hour(-1), hour(-100)) == ((hour(-100), hour(0)), "gap")
    assert planning.sync_window(hour(0), 6, month, hour(-2000))[1] == "lookback"
    assert planning.sync_window(hour(0), 6, month, hour(30)) == ((hour(-12), hour(0)), "recheck")


def test_coverage_ranges(spark):
    rows = [("k", hour(h) + dt.timedelta(minutes=m)) for h in (0, 1, 2, 5, 6) for m in range(0, 60, 10)] + [("k", hour(3))]
    got = planning.coverage_ranges(spark.createDataFrame(rows, "key string, timestamp timestamp_ntz"), "2026-05-01", "2026-05-02", 3600, "key").collect()
    assert sorted((r.start, r.end) for r in got) == [(hour(0), hour(3)), (hour(5), hour(7))]


@pytest.mark.parametrize(("rule", "want"), [
    (dict(raw="x", action="drop"), "unknown_action"), (dict(raw="x", action="map"), "missing_target"), (dict(raw="x", action="map", target="odd"), "unknown_target"),
    (dict(raw="x", action="map", target="energy_active", source_unit="kJ"), None), (dict(raw="x", action="map", target="energy_active", source_unit="kg"), "no_conversion"),
    (dict(raw="x", action="adopt", target="odd", aggregation="sum", cadence="daily", source_unit="kg", target_unit="kg"), "target_outside_namespaces"),
    (dict(raw="x", action="adopt", target="custom_X", aggregation="sum", cadence="daily", source_unit="kg", target_unit="kg"), "target_outside_namespaces"),
    (dict(raw="x", action="adopt", target="custom_x", aggregation="sum", cadence="daily", source_unit="lb", target_unit="kg"), None), (dict(raw="x", action="map", target="energy_active"), "missing_unit"),
    (dict(raw="x", action="adopt", target="custom_x", aggregation="sum", cadence="daily", source_unit="kg", target_unit="m"), "no_conversion"), (dict(raw="x" * 129, action="keep"), "name_too_long"),
    (dict(raw="x", action="map", target="energy_active", source_unit="kJ", target_unit="kg"), "unit_not_of_metric"), (dict(raw="x", action="keep", source_unit="kg"), "target_not_allowed"), (dict(raw="x", action="discard", target="steps"), "target_not_allowed"),
])
def test_rules(rule, want):
    assert mapping.rule_error(**rule) == want


def test_custom_definitions_that_conflict_are_left_out(spark):
    rules = [("t", "adopt", "custom_a", "kg", "sum", "daily"), ("t", "adopt", "custom_a", "kg", "sum", "daily"), ("t", "adopt", "custom_b", "kg", "sum", "daily"), ("t", "adopt", "custom_b", "g", "sum", "daily")]
    got = mapping.custom_definitions(spark.createDataFrame(rules, "tenant_id string, action string, target_metric_type string, target_unit string, aggregation string, cadence string"))
    assert [r.metric_type for r in got.collect()] == ["custom_a"]


def test_policies(spark):
    own = spark.createDataFrame([("t", "steps", "odd", 7), ("t", "vo2_max", "hour", None)], "tenant_id string, metric_type string, resolution string, raw_retention_days int")
    got = {r.metric_type: (r.resolution, r.retention_days) for r in mapping.effective_policies(spark, own).collect()}
    assert len(got) == 145 and got["steps"] == ("minute", 7) and got["vo2_max"] == ("hour", None) and got["workout_steps"] == ("raw", None)


def test_session_backfill(spark):
    rows = [("s", '{"workout_id": "7", "x": 5, "o": {"y": [1], "session_id": null}}'), ("s", '{"session_id": "old", "workout_id": "7"}'), ("s", "{}")]
    got = mapping.tagged_sessions(spark.createDataFrame(rows, "source_id string, metadata string"), "workout_id").collect()
    assert [r.changed for r in got] == [True, False, False] and "backfill:" in got[0].metadata and got[1].metadata == rows[1][1] and got[2].metadata == "{}"
    kept = json.loads(got[0].metadata)
    assert kept.pop("session_id").startswith("backfill:") and kept == {"workout_id": "7", "x": 5, "o": {"y": [1], "session_id": None}}


def test_calendar(spark):
    ics = "\r\n".join([
        "BEGIN:VCALENDAR", "BEGIN:VEVENT", "UID:a", "SUMMARY:Stand", " up", "DTSTART:20260501T090000Z", "DTEND:20260501T091500Z", "RRULE:FREQ=WEEKLY;BYDAY=MO,FR;COUNT=5", "EXDATE:20260504T090000Z", "END:VEVENT",
        "BEGIN:VEVENT", "UID:a", "SUMMARY:Moved", "RECURRENCE-ID:20260508T090000Z", "DTSTART:20260508T150000Z", "DTEND:20260508T160000Z", "END:VEVENT",
        "BEGIN:VEVENT", "UID:b", "DTSTART;VALUE=DATE:20260531", "RRULE:FREQ=MONTHLY;UNTIL=20260831", "TRANSP:TRANSPARENT", "END:VEVENT", "END:VCALENDAR",
    ])
    got = sorted((r.start, r.summary, r.all_day) for r in occurrences(spark.createDataFrame([(ics,), (None,)], "ics string"), "2026-05-01", "2026-09-01").collect())
    d = dt.datetime
    assert got == [(d(2026, 5, 1, 9), "Standup", False), (d(2026, 5, 8, 15), "Moved", False), (d(2026, 5, 11, 9), "Standup", False), (d(2026, 5, 15, 9), "Standup", False), (d(2026, 5, 31), "", True), (d(2026, 7, 31), "", True), (d(2026, 8, 31), "", True)]
