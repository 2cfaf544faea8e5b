"""Times, sessions, calendars, ranges and fields by hand."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from meterlake.functions.text import activity_words, parsed_timestamp
from meterlake.operators.intervals import subtract
from meterlake.operators.mapping import tagged_sessions
from meterlake.sources.calendars import occurrences
from meterlake.sources.fields import collected_fields, unmapped


def test_times(spark):
    utc = {
        "2024-01-01T00:00:00.123456+00:00": "2024-01-01 00:00:00.123456",
        "2024-01-01 00:00:00+02:00": "2023-12-31 22:00:00.000000",
        "2024-01-01 00:00:00 +0200": "2023-12-31 22:00:00.000000",
        "2024-01-01T00:00:00-0530": "2024-01-01 05:30:00.000000",
        "2024-01-01T00:00:00": "2024-01-01 00:00:00.000000",
        "2024-01-01T10:20": "2024-01-01 10:20:00.000000",
        "2024-01-01T10:20+02:00": "2024-01-01 08:20:00.000000",
        " 2024-01-01 ": "2024-01-01 00:00:00.000000",
        "2024-06-01T00:00:00Z": "2024-06-01 00:00:00.000000",
    }
    none = ["10:20:00", "2024", "2024-01", "soon", "", "2024-13-01", "2024-01-01x", None]
    rows = spark.createDataFrame([(x,) for x in [*utc, *none]], "raw string")
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    got = {r.raw: (r.a, r.b) for r in rows.select("raw", shown(parsed_timestamp(F.col("raw"))).alias("a"), shown(parsed_timestamp(F.col("raw"), "Europe/Berlin")).alias("b")).collect()}
    assert {x: got[x][0] for x in got} == utc | dict.fromkeys(none)
    assert got["2024-01-01T00:00:00"][1] == "2023-12-31 23:00:00.000000" == got[" 2024-01-01 "][1]
    assert got["2024-06-01T00:00:00Z"][1] == "2024-06-01 00:00:00.000000"


@pytest.mark.parametrize(("raw", "words"), [("HKWorkoutActivityTypeHighIntensity", "high intensity"), ("Straßen-Läufe2Go", "strassen laeufe2 go"), ("ABCRun", "abcrun"), ("x.Y_z", "x y z"), ("ÜberGroß", "ueber gross"), ("", "")])
def test_words_of_activities(spark, raw, words):
    assert " ".join(spark.range(1).select(activity_words(F.lit(raw)).alias("w")).first().w) == words


def test_sessions_are_told_by_their_own_member(spark):
    texts = ['{"workout_id":"7","o":{"session_id":null,"k":1}}', '{"workout_id":"7","session_id":null}', '{"workout_id":"7","session_id":"x"}', '{"k":1}', " { \"workout_id\" : 7 }", "[1]", None]
    rows = spark.createDataFrame([("s", t) for t in texts], "source_id string, metadata string")
    got = tagged_sessions(rows, "workout_id").collect()
    assert [r.changed for r in got] == [True, False, False, False, True, False, False]
    assert got[0].metadata.endswith('","workout_id":"7","o":{"session_id":null,"k":1}}') and got[0].metadata.startswith('{"session_id":"backfill:')
    assert [r.metadata for r in got[1:4]] == texts[1:4] and [r.metadata for r in got[5:]] == texts[5:]


def test_holes_in_several_ranges_of_a_key(spark):
    at = lambda d, h=0: dt.datetime(2024, 1, d, h)
    schema = "k string, start timestamp_ntz, end timestamp_ntz"
    outer = spark.createDataFrame([("a", at(1), at(3)), ("a", at(6), at(9)), ("a", at(6), at(9)), ("a", at(8), at(10)), ("b", at(1), at(2)), ("b", at(5), at(5))], schema)
    holes = spark.createDataFrame([("a", at(1, 12), at(2)), ("a", at(2, 12), at(7)), ("b", at(1), at(2))], schema)
    got = sorted((r.k, r.start, r.end) for r in subtract(outer, holes, "k").collect())
    assert got == [("a", at(1), at(1, 12)), ("a", at(2), at(2, 12)), ("a", at(7), at(9)), ("a", at(8), at(10))]


def feed(*events):
    return "BEGIN:VCALENDAR\r\n" + "".join(f"BEGIN:VEVENT\r\n{e.strip()}\r\nEND:VEVENT\r\n".replace("\n", "\r\n").replace("\r\r", "\r") for e in events) + "END:VCALENDAR\r\n"


def begins(spark, ics, start="2026-01-01", end="2027-01-01", **more):
    got = occurrences(spark.createDataFrame([(ics,)], "ics string"), start, end, **more).collect()
    return sorted(f"{r.start:%m-%d %H:%M}" for r in got if r.start), [(r.uid, r.problem) for r in got if r.problem]


def test_calendars_in_zones(spark):
    ics = feed("UID:1\nDTSTART;TZID=Europe/Berlin:20260301T090000\nDTEND;TZID=Europe/Berlin:20260301T100000\nRRULE:FREQ=MONTHLY;BYDAY=2MO;COUNT=3")
    assert begins(spark, ics) == (["03-09 08:00", "04-13 07:00", "05-11 07:00"], [])
    ics = feed("UID:1\nDTSTART;TZID=Europe/Berlin:20260130T090000\nRRULE:FREQ=MONTHLY;BYDAY=-1FR;UNTIL=20260327T080000Z\nEXDATE;TZID=Europe/Berlin:20260227T090000")
    assert begins(spark, ics)[0] == ["01-30 08:00", "03-27 08:00"]
    ics = feed("UID:1\nDTSTART:20260131T000000Z\nRRULE:FREQ=MONTHLY;BYMONTHDAY=-1;COUNT=3", "UID:2\nDTSTART:20260105T000000Z\nRRULE:FREQ=MONTHLY;BYDAY=MO,TU,WE,TH,FR;BYSETPOS=-1;COUNT=2")
    assert begins(spark, ics)[0] == ["01-30 00:00", "01-31 00:00", "02-27 00:00", "02-28 00:00", "03-31 00:00"]
    ics = feed("UID:1\nDTSTART;VALUE=DATE:20260501\nSUMMARY:Holi\n day", "UID:2\nDTSTART:20260501T100000\nDURATION:PT30M\nBEGIN:VALARM\nDURATION:PT5M\nEND:VALARM")
    assert begins(spark, ics, zone="America/New_York")[0] == ["05-01 04:00", "05-01 14:00"]


def test_moved_and_added_occurrences_and_the_window(spark):
    ics = feed("UID:1\nDTSTART:20260101T100000Z\nRRULE:FREQ=DAILY;COUNT=4\nRDATE:20260110T100000Z", "UID:1\nRECURRENCE-ID:20260102T100000Z\nDTSTART:20260102T150000Z", "UID:2\nDTSTART:20251231T230000Z\nDTEND:20260101T010000Z")
    assert begins(spark, ics)[0] == ["01-01 10:00", "01-02 15:00", "01-03 10:00", "01-04 10:00", "01-10 10:00", "12-31 23:00"]


def test_what_cannot_be_read_is_told(spark):
    ics = feed("UID:bad\nDTSTART:2026-05-01", "UID:good\nDTSTART:20260501T100000Z", "UID:rule\nDTSTART:20260501T100000Z\nRRULE:FREQ=SOMETIMES", "UID:none\nSUMMARY:x")
    got, problems = begins(spark, ics)
    assert got == ["05-01 10:00"] and {u for u, _ in problems} == {"bad", "rule", "none"}
    assert begins(spark, "<html>") == ([], [(None, "not a calendar")])
    many, problems = begins(spark, feed("UID:m\nDTSTART:20260101T000000Z\nRRULE:FREQ=MINUTELY"))
    assert len(many) == 10_000 and problems == [("m", "more than 10000 occurrences")]


def test_fields(spark):
    texts = ['{"a": 1, "b": [{"c": null}, {"c": "x"}, 2, [true]], "d": {}, "e": []}', '{"a": 1.5, "b": {"c": 1}}', "[{\"a\": 2}]", "7", "no json", None, "", '{"a": "x"}']
    got = collected_fields(spark.createDataFrame([(t,) for t in texts], "payload string"))
    told = {(r.path, r.kind): (r.n, r.documents) for r in got.collect()}
    assert told == {
        ("a", "number"): (2, 2), ("a", "string"): (1, 1), ("b", "array"): (1, 1), ("b", "object"): (1, 1), ("d", "object"): (1, 1), ("e", "array"): (1, 1),
        ("b[]", "object"): (2, 1), ("b[]", "number"): (1, 1), ("b[]", "array"): (1, 1), ("b[].c", "null"): (1, 1), ("b[].c", "string"): (1, 1),
        ("b[][]", "boolean"): (1, 1), ("b.c", "number"): (1, 1), ("[]", "object"): (1, 1), ("[].a", "number"): (1, 1),
    }
    mapped = spark.createDataFrame([("a",), ("b",)], "path string")
    assert {r.path for r in unmapped(got, mapped).collect()} == {p for p, _ in told} - {"a", "b"}
    assert collected_fields(spark.createDataFrame([("1",), (None,)], "payload string")).count() == 0
