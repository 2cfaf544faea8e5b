"""Workouts, samples and routes of health exports by hand."""

from __future__ import annotations

import json
import zipfile

from meterlake.sources.workouts import archive_elements, archive_workouts, health_workouts, route_fixes, workout_events

START = "2026-05-01 10:00:00 +0200"


def told(events):
    return {(r.metric_type, r.value, r.unit) for r in events.collect()}


def test_pushed_workouts(spark):
    beats = [{"date": "2026-05-01 10:01:00 +0200", "Avg": 100, "Min": 90, "Max": 120}, {"date": "2026-05-01 10:02:00 +0200", "qty": 140}, {"Avg": 1}, {"date": "2026-05-01 10:03:00 +0200"}]
    first = {"name": "Run", "start": START, "end": "2026-05-01 11:00:00 +0200", "duration": 3600, "totalEnergy": {"qty": 500, "units": "kcal"}, "activeEnergy": [{"qty": 3}], "distance": {"qty": 3, "units": "mi"}, "totalDistance": 9, "heartRateData": beats}
    second = {"id": "x", "workoutName": "Ride", "startDate": "2026-05-02T10:00:00Z", "activeEnergy": [{"qty": 3, "units": "kJ"}, {"qty": 4}], "basalEnergy": [{"qty": 1}], "heartRate": {"Avg": 120, "Max": 160}, "avgHeartRate": 121, "cyclingPower": [{"qty": 100}, {"Avg": 300}], "stepCount": []}
    payload = json.dumps({"data": {"workouts": [first, second, {"name": "no start"}]}})
    events = health_workouts(spark.createDataFrame([(payload,), ("no json",), (None,), ('{"data":{}}',)], "payload string"), "src").collect()
    by = {}
    for r in events:
        by.setdefault(json.loads(r.metadata)["workout_name"], set()).add((r.metric_type, r.value, r.unit, f"{r.timestamp:%H:%M}"))
    assert by["Run"] == {
        ("workout_energy", 500.0, "kcal", "08:00"), ("workout_distance", 3.0, "mi", "08:00"), ("workout_duration", 3600.0, "s", "08:00"),
        ("workout_heart_rate_average", 241 / 3, "", "08:00"), ("workout_heart_rate_max", 140.0, "", "08:00"),
        ("workout_heart_rate", 100.0, "bpm", "08:01"), ("workout_heart_rate", 140.0, "bpm", "08:02"),
    }
    assert by["Ride"] == {("workout_energy", 8.0, "kJ", "10:00"), ("workout_heart_rate_average", 121.0, "", "10:00"), ("workout_heart_rate_max", 160.0, "", "10:00"), ("workout_cycling_power", 200.0, "", "10:00")}
    assert len({json.loads(r.metadata)["session_id"] for r in events}) == 2


def test_a_payload_of_workouts_is_read_once(spark):
    events = health_workouts(spark.createDataFrame([("{}",)], "payload string"), "src")
    plan = events._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.lower().count("parsejson") == 1


EXPORT = f"""<?xml version="1.0"?><!DOCTYPE HealthData [<!ELEMENT HealthData ANY>]><HealthData>
<Record type="HKQuantityTypeIdentifierHeartRate" startDate="{START}" value="90" unit="count/min"/>
<Workout workoutActivityType="HKWorkoutActivityTypeTrailRunning" startDate="{START}" endDate="2026-05-01 11:00:00 +0200" duration="60" durationUnit="min">
 <MetadataEntry key="HKElevationAscended" value="12.5 cm"/><MetadataEntry key="HKAverageMETs" value="9"/><MetadataEntry key="HKIndoorWorkout" value="0"/>
 <WorkoutStatistics type="HKQuantityTypeIdentifierActiveEnergyBurned" sum="400" unit="kcal"/>
 <WorkoutStatistics type="HKQuantityTypeIdentifierHeartRate" average="150" maximum="180" unit="count/min"/>
 <WorkoutRoute><FileReference path="/workout-routes/one.gpx"/></WorkoutRoute></Workout>
<Workout workoutActivityType="HKWorkoutActivityTypeYoga" startDate="2026-05-02 10:00:00 +0200" totalEnergyBurned="80" totalEnergyBurnedUnit="kcal"><WorkoutStatistics type="HKQuantityTypeIdentifierActiveEnergyBurned" sum="70" unit="kcal"/></Workout>
<Workout workoutActivityType="HKWorkoutActivityTypeYoga"/></HealthData>"""
GPX = '<gpx xmlns="http://www.topografix.com/GPX/1/1"><trk><trkseg>{}</trkseg></trk></gpx>'
POINT = '<trkpt lat="{}" lon="11.5"><ele>520.5</ele><time>2026-05-01T08:0{}:00Z</time><extensions><speed>2.5</speed></extensions></trkpt>'


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "export.zip", "w") as z:
        z.writestr("apple/export.xml", EXPORT)
        z.writestr("apple/export_cda.xml", "<broken")
        z.writestr("apple/workout-routes/one.gpx", GPX.format("".join(POINT.format(48 + k / 10, k) for k in range(3)) + '<trkpt lat="1" lon="2"/>'))
        z.writestr("apple/workout-routes/two.gpx", GPX.format(POINT.format(50, 0)))
        z.writestr("apple/workout-routes/broken.gpx", GPX.format(POINT.format(51, 0))[:-12])
        z.writestr("apple/photo.jpg", b"\xff")
    (tmp_path / "other.zip").write_bytes(b"no archive")
    elements = archive_elements(spark, str(tmp_path))
    assert {r.member for r in elements.where("tag = 'problem'").collect()} == {None, "broken.gpx"}
    assert elements.where("tag = 'Record'").count() == 1
    workouts = archive_workouts(elements, "src")
    by = {}
    for r in workout_events(workouts).collect():
        by.setdefault(json.loads(r.metadata)["workout_name"], set()).add((r.metric_type, r.value, r.unit))
    assert by == {
        "trail_running": {("workout_duration", 60.0, "min"), ("workout_elevation_gain", 12.5, "cm"), ("physical_effort", 9.0, "MET"), ("workout_energy", 400.0, "kcal"), ("workout_heart_rate_average", 150.0, "count/min"), ("workout_heart_rate_max", 180.0, "count/min")},
        "yoga": {("workout_energy", 80.0, "kcal")},
    }
    fixes = sorted((r.member, r.latitude, r.altitude, r.speed, r.workout_name, r.session_id is not None, f"{r.timestamp:%H:%M}") for r in route_fixes(elements, workouts).collect())
    assert fixes == [("broken.gpx", 51.0, 520.5, 2.5, "route", False, "08:00"), *[("one.gpx", 48 + k / 10, 520.5, 2.5, "trail_running", True, f"08:0{k}") for k in range(3)], ("two.gpx", 50.0, 520.5, 2.5, "route", False, "08:00")]


def test_a_member_that_unpacks_to_too_much_is_told(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "export.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("export.xml", "<HealthData>" + '<Record type="x" value="1"/>' * 20_000 + "</HealthData>")
    got = archive_elements(spark, str(tmp_path), most_bytes=200_000).groupBy("tag").count().collect()
    assert {r.tag: r["count"] for r in got}["problem"] == 1 and 0 < {r.tag: r["count"] for r in got}["Record"] < 20_000
