"""Workouts of health exports: pushed as JSON, or in archives with their statistics, samples and routes."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree.ElementTree import ParseError, iterparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import activity_type, parsed_timestamp, slug
from ..operators.sessions import session_id

#: Fields of a pushed workout that state a quantity, and the metric of each; the first that has a value wins.
FIELDS = """
totalEnergy workout_energy | activeEnergyBurned workout_energy | activeEnergy workout_energy
distance workout_distance | totalDistance workout_distance | duration workout_duration
avgHeartRate workout_heart_rate_average | maxHeartRate workout_heart_rate_max
avgSpeed workout_speed_average | speed workout_speed_average | maxSpeed workout_speed_max
stepCadence workout_cadence | elevationUp workout_elevation_gain | elevationDown workout_elevation_loss
lapLength workout_lap_length | swimCadence workout_swim_cadence | totalSwimmingStrokeCount workout_swimming_strokes
flightsClimbed flights_climbed | intensity workout_intensity
heartRate.Avg workout_heart_rate_average | heartRate.Max workout_heart_rate_max
"""
#: Series of samples that stand for a quantity where no field states it; equal metrics of sums add up.
SERIES = """
sum: activeEnergy workout_energy | basalEnergy workout_energy | walkingAndRunningDistance workout_distance
sum: cyclingDistance workout_distance | swimDistance workout_distance | swimStroke workout_swimming_strokes | stepCount workout_steps
average: cyclingCadence workout_cycling_cadence | cyclingPower workout_cycling_power | cyclingSpeed workout_speed_average | heartRateData workout_heart_rate_average
max: heartRateData workout_heart_rate_max
"""
#: Attributes, metadata entries and statistics of a workout in an archive, in this order of preference.
ATTRIBUTES = "duration workout_duration | totalDistance workout_distance | totalEnergyBurned workout_energy"
METADATA = {
    "HKAverageMETs": ("physical_effort", "MET"),
    "HKElevationAscended": ("workout_elevation_gain", "m"),
    "HKElevationDescended": ("workout_elevation_loss", "m"),
    "HKMaximumSpeed": ("workout_speed_max", "m/s"),
    "HKLapLength": ("workout_lap_length", "m"),
    "WHOOP Strain": ("whoop_workout_strain", "index"),
}
STATISTICS = """
ActiveEnergyBurned.sum workout_energy | BasalEnergyBurned.sum workout_energy_resting
DistanceWalkingRunning.sum workout_distance | DistanceCycling.sum workout_distance | DistanceSwimming.sum workout_distance
DistanceDownhillSnowSports.sum workout_distance | HeartRate.average workout_heart_rate_average | HeartRate.maximum workout_heart_rate_max
RunningPower.average running_power | RunningSpeed.average running_speed | RunningStrideLength.average running_stride_length
RunningVerticalOscillation.average running_vertical_oscillation | RunningGroundContactTime.average running_ground_contact_time
SwimmingStrokeCount.sum workout_swimming_strokes | StepCount.sum workout_steps | WalkingSpeed.average walking_speed | StairAscentSpeed.average stair_ascent_speed
"""
VENDOR_TYPE = "HKQuantityTypeIdentifier"
MEASURE = "struct<metric_type:string,value:double,unit:string>"


def _pairs(table: str) -> list[tuple[str, str]]:
    return [(field, metric) for cell in table.replace("\n", "|").split("|") if cell.strip() for field, metric in [cell.split()]]


def _measure(metric: str, value: Column, unit: Column) -> Column:
    return F.struct(F.lit(metric).alias("metric_type"), value.alias("value"), F.coalesce(unit, F.lit("")).alias("unit")).cast(MEASURE)


def _bound(made: Column, used: Callable[[Column], Column]) -> Column:
    """What ``used`` makes of a value that is made once: the only element of an array is bound to a name."""
    return F.get(F.transform(F.array(made), used), F.lit(0))


def first_of_each(measures: Column) -> Column:
    """Of measures with a value those whose metric none before them has."""

    def firsts(there: Column) -> Column:
        return F.filter(there, lambda m, i: ~F.exists(F.slice(there, 1, i), lambda e: e["metric_type"] == m["metric_type"]))

    return _bound(F.filter(measures, lambda m: m["value"].isNotNull()), firsts)


def _unfolded(workouts: DataFrame) -> DataFrame:
    """One event for each of a workout's measures, at its start."""
    rows = workouts.select(F.col("start").alias("timestamp"), F.to_json(F.struct("session_id", "workout_name", "activity_type", "session_start", "session_end")).alias("metadata"), F.explode("measures").alias("m"))
    return rows.select("m.metric_type", "timestamp", "m.value", "m.unit", "metadata")


def _sessions(workouts: DataFrame, source: Column) -> DataFrame:
    """Adds what ties a workout's points together; ``start`` and ``end`` are times, ``stated_id`` may be null."""
    shown = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    identity = F.coalesce("stated_id", shown("start"))
    return workouts.withColumns({"session_id": session_id(F.lit("health"), source, identity, F.coalesce("workout_name", F.lit(""))), "activity_type": activity_type(F.coalesce("workout_name", F.lit(""))), "session_start": shown("start"), "session_end": shown("end")})


def pushed_workouts(payloads: DataFrame) -> DataFrame:
    """The workouts of JSON payloads (``payload``): names, times, measures and pulse samples, in columns.

    A field may be a number or an object with qty and units; a series is an array of samples, of which Avg or qty is the
    value. A stated figure goes before a series' own. A workout without a start, or what isn't JSON, is left out."""
    number = lambda v, path: F.coalesce(F.try_variant_get(v, path, "double"), F.try_variant_get(v, f"{path}.qty", "double"))
    listed = payloads.select(F.try_variant_get(F.try_parse_json("payload"), "$.data.workouts", "array<variant>").alias("ws"))
    # An inner explode would have its list tested for being empty below, which makes it three times.
    rows = listed.select(F.explode_outer("ws").alias("w"))
    told = lambda *paths: F.coalesce(*[F.try_variant_get("w", f"$.{p}", "string") for p in paths])
    samples = lambda field: F.try_variant_get("w", f"$.{field}", "array<variant>")
    sample = lambda s: F.coalesce(F.try_variant_get(s, "$.Avg", "double"), F.try_variant_get(s, "$.qty", "double"))
    stated = []
    for field, metric in _pairs(FIELDS):
        unit = F.try_variant_get("w", f"$.{field.split('.')[0]}.units", "string")
        stated.append(_measure(metric, number("w", f"$.{field}"), F.coalesce(unit, F.lit("s")) if field == "duration" else unit))
    folded: dict[tuple[str, str], list[str]] = {}
    for line in SERIES.strip().splitlines():
        how, _, cells = line.partition(": ")
        for field, metric in _pairs(cells):
            folded.setdefault((how, metric), []).append(field)

    def series(how: str) -> Callable[[Column], Column]:
        sums = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
        folds = {"max": F.array_max, "sum": sums, "average": lambda v: sums(v) / F.size(v)}
        most = lambda s: F.coalesce(F.try_variant_get(s, "$.Max", "double"), sample(s))

        def told_by(every: Column) -> Column:
            values = F.array_compact(F.transform(every, most if how == "max" else sample))
            return F.struct(_bound(values, lambda v: F.when(F.size(v) > 0, folds[how](v))).alias("value"), F.try_variant_get(F.get(every, F.lit(0)), "$.units", "string").alias("unit"))

        return told_by

    def as_measure(metric: str) -> Callable[[Column], Column]:
        return lambda t: _measure(metric, t["value"], t["unit"])

    for (how, metric), fields in folded.items():
        lists = [samples(f) for f in fields]
        every = lists[0] if len(lists) == 1 else F.flatten(F.array_compact(F.array(*lists)))
        stated.append(_bound(_bound(every, series(how)), as_measure(metric)))
    beats = F.transform(samples("heartRateData"), lambda s: F.struct(parsed_timestamp(F.coalesce(F.try_variant_get(s, "$.date", "string"), F.try_variant_get(s, "$.timestamp", "string"))).alias("at"), sample(s).alias("value"), F.try_variant_get(s, "$.Min", "double").alias("bucket_min"), F.try_variant_get(s, "$.Max", "double").alias("bucket_max")))
    return rows.select(
        told("id").alias("stated_id"),
        told("name", "workoutName").alias("workout_name"),
        parsed_timestamp(told("start", "startDate")).alias("start"),
        parsed_timestamp(told("end", "endDate")).alias("end"),
        F.array(*stated).alias("measures"),
        beats.alias("beats"),
    ).where("start IS NOT NULL").withColumn("measures", first_of_each(F.col("measures")))


def health_workouts(payloads: DataFrame, source: str) -> DataFrame:
    """Events of pushed workouts: their measures, and each sample of the pulse at its own time (workout_heart_rate).
    Samples without a time or a value give none."""
    workouts = _sessions(pushed_workouts(payloads), F.lit(source))
    start = F.col("start")
    event = lambda metric, at, value, unit, low, high: F.struct(metric.alias("metric_type"), at.alias("timestamp"), value.alias("value"), unit.alias("unit"), low.alias("bucket_min"), high.alias("bucket_max"), F.lit(at is not start).alias("beat"))
    none = F.lit(None).cast("double")
    measures = F.transform("measures", lambda m: event(m["metric_type"], start, m["value"], m["unit"], none, none))
    usable = F.filter(F.coalesce("beats", F.array()), lambda b: b["at"].isNotNull() & b["value"].isNotNull())
    beats = F.transform(usable, lambda b: event(F.lit("workout_heart_rate"), b["at"], b["value"], F.lit("bpm"), b["bucket_min"], b["bucket_max"]))
    own = F.to_json(F.struct("session_id", "workout_name", "activity_type", "session_start", "session_end"))
    rows = workouts.select("session_id", "workout_name", own.alias("_own"), F.explode_outer(F.concat(measures, beats)).alias("e")).where("e IS NOT NULL")
    meta = F.when(F.col("e.beat"), F.to_json(F.struct("session_id", "workout_name", "e.bucket_min", "e.bucket_max"))).otherwise(F.col("_own"))
    return rows.select("e.metric_type", "e.timestamp", "e.value", "e.unit", meta.alias("metadata"))


ELEMENTS = "archive string, member string, tag string, attributes map<string,string>, children array<struct<tag:string,attributes:map<string,string>>>"
_ATTRIBUTES = pa.map_(pa.string(), pa.string())
_ELEMENT = pa.schema([("archive", pa.string()), ("member", pa.string()), ("tag", pa.string()), ("attributes", _ATTRIBUTES), ("children", pa.list_(pa.struct([("tag", pa.string()), ("attributes", _ATTRIBUTES)])))])
WANTED = {"Record", "Workout", "trkpt"}


class _Bounded(io.RawIOBase):
    """What a member holds, up to a bound of bytes that count as they come, not as the archive states them."""

    def __init__(self, inner: io.BufferedIOBase, most: int):
        self.inner, self.left = inner, most

    def read(self, size: int = -1) -> bytes:
        data = self.inner.read(min(size if size > 0 else 1 << 16, 1 << 16))
        self.left -= len(data)
        if self.left < 0:
            raise ValueError("too large")
        return data


def _elements(member: io.RawIOBase) -> Iterator[tuple[str, dict[str, str], list[tuple[str, dict[str, str]]]]]:
    """Records, workouts and track points of an XML text as they end; what has been read is let go."""
    bare = lambda e: e.tag.rsplit("}", 1)[-1]
    path = []
    for event, e in iterparse(member, events=("start", "end")):
        if event == "start":
            path.append(e)
            continue
        path.pop()
        if bare(e) in WANTED:
            parts = [c for c in e.iter() if c is not e]
            yield bare(e), dict(e.attrib), [(bare(c), dict(c.attrib) | ({"": c.text.strip()} if c.text and c.text.strip() else {})) for c in parts]
        if not any(bare(p) in WANTED for p in path):
            e.clear()
            if path:
                path[-1].remove(e)


def archive_elements(spark: SparkSession, path: str, most_bytes: int = 8 << 30) -> DataFrame:
    """Records, workouts and track points in the XML and GPX members of ZIP archives, a row each.

    An archive is one row of Spark's binary source (2 GB at most); its members are unpacked as a stream and
    leave a task element by element. A member that can't be read, or is larger than ``most_bytes`` once unpacked,
    gives what came before that and a row with the tag "problem"; so does a file that is no archive."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held: list[dict] = []
                for row in _unpacked(archive, io.BytesIO(content.as_buffer()), most_bytes):
                    held.append(dict(zip(_ELEMENT.names, row, strict=True)))
                    if len(held) == 1000:
                        yield pa.RecordBatch.from_pylist(held, _ELEMENT)
                        held = []
                yield pa.RecordBatch.from_pylist(held, _ELEMENT)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return files.mapInArrow(told, ELEMENTS)


def _unpacked(archive: str, content: io.BytesIO, most_bytes: int) -> Iterator[tuple]:
    try:
        opened = zipfile.ZipFile(content)
    except zipfile.BadZipFile as wrong:
        yield archive, None, "problem", [("", str(wrong))], []
        return
    for info in opened.infolist():
        name = info.filename.rsplit("/", 1)[-1]
        if info.is_dir() or not name.lower().endswith((".gpx", ".xml")) or name.lower().endswith("_cda.xml"):
            continue
        try:
            with opened.open(info) as member:
                for tag, attributes, children in _elements(_Bounded(member, most_bytes)):
                    yield archive, name, tag, list(attributes.items()), [{"tag": t, "attributes": list(a.items())} for t, a in children]
        except (ParseError, ValueError, zipfile.BadZipFile, OSError) as wrong:
            yield archive, name, "problem", [("", str(wrong)[:200])], []


def archive_workouts(elements: DataFrame, source: str) -> DataFrame:
    """The workouts of archives with their measures, session and names of route files. Attributes go before
    metadata, these before statistics."""
    rows = elements.where("tag = 'Workout'")
    given = lambda key: F.try_element_at("attributes", F.lit(key))
    quantity = r"^\s*([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s*(.*)$"
    of_child = lambda tag, key, name: F.get(F.filter("children", lambda c: (c["tag"] == tag) & (F.try_element_at(c["attributes"], F.lit(key)) == name)), F.lit(0))["attributes"]
    measures = [_measure(metric, given(field).try_cast("double"), given(f"{field}Unit")) for field, metric in _pairs(ATTRIBUTES)]
    for key, (metric, unit) in METADATA.items():
        text = F.try_element_at(of_child("MetadataEntry", "key", key), F.lit("value"))
        measures.append(_measure(metric, F.regexp_extract(text, quantity, 1).try_cast("double"), F.coalesce(F.nullif(F.trim(F.regexp_extract(text, quantity, 2)), F.lit("")), F.lit(unit))))
    for field, metric in _pairs(STATISTICS):
        name, how = field.split(".")
        own = of_child("WorkoutStatistics", "type", f"{VENDOR_TYPE}{name}")
        measures.append(_measure(metric, F.try_element_at(own, F.lit(how)).try_cast("double"), F.try_element_at(own, F.lit("unit"))))
    files = F.transform(F.filter("children", lambda c: c["tag"] == "FileReference"), lambda c: F.substring_index(F.try_element_at(c["attributes"], F.lit("path")), "/", -1))
    name = slug(F.regexp_replace(F.regexp_replace(given("workoutActivityType"), "^HKWorkoutActivityType", ""), "(?<=[a-z])(?=[A-Z])", "_"))
    told = rows.select("archive", F.lit(None).cast("string").alias("stated_id"), name.alias("workout_name"), parsed_timestamp(given("startDate")).alias("start"), parsed_timestamp(given("endDate")).alias("end"), first_of_each(F.array(*measures)).alias("measures"), files.alias("files"))
    return _sessions(told.where("start IS NOT NULL"), F.lit(source))


def workout_events(workouts: DataFrame) -> DataFrame:
    return _unfolded(workouts)


def route_fixes(elements: DataFrame, workouts: DataFrame) -> DataFrame:
    """Track points with the session of the workout that names their file, or none: a route that no workout claims is kept.
    A file that several name is that of the first session."""
    child = lambda tag: F.try_element_at(F.get(F.filter("children", lambda c: c["tag"] == tag), F.lit(0))["attributes"], F.lit(""))
    given = lambda key: F.try_element_at("attributes", F.lit(key)).try_cast("double")
    points = elements.where("tag = 'trkpt'").select("archive", "member", parsed_timestamp(child("time")).alias("timestamp"), given("lat").alias("latitude"), given("lon").alias("longitude"), child("ele").try_cast("double").alias("altitude"), child("speed").try_cast("double").alias("speed"))
    owners = workouts.select("archive", F.explode("files").alias("member"), "session_id", "workout_name").groupBy("archive", "member").agg(F.min(F.struct("session_id", "workout_name")).alias("_s"))
    fixes = points.where("timestamp IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL")
    return fixes.join(owners, ["archive", "member"], "left").select(*[c for c in points.columns if c != "archive"], "_s.session_id", F.coalesce("_s.workout_name", F.lit("route")).alias("workout_name"))
