"""What providers send, as canonical events: metric_type, timestamp, value, unit and metadata (JSON).

Each function takes a DataFrame of payloads (one JSON text in the column ``payload`` for each row) or files,
and returns events. Times are those of the provider, in UTC; a value that isn't one gives no event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.registry import converted
from ..functions.text import numeric_state, parsed_timestamp, slug

#: A provider's fields, and the metric and unit of each.
WEATHER = {
    "temperature_2m": ("weather_temperature", "°C"),
    "apparent_temperature": ("weather_temperature_apparent", "°C"),
    "relative_humidity_2m": ("weather_humidity", "%"),
    "precipitation": ("weather_precipitation", "mm"),
    "surface_pressure": ("weather_pressure", "hPa"),
    "wind_speed_10m": ("weather_wind_speed", "km/h"),
    "cloud_cover": ("weather_cloud_cover", "%"),
    "uv_index": ("weather_uv_index", "index"),
}
RECOVERY = {
    "recovery_score": ("whoop_recovery_score", "%"),
    "resting_heart_rate": ("heart_rate_resting", "bpm"),
    "hrv_rmssd_milli": ("hrv_rmssd", "ms"),
    "spo2_percentage": ("blood_oxygen", "%"),
    "skin_temp_celsius": ("skin_temperature", "°C"),
}
SLEEP = {"qty": "sleep_duration", "deep": "sleep_duration_deep", "rem": "sleep_duration_rem", "core": "sleep_duration_light", "awake": "sleep_duration_awake"}
CSV_HEADERS = {
    "Cycle start time": "start", "Startzeit des Zyklus": "start",
    "Recovery score %": "recovery_score", "Erholungswert %": "recovery_score",
    "Resting heart rate (bpm)": "resting_heart_rate", "Ruheherzfrequenz (bpm)": "resting_heart_rate",
    "Heart rate variability (ms)": "hrv_rmssd_milli", "Herzfrequenzvariabilität (ms)": "hrv_rmssd_milli",
    "Skin temp (celsius)": "skin_temp_celsius", "Hauttemperatur (Celsius)": "skin_temp_celsius",
    "Blood oxygen %": "spo2_percentage", "Blutsauerstoff %": "spo2_percentage",
}


def _measured(rows: DataFrame, at: Column, fields: dict[str, tuple[str, str]], of: str = "", metadata: Column | None = None) -> DataFrame:
    """One event for each field that has a number; all of a row have its metadata."""
    one = lambda f, m, u: F.struct(F.lit(m).alias("metric_type"), F.col(f"{of}{f}").cast("double").alias("value"), F.lit(u).alias("unit"))
    meta = F.lit("{}") if metadata is None else metadata
    long = rows.select(at.alias("timestamp"), meta.alias("metadata"), F.explode(F.array(*[one(f, m, u) for f, (m, u) in fields.items()])).alias("e"))
    return long.where("e.value IS NOT NULL").select("e.metric_type", "timestamp", "e.value", "e.unit", "metadata")


def weather(payloads: DataFrame) -> DataFrame:
    """Hours in columns: arrays of times and of each variable stand side by side."""
    fields = ", ".join(f"{f}: array<double>" for f in WEATHER)
    hourly = payloads.select(F.from_json("payload", f"hourly struct<time: array<string>, {fields}>").alias("p")).select("p.hourly.*")
    there = hourly.select("time", *[F.coalesce(f, F.array().cast("array<double>")).alias(f) for f in WEATHER])
    rows = there.select(F.inline(F.arrays_zip("time", *WEATHER)))
    return _measured(rows, parsed_timestamp(F.col("time")), WEATHER)


def home_states(payloads: DataFrame) -> DataFrame:
    """Lists of lists of states; each entity is a metric of its own, named by its id without the domain."""
    entity = F.btrim(F.lower(F.regexp_replace(F.regexp_replace("entity_id", r"^[^.]*\.", ""), r"[^\p{L}\p{N}]", "_")), F.lit("_"))
    state = "entity_id: string, state: string, last_changed: string, last_updated: string, attributes: struct<unit_of_measurement: string>"
    rows = payloads.select(F.explode(F.flatten(F.from_json("payload", f"array<array<struct<{state}>>>"))).alias("s")).select("s.*")
    value = numeric_state(F.col("state"))
    return rows.where(value.isNotNull()).select(
        F.concat(F.lit("home_assistant_"), F.coalesce(F.nullif(entity, F.lit("")), F.lit("unknown"))).alias("metric_type"),
        parsed_timestamp(F.coalesce("last_changed", "last_updated")).alias("timestamp"),
        value.alias("value"),
        F.coalesce("attributes.unit_of_measurement", F.lit("")).alias("unit"),
        F.to_json(F.struct("entity_id")).alias("metadata"),
    )


def health_export(payloads: DataFrame) -> DataFrame:
    """Metrics with their samples; a night of sleep is up to five metrics."""
    metric = payloads.select(F.explode(F.from_json("payload", "data struct<metrics: array<struct<name: string, units: string, data: array<map<string, string>>>>>")["data"]["metrics"]).alias("m"))
    rows = metric.select("m.name", "m.units", F.explode("m.data").alias("d"))
    given = lambda field: F.try_element_at("d", F.lit(field))
    at = parsed_timestamp(given("date"))
    asleep = F.col("name") == "sleep_analysis"
    nights = rows.where(asleep).withColumns({f: given(f).try_cast("double") for f in SLEEP})
    hours = _measured(nights, at, {f: (m, "h") for f, m in SLEEP.items()})
    minutes = converted(hours.withColumn("target", F.lit("min")), "value", "unit", "target").select("metric_type", "timestamp", F.col("converted").alias("value"), F.col("target").alias("unit"), "metadata")
    value = F.coalesce(*[given(f).try_cast("double") for f in ("qty", "avg", "Avg")])
    others = rows.where(~asleep & value.isNotNull()).select(F.col("name").alias("metric_type"), at.alias("timestamp"), value.alias("value"), F.col("units").alias("unit"), F.to_json(F.struct(given("source").alias("source"))).alias("metadata"))
    return minutes.unionByName(others)


def strength_log(payloads: DataFrame) -> DataFrame:
    """Workouts and their sets: up to four measures of a set, and two totals of a session."""
    exercise = "exercise: struct<id: string, title: string, category: string>"
    workout = f"id: string, title: string, createdAt: string, sets: array<struct<id: string, setNumber: int, weight: double, reps: double, maxPulse: double, createdAt: string, {exercise}>>"
    workouts = payloads.select(F.explode(F.from_json("payload", f"workouts array<struct<{workout}>>")["workouts"]).alias("w")).select("w.*")
    sets = workouts.select(F.col("id").alias("session_id"), F.explode("sets").alias("s"))
    meta = F.to_json(F.struct("session_id", F.col("s.exercise.title").alias("exercise_title"), F.col("s.exercise.category").alias("muscle_group"), F.col("s.id").alias("set_id"), F.col("s.setNumber").alias("set_number")))
    measures = {"strength_set_weight": (F.col("s.weight"), "kg"), "strength_set_reps": (F.col("s.reps"), "count"), "strength_set_volume": (F.col("s.weight") * F.col("s.reps"), "kg"), "strength_set_heart_rate_max": (F.col("s.maxPulse"), "bpm")}
    each = F.array(*[F.struct(F.lit(m).alias("metric_type"), v.alias("value"), F.lit(u).alias("unit")) for m, (v, u) in measures.items()])
    of_sets = sets.select(parsed_timestamp(F.col("s.createdAt")).alias("timestamp"), F.explode(each).alias("e"), meta.alias("metadata")).where("e.value IS NOT NULL").select("e.metric_type", "timestamp", "e.value", "e.unit", "metadata")
    volume = F.aggregate("sets", F.lit(0.0), lambda a, s: a + F.coalesce(s["weight"] * s["reps"], F.lit(0.0)))
    totals = F.array(F.struct(F.lit("strength_session_volume").alias("metric_type"), volume.alias("value"), F.lit("kg").alias("unit")), F.struct(F.lit("strength_session_sets").alias("metric_type"), F.size("sets").cast("double").alias("value"), F.lit("count").alias("unit")))
    of_sessions = workouts.select(parsed_timestamp(F.col("createdAt")).alias("timestamp"), F.explode(totals).alias("e"), F.to_json(F.struct(F.col("id").alias("session_id"), F.col("title").alias("workout_title"))).alias("metadata"))
    return of_sets.unionByName(of_sessions.select("e.metric_type", "timestamp", "e.value", "e.unit", "metadata"))


#: Fields of a record's score by the kind of record, and the metric and unit of each.
RECORDS = {
    "cycle": {"strain": ("whoop_strain", "index"), "kilojoule": ("energy_total", "kJ"), "average_heart_rate": ("heart_rate_average", "bpm"), "max_heart_rate": ("heart_rate_max", "bpm")},
    "recovery": RECOVERY,
    "sleep": {"sleep_performance_percentage": ("whoop_sleep_performance", "%"), "sleep_efficiency_percentage": ("sleep_efficiency", "%"), "respiratory_rate": ("respiratory_rate", "breaths/min")},
    "workout": {
        "strain": ("whoop_workout_strain", "index"), "kilojoule": ("workout_energy", "kJ"), "average_heart_rate": ("workout_heart_rate_average", "bpm"),
        "distance_meter": ("workout_distance", "m"), "max_heart_rate": ("workout_heart_rate_max", "bpm"), "altitude_gain_meter": ("workout_elevation_gain", "m"),
    },
}
#: Times in zones of the pulse; that below the first is part of the whole, but no zone.
ZONES = ("zone_zero_milli", "zone_one_milli", "zone_two_milli", "zone_three_milli", "zone_four_milli", "zone_five_milli")


def interval_minutes(start: Column, end: Column) -> Column:
    """Minutes from one time to a later one; null if it isn't later."""
    return F.when(end > start, F.timestamp_diff("MICROSECOND", start, end) / 60e6)


#: Fixed value: 1/4.184, cut after ten digits. The whole quotient takes exact halves of a decimal (5.23 kJ are 1.25 kcal)
#: up or down as a double happens to fall; with this one all of them go down.
KCAL_OF_KJ = 0.2390057361


def in_kilocalories(events: DataFrame) -> DataFrame:
    """Events of energy in kcal, with one decimal, where they are in kJ. Halves of a decimal go down."""
    joules = F.col("unit") == "kJ"
    return events.withColumns({"value": F.when(joules, F.round(F.col("value") * KCAL_OF_KJ, 1)).otherwise(F.col("value")), "unit": F.when(joules, "kcal").otherwise(F.col("unit"))})


def recovery(payloads: DataFrame, kind: str = "recovery") -> DataFrame:
    """Records of a kind (cycle, recovery, sleep, workout) that have been scored, energy in kcal.

    A workout also has its minutes from start to end, and the share of each zone of the pulse in the time of all zones
    that are stated, the one below the first included."""
    fields = RECORDS[kind]
    numbers = ", ".join(f"{f}: double" for f in fields)
    zones = f", zone_duration: struct<{', '.join(f'{z}: double' for z in ZONES)}>" if kind == "workout" else ""
    rows = payloads.select(F.explode(F.from_json("payload", f"array<struct<id: string, score_state: string, start: string, end: string, score: struct<{numbers}{zones}>>>")).alias("r")).select("r.*")
    scored = rows.where("score_state = 'SCORED'")
    at = parsed_timestamp(F.col("start"))
    found = in_kilocalories(_measured(scored, at, fields, "score."))
    if kind != "workout":
        return found
    total = sum((F.coalesce(F.col(f"score.zone_duration.{z}"), F.lit(0.0)) for z in ZONES), F.lit(0.0))
    shares = {f"_share{k}": F.when(total > 0, F.col(f"score.zone_duration.{z}") / total * 100) for k, z in enumerate(ZONES) if k}
    derived = scored.withColumns(shares | {"_minutes": interval_minutes(at, parsed_timestamp(F.col("end"))), "_total": total})
    meta = F.to_json(F.struct(F.lit("share").alias("derived_by"), F.col("_total").alias("zone_total_ms"), F.col("score.zone_duration.zone_zero_milli").alias("zone_below_one_ms")))
    zoned = _measured(derived, at, {f"_share{k}": (f"workout_heart_rate_zone_{k}", "%") for k in range(1, len(ZONES))}, metadata=meta)
    timed = _measured(derived, at, {"_minutes": ("workout_duration", "min")}, metadata=F.lit('{"derived_by":"difference"}'))
    return found.unionByName(timed).unionByName(zoned)


def recovery_csv(spark: SparkSession, path: str) -> DataFrame:
    """The same from an exported table, with English or German headers."""
    table = spark.read.csv(path, header=True)
    known = table.select(*[F.col(f"`{c}`").alias(CSV_HEADERS[c]) for c in table.columns if c in CSV_HEADERS])
    there = {f: m for f, m in RECOVERY.items() if f in known.columns}
    numbers = known.withColumns({f: F.col(f).try_cast("double") for f in there})
    return _measured(numbers, parsed_timestamp(F.col("start")), there)


def gps_fixes(payloads: DataFrame) -> DataFrame:
    """Three events for each fix: that it was, its latitude and its longitude."""
    fix = "id: string, latitude: string, longitude: string, altitude: double, speed: double, timestamp: string"
    rows = payloads.select(F.explode(F.from_json("payload", f"array<struct<{fix}>>")).alias("f")).select("f.*")
    at = F.coalesce(F.timestamp_seconds(F.col("timestamp").try_cast("long")), parsed_timestamp(F.col("timestamp")))
    placed = rows.withColumns({"latitude": F.col("latitude").try_cast("double"), "longitude": F.col("longitude").try_cast("double"), "at": at, "one": F.lit(1.0)}).where("latitude IS NOT NULL AND longitude IS NOT NULL")
    meta = F.to_json(F.struct("latitude", "longitude", "altitude", "speed"))
    return _measured(placed, F.col("at"), {"one": ("location_point", "count"), "latitude": ("location_latitude", "°"), "longitude": ("location_longitude", "°")}, metadata=meta)


#: Counts by day of a window, and the metric of each.
COUNTERS = {
    "commits_by_day": "code_commits",
    "pull_requests_opened_by_day": "code_pull_requests_opened",
    "pull_requests_merged_by_day": "code_pull_requests_merged",
    "reviews_by_day": "code_reviews_submitted",
    "issues_opened_by_day": "code_issues_opened",
}
BY_DAY = "map<string, int>"
REPOSITORY = f"struct<name_with_owner: string, commits_by_day: {BY_DAY}, additions_by_day: {BY_DAY}, deletions_by_day: {BY_DAY}, commits_truncated: boolean>"


def commits(payloads: DataFrame, start: str, end: str, most_repositories: int = 100) -> DataFrame:
    """Counters of each day of a window: zeros included, of lines only where the scan of repositories was whole and
    the day has no commits; and the commits of each repository on days that have some.

    The lines of a day are those of all repositories, its repositories those with commits. A scan isn't whole if
    there are more than ``most_repositories`` of them or one's commits were cut off."""
    counters = ", ".join(f"{c} {BY_DAY}" for c in COUNTERS)
    told = payloads.select(F.from_json("payload", f"login string, {counters}, repositories array<{REPOSITORY}>").alias("p")).select("p.*")
    there = F.coalesce("repositories", F.array().cast(f"array<{REPOSITORY}>"))
    whole = (F.size(there) <= most_repositories) & ~F.exists(there, lambda r: F.coalesce(r["commits_truncated"], F.lit(False)))
    days = told.select(*told.columns, there.alias("_r"), whole.alias("_whole"), F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("_d"))
    key = F.date_format("_d", "yyyy-MM-dd")
    on_day = lambda m: F.try_element_at(m, key)
    total = lambda part: F.aggregate(F.transform("_r", lambda r: on_day(r[part])), F.lit(None).cast("int"), lambda a, x: F.coalesce(a + x, a, x))
    touched = F.size(F.array_distinct(F.transform(F.filter("_r", lambda r: F.coalesce(on_day(r["commits_by_day"]), F.lit(0)) > 0), lambda r: r["name_with_owner"])))
    quiet = F.col("_whole") & (F.coalesce(on_day(F.col("commits_by_day")), F.lit(0)) == 0)
    lines = {m: F.coalesce(total(p), F.when(quiet, 0)) for m, p in (("code_lines_added", "additions_by_day"), ("code_lines_removed", "deletions_by_day"))}
    values = {m: F.coalesce(on_day(F.col(c)), F.lit(0)) for c, m in COUNTERS.items()} | {"code_repositories_touched": touched} | lines
    meta = F.to_json(F.struct("login"))
    each = F.array(*[F.struct(F.lit(m).alias("metric_type"), v.cast("double").alias("value")) for m, v in values.items()])
    daily = days.select(F.col("_d").cast("timestamp").alias("timestamp"), meta.alias("metadata"), F.explode(each).alias("e")).where("e.value IS NOT NULL")
    own = days.select("login", "_d", F.explode("_r").alias("r")).withColumn("n", F.try_element_at("r.commits_by_day", key)).where("n > 0")
    name = F.btrim(F.regexp_replace(F.lower(F.col("r.name_with_owner")), "[^a-z0-9]+", "_"), F.lit("_"))
    of_each = own.select(F.concat(F.lit("github_"), name, F.lit("_commits")).alias("metric_type"), F.col("_d").cast("timestamp").alias("timestamp"), F.col("n").cast("double").alias("value"), F.to_json(F.struct("login", F.col("r.name_with_owner").alias("repository"), F.try_element_at("r.additions_by_day", key).alias("lines_added"), F.try_element_at("r.deletions_by_day", key).alias("lines_removed"))).alias("metadata"))
    counted = daily.select("e.metric_type", "timestamp", "e.value", "metadata").unionByName(of_each)
    return counted.withColumn("unit", F.lit("count")).select("metric_type", "timestamp", "value", "unit", "metadata")


def busy_minutes(occurrences: DataFrame) -> DataFrame:
    """Events and busy minutes of each day, of calendar occurrences (start, end, all_day, transparent, status)."""
    busy = ~F.coalesce("transparent", F.lit(False)) & ~F.coalesce("all_day", F.lit(False)) & (F.coalesce("status", F.lit("")) != "CANCELLED")
    minutes = (F.unix_seconds("end") - F.unix_seconds("start")) / 60
    days = occurrences.where("start IS NOT NULL").groupBy(F.to_date("start").alias("day")).agg(F.count("*").cast("double").alias("n"), F.coalesce(F.sum(F.when(busy, minutes)), F.lit(0.0)).alias("minutes"))
    return _measured(days, F.col("day").cast("timestamp"), {"n": ("calendar_event_count", "count"), "minutes": ("calendar_busy_duration", "min")})


def health_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of an exported XML archive, read by Spark's own XML source, a row for each element."""
    rows = spark.read.format("xml").option("rowTag", "Record").option("attributePrefix", "_").schema("_type string, _startDate string, _value string, _unit string, _sourceName string").load(path)
    name = F.regexp_replace("_type", "^HK(Quantity|Category)TypeIdentifier", "")
    metric = slug(F.regexp_replace(name, "(?<=[a-z])(?=[A-Z])", "_"))
    at = parsed_timestamp(F.col("_startDate"))
    value = F.col("_value").try_cast("double")
    return rows.where(value.isNotNull()).select(metric.alias("metric_type"), at.alias("timestamp"), value.alias("value"), F.coalesce("_unit", F.lit("")).alias("unit"), F.to_json(F.struct(F.col("_sourceName").alias("source"))).alias("metadata"))
