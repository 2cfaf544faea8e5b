"""Providers' payloads, built from the driver's tables and read back as events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mapping import tagged_sessions
from ..sources import providers as S
from ..sources.calendars import occurrences
from ..sources.fields import collected_fields, unmapped
from ..sources.workouts import health_workouts
from .driver_tables import table
from .register import query, rounded, text, text_sql


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("at", F.date_trunc("minute", "ts"))


def _payloads(rows: DataFrame, each: Column, payload: Column, *keys: str) -> DataFrame:
    """One payload for each key, made of a list of what each row gives (``items``)."""
    return rows.groupBy(*keys).agg(F.collect_list(each).alias("items")).select(payload.alias("payload"))


def _counted(events: DataFrame) -> DataFrame:
    return events.groupBy("metric_type", text(F.date_trunc("day", "timestamp")).alias("day"), "unit").agg(F.count("*").alias("n"), rounded(F.sum("value"), 6).alias("total"))


def _counted_sql(rows: str) -> str:
    day = text_sql("date_trunc('day', tm)")
    return f"WITH r AS ({rows}) SELECT metric_type, {day} AS day, unit, count(*) AS n, round(sum(value), 6) AS total FROM r WHERE value IS NOT NULL GROUP BY metric_type, {day}, unit"


_AT = "date_trunc('minute', ts) AS tm"


@query(_counted_sql(f"SELECT 'weather_temperature' AS metric_type, {_AT}, '°C' AS unit, value FROM events UNION ALL SELECT 'weather_humidity', {_AT}, '%', event_id % 100 FROM events"))
def weather_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct(F.date_format("at", "yyyy-MM-dd'T'HH:mm").alias("time"), F.col("value").alias("temperature_2m"), (F.col("event_id") % 100).cast("double").alias("relative_humidity_2m"))
    lists = F.struct(*[F.col(f"items.{c}").alias(c) for c in ("time", "temperature_2m", "relative_humidity_2m")])
    return _counted(S.weather(_payloads(_events(spark, sf_dir), item, F.to_json(F.struct(lists.alias("hourly"))), "user_id")))


@query(_counted_sql(f"SELECT 'home_assistant_' || event_type || '_' || user_id % 3 AS metric_type, {_AT}, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'W' END AS unit, CASE event_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN NULL ELSE value END AS value FROM events"))
def home_state_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    state = F.when(k == 0, "On").when(k == 1, "unavailable").otherwise(F.col("value").cast("string"))
    item = F.struct(
        F.concat(F.lit("sensor."), F.initcap("event_type"), F.lit(" "), (F.col("user_id") % 3).cast("string")).alias("entity_id"),
        state.alias("state"),
        F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias("last_changed"),
        F.struct(F.when(k != 0, "W").alias("unit_of_measurement")).alias("attributes"),
    )
    return _counted(S.home_states(_payloads(_events(spark, sf_dir), item, F.to_json(F.array("items")), "user_id")))


@query(_counted_sql(f"SELECT unnest(['location_point', 'location_latitude', 'location_longitude']) AS metric_type, {_AT}, unnest(['count', '°', '°']) AS unit, unnest([1.0, value / 2, value / 4]) AS value FROM events WHERE value IS NOT NULL"))
def gps_fix_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.when(F.col("event_id") % 2 == 0, F.unix_seconds(F.col("at").cast("timestamp")).cast("string")).otherwise(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ssXXX"))
    item = F.struct(F.col("event_id").cast("string").alias("id"), (F.col("value") / 2).alias("latitude"), (F.col("value") / 4).alias("longitude"), stamp.alias("timestamp"))
    return _counted(S.gps_fixes(_payloads(_events(spark, sf_dir), item, F.to_json("items"), "user_id")))


@query(_counted_sql(f"SELECT event_type AS metric_type, {_AT}, 'count' AS unit, value FROM events WHERE event_type <> 'error' UNION ALL SELECT 'sleep_duration', {_AT}, 'min', value * 60 FROM events WHERE event_type = 'error' UNION ALL SELECT 'sleep_duration_deep', {_AT}, 'min', value * 15 FROM events WHERE event_type = 'error'"))
def health_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    asleep = F.col("event_type") == "error"
    own = _events(spark, sf_dir).withColumn("name", F.when(asleep, "sleep_analysis").otherwise(F.col("event_type")))
    item = F.struct(F.date_format("at", "yyyy-MM-dd HH:mm:ss xx").alias("date"), F.when(asleep | (F.col("event_id") % 2 == 0), F.col("value")).alias("qty"), F.when(~asleep & (F.col("event_id") % 2 == 1), F.col("value")).alias("Avg"), F.when(asleep, F.col("value") / 4).alias("deep"))
    metric = F.struct(F.col("name"), F.lit("count").alias("units"), F.col("items").alias("data"))
    return _counted(S.health_export(_payloads(own, item, F.to_json(F.struct(F.struct(F.array(metric).alias("metrics")).alias("data"))), "user_id", "name")))


_SETS = "SELECT l_orderkey, o_orderdate, l_linenumber, l_extendedprice AS w, l_quantity AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@query(f"""WITH s AS ({_SETS}), r AS (SELECT o_orderdate AS d, unnest(['strength_set_weight', 'strength_set_reps', 'strength_set_volume']) AS metric_type, unnest(['kg', 'count', 'kg']) AS unit, unnest([w, r, w * r]) AS value FROM s
UNION ALL SELECT o_orderdate, unnest(['strength_session_volume', 'strength_session_sets']), unnest(['kg', 'count']), unnest([sum(w * r), count(*)]) FROM s GROUP BY l_orderkey, o_orderdate)
SELECT metric_type, strftime(d, '%Y-%m') AS month, unit, count(*) AS n, round(sum(value) / 1e6, 3) AS millions FROM r GROUP BY ALL""")
def strength_log_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'12:00:00.000'Z'")
    exercise = F.struct(F.col("l_partkey").cast("string").alias("id"))
    item = F.struct(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_linenumber").cast("int").alias("setNumber"), F.col("l_extendedprice").cast("double").alias("weight"), F.col("l_quantity").cast("double").alias("reps"), stamp.alias("createdAt"), exercise.alias("exercise"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey", "o_orderdate").agg(F.collect_list(item).alias("sets"))
    workout = F.struct(F.col("l_orderkey").cast("string").alias("id"), stamp.alias("createdAt"), "sets")
    events = S.strength_log(joined.select(F.to_json(F.struct(F.array(workout).alias("workouts"))).alias("payload")))
    return events.groupBy("metric_type", F.date_format("timestamp", "yyyy-MM").alias("month"), "unit").agg(F.count("*").alias("n"), rounded(F.sum("value") / 1e6, 3).alias("millions"))


@query(_counted_sql(f"SELECT unnest(['whoop_recovery_score', 'heart_rate_resting']) AS metric_type, {_AT}, unnest(['%', 'bpm']) AS unit, unnest([value, user_id % 60]) AS value FROM events WHERE event_id % 3 > 0"))
def recovery_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.struct(F.col("value").alias("recovery_score"), (F.col("user_id") % 60).cast("double").alias("resting_heart_rate"))
    item = F.struct(F.col("event_id").cast("string").alias("id"), F.when(F.col("event_id") % 3 > 0, "SCORED").otherwise("PENDING").alias("score_state"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("start"), score.alias("score"))
    return _counted(S.recovery(_payloads(_events(spark, sf_dir), item, F.to_json("items"), "user_id")))


@query("""WITH l AS (SELECT l_orderkey AS o, sum(l_quantity) AS energy, avg(l_quantity) AS beat, max(l_quantity) AS most, count(*) AS beats, sum(l_quantity) AS beat_sum FROM lineitem GROUP BY 1),
w AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderkey AS k, o_totalprice AS p, l.* FROM orders JOIN l ON o_orderkey = o),
r AS (SELECT month, 'workout_duration' AS metric_type, 's' AS unit, (k % 90 * 60)::DOUBLE AS value FROM w UNION ALL SELECT month, 'workout_energy', CASE WHEN k % 2 = 0 THEN 'kcal' ELSE 'kJ' END, CASE WHEN k % 2 = 0 THEN p ELSE energy END FROM w
    UNION ALL SELECT month, 'workout_heart_rate_average', '', CASE WHEN k % 3 = 0 THEN 77 ELSE beat END FROM w UNION ALL SELECT month, 'workout_heart_rate_max', '', most FROM w)
SELECT month, metric_type, unit, count(*) AS n, round(sum(value), 3) AS total FROM r GROUP BY ALL UNION ALL SELECT month, 'workout_heart_rate', 'bpm', sum(beats)::BIGINT, round(sum(beat_sum), 3) FROM w GROUP BY month""")
def workout_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pushed workouts: energy and pulse are stated by some, and by others only as samples (their lines)."""
    o = table(spark, sf_dir, "orders")
    quantity = F.col("l_quantity").cast("double")
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(quantity.alias("qty"), F.lit("kJ").alias("units"))).alias("energy"), F.collect_list(F.struct(quantity.alias("Avg"), F.col("l_linenumber").alias("n"))).alias("beats"))
    joined = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    k = F.col("o_orderkey")
    beat = lambda b: F.struct(b["Avg"].alias("Avg"), F.concat(stamp, F.lit("T09:0"), b["n"].cast("string"), F.lit(":00Z")).alias("date"))
    workout = F.struct(
        k.cast("string").alias("id"), F.lit("Run").alias("name"), F.concat(stamp, F.lit("T09:00:00Z")).alias("start"), (k % 90 * 60).alias("duration"),
        F.when(k % 2 == 0, F.struct(F.col("o_totalprice").cast("double").alias("qty"), F.lit("kcal").alias("units"))).alias("totalEnergy"), F.col("energy").alias("activeEnergy"),
        F.when(k % 3 == 0, 77).alias("avgHeartRate"), F.transform("beats", beat).alias("heartRateData"),
    )
    payloads = joined.groupBy("o_custkey").agg(F.collect_list(workout).alias("workouts")).select(F.to_json(F.struct(F.struct("workouts").alias("data"))).alias("payload"))
    events = health_workouts(payloads, "src")
    return events.groupBy(F.date_format("timestamp", "yyyy-MM").alias("month"), "metric_type", "unit").agg(F.count("*").alias("n"), rounded(F.sum("value"), 3).alias("total"))


_BERLIN = """CASE WHEN d >= last_day(make_date(year(d), 3, 1)) - CAST(isodow(make_date(year(d), 3, 31)) % 7 AS INTEGER)
    AND d < CASE WHEN year(d) < 1996 THEN make_date(year(d), 9, 30) - CAST(isodow(make_date(year(d), 9, 30)) % 7 AS INTEGER) ELSE make_date(year(d), 10, 31) - CAST(isodow(make_date(year(d), 10, 31)) % 7 AS INTEGER) END THEN '07' ELSE '08' END"""


def _calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as a feed: from the day of each on, the next three second Mondays of months, at nine in Berlin."""
    event = F.concat(
        F.lit("BEGIN:VEVENT\r\nUID:"), F.col("o_orderkey").cast("string"), F.lit("\r\nDTSTART;TZID=Europe/Berlin:"), F.date_format("o_orderdate", "yyyyMMdd"),
        F.lit("T090000\r\nDURATION:PT"), (F.col("o_orderkey") % 90 + 1).cast("string"), F.lit("M\r\nRRULE:FREQ=MONTHLY;BYDAY=2MO;COUNT=3\r\nEND:VEVENT\r\n"),
    )
    feeds = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(event), "").alias("e"))
    ics = F.concat(F.lit("BEGIN:VCALENDAR\r\n"), F.col("e"), F.lit("END:VCALENDAR\r\n"))
    return occurrences(feeds.select(F.col("o_custkey").cast("long").alias("feed"), ics.alias("ics")), "1990-01-01", "2010-01-01", feed_col="feed")


_MONDAYS = f"""m AS (SELECT o_custkey, o_orderkey, o_orderdate, CAST(date_trunc('month', o_orderdate) + to_months(CAST(k AS INTEGER)) AS DATE) AS first FROM orders, range(5) t(k)),
s AS (SELECT *, first + CAST((8 - isodow(first)) % 7 + 7 AS INTEGER) AS d FROM m),
c AS (SELECT *, {_BERLIN} AS h FROM s WHERE d >= CAST(o_orderdate AS DATE) QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY d) <= 3)"""


@query(f"WITH {_MONDAYS} SELECT CAST(o_custkey AS BIGINT) AS feed, CAST(o_orderkey AS VARCHAR) AS uid, strftime(d, '%Y-%m-%d') || ' ' || h || ':00:00' AS begins FROM c")
def calendar_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calendar(spark, sf_dir).where("problem IS NULL").select("feed", "uid", text("start").alias("begins"))


@query(f"WITH {_MONDAYS} SELECT strftime(d, '%Y-%m-%d') AS day, count(*)::DOUBLE AS events, sum(o_orderkey % 90 + 1)::DOUBLE AS busy FROM c GROUP BY 1")
def calendar_busy_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = S.busy_minutes(_calendar(spark, sf_dir)).groupBy(F.date_format("timestamp", "yyyy-MM-dd").alias("day"))
    return told.agg(F.max(F.when(F.col("metric_type") == "calendar_event_count", F.col("value"))).alias("events"), F.max(F.when(F.col("metric_type") == "calendar_busy_duration", F.col("value"))).alias("busy"))


_SESSION = "'backfill:' || left(sha256('s' || user_id % 3 || '|' || user_id), 16)"


@query(f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN {_SESSION} WHEN 2 THEN {_SESSION} WHEN 3 THEN 'own' END AS session_id, event_id % 4 IN (0, 2) AS changed, CASE WHEN event_id % 4 = 2 THEN 'null' END AS nested FROM events")
def session_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points by their provider's workout: some without a session, some whose session is null or their own, some with one in a member of a member."""
    k = F.col("event_id") % 4
    workout = F.concat(F.lit('{"workout_id": "'), F.col("user_id").cast("string"), F.lit('"'))
    metadata = F.concat(workout, F.when(k == 1, ', "session_id": null}').when(k == 2, ', "o": {"session_id": null}}').when(k == 3, ', "session_id": "own"}').otherwise("}"))
    own = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("source_id"), metadata.alias("metadata"))
    told = tagged_sessions(own, "workout_id")
    nested = F.when(F.get_json_object("metadata", "$.o") == '{"session_id":null}', "null")
    return told.select("event_id", F.get_json_object("metadata", "$.session_id").alias("session_id"), "changed", nested.alias("nested"))


_LINES = "SELECT l_orderkey AS o, count(*) AS lines, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1"


@query(f"""WITH l AS ({_LINES}) SELECT path, kind, sum(n)::BIGINT AS n, count(*) AS documents FROM (
    SELECT o, 'order' AS path, 'object' AS kind, 1 AS n FROM l UNION ALL SELECT o, 'order.key', 'number', 1 FROM l UNION ALL SELECT o, 'order.lines', 'array', 1 FROM l
    UNION ALL SELECT o, 'order.lines[]', 'object', lines FROM l UNION ALL SELECT o, 'order.lines[].part', 'number', lines FROM l
    UNION ALL SELECT o, 'order.lines[].back', 'boolean', lines FROM l UNION ALL SELECT o, 'order.lines[].note', 'string', returned FROM l WHERE returned > 0
    UNION ALL SELECT o, 'order.lines[].note', 'null', lines - returned FROM l WHERE lines > returned) WHERE path <> 'order.key' GROUP BY path, kind""")
def unmapped_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What orders with their lines as documents hold that nobody maps (the key is)."""
    note = F.when(F.col("l_returnflag") == "R", '"back"').otherwise("null")
    line = F.concat(F.lit('{"part":'), F.col("l_partkey").cast("string"), F.lit(',"back":'), (F.col("l_returnflag") == "R").cast("string"), F.lit(',"note":'), note, F.lit("}"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(line), ",").alias("x"))
    payload = F.concat(F.lit('{"order":{"key":'), F.col("l_orderkey").cast("string"), F.lit(',"lines":['), F.col("x"), F.lit("]}}"))
    found = collected_fields(lines.select(payload.alias("payload")))
    return unmapped(found, spark.createDataFrame([("order.key",)], "path string")).select("path", "kind", "n", "documents")


_ZONES = "event_id % 7 * 1000 AS z0, event_id % 5 * 1000 AS z1, event_id % 3 * 1000 AS z2"


@query(f"""WITH w AS (SELECT event_id, date_trunc('minute', ts) AS tm, value, {_ZONES} FROM events WHERE event_id % 3 > 0), s AS (SELECT *, z0 + z1 + z2 AS whole FROM w),
r AS (SELECT 'workout_energy' AS metric_type, 'kcal' AS unit, round(value * 0.2390057361, 1) AS value FROM s UNION ALL SELECT 'workout_duration', 'min', event_id % 90 FROM s WHERE event_id % 90 > 0
    UNION ALL SELECT 'workout_heart_rate_zone_1', '%', z1 * 100.0 / whole FROM s WHERE whole > 0 UNION ALL SELECT 'workout_heart_rate_zone_2', '%', z2 * 100.0 / whole FROM s WHERE whole > 0)
SELECT metric_type, unit, count(*) AS n, round(sum(value), 3) AS total FROM r WHERE value IS NOT NULL GROUP BY ALL""")
def workout_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored workouts: energy in kcal, minutes from start to end, and each zone's share of the time in all."""
    k = F.col("event_id")
    zones = F.struct((k % 7 * 1000).alias("zone_zero_milli"), (k % 5 * 1000).alias("zone_one_milli"), (k % 3 * 1000).alias("zone_two_milli"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    score = F.struct(F.col("value").alias("kilojoule"), zones.alias("zone_duration"))
    item = F.struct(F.when(k % 3 > 0, "SCORED").otherwise("PENDING").alias("score_state"), stamp(F.col("at")).alias("start"), stamp(F.timestamp_add("MINUTE", (k % 90).cast("int"), F.col("at"))).alias("end"), score.alias("score"))
    events = S.recovery(_payloads(_events(spark, sf_dir), item, F.to_json("items"), "user_id"), "workout")
    return events.groupBy("metric_type", "unit").agg(F.count("*").alias("n"), rounded(F.sum("value"), 3).alias("total"))


@query("""WITH d AS (SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL), days AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-10', INTERVAL 1 DAY)) AS d),
u AS (SELECT DISTINCT user_id FROM events), g AS (SELECT user_id, strftime(d, '%Y-%m-%d') AS day FROM u, days),
t AS (SELECT g.user_id, g.day, coalesce(sum(n), 0) AS commits, count(DISTINCT event_type) AS repositories, sum(n * 3) AS added FROM g LEFT JOIN d USING (user_id, day) GROUP BY ALL)
SELECT 'code_commits' AS metric_type, day, count(*) AS n, sum(commits)::DOUBLE AS total FROM t GROUP BY day UNION ALL SELECT 'code_repositories_touched', day, count(*), sum(repositories)::DOUBLE FROM t GROUP BY day
UNION ALL SELECT 'code_lines_added', day, count(*), sum(coalesce(added, 0))::DOUBLE FROM t GROUP BY day
UNION ALL SELECT 'github_own_' || event_type || '_commits', day, count(*), sum(n)::DOUBLE FROM d WHERE day <= '2024-01-10' GROUP BY event_type, day""")
def code_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as commits, their type as the repository: counters of each day and of each repository."""
    counts = _events(spark, sf_dir).groupBy("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    days = lambda times: F.map_from_entries(F.collect_list(F.struct("day", F.col("n") * times)))
    each = counts.groupBy("user_id", "event_type").agg(days(1).alias("commits_by_day"), days(3).alias("additions_by_day"))
    repository = F.struct(F.concat(F.lit("Own/"), "event_type").alias("name_with_owner"), "commits_by_day", "additions_by_day")
    repositories = each.groupBy("user_id").agg(F.collect_list(repository).alias("repositories"))
    totals = counts.groupBy("user_id", "day").agg(F.sum("n").alias("n")).groupBy("user_id").agg(days(1).alias("commits_by_day"))
    window = F.struct(F.col("user_id").cast("string").alias("login"), "commits_by_day", "repositories")
    events = S.commits(repositories.join(totals, "user_id").select(F.to_json(window).alias("payload")), "2024-01-01", "2024-01-10")
    shown = F.col("metric_type").isin("code_commits", "code_repositories_touched", "code_lines_added") | F.col("metric_type").startswith("github_")
    return events.where(shown).groupBy("metric_type", F.date_format("timestamp", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
