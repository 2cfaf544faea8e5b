"""Queries over sessions, sets, streams, tracks and the diary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.registry import with_definition
from ..operators import sessions as S
from .driver_tables import POINTS_SQL, SETS_SQL, placed_table, points, sets, table
from .register import query, rounded, text, text_sql


def _sets(select: str, *more: str) -> str:
    return ",\n".join([f"WITH {SETS_SQL}", *more]) + "\n" + select


def _points(select: str, *more: str) -> str:
    return ",\n".join([f"WITH {POINTS_SQL}", *more]) + "\n" + select


@query(_sets(f"SELECT tenant_id, session_id, {text_sql('min("at")')} AS start, count(*) AS sets, count(DISTINCT exercise_title) AS exercises, array_to_string(list_sort(list(DISTINCT muscle_group)), ',') AS muscle_groups, round(sum(weight_kg * reps), 2) AS volume FROM sets GROUP BY tenant_id, session_id"))
def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.session_list(sets(spark, sf_dir))
    return found.withColumn("start", text("start")).withColumn("volume", rounded("volume", 2))


@query(_sets("SELECT tenant_id, exercise_title, count(DISTINCT session_id) AS sessions, count(*) AS sets, round(sum(weight_kg * reps), 2) AS volume, sum(reps) AS reps, max(weight_kg) AS max_weight FROM sets GROUP BY tenant_id, exercise_title"))
def strength_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets(spark, sf_dir).groupBy("tenant_id", "exercise_title").agg(
        F.count_distinct("session_id").alias("sessions"), F.count("*").alias("sets"), rounded(F.sum(F.col("weight_kg") * F.col("reps")), 2).alias("volume"), F.sum("reps").alias("reps"), F.max("weight_kg").alias("max_weight")
    )


@query(_sets("SELECT tenant_id, session_id, exercise_title, CAST(set_number AS BIGINT) AS set_number, max(CASE WHEN set_number % 4 <> 0 THEN weight_kg END) AS weight_kg, max(reps) AS reps, round(max(weight_kg * reps), 2) AS volume_kg, CAST(count(*) * 2 + count(*) FILTER (WHERE set_number % 4 <> 0) AS BIGINT) AS points, max(CASE WHEN set_number % 4 <> 0 THEN weight_kg END) IS NOT NULL AS has_weight FROM sets GROUP BY ALL"))
def strength_sets_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fourth set is one of body weight: it has no weight among its measures."""
    own = sets(spark, sf_dir)
    measures = F.filter(
        F.array(
            F.when(F.col("set_number") % 4 != 0, F.struct(F.lit("strength_set_weight").alias("metric_type"), F.col("weight_kg").alias("value"))),
            F.struct(F.lit("strength_set_reps").alias("metric_type"), F.col("reps").alias("value")),
            F.struct(F.lit("strength_set_volume").alias("metric_type"), F.round(F.col("weight_kg") * F.col("reps"), 2).alias("value")),
        ),
        lambda m: m.isNotNull(),
    )
    long = own.select("tenant_id", "session_id", "exercise_title", F.col("set_number").cast("long").alias("set_number"), F.explode(measures).alias("m")).select("tenant_id", "session_id", "exercise_title", "set_number", "m.*")
    return S.pivot_sets(long)


_E1RM = "CASE WHEN reps = 1 THEN weight_kg WHEN reps BETWEEN 2 AND 10 THEN weight_kg * (1 + reps / 30) END"


@query(_sets(f"SELECT session_id, set_number, part, round({_E1RM}, 6) AS e1rm FROM sets"))
def one_rep_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = sets(spark, sf_dir)
    return own.select("session_id", "set_number", "part", rounded(S.one_rep_max(F.col("weight_kg"), F.col("reps")), 6).alias("e1rm"))


@query(_sets("SELECT tenant_id, exercise_title, count(*) AS days, round(max(e), 6) AS best, round(arg_max(e, \"at\"), 6) AS latest, round(regr_slope(e, i), 4) AS slope FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, exercise_title ORDER BY \"at\") - 1 AS i FROM b WHERE e IS NOT NULL) GROUP BY tenant_id, exercise_title", f"b AS (SELECT tenant_id, exercise_title, \"at\", max({_E1RM}) AS e FROM sets GROUP BY ALL)"))
def exercise_progression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.progression(sets(spark, sf_dir))
    return found.select("tenant_id", "exercise_title", "days", rounded("best", 6).alias("best"), rounded("latest", 6).alias("latest"), rounded("slope", 4).alias("slope"))


@query(_sets("SELECT tenant_id, muscle_group, sets, round(volume / sum(volume) OVER (PARTITION BY tenant_id), 9) AS volume_share, round(sets / sum(sets) OVER (PARTITION BY tenant_id), 9) AS set_share FROM (SELECT tenant_id, muscle_group, sum(weight_kg * reps) AS volume, count(*) AS sets FROM sets GROUP BY ALL)"))
def muscle_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.muscle_share(sets(spark, sf_dir))
    return found.select("tenant_id", "muscle_group", "sets", rounded("volume_share").alias("volume_share"), rounded("set_share").alias("set_share"))


@query(_sets("SELECT exercise_title, round(volume, 2) AS volume FROM (SELECT exercise_title, sum(weight_kg * reps) AS volume FROM sets GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 20)"))
def top_exercises(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sets(spark, sf_dir).groupBy("exercise_title").agg(F.sum(F.col("weight_kg") * F.col("reps")).alias("volume"))
    return found.orderBy(F.col("volume").desc(), "exercise_title").limit(20).withColumn("volume", rounded("volume", 2))


@query(_points(
    "SELECT w.tenant_id, w.session, p.metric_type, count(*) AS n, min(p.value) AS least, max(p.value) AS most FROM w JOIN points p ON p.tenant_id = w.tenant_id AND p.timestamp >= w.s - INTERVAL 300 SECOND AND p.timestamp < w.e + INTERVAL 300 SECOND GROUP BY ALL",
    "w AS (SELECT tenant_id, point_id AS session, timestamp AS s, timestamp + INTERVAL 90 MINUTE AS e FROM points WHERE metric_type = 'workout_heart_rate')",
))
def session_window_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was measured around each session, by any source."""
    own = points(spark, sf_dir)
    starts = own.where("metric_type = 'workout_heart_rate'")
    windows = starts.select("tenant_id", F.col("point_id").alias("session"), F.col("timestamp").alias("start"), (F.col("timestamp") + F.expr("interval 90 minutes")).alias("end"))
    return S.measured_within(windows, own, pad_seconds=300)


@query(_points("SELECT metric_type, tenant_id, source_id, CAST(floor(epoch(timestamp) / 43200) * 43200 AS BIGINT) AS bucket_epoch, round(avg(value), 9) AS mean, min(value) AS least, max(value) AS most, count(*) AS n FROM points JOIN (SELECT tenant_id, source_id, metric_type, row_number() OVER (PARTITION BY tenant_id, source_id ORDER BY count(*) DESC, metric_type) AS r FROM points GROUP BY tenant_id, source_id, metric_type HAVING count(*) >= 3) USING (tenant_id, source_id, metric_type) WHERE r <= 3 GROUP BY metric_type, tenant_id, source_id, floor(epoch(timestamp) / 43200)"))
def stream_decimation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.decimate(points(spark, sf_dir), 43_200, "tenant_id", "source_id", most=3).withColumn("mean", rounded("mean"))


def _fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points as fixes whose place follows from their ids."""
    k = F.get_json_object("metadata", "$.k").cast("double")
    return points(spark, sf_dir).withColumn("latitude", F.lit(48.0) + k / 100).withColumn("longitude", F.lit(11.0) + F.col("value") / 100)


_FIXES = "fixes AS (SELECT *, 48.0 + CAST(json_extract_string(metadata, '$.k') AS DOUBLE) / 100 AS latitude, 11.0 + value / 100 AS longitude FROM points)"
_STEPS = "steps AS (SELECT *, lag(latitude) OVER w AS lat0, lag(longitude) OVER w AS lon0, lead(latitude) OVER w AS lat2, lead(longitude) OVER w AS lon2 FROM fixes WINDOW w AS (PARTITION BY tenant_id, source_id ORDER BY timestamp, point_id))"


@query(_points("SELECT tenant_id, source_id, count(*) AS fixes, round(sum(2 * 6371008.8 * asin(sqrt(least(pow(sin(radians(latitude - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(latitude)) * pow(sin(radians(longitude - lon0) / 2), 2), 1)))), 3) AS meters FROM steps GROUP BY tenant_id, source_id", _FIXES, _STEPS))
def track_length_haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.track_length(_fixes(spark, sf_dir), "tenant_id", "source_id").withColumn("meters", rounded("meters", 3))


@query(_points("SELECT tenant_id, source_id, point_id FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, source_id ORDER BY coalesce(round(abs((longitude - lon0) * (lat2 - lat0) - (lon2 - lon0) * (latitude - lat0)) / 2, 9), CAST('infinity' AS DOUBLE)) DESC, timestamp, point_id) AS n FROM steps) WHERE n <= 50", _FIXES, _STEPS))
def simplify_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.simplify_track(_fixes(spark, sf_dir), 50, "tenant_id", "source_id").select("tenant_id", "source_id", "point_id")


_MEAL = "CASE l_returnflag WHEN 'A' THEN 'Breakfast' WHEN 'N' THEN 'dinner' ELSE 'brunch' END"


@query(f"SELECT tenant_id, strftime(l_shipdate, '%Y-%m-%d') AS day, {_MEAL} AS meal, arg_max(CASE WHEN l_linenumber = 1 THEN l_extendedprice END, l_orderkey) FILTER (WHERE l_linenumber = 1) AS stated, round(sum(CASE WHEN l_linenumber > 1 THEN l_quantity END), 1) AS derived, count(CASE WHEN l_linenumber > 1 THEN l_quantity END) AS items, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 3 ELSE 99 END AS place FROM (SELECT *, 't' || (l_suppkey % 2) AS tenant_id FROM lineitem) GROUP BY tenant_id, l_shipdate, l_returnflag")
def diary_by_meal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as diary entries: the first line of an order states a meal's energy, the others are items.

    An order may state a meal's energy twice. Of these the row that comes first in the table stays, as in the SQL, where
    an equal order doesn't replace what is there; so their time is the order with its place (a decimal, which hash aggregates take)."""
    lines, first = placed_table(spark, sf_dir, "lineitem"), F.col("l_linenumber") == 1
    at = F.col("l_orderkey").cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)") - F.col("place").cast("decimal(19,0)")
    entries = lines.select(
        F.concat(F.lit("t"), (F.col("l_suppkey") % 2).cast("string")).alias("tenant_id"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"),
        F.when(F.col("l_returnflag") == "A", "Breakfast").when(F.col("l_returnflag") == "N", "dinner").otherwise("brunch").alias("meal"),
        F.when(first, F.col("l_extendedprice")).alias("stated"),
        F.when(~first, F.col("l_quantity")).alias("item_energy"),
        F.when(first, at).alias("timestamp"),
    )
    return S.meals(entries).select("tenant_id", "day", "meal", "stated", "derived", "items", F.col("place").cast("int").alias("place"))


@query(_points(f"SELECT tenant_id, CASE WHEN starts_with(metric_type, 'workout_') THEN 'session' WHEN metric_type = 'body_weight' THEN 'body' WHEN metric_type = 'steps' THEN 'activity' ELSE 'heart' END AS lane, metric_type, count(*) AS n, {text_sql('min(timestamp)')} AS first_at FROM points WHERE timestamp >= TIMESTAMP '2024-01-15' - INTERVAL 120 MINUTE AND timestamp < TIMESTAMP '2024-01-16' - INTERVAL 120 MINUTE GROUP BY ALL"))
def day_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day of a reader two hours ahead of UTC, by lane."""
    offset = F.expr("interval 120 minutes")
    at = F.col("timestamp")
    own = points(spark, sf_dir).where((at >= F.lit("2024-01-15").cast("timestamp_ntz") - offset) & (at < F.lit("2024-01-16").cast("timestamp_ntz") - offset))
    lane = F.when(F.col("category") == "workout", "session").otherwise(F.col("category"))
    return with_definition(own, ("category",)).groupBy("tenant_id", lane.alias("lane"), "metric_type").agg(F.count("*").alias("n"), text(F.min("timestamp")).alias("first_at"))


def _lanes(spark: SparkSession, sf_dir: str, days: list[str]) -> DataFrame:
    offset, at = F.expr("interval 120 minutes"), F.col("timestamp")
    local = F.to_date(at + offset)
    own = points(spark, sf_dir).where((at >= F.lit(min(days)).cast("timestamp_ntz") - offset) & (at < F.date_add(F.lit(max(days)).cast("date"), 1).cast("timestamp_ntz") - offset))
    lane = F.when(F.col("category") == "workout", "session").otherwise(F.col("category"))
    return with_definition(own, ("category",)).groupBy("tenant_id", F.date_format(local, "yyyy-MM-dd").alias("day"), lane.alias("lane"), "metric_type").agg(F.count("*").alias("n"))


@query(_points("SELECT tenant_id, strftime(timestamp + INTERVAL 120 MINUTE, '%Y-%m-%d') AS day, CASE WHEN starts_with(metric_type, 'workout_') THEN 'session' WHEN metric_type = 'body_weight' THEN 'body' WHEN metric_type = 'steps' THEN 'activity' ELSE 'heart' END AS lane, metric_type, count(*) AS n FROM points WHERE strftime(timestamp + INTERVAL 120 MINUTE, '%Y-%m-%d') IN ('2024-01-14', '2024-01-15') GROUP BY ALL"))
def day_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yesterday and today of a reader two hours ahead of UTC."""
    return _lanes(spark, sf_dir, ["2024-01-14", "2024-01-15"])


@query("SELECT o_orderkey, 'streak:' || substr(sha256(concat_ws('|', 's' || (o_custkey % 3), CAST(o_orderkey AS VARCHAR), o_orderpriority)), 1, 16) AS session_id FROM orders")
def session_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.concat(F.lit("s"), (F.col("o_custkey") % 3).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.session_id(F.lit("streak"), source, F.col("o_orderkey").cast("string"), F.col("o_orderpriority")).alias("session_id"))


@query("SELECT o_orderkey, rtrim(replace(replace(to_base64(encode('v1|s|' || o_orderkey || '|' || o_orderpriority)), '+', '-'), '/', '_'), '=') AS url_key, 'v1|s|' || o_orderkey || '|' || o_orderpriority AS decoded FROM orders")
def session_url_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat_ws("|", F.lit("v1"), F.lit("s"), F.col("o_orderkey").cast("string"), F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.encode_key(raw).alias("url_key")).withColumn("decoded", S.decode_key(F.col("url_key")))


@query("SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN NULL ELSE p_name END), ''), nullif(trim(CASE WHEN p_partkey % 2 = 0 THEN ' ' ELSE p_type END), ''), '') AS title FROM part")
def session_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    fields = [F.when(k % 3 == 0, "").when(k % 3 == 2, F.col("p_name")), F.when(k % 2 == 0, " ").otherwise(F.col("p_type"))]
    return table(spark, sf_dir, "part").select("p_partkey", S.first_title(fields).alias("title"))


@query()
def track_length_ellipsoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On WGS84 (tests have known distances)."""
    return S.track_length(_fixes(spark, sf_dir), "tenant_id", "source_id", distance=S.ellipsoid_distance).withColumn("meters", rounded("meters", 3))
