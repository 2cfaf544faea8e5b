"""Queries over points, rollups and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.registry import metrics, registry, with_definition
from ..operators import points as P
from ..operators import rollups as R
from ..operators import series as S
from .driver_tables import COLLAPSE_SQL, POINTS_SQL, points, table
from .register import query, rounded, text, text_sql
from .stored_points import build_store, stored

W = f"WITH {POINTS_SQL}"
START, END = "2024-01-01", "2024-01-31"


def _sql(select: str, *more: str) -> str:
    return ",\n".join([W, *more]) + "\n" + select


@query(_sql(f"SELECT point_id, source_id, metric_type, {text_sql('timestamp')} AS at, value FROM points WHERE tenant_id = 't1' AND metric_type IN ('steps', 'heart_rate') AND source_id = 's1' AND timestamp BETWEEN '2024-01-05' AND '2024-01-20' AND value BETWEEN 10 AND 80"))
def scan_points_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.scan(points(spark, sf_dir), "t1", ["steps", "heart_rate"], ["s1"], "2024-01-05", "2024-01-20", 10, 80)
    return found.select("point_id", "source_id", "metric_type", text("timestamp").alias("at"), "value")


@query(_sql("SELECT point_id, tenant_id, value FROM points WHERE tenant_id = 't2' AND point_id = 42"))
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where("tenant_id = 't2' AND point_id = 42").select("point_id", "tenant_id", "value").limit(1)


@query(_sql("SELECT point_id, value FROM points WHERE tenant_id = 't0' AND timestamp >= '2024-01-03' AND timestamp < '2024-01-04'"))
def half_open_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.scan(points(spark, sf_dir), "t0", start="2024-01-03", end="2024-01-04", inclusive_end=False).select("point_id", "value")


@query(_sql("SELECT metric_type, count(*) AS n, min(value) AS least, max(value) AS most FROM points WHERE tenant_id = 't3' AND value >= 25.5 AND value <= 60.25 GROUP BY metric_type"))
def value_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.scan(points(spark, sf_dir), "t3", least=25.5, most=60.25)
    return found.groupBy("metric_type").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))


@query(_sql("SELECT point_id, CAST(json_extract_string(metadata, '$.k') AS BIGINT) AS k FROM points WHERE json_extract_string(metadata, '$.k') IN ('7', '11')"))
def json_key_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = P.json_text("k")
    return points(spark, sf_dir).where(k.isin("7", "11")).select("point_id", k.cast("long").alias("k"))


@query(_sql("SELECT tenant_id, count(*) FILTER (WHERE json_extract(metadata, '$.k') IS NOT NULL) AS tagged, count(*) FILTER (WHERE json_extract(metadata, '$.session_id') IS NULL) AS untagged, sum(CAST(json_extract_string(metadata, '$.k') AS DOUBLE)) AS total FROM points GROUP BY tenant_id"))
def json_key_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = points(spark, sf_dir)
    return own.groupBy("tenant_id").agg(
        F.count(P.json_text("k")).alias("tagged"), F.count_if(P.json_text("session_id").isNull()).alias("untagged"), F.sum(P.json_number("k")).alias("total")
    )


@query(_sql("SELECT metric_type, starts_with(metric_type, 'workout_') AS in_session, metric_type = 'workout_heart_rate' AS is_stream, starts_with(metric_type, 'workout_') AND metric_type <> 'workout_heart_rate' AS sessionable, count(*) AS n FROM points GROUP BY metric_type"))
def metric_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = points(spark, sf_dir).groupBy("metric_type").agg(F.count("*").alias("n"))
    return own.select("metric_type", P.is_session().alias("in_session"), P.is_stream().alias("is_stream"), P.is_sessionable().alias("sessionable"), "n")


@query(_sql(f"SELECT point_id, {text_sql('timestamp')} AS at FROM points WHERE tenant_id = 't1' AND (timestamp > '2024-01-10' OR timestamp = '2024-01-10' AND point_id > 0) ORDER BY timestamp, point_id LIMIT 51"))
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.page(points(spark, sf_dir).where("tenant_id = 't1'"), 50, ("2024-01-10", 0))
    return found.select("point_id", text("timestamp").alias("at"))


@query(_sql("SELECT point_id FROM points WHERE tenant_id = 't1' ORDER BY timestamp, point_id LIMIT 20 OFFSET 40"))
def offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where("tenant_id = 't1'").orderBy("timestamp", "point_id").offset(40).limit(20).select("point_id")


@query(_sql("SELECT point_id, value FROM points WHERE tenant_id = 't2' AND metric_type = 'heart_rate' ORDER BY value DESC, point_id LIMIT 25"))
def value_ranking_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.ranked(P.scan(points(spark, sf_dir), "t2", ["heart_rate"]), 25).select("point_id", "value")


@query(_sql(f"SELECT tenant_id, metric_type, count(*) AS n, {text_sql('min(timestamp)')} AS first_at, {text_sql('max(timestamp)')} AS last_at, count(DISTINCT source_id) AS sources, CASE WHEN count(DISTINCT source_id) = 1 THEN min(source_id) END AS only_source FROM points GROUP BY tenant_id, metric_type"))
def metric_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = F.count_distinct("source_id")
    return (
        points(spark, sf_dir)
        .groupBy("tenant_id", "metric_type")
        .agg(F.count("*").alias("n"), text(F.min("timestamp")).alias("first_at"), text(F.max("timestamp")).alias("last_at"), sources.alias("sources"), F.when(sources == 1, F.min("source_id")).alias("only_source"))
    )


@query(_sql("SELECT DISTINCT tenant_id, metric_type FROM points"))
def distinct_metric_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("tenant_id", "metric_type").distinct()


@query(_sql("SELECT metric_type, count(*) AS n FROM points WHERE contains(lower(metric_type), lower('HEART')) GROUP BY metric_type"))
def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where(F.lower("metric_type").contains("HEART".lower())).groupBy("metric_type").agg(F.count("*").alias("n"))


@query(_sql("SELECT metric_type, count(*) AS outliers FROM points WHERE metric_type = 'heart_rate' AND (value < 20 OR value > 250) OR metric_type = 'heart_rate_max' AND (value < 20 OR value > 250) OR metric_type = 'steps' AND (value < 0 OR value > 200000) OR metric_type = 'body_weight' AND (value < 20 OR value > 400) OR metric_type = 'workout_heart_rate' AND (value < 20 OR value > 250) GROUP BY metric_type"))
def implausible_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = with_definition(points(spark, sf_dir), ("least", "most"))
    return known.where("value < least OR value > most").groupBy("metric_type").agg(F.count("*").alias("outliers"))


def _rollup_sql(unit: str) -> str:
    return _sql(f"""SELECT tenant_id, source_id, metric_type, {text_sql(f"date_trunc('{unit}', timestamp)")} AS bucket, count(*) AS sample_count, round(sum(value), 9) AS sum_value,
    min(value) AS min_value, max(value) AS max_value, arg_min(value, (timestamp, point_id)) AS first_value, arg_max(value, (timestamp, point_id)) AS last_value,
    round({COLLAPSE_SQL}, 9) AS value FROM points GROUP BY tenant_id, source_id, metric_type, date_trunc('{unit}', timestamp)""")


def _rollup(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    states = R.rollup(points(spark, sf_dir), unit)
    return states.select(*R.KEYS, text("bucket_start").alias("bucket"), "sample_count", rounded("sum_value").alias("sum_value"), "min_value", "max_value", "first_value", "last_value", rounded("value").alias("value"))


@query(_rollup_sql("minute"))
def rollup_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(spark, sf_dir, "minute")


@query(_rollup_sql("hour"))
def rollup_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(spark, sf_dir, "hour")


@query(_rollup_sql("day"))
def rollup_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(spark, sf_dir, "day")


@query(_sql("""SELECT tenant_id, source_id, strftime(date_trunc('day', timestamp), '%Y-%m-%d') AS day, bool_or(value > 95) AS is_provider_total,
    round(coalesce(arg_max(value, (timestamp, point_id)) FILTER (WHERE value > 95), sum(value)), 9) AS value
    FROM points WHERE metric_type = 'steps' GROUP BY tenant_id, source_id, date_trunc('day', timestamp)"""))
def rollup_provider_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points over 95 stand for totals that a provider states."""
    own = points(spark, sf_dir).where("metric_type = 'steps'").withColumn("is_total", F.col("value") > 95)
    return R.rollup(own, "day").select("tenant_id", "source_id", F.date_format("bucket_start", "yyyy-MM-dd").alias("day"), "is_provider_total", rounded("value").alias("value"))


@query(_sql(f"SELECT tenant_id, metric_type, round({COLLAPSE_SQL}, 9) AS value FROM points GROUP BY tenant_id, metric_type"))
def registry_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day states of each source, merged into one value."""
    days = R.rollup(points(spark, sf_dir), "day", "tenant_id", "metric_type")
    return R.merge(days, "tenant_id", "metric_type").select("tenant_id", "metric_type", rounded("value").alias("value"))


@query(_sql("SELECT metric_type, source_id, round(sum(value * greatest(CAST(json_extract_string(metadata, '$.k') AS DOUBLE), 1)) / sum(greatest(CAST(json_extract_string(metadata, '$.k') AS DOUBLE), 1)), 9) AS average FROM points GROUP BY metric_type, source_id"))
def weighted_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.greatest(F.coalesce(P.json_number("k"), F.lit(1.0)), F.lit(1.0))
    own = points(spark, sf_dir).withColumn("w", weight).groupBy("metric_type", "source_id").agg((F.sum(F.col("value") * F.col("w")) / F.sum("w")).alias("average"))
    return own.withColumn("average", rounded("average"))


@query(_sql(f"SELECT metric_type, source_id, count(*) AS n, round(sum(value), 9) AS total, round(avg(value), 9) AS average, max(value) AS most, arg_max(value, (timestamp, point_id)) AS latest, {text_sql('max(timestamp)')} AS last_at FROM points WHERE tenant_id = 't0' AND timestamp >= '2024-01-08' AND timestamp < '2024-01-15' GROUP BY metric_type, source_id"))
def window_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = P.scan(points(spark, sf_dir), "t0", start="2024-01-08", end="2024-01-15", inclusive_end=False)
    states = own.groupBy("metric_type", "source_id").agg(*R.partial_states(F.col("value"), F.col("timestamp"), order=F.struct("timestamp", "point_id")))
    return states.select("metric_type", "source_id", F.col("sample_count").alias("n"), rounded("sum_value").alias("total"), rounded(F.col("sum_value") / F.col("sample_count")).alias("average"), F.col("max_value").alias("most"), F.col("last_value").alias("latest"), text("last_timestamp").alias("last_at"))


_COVERED = "covered AS (SELECT tenant_id, source_id, metric_type, date_trunc('day', timestamp) AS bucket, min(timestamp) AS f, max(timestamp) AS l FROM points WHERE timestamp < '2024-01-20 12:00:00' GROUP BY ALL)"
_UNCOVERED = "rest AS (SELECT p.* FROM points p WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.tenant_id = p.tenant_id AND c.source_id = p.source_id AND c.metric_type = p.metric_type AND c.bucket = date_trunc('day', p.timestamp) AND p.timestamp BETWEEN c.f AND c.l))"


def _as_of_noon(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All points, and day rollups that were made at noon of a day, when the later ones hadn't come."""
    own = points(spark, sf_dir)
    return own, R.rollup(own.where("timestamp < '2024-01-20 12:00:00'"), "day")


@query(_sql("SELECT point_id, tenant_id, metric_type FROM rest", _COVERED, _UNCOVERED))
def uncovered_raw_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.uncovered(*_as_of_noon(spark, sf_dir), "day").select("point_id", "tenant_id", "metric_type")


@query(_sql(f"SELECT tenant_id, source_id, metric_type, {text_sql('date_trunc(D, timestamp)')} AS bucket, count(*) AS n, round({COLLAPSE_SQL}, 9) AS value FROM (SELECT * FROM points WHERE timestamp < '2024-01-20 12:00:00' UNION ALL SELECT * FROM rest) GROUP BY tenant_id, source_id, metric_type, date_trunc(D, timestamp)", _COVERED, _UNCOVERED).replace("date_trunc(D,", "date_trunc('day',"))
def hybrid_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored states of days that they count in full, and the points of the others."""
    found = stored(spark, sf_dir).series()
    return found.select(*R.KEYS, text("bucket_start").alias("bucket"), F.col("sample_count").alias("n"), rounded("value").alias("value"))


@query(_sql(f"SELECT tenant_id, source_id, metric_type, {text_sql('date_trunc(D, timestamp)')} AS bucket, count(*) AS n, round({COLLAPSE_SQL}, 9) AS value FROM (SELECT * FROM points WHERE timestamp < '2024-01-20 12:00:00' UNION ALL SELECT * FROM rest) GROUP BY tenant_id, source_id, metric_type, date_trunc(D, timestamp)", _COVERED, _UNCOVERED).replace("date_trunc(D,", "date_trunc('day',"))
def hybrid_from_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a table of rollups without counts, by the anti-join of points that these don't cover."""
    found = R.hybrid(*_as_of_noon(spark, sf_dir), "day")
    return found.select(*R.KEYS, text("bucket_start").alias("bucket"), F.col("sample_count").alias("n"), rounded("value").alias("value"))


@query(_sql(f"SELECT metric_type, count(*) AS n, round(avg(value), 9) AS average, min(value) AS least, max(value) AS most, round(sum(value), 9) AS total, {text_sql('max(timestamp)')} AS latest FROM (SELECT * FROM points WHERE timestamp < '2024-01-20 12:00:00' UNION ALL SELECT * FROM rest) WHERE tenant_id = 't1' GROUP BY metric_type", _COVERED, _UNCOVERED))
def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From stored states; of the one day that they haven't counted in full, from its points."""
    found = stored(spark, sf_dir).summary("t1")
    return found.select("metric_type", F.col("sample_count").alias("n"), rounded(F.col("weighted_sum") / F.col("weight")).alias("average"), F.col("min_value").alias("least"), F.col("max_value").alias("most"), rounded("sum_value").alias("total"), text("last_timestamp").alias("latest"))


def _dense_sql(unit: str, where: str) -> str:
    return _sql(
        f"""SELECT g.tenant_id, g.metric_type, g.source_id, {text_sql('g.b')} AS bucket, round(v.value, 9) AS value, v.value IS NULL AS is_gap FROM g LEFT JOIN v USING (tenant_id, metric_type, source_id, b)""",
        f"v AS (SELECT tenant_id, metric_type, source_id, date_trunc('{unit}', timestamp) AS b, {COLLAPSE_SQL} AS value FROM points WHERE {where} GROUP BY tenant_id, metric_type, source_id, date_trunc('{unit}', timestamp))",
        f"g AS (SELECT tenant_id, metric_type, source_id, unnest(generate_series(TIMESTAMP '{START}', TIMESTAMP '{END}' - INTERVAL 1 {unit}, INTERVAL 1 {unit})) AS b FROM (SELECT DISTINCT tenant_id, metric_type, source_id FROM v))",
    )


def _dense(spark: SparkSession, sf_dir: str, unit: str, where: str) -> DataFrame:
    values = R.rollup(points(spark, sf_dir).where(where), unit)
    found = S.dense(values, START, END, unit, "tenant_id", "metric_type", "source_id")
    return found.select("tenant_id", "metric_type", "source_id", text("bucket_start").alias("bucket"), rounded("value").alias("value"), "is_gap")


@query(_dense_sql("day", "1 = 1"))
def dense_day_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, "day", "1 = 1")


@query(_dense_sql("hour", "1 = 1"))
def dense_hour_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, "hour", "1 = 1")


@query(_sql(f"SELECT tenant_id, metric_type, {text_sql('date_trunc(W, timestamp)')} AS week, count(*) AS n, round({COLLAPSE_SQL}, 9) AS value FROM points GROUP BY tenant_id, metric_type, date_trunc(W, timestamp)").replace("(W,", "('week',"))
def week_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = R.rollup(points(spark, sf_dir), "day", "tenant_id", "metric_type")
    weeks = S.weekly(days, "tenant_id", "metric_type")
    return weeks.select("tenant_id", "metric_type", text("week_start").alias("week"), F.col("sample_count").alias("n"), rounded("value").alias("value"))


@query(_sql(f"SELECT tenant_id, metric_type, source_id, {text_sql('b')} AS bucket, point_id, value FROM (SELECT *, date_trunc('day', timestamp) AS b, row_number() OVER (PARTITION BY tenant_id, metric_type, source_id, date_trunc('day', timestamp) ORDER BY timestamp DESC, point_id DESC) AS n FROM points) WHERE n = 1"))
def latest_per_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = points(spark, sf_dir).withColumn("b", F.date_trunc("day", "timestamp"))
    return P.newest_each(own, "tenant_id", "metric_type", "source_id", "b").select("tenant_id", "metric_type", "source_id", text("b").alias("bucket"), "point_id", "value")


@query(_sql("SELECT tenant_id, metric_type, strftime(date_trunc('day', timestamp), '%Y-%m-%d') AS day, arg_max(value, (timestamp, point_id)) AS value FROM points WHERE metric_type IN ('steps', 'heart_rate_max') GROUP BY tenant_id, metric_type, date_trunc('day', timestamp)"))
def daily_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of daily cadence by their last point of the day, as the tool interface reads them."""
    daily = with_definition(points(spark, sf_dir), ("cadence",)).where("cadence = 'daily'").withColumn("day", F.date_format("timestamp", "yyyy-MM-dd"))
    return P.newest_each(daily, "tenant_id", "metric_type", "day").select("tenant_id", "metric_type", "day", "value")


@query(_sql("SELECT tenant_id, metric_type, source_id, count(*) AS samples FROM points GROUP BY ALL"))
def source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.coverage(R.rollup(points(spark, sf_dir), "day"))


_PRIMARY = "SELECT tenant_id, metric_type, source_id, samples, CASE WHEN preferred THEN 'preference' WHEN n = 1 THEN 'only_source' ELSE 'coverage' END AS reason FROM (SELECT *, count(*) OVER (PARTITION BY tenant_id, metric_type) AS n, row_number() OVER (PARTITION BY tenant_id, metric_type ORDER BY preferred DESC, samples DESC, source_id) AS r FROM c) WHERE r = 1"


@query(_sql(_PRIMARY, "c AS (SELECT tenant_id, metric_type, source_id, count(*) AS samples, tenant_id = 't1' AND metric_type = 'steps' AND source_id = 's2' AS preferred FROM points GROUP BY ALL)"))
def primary_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([("t1", "steps", "s2")], "tenant_id string, metric_type string, primary_source_id string")
    return S.primary_source(stored(spark, sf_dir).coverage(), wanted)


@query(_sql("SELECT strftime(timestamp, '%Y-%m-%d') AS day, count(*) AS stored, CAST(count(*) FILTER (WHERE timestamp < '2024-01-20 12:00:00' OR timestamp >= '2024-01-21') AS BIGINT) AS counted FROM points GROUP BY 1"))
def stored_day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store made anew: how many points of each day it holds, and how many its states have counted."""
    return build_store(spark, sf_dir).manifest().select("day", "stored", "counted")


@query(_sql(f"SELECT metric_type, {text_sql('b')} AS bucket, value FROM (SELECT *, row_number() OVER (PARTITION BY metric_type ORDER BY value DESC, b) AS n FROM (SELECT metric_type, date_trunc('day', timestamp) AS b, round({COLLAPSE_SQL}, 9) AS value FROM points WHERE tenant_id = 't3' GROUP BY metric_type, date_trunc('day', timestamp))) WHERE n <= 5"))
def bucket_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = R.rollup(points(spark, sf_dir).where("tenant_id = 't3'"), "day", "metric_type").withColumn("value", rounded("value"))
    order = Window.partitionBy("metric_type").orderBy(F.col("value").desc(), "bucket_start")
    return days.withColumn("n", F.row_number().over(order)).where("n <= 5").select("metric_type", text("bucket_start").alias("bucket"), "value")


@query(_sql(f"SELECT tenant_id, metric_type, {text_sql('b')} AS bucket FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, metric_type ORDER BY b) - 1 AS n, count(*) OVER (PARTITION BY tenant_id, metric_type) AS m FROM (SELECT DISTINCT tenant_id, metric_type, date_trunc('hour', timestamp) AS b FROM points)) WHERE m <= 40 OR n IN (SELECT CAST(round_even(i * (m - 1) / 39.0, 0) AS BIGINT) FROM range(40) r(i))"))
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = points(spark, sf_dir).select("tenant_id", "metric_type", F.date_trunc("hour", "timestamp").alias("bucket_start")).distinct()
    return S.evenly_sampled(hours, 40, "tenant_id", "metric_type").select("tenant_id", "metric_type", text("bucket_start").alias("bucket"))


@query(_sql("SELECT tenant_id, source_id, point_id FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, source_id ORDER BY timestamp, point_id) - 1 AS n, count(*) OVER (PARTITION BY tenant_id, source_id) AS m FROM points) WHERE n % CAST(greatest(ceil(m / 100.0), 1) AS BIGINT) = 0"))
def track_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.every_nth(points(spark, sf_dir), 100, "timestamp", "tenant_id", "source_id").select("tenant_id", "source_id", "point_id")


@query("SELECT s_suppkey AS source_id, n_name AS source_type, s_name AS display_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def source_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as connectors; their configuration isn't shown."""
    suppliers, nations = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return suppliers.join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("source_id"), F.col("n_name").alias("source_type"), F.col("s_name").alias("display_name"))


@query(_sql(f"SELECT source_id, {text_sql('max(timestamp)')} AS newest FROM points GROUP BY source_id"))
def newest_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).groupBy("source_id").agg(text(F.max("timestamp")).alias("newest"))


@query(_sql("SELECT p.metric_type, d.source_type, count(*) AS n FROM points p JOIN (SELECT concat('s', s_suppkey) AS source_id, n_name AS source_type FROM supplier JOIN nation ON s_nationkey = n_nationkey) d USING (source_id) GROUP BY ALL"))
def points_with_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = source_list(spark, sf_dir).select(F.concat(F.lit("s"), F.col("source_id").cast("string")).alias("source_id"), "source_type")
    return points(spark, sf_dir).join(sources, "source_id").groupBy("metric_type", "source_type").agg(F.count("*").alias("n"))


def _value(v: object) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + (",".join(v) if isinstance(v, list) else v).replace("'", "''") + "'"


_METRICS = "SELECT * FROM (VALUES " + ", ".join(f"({', '.join(map(_value, m.__dict__.values()))})" for m in metrics().values()) + ") AS t(" + ", ".join(next(iter(metrics().values())).__dict__) + ")"


@query(f"WITH {POINTS_SQL} SELECT metric_type, unit, aggregation, category, cadence, resolution, CAST(retention_days AS DOUBLE) AS retention_days, CAST(least AS DOUBLE) AS least, CAST(most AS DOUBLE) AS most, CAST(precision AS INTEGER) AS precision, sources, aliases, coalesce(n, 0) AS points FROM ({_METRICS}) LEFT JOIN (SELECT metric_type, count(*) AS n FROM points GROUP BY 1) USING (metric_type)")
def registry_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue, with how many points there are of each metric; names of sources and aliases as one text each."""
    counts = points(spark, sf_dir).groupBy("metric_type").agg(F.count("*").alias("points"))
    numbers = {c: F.col(c).cast(t) for c, t in (("retention_days", "double"), ("least", "double"), ("most", "double"), ("precision", "int"))}
    catalogue = registry(spark).withColumns({c: F.array_join(c, ",") for c in ("sources", "aliases")} | numbers)
    return catalogue.join(counts, "metric_type", "left").withColumn("points", F.coalesce("points", F.lit(0)))


@query(_sql("SELECT * FROM points WHERE tenant_id <> 't2'").replace("SELECT * FROM points WHERE tenant_id <> 't2'", "SELECT tenant_id, metric_type, count(*) AS n FROM points WHERE tenant_id <> 't2' GROUP BY ALL"))
def tenant_wipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.without_tenant(points(spark, sf_dir), "t2").groupBy("tenant_id", "metric_type").agg(F.count("*").alias("n"))


@query(_sql("SELECT tenant_id, metric_type, strftime(b, '%Y-%m-%d') AS day, point_id, value FROM (SELECT *, date_trunc('day', timestamp) AS b, row_number() OVER (PARTITION BY tenant_id, metric_type, date_trunc('day', timestamp) ORDER BY point_id % 3 = 0 DESC, value > 95 DESC, timestamp DESC, point_id DESC) AS n FROM points) WHERE n = 1"))
def preferred_per_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's value speaks for it before raw ones do, a provider's before a derived one."""
    day = F.when(F.col("point_id") % 3 == 0, "day").otherwise("raw")
    own = points(spark, sf_dir).withColumn("day", F.date_format("timestamp", "yyyy-MM-dd"))
    return P.newest_each(own, "tenant_id", "metric_type", "day", prefer=P.preference(day, F.col("value") > 95)).select("tenant_id", "metric_type", "day", "point_id", "value")
