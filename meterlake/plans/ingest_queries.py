"""Queries over events on their way to points: keys, names, validation, mapping, quarantine, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.registry import canonical, converted, unit_factors
from ..operators import ingest as G
from .driver_tables import POINTS_SQL, points, table
from .register import query, rounded, text, text_sql


def _sql(select: str, *more: str) -> str:
    return ",\n".join([f"WITH {POINTS_SQL}", *more]) + "\n" + select


@query(_sql(f"SELECT point_id, sha256(concat_ws(':', tenant_id, source_id, metric_type, {text_sql('timestamp')})) AS key FROM points"))
def idempotency_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("point_id", X.idempotency_key(F.col("tenant_id"), F.col("source_id"), F.col("metric_type"), text("timestamp")).alias("key"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_brand || ' / ' || p_name || '!'), '[^0-9a-z]+', '_', 'g'), '_') AS slug FROM part")
def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.slug(F.concat("p_brand", F.lit(" / "), "p_name", F.lit("!"))).alias("slug"))


@query("SELECT p_partkey, trim(regexp_replace(replace(lower(regexp_replace(replace(replace('HKWorkoutActivityType' || upper(substr(p_name, 1, 1)) || substr(p_name, 2) || 'Übung', 'HKWorkoutActivityType', ''), 'xx', 'xx'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), 'ü', 'ue'), '[^a-z0-9]+', ' ', 'g')) AS activity FROM part")
def activity_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("HKWorkoutActivityType"), F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"), F.lit("Übung"))
    return table(spark, sf_dir, "part").select("p_partkey", X.activity_name(raw).alias("activity"))


#: What providers call activities and muscles, and what these are.
_ACTIVITY_CASES = [("HKWorkoutActivityTypeTraditionalStrengthTraining", "strength_training"), ("Outdoor Radfahren", "cycling"), ("open water swim", "swimming"), ("Tischtennis", "tennis"), ("Innenräume Ausführen", "running"), ("Rock_climbings", "climbing"), ("Curling", "other"), ("", "other")]
_MUSCLE_CASES = [(" Upper-Back ", "back"), ("Gesäß", "glutes"), ("Full_Body", "full_body"), ("legs", "quads"), ("Kettlebell", None), ("arme", "other")]


def _case_sql(cases: list[tuple[str, str | None]], out: str) -> str:
    values = ", ".join(f"({k}, '{raw}', {'NULL' if kind is None else chr(39) + kind + chr(39)})" for k, (raw, kind) in enumerate(cases))
    return f"SELECT p_partkey, kind AS {out} FROM part JOIN (VALUES {values}) AS c(k, raw, kind) ON p_partkey % {len(cases)} = k"


def _raw(cases: list[tuple[str, str | None]]) -> Column:
    return F.get(F.array(*[F.lit(raw) for raw, _ in cases]), (F.col("p_partkey") % len(cases)).cast("int"))


@query(_case_sql(_ACTIVITY_CASES, "activity_type"))
def activity_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.activity_metadata(_raw(_ACTIVITY_CASES))["activity_type"].alias("activity_type"))


@query(_case_sql(_MUSCLE_CASES, "muscle_group"))
def muscle_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.muscle_group(_raw(_MUSCLE_CASES)).alias("muscle_group"))


@query(_sql("SELECT CASE WHEN point_id % 7 = 1 THEN 'wrong_key' WHEN point_id % 5 = 2 AND metric_type = 'steps' THEN 'legacy_alias' ELSE 'valid' END AS reason, count(*) AS n FROM points GROUP BY ALL"))
def key_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the key of their canonical name; some keys are of another event, some names are legacy aliases."""
    k = F.col("point_id")
    keyed = G.keyed(points(spark, sf_dir)).withColumn("idempotency_key", F.when(k % 7 == 1, F.sha2(k.cast("string"), 256)).otherwise(F.col("idempotency_key")))
    named = canonical(keyed.withColumn("metric_type", F.when((k % 5 == 2) & (F.col("metric_type") == "steps"), "step_count").otherwise(F.col("metric_type"))))
    reason = G.reject_reason(F.col("canonical"), F.col("idempotency_key"))
    return named.groupBy(F.coalesce(reason, F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT state, CASE lower(trim(state)) WHEN 'on' THEN 1.0 WHEN 'off' THEN 0.0 ELSE try_cast(state AS DOUBLE) END AS value, n FROM (SELECT CASE event_id % 5 WHEN 0 THEN 'On' WHEN 1 THEN 'off ' WHEN 2 THEN 'unavailable' ELSE CAST(user_id AS VARCHAR) || '.5' END AS state, count(*) AS n FROM events GROUP BY ALL)")
def numeric_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    state = F.when(k == 0, "On").when(k == 1, "off ").when(k == 2, "unavailable").otherwise(F.concat(F.col("user_id").cast("string"), F.lit(".5")))
    return table(spark, sf_dir, "events").groupBy(state.alias("state")).agg(F.count("*").alias("n")).withColumn("value", X.numeric_state(F.col("state")))


@query(f"SELECT event_id, CASE WHEN event_id % 8 < 7 THEN strftime(CASE event_id % 8 WHEN 3 THEN ts - INTERVAL 2 HOUR WHEN 6 THEN date_trunc('day', ts) ELSE date_trunc(CASE WHEN event_id % 8 = 2 THEN 'milliseconds' ELSE 'second' END, ts) END, '%Y-%m-%d %H:%M:%S') END AS at FROM events".replace("AS at", 'AS "at"'))
def timestamp_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in the formats of several providers, and ones that are none."""
    k = F.col("event_id") % 8
    shown = lambda f: F.date_format("ts", f)
    raw = (
        F.when(k == 0, shown("yyyy-MM-dd HH:mm:ss"))
        .when(k == 1, F.concat(shown("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")))
        .when(k == 2, F.concat(shown("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")))
        .when(k == 3, F.concat(shown("yyyy-MM-dd HH:mm:ss"), F.lit("+02:00")))
        .when(k == 4, F.concat(shown("yyyy-MM-dd HH:mm:ss"), F.lit(" +0000")))
        .when(k == 5, shown("yyyy-MM-dd'T'HH:mm:ss"))
        .when(k == 6, shown("yyyy-MM-dd"))
        .otherwise(shown("HH:mm:ss"))
    )
    return table(spark, sf_dir, "events").select("event_id", text(X.parsed_timestamp(raw)).alias("at"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * CASE l_returnflag WHEN 'A' THEN 0.45359237 WHEN 'N' THEN 1.0 END, 6) AS kilograms FROM lineitem")
def unit_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("l_returnflag") == "A", "lb").when(F.col("l_returnflag") == "N", "kg").otherwise("stone")
    rows = table(spark, sf_dir, "lineitem").withColumn("unit", unit).withColumn("target", F.lit("kg"))
    return converted(rows, "l_extendedprice", "unit", "target", "kilograms").select("l_orderkey", "l_linenumber", "l_partkey", rounded("kilograms", 6).alias("kilograms"))


_FACTORS = "(VALUES " + ", ".join(f"('{a}', '{b}', CAST({f!r} AS DOUBLE))" for (a, b), f in unit_factors().items()) + ") AS t(source, target, factor)"


@query(f"SELECT source, target, factor, round(factor * total, 2) AS converted FROM {_FACTORS}, (SELECT sum(l_quantity) AS total FROM lineitem)")
def unit_factor_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each known conversion, of the quantity of all lines."""
    total = table(spark, sf_dir, "lineitem").agg(F.sum("l_quantity").cast("double").alias("total"))
    known = spark.createDataFrame([(a, b, f) for (a, b), f in unit_factors().items()], "source string, target string, factor double")
    rows = total.withColumn("_k", F.lit(1)).join(F.broadcast(known.withColumn("_k", F.lit(1))), "_k")  # 42 conversions of one row
    return converted(rows, "total", "source", "target").select("source", "target", "factor", rounded("converted", 2).alias("converted"))


@query("SELECT CASE event_type WHEN 'view' THEN 'step_count' WHEN 'click' THEN 'custom_mood' WHEN 'error' THEN ' heart_rate ' ELSE event_type END AS raw, CASE event_type WHEN 'view' THEN 'steps' WHEN 'click' THEN 'custom_mood' WHEN 'error' THEN 'heart_rate' END AS canonical, count(*) AS n FROM events GROUP BY ALL")
def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    raw = F.when(kind == "view", "step_count").when(kind == "click", "custom_mood").when(kind == "error", " heart_rate ").otherwise(kind)
    return canonical(table(spark, sf_dir, "events").withColumn("raw", raw), "raw").groupBy("raw", "canonical").agg(F.count("*").alias("n"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that arrive in the order of their ids; some are broken."""
    own, k = points(spark, sf_dir), F.col("point_id")
    return own.withColumns({
        "arrival": k,
        "tenant_id": F.when(k % 97 == 0, "").otherwise(F.col("tenant_id")),
        "metric_type": F.when(k % 89 == 0, " ").otherwise(F.col("metric_type")),
        "value": F.when(k % 83 == 0, float("nan")).otherwise(F.col("value")),
    })


@query(_sql("SELECT CASE WHEN point_id % 97 = 0 THEN 'missing_tenant' WHEN point_id % 89 = 0 THEN 'missing_metric' WHEN point_id % 83 = 0 THEN 'not_finite' ELSE 'valid' END AS reason, count(*) AS n FROM points GROUP BY ALL"))
def validation_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy(F.coalesce(G.reject_reason(), F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query(_sql("SELECT tenant_id, source_id, metric_type, strftime(day, '%Y-%m-%d') AS day, point_id FROM (SELECT *, CAST(timestamp AS DATE) AS day, row_number() OVER (PARTITION BY tenant_id, source_id, metric_type, CAST(timestamp AS DATE) ORDER BY point_id) AS n FROM points) WHERE n = 1"))
def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a day share a key here; the first to arrive stays."""
    own = points(spark, sf_dir).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd")).withColumn("arrival", F.col("point_id"))
    return G.deduplicated(G.keyed(own)).select("tenant_id", "source_id", "metric_type", F.col("timestamp").alias("day"), "point_id")


@query(_sql("SELECT point_id FROM points WHERE timestamp >= '2024-01-15'"))
def new_points_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = G.keyed(points(spark, sf_dir))
    return G.new_only(own, own.where("timestamp < '2024-01-15'")).select("point_id")


_UNKNOWN = "u AS (SELECT *, 'odd_' || (CAST(json_extract_string(metadata, '$.k') AS BIGINT) % 40) AS raw FROM points WHERE metric_type IN ('steps', 'heart_rate'))"


def _unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = points(spark, sf_dir).where("metric_type IN ('steps', 'heart_rate')")
    return own.withColumn("metric_type", F.concat(F.lit("odd_"), (F.get_json_object("metadata", "$.k").cast("long") % 40).cast("string"))).withColumn("arrival", F.col("point_id"))


@query(_sql("SELECT tenant_id, source_id, CASE WHEN r > 10 THEN 'too_many_names' WHEN w > 50 THEN 'too_many_rows' ELSE 'quarantined' END AS outcome, count(*) AS n FROM (SELECT u.*, r, row_number() OVER (PARTITION BY u.tenant_id, u.source_id, r <= 10 ORDER BY point_id) AS w FROM u JOIN (SELECT *, row_number() OVER (PARTITION BY tenant_id, source_id ORDER BY f, raw) AS r FROM (SELECT tenant_id, source_id, raw, min(point_id) AS f FROM u GROUP BY ALL)) USING (tenant_id, source_id, raw)) GROUP BY ALL", _UNKNOWN))
def quarantine_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.quarantine_split(_unknown(spark, sf_dir), names=10, rows=50).groupBy("tenant_id", "source_id", "outcome").agg(F.count("*").alias("n"))


@query(_sql("SELECT tenant_id, source_id, action, m AS metric_type, count(*) AS n, round(sum(v), 6) AS total FROM (SELECT *, CASE WHEN raw = 'odd_1' AND tenant_id = 't1' AND source_id = 's1' THEN 'map' WHEN raw = 'odd_2' AND tenant_id = 't1' AND source_id = 's1' THEN 'discard' ELSE 'quarantine' END AS action, CASE WHEN raw = 'odd_1' AND tenant_id = 't1' AND source_id = 's1' THEN 'energy_active' ELSE raw END AS m, CASE WHEN raw = 'odd_1' AND tenant_id = 't1' AND source_id = 's1' THEN value / 4.184 ELSE value END AS v FROM u) GROUP BY ALL", _UNKNOWN))
def mapping_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(
        [("t1", "s1", "odd_1", "map", "energy_active", "kJ", "kcal"), ("t1", "s1", "odd_2", "discard", None, None, None)],
        "tenant_id string, source_id string, metric_type string, action string, target_metric_type string, source_unit string, target_unit string",
    )
    told = G.mapped(_unknown(spark, sf_dir), rules)
    return told.groupBy("tenant_id", "source_id", "action", "metric_type").agg(F.count("*").alias("n"), rounded(F.sum("value"), 6).alias("total"))


@query(_sql(f"SELECT tenant_id, source_id, metric_type, {text_sql('b')} AS bucket, round(CASE WHEN t = 1 OR metric_type = 'body_weight' THEN arg_max(value, (timestamp, point_id)) WHEN metric_type = 'steps' THEN sum(value) WHEN metric_type = 'heart_rate_max' THEN max(value) ELSE avg(value) END, 9) AS value, count(*) AS bucket_samples, min(value) AS bucket_min, max(value) AS bucket_max, t = 1 AS provider_total FROM (SELECT *, CASE WHEN t = 1 THEN date_trunc('day', timestamp) ELSE date_trunc('hour', timestamp) END AS b FROM e WHERE t = 0 OR total) GROUP BY tenant_id, source_id, metric_type, b, t", "e AS (SELECT *, value > 95 AS total, max(CASE WHEN value > 95 AND metric_type = 'steps' THEN 1 ELSE 0 END) OVER (PARTITION BY tenant_id, source_id, metric_type, date_trunc('day', timestamp)) AS t FROM points)"))
def batch_preaggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = points(spark, sf_dir).withColumn("is_total", F.col("value") > 95)
    told = G.preaggregated(own, "hour")
    return told.select("tenant_id", "source_id", "metric_type", text("bucket_start").alias("bucket"), rounded("value").alias("value"), "bucket_samples", "bucket_min", "bucket_max", "provider_total")


@query("SELECT o_orderkey AS batch_id, CAST(l_linenumber - 1 AS INTEGER) AS position, CASE WHEN l_linenumber % 5 = 0 THEN 'other' ELSE 't' || (o_custkey % 4) END AS tenant_id, l_linenumber % 5 = 0 AS mismatch FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey)")
def envelope_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as envelopes of their lines; each fifth child names another tenant."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    tenant = F.concat(F.lit("t"), (F.col("o_custkey") % 4).cast("string"))
    child = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    batches = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey", tenant.alias("tenant_id")).agg(F.sort_array(F.collect_list(child)).alias("c"))
    event = lambda c, i: F.struct(F.when((i + 1) % 5 == 0, "other").alias("tenant_id"), F.lit(None).cast("string").alias("source_id"), F.lit("steps").alias("metric_type"), F.lit(None).cast("timestamp").alias("timestamp"), c["l_extendedprice"].alias("value"))
    envelopes = batches.select(F.col("o_orderkey").alias("batch_id"), "tenant_id", F.lit("s").alias("source_id"), F.transform("c", event).alias("events"))
    return G.exploded(envelopes).select("batch_id", "position", "tenant_id", "mismatch")


@query(_sql("SELECT metric_type, count(*) AS n FROM points WHERE date_diff('day', CAST(timestamp AS DATE), DATE '2024-04-10') > CASE WHEN metric_type = 'workout_heart_rate' THEN 365 WHEN metric_type = 'steps' AND tenant_id = 't1' THEN 80 WHEN metric_type = 'steps' AND tenant_id = 't2' THEN NULL ELSE 90 END GROUP BY ALL"))
def retention_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([("t1", "steps", 80), ("t2", "steps", None)], "tenant_id string, metric_type string, raw_retention_days int")
    return G.purgeable(points(spark, sf_dir), "2024-04-10", own).groupBy("metric_type").agg(F.count("*").alias("n"))


@query(_sql(f"SELECT tenant_id, source_id, 'data.' || metric_type AS field_path, count(*) * 2 AS occurrences, max(CASE WHEN point_id % 2 = 0 THEN metric_type END) AS metric_type, {text_sql('min(timestamp)')} AS first_seen, {text_sql('max(timestamp)')} AS last_seen FROM points GROUP BY tenant_id, source_id, points.metric_type"))
def field_report_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = points(spark, sf_dir)
    reports = own.select("tenant_id", "source_id", F.concat(F.lit("data."), "metric_type").alias("field_path"), F.lit(2).alias("occurrences"), F.when(F.col("point_id") % 2 == 0, F.col("metric_type")).alias("metric_type"), F.col("timestamp").alias("seen_at"))
    return G.field_reports(reports).withColumn("first_seen", text("first_seen")).withColumn("last_seen", text("last_seen"))


@query(_sql("SELECT tenant_id, source_id, count(*) AS n, count(DISTINCT raw) AS names, CASE WHEN count(DISTINCT raw) >= 100 OR count(*) >= 100000 THEN 'critical' WHEN count(DISTINCT raw) >= 80 OR count(*) >= 80000 THEN 'warning' ELSE 'ok' END AS warning FROM (SELECT *, 'odd_' || CAST(json_extract_string(metadata, '$.k') AS BIGINT) AS raw FROM points) GROUP BY ALL"))
def capacity_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = points(spark, sf_dir).groupBy("tenant_id", "source_id").agg(F.count("*").alias("n"), F.count_distinct(F.get_json_object("metadata", "$.k")).alias("names"))
    return own.withColumn("warning", G.capacity_warning(F.col("n"), F.col("names"), F.lit(0)))


@query("SELECT 'import' AS kind, o_orderkey AS job_id, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'report', o_orderkey, strftime(o_orderdate, '%Y-%m-%d') FROM orders WHERE o_orderstatus = 'P'")
def jobs_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    kinds = [runs.where(F.col("o_orderstatus") == s).select(F.lit(k).alias("kind"), "job_id", "day") for s, k in (("F", "import"), ("P", "report"))]
    return kinds[0].unionByName(kinds[1])


@query("SELECT c_mktsegment AS tenant_id, n, seconds FROM (SELECT c_mktsegment, count(*) AS n, median(o_totalprice) AS seconds FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY ALL)")
def typical_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median over runs that succeeded."""
    runs = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return runs.where("o_orderstatus = 'F'").groupBy(F.col("c_mktsegment").alias("tenant_id")).agg(F.count("*").alias("n"), F.median("o_totalprice").alias("seconds"))


@query("SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderstatus <> 'O') WHERE n = 1")
def newest_successful_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("o_custkey", "o_orderpriority").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    runs = table(spark, sf_dir, "orders").where("o_orderstatus <> 'O'").withColumn("n", F.row_number().over(order)).where("n = 1")
    return runs.select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("SELECT n_name, count(o_orderkey) AS runs, count(DISTINCT c_custkey) AS sources FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name")
def runs_with_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    runs = table(spark, sf_dir, "orders")
    return sources.join(runs, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("n_name").agg(F.count("o_orderkey").alias("runs"), F.count_distinct("c_custkey").alias("sources"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority LIKE '1%')")
def sources_without_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs are orders of one status and priority."""
    runs = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' AND o_orderpriority LIKE '1%'")
    return table(spark, sf_dir, "customer").join(runs, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")
