"""Queries over coverage, connectors, reports and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.registry import registry
from ..operators import mapping as M
from ..operators import planning as P
from .driver_tables import POINTS_SQL, points, table
from .point_queries import _METRICS
from .register import query, rounded, text, text_sql


def _sql(select: str, *more: str) -> str:
    return ",\n".join([f"WITH {POINTS_SQL}", *more]) + "\n" + select


@query(_sql(
    f"SELECT tenant_id, {text_sql('min(b)')} AS range_start, {text_sql('max(b) + INTERVAL 6 HOUR')} AS range_end FROM (SELECT *, b - INTERVAL 6 HOUR * row_number() OVER (PARTITION BY tenant_id ORDER BY b) AS island FROM c WHERE n >= 0.9 * m) GROUP BY tenant_id, island",
    "g AS (SELECT tenant_id, unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-28' - INTERVAL 6 HOUR, INTERVAL 6 HOUR)) AS b FROM (SELECT DISTINCT tenant_id FROM points))",
    "n AS (SELECT g.tenant_id, b, count(point_id) AS n FROM g LEFT JOIN points p ON p.tenant_id = g.tenant_id AND p.timestamp >= b AND p.timestamp < b + INTERVAL 6 HOUR GROUP BY ALL)",
    "c AS (SELECT *, median(CASE WHEN n > 0 THEN n END) OVER (PARTITION BY tenant_id) AS m FROM n)",
))
def coverage_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.coverage_ranges(points(spark, sf_dir), "2024-01-02", "2024-01-28", 21_600, "tenant_id")
    return found.select("tenant_id", text("start").alias("range_start"), text("end").alias("range_end"))


@query("SELECT o_orderkey, CASE WHEN q > 0 THEN round(least(1.0, greatest(0.0, o_totalprice / q)), 9) END AS progress FROM (SELECT o_orderkey, o_totalprice, coalesce(sum(l_extendedprice), 0) AS q FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)")
def import_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs: their price is what is done, their lines what is expected."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("q"))
    runs = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    expected = F.coalesce("q", F.lit(0.0))
    return runs.select("o_orderkey", rounded(P.progress(F.col("o_totalprice"), expected)).alias("progress"))


@query("SELECT c_custkey, c_nationkey > 0 AND (m IS NULL OR epoch(TIMESTAMP '2001-07-01') - epoch(m) >= 3600 * 24 * 10 * c_nationkey) AS due FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS m FROM orders GROUP BY ALL) ON o_custkey = c_custkey")
def due_connectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as connectors that poll every so many times ten days as their nation's number."""
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    sources = table(spark, sf_dir, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    return sources.select("c_custkey", P.due(F.col("last"), F.col("c_nationkey") * 240, "2001-07-01").alias("due"))


@query("SELECT c_mktsegment AS tenant_id, max(o_orderdate) FILTER (WHERE o_orderstatus = 'F') < max(o_orderdate) AS stale FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def report_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report covers what had come by a tenant's last finished order."""
    runs = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("tenant_id", F.col("c_mktsegment"))
    reports = runs.groupBy("tenant_id").agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("covers_through"))
    water = runs.groupBy("tenant_id").agg(F.max("o_orderdate").alias("high_water"))
    return P.stale(reports, water).select("tenant_id", "stale")


@query(_sql("SELECT tenant_id, source_id, strftime(greatest(min(CAST(timestamp AS DATE)), DATE '2024-01-15'), '%Y-%m-%d') AS first, strftime(max(CAST(timestamp AS DATE)), '%Y-%m-%d') AS last, array_to_string(list_sort(list(DISTINCT 'data.' || metric_type)), ',') AS fields FROM points WHERE metric_type IN ('steps', 'heart_rate') AND source_id <> 's2' GROUP BY ALL"))
def pending_backfills(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("timestamp")
    reports = points(spark, sf_dir).select(
        "tenant_id", "source_id", F.concat(F.lit("data."), "metric_type").alias("field_path"), at.alias("first_seen"), at.alias("last_seen"),
        F.when(F.col("metric_type").isin("steps", "heart_rate"), at).alias("supported_since"), F.when(F.col("source_id") == "s2", at).alias("history_backfilled_at"),
    )
    found = P.pending_backfills(reports, "2024-01-30", 15)
    return found.withColumn("first", F.date_format("first", "yyyy-MM-dd")).withColumn("last", F.date_format("last", "yyyy-MM-dd"))


@query("SELECT c_mktsegment AS source, count(*) FILTER (WHERE o_orderstatus = 'F') AS map, count(*) FILTER (WHERE o_orderstatus = 'O') AS adopt, count(*) FILTER (WHERE o_orderstatus = 'P') AS discard FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def mapping_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rules; their status is the action."""
    action = F.when(F.col("o_orderstatus") == "F", "map").when(F.col("o_orderstatus") == "O", "adopt").otherwise("discard")
    rules = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    counted = rules.withColumn("action", action).groupBy(F.col("c_mktsegment").alias("source")).pivot("action", ["map", "adopt", "discard"])
    return counted.count().na.fill(0)


@query("SELECT c_mktsegment AS lane, CASE WHEN count(*) FILTER (WHERE m IS NULL) = 0 THEN strftime(min(m), '%Y-%m-%d') END AS complete_through FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS m FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL) ON o_custkey = c_custkey GROUP BY ALL")
def lane_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lane is complete through the earliest of its sources' last successes; unknown where one has none."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_orderdate").alias("m"))
    sources = table(spark, sf_dir, "customer").join(done, F.col("c_custkey") == F.col("o_custkey"), "left")
    told = sources.groupBy(F.col("c_mktsegment").alias("lane")).agg(F.min("m").alias("m"), F.count_if(F.col("m").isNull()).alias("unknown"))
    return told.select("lane", F.when(F.col("unknown") == 0, F.date_format("m", "yyyy-MM-dd")).alias("complete_through"))


@query(_sql("SELECT tenant_id, metric_type, arg_min(value, (timestamp, point_id)) AS value, strftime(CAST(timestamp AS DATE), '%Y-%m-%d') AS day FROM points GROUP BY tenant_id, metric_type, CAST(timestamp AS DATE)"))
def first_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily series of the simple correlation matrix: the earliest point of a day, sources mixed."""
    days = points(spark, sf_dir).groupBy("tenant_id", "metric_type", F.date_format("timestamp", "yyyy-MM-dd").alias("day"))
    return days.agg(F.min_by("value", F.struct("timestamp", "point_id")).alias("value"))


_OWN = "(VALUES ('t1', 'steps', 'hour', 30), ('t2', 'heart_rate', NULL, NULL)) AS o(tenant_id, metric_type, own_resolution, days)"


@query(f"""WITH {POINTS_SQL}, e AS (SELECT g.tenant_id, m.metric_type, coalesce(o.own_resolution, m.resolution) AS resolution, CASE WHEN o.tenant_id IS NULL THEN m.retention_days ELSE o.days END AS days
    FROM (VALUES ('t1'), ('t2')) AS g(tenant_id) CROSS JOIN ({_METRICS}) m LEFT JOIN {_OWN} ON o.tenant_id = g.tenant_id AND o.metric_type = m.metric_type)
SELECT e.tenant_id, e.metric_type, e.resolution, CAST(e.days AS DOUBLE) AS retention_days, count(p.point_id) AS points, count(p.point_id) FILTER (date_diff('day', p.timestamp, TIMESTAMP '2024-03-01') > e.days) AS expired
FROM e LEFT JOIN points p ON p.tenant_id = e.tenant_id AND p.metric_type = e.metric_type GROUP BY ALL""")
def effective_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policies of two tenants, and how many of their points there are and are past them on a day."""
    own = spark.createDataFrame([("t1", "steps", "hour", 30), ("t2", "heart_rate", "odd", None)], "tenant_id string, metric_type string, resolution string, raw_retention_days int")
    policies = M.effective_policies(spark, own).withColumn("retention_days", F.col("retention_days").cast("double"))
    days = points(spark, sf_dir).groupBy("tenant_id", "metric_type", F.to_date("timestamp").alias("day")).agg(F.count("*").alias("n"))
    age = F.datediff(F.lit("2024-03-01").cast("date"), F.col("day"))
    met = policies.join(days, ["tenant_id", "metric_type"], "left").groupBy("tenant_id", "metric_type", "resolution", "retention_days")
    return met.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("points"), F.coalesce(F.sum(F.when(age > F.col("retention_days"), F.col("n"))), F.lit(0)).alias("expired"))


_REPORTS = """runs AS (SELECT 't' || (o_custkey % 40) AS tenant_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'gaps' WHEN '2-HIGH' THEN 'day' ELSE 'insights' END AS kind,
    CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE 'running' END AS status, CAST(o_orderdate AS TIMESTAMP) AS moment, CAST(o_orderkey % 400 AS INTEGER) AS days, CAST((o_orderkey % 24) * 60 - 720 AS INTEGER) AS minutes FROM orders),
water AS (SELECT tenant_id, max(moment) AS high FROM runs WHERE status = 'success' AND kind = 'day' GROUP BY ALL),
latest AS (SELECT tenant_id, kind, max(moment) AS moment, arg_max(days, (moment, days)) AS days, arg_max(minutes, (moment, days)) AS minutes FROM runs WHERE status = 'success' GROUP BY ALL),
want AS (SELECT w.tenant_id, k.kind, w.high, l.moment, l.days, l.minutes FROM water w CROSS JOIN (VALUES ('gaps'), ('day'), ('insights')) AS k(kind) LEFT JOIN latest l ON l.tenant_id = w.tenant_id AND l.kind = k.kind
    WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.tenant_id = w.tenant_id AND r.kind = k.kind AND r.status = 'running' AND date_diff('second', r.moment, TIMESTAMP '2001-08-02 12:00:00') <= 90000))"""


@query(f"WITH {_REPORTS} SELECT tenant_id, kind, CASE WHEN moment IS NULL THEN 'no_report' WHEN moment < high THEN 'new_data' ELSE 'max_age' END AS reason FROM want WHERE NOT coalesce(days > 90 AND date_diff('second', moment, TIMESTAMP '2001-08-02 12:00:00') < 129600 AND NOT (hour(TIMESTAMP '2001-08-02 12:00:00' + to_minutes(minutes)) BETWEEN 1 AND 4), false)")
def due_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as report runs of forty tenants; those of one kind also stand for imports."""
    priority, status, k = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_orderkey")
    at = F.col("o_orderdate").cast("timestamp_ntz")
    runs = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("t"), (F.col("o_custkey") % 40).cast("string")).alias("tenant_id"),
        F.when(priority == "1-URGENT", "gaps").when(priority == "2-HIGH", "day").otherwise("insights").alias("kind"),
        F.when(status == "F", "success").when(status == "O", "failed").otherwise("running").alias("status"),
        at.alias("started_at"), at.alias("finished_at"), at.alias("covers_through"), (k % 400).cast("int").alias("window_days"), ((k % 24) * 60 - 720).cast("int").alias("offset_minutes"),
    )
    imports = runs.where("kind = 'day'").select("tenant_id", "status", "finished_at")
    return P.due_reports(runs, imports, ["gaps", "day", "insights"], "2001-08-02 12:00:00", most_age_hours=12, stuck_hours=25)


@query(_sql("SELECT metric_type, source_id, count(*) AS n FROM points WHERE metric_type IN ('steps', 'heart_rate', 'body_weight') AND source_id = 's1' GROUP BY ALL"))
def metrics_of_a_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of what the registry says that a kind of source sends."""
    sent = registry(spark).where(F.array_contains("sources", "apple_health") & F.col("metric_type").isin("steps", "heart_rate", "body_weight", "heart_rate_max")).select("metric_type")
    return points(spark, sf_dir).where("source_id = 's1'").join(F.broadcast(sent), "metric_type", "left_semi").groupBy("metric_type", "source_id").agg(F.count("*").alias("n"))
