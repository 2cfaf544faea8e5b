"""The library's shapes as projections of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with ``place``, which grows with its files by name and with the rows in each."""
    own = table(spark, sf_dir, name)
    files = sorted(own.inputFiles())
    told = own.withColumns({"place": F.col("_metadata.row_index"), "_file": F.input_file_name()})
    if len(files) < 2:
        return told.drop("_file")
    numbers = F.broadcast(spark.createDataFrame(list(zip(files, range(len(files)), strict=True)), "_file string, _number long"))
    return told.join(numbers, "_file", "left").withColumn("place", F.coalesce("_number", F.lit(0)) * (1 << 36) + F.col("place")).drop("_file", "_number")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as metric points of four tenants with three sources each."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("point_id"),
        F.concat(F.lit("t"), (F.col("user_id") % 4).cast("string")).alias("tenant_id"),
        F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("source_id"),
        F.when(kind == "view", "steps").when(kind == "click", "heart_rate").when(kind == "purchase", "heart_rate_max").when(kind == "signup", "body_weight").otherwise("workout_heart_rate").alias("metric_type"),
        F.col("ts").alias("timestamp"),
        "value",
        F.col("props").alias("metadata"),
    )


def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as strength sets: the order is the session, the part the exercise."""
    lines, orders, parts = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.concat(F.lit("t"), (F.col("o_custkey") % 4).cast("string")).alias("tenant_id"),
            F.col("o_orderkey").alias("session_id"),
            F.col("l_linenumber").alias("set_number"),
            F.col("o_orderdate").alias("at"),
            F.col("p_brand").alias("exercise_title"),
            F.col("p_type").alias("muscle_group"),
            F.col("l_extendedprice").alias("weight_kg"),
            F.col("l_quantity").alias("reps"),
            F.col("l_partkey").alias("part"),
            F.col("l_suppkey").alias("supplier"),
        )
    )


POINTS_SQL = """points AS (
    SELECT event_id AS point_id, concat('t', user_id % 4) AS tenant_id, concat('s', user_id % 3) AS source_id,
           CASE event_type WHEN 'view' THEN 'steps' WHEN 'click' THEN 'heart_rate' WHEN 'purchase' THEN 'heart_rate_max'
                           WHEN 'signup' THEN 'body_weight' ELSE 'workout_heart_rate' END AS metric_type,
           ts AS timestamp, value, props AS metadata
    FROM events)"""

SETS_SQL = """sets AS (
    SELECT concat('t', o_custkey % 4) AS tenant_id, o_orderkey AS session_id, l_linenumber AS set_number, o_orderdate AS "at",
           p_brand AS exercise_title, p_type AS muscle_group, l_extendedprice AS weight_kg, l_quantity AS reps,
           l_partkey AS part, l_suppkey AS supplier
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

#: How the metrics of the projection aggregate, as the registry has it.
COLLAPSE_SQL = """CASE WHEN metric_type = 'steps' THEN sum(value) WHEN metric_type = 'heart_rate_max' THEN max(value)
    WHEN metric_type = 'body_weight' THEN arg_max(value, (timestamp, point_id)) ELSE avg(value) END"""
