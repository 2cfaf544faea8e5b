"""Aggregates that follow the registry, mergeable rollups, and what they cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.registry import with_definition

KEYS = ("tenant_id", "source_id", "metric_type")


def partial_states(value: Column, at: Column, weight: Column | None = None, order: Column | None = None) -> list[Column]:
    """State of a group of points that can be merged with that of another. Points without a value are left out."""
    weight = F.coalesce(weight, F.lit(1.0)) if weight is not None else F.lit(1.0)
    weight = F.when(value.isNotNull(), F.greatest(weight, F.lit(1.0)))
    order = order if order is not None else F.struct(at)
    there = value.isNotNull()
    return [
        F.count(value).alias("sample_count"),
        F.sum(value).alias("sum_value"),
        F.sum(value * weight).alias("weighted_sum"),
        F.sum(weight).alias("weight"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.min(F.when(there, at)).alias("first_timestamp"),
        F.max(F.when(there, at)).alias("last_timestamp"),
        F.min(F.when(there, order)).alias("first_key"),
        F.max(F.when(there, order)).alias("last_key"),
        F.min_by(value, F.when(there, order)).alias("first_value"),
        F.max_by(value, F.when(there, order)).alias("last_value"),
    ]


STATE = ("sample_count", "sum_value", "weighted_sum", "weight", "min_value", "max_value", "first_timestamp", "last_timestamp", "first_key", "last_key", "first_value", "last_value")


def merged_states() -> list[Column]:
    return [
        F.sum("sample_count").alias("sample_count"),
        F.sum("sum_value").alias("sum_value"),
        F.sum("weighted_sum").alias("weighted_sum"),
        F.sum("weight").alias("weight"),
        F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"),
        F.min("first_timestamp").alias("first_timestamp"),
        F.max("last_timestamp").alias("last_timestamp"),
        F.min("first_key").alias("first_key"),
        F.max("last_key").alias("last_key"),
        F.min_by("first_value", "first_key").alias("first_value"),
        F.max_by("last_value", "last_key").alias("last_value"),
    ]


def final_value() -> Column:
    """The value of a state under the metric's aggregation."""
    return (
        F.when(F.col("aggregation") == "sum", F.col("sum_value"))
        .when(F.col("aggregation") == "max", F.col("max_value"))
        .when(F.col("aggregation") == "last", F.col("last_value"))
        .otherwise(F.try_divide("weighted_sum", "weight"))
    )


def rollup(points: DataFrame, resolution: str, *keys: str) -> DataFrame:
    """One state for each key and bucket. Ties in time go by point_id.

    Where a bucket of summed values holds provider totals (a boolean column is_total), the latest of these
    is the value and the other samples don't count.
    """
    keys = keys or KEYS
    totals = "is_total" in points.columns
    bucketed = points.withColumn("bucket_start", F.date_trunc(resolution, "timestamp").cast("timestamp_ntz"))
    order = F.struct("timestamp", "point_id")
    more = [F.bool_or("is_total").alias("is_provider_total"), F.max_by("value", F.when(F.col("is_total"), order)).alias("total_value")] if totals else []
    states = bucketed.groupBy(*keys, "bucket_start").agg(*partial_states(F.col("value"), F.col("timestamp"), order=order), *more)
    valued = with_definition(states, ("aggregation",)).withColumn("value", final_value())
    if totals:
        valued = valued.withColumn("value", F.when(F.col("is_provider_total") & (F.col("aggregation") == "sum"), F.col("total_value")).otherwise(F.col("value")))
    return valued.withColumn("resolution", F.lit(resolution))


def merge(states: DataFrame, *keys: str) -> DataFrame:
    """States of one key from several batches or tables as one state, with its value."""
    merged = states.groupBy(*keys).agg(*merged_states())
    return with_definition(merged, ("aggregation",)).withColumn("value", final_value())


def uncovered(points: DataFrame, rollups: DataFrame, resolution: str) -> DataFrame:
    """Points that no rollup of their bucket covers: its first and last time enclose those it has counted."""
    own = rollups.select(*KEYS, F.col("bucket_start").alias("_bucket"), F.col("first_timestamp").alias("_first"), F.col("last_timestamp").alias("_last"))
    bucket = F.date_trunc(resolution, F.col("p.timestamp")).cast("timestamp_ntz")
    on = [F.col(f"p.{k}") == F.col(f"r.{k}") for k in KEYS] + [bucket == F.col("r._bucket"), F.col("p.timestamp").between(F.col("r._first"), F.col("r._last"))]
    return points.alias("p").join(own.alias("r"), on, "left_anti")


def hybrid(points: DataFrame, rollups: DataFrame, resolution: str) -> DataFrame:
    """Values of each bucket from rollups and, where these don't cover them, from points; states are merged."""
    columns = [*KEYS, "bucket_start", *STATE]
    rest = rollup(uncovered(points, rollups, resolution), resolution)
    return merge(rollups.select(columns).unionByName(rest.select(columns)), *KEYS, "bucket_start")


def summary(points: DataFrame, rollups: DataFrame, tenant: str) -> DataFrame:
    """The whole history of each metric: from day rollups, and from points that these don't cover."""
    own = points.where(F.col("tenant_id") == tenant)
    states = rollups.where(F.col("tenant_id") == tenant)
    rest = rollup(uncovered(own, states, "day"), "day")
    columns = ["metric_type", *STATE]
    return merge(states.select(columns).unionByName(rest.select(columns)), "metric_type")
