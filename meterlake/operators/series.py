"""Dense, ranked and sampled series, and which source of several a series takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rollups import merge

STEPS = {"minute": "1 minute", "hour": "1 hour", "day": "1 day", "week": "7 days"}


def choose_resolution(seconds: float) -> str:
    """Raw up to two hours, minutes up to a day, hours up to ninety days, else days."""
    return "raw" if seconds <= 7200 else "minute" if seconds <= 86_400 else "hour" if seconds <= 90 * 86_400 else "day"


def bucket_grid(frame: DataFrame, start: str, end: str, resolution: str) -> DataFrame:
    """Each row of ``frame`` with every bucket from ``start`` to before ``end``."""
    first = F.date_trunc(resolution, F.lit(start).cast("timestamp_ntz")).cast("timestamp_ntz")
    last = F.lit(end).cast("timestamp_ntz") - F.expr("interval 1 microsecond")
    return frame.withColumn("bucket_start", F.explode(F.sequence(first, last, F.expr(f"interval {STEPS[resolution]}"))))


def dense(values: DataFrame, start: str, end: str, resolution: str, *keys: str) -> DataFrame:
    """Values of each bucket and key between two times; buckets without one have a null value and is_gap."""
    within = values.where((F.col("bucket_start") >= F.date_trunc(resolution, F.lit(start).cast("timestamp_ntz"))) & (F.col("bucket_start") < F.lit(end).cast("timestamp_ntz")))
    grid = bucket_grid(within.select(*keys).distinct(), start, end, resolution)
    return grid.join(within, [*keys, "bucket_start"], "left").withColumn("is_gap", F.col("value").isNull())


def coverage(day_rollups: DataFrame) -> DataFrame:
    """How many samples each source has of a metric."""
    return day_rollups.groupBy("tenant_id", "metric_type", "source_id").agg(F.sum("sample_count").alias("samples"))


def primary_source(covered: DataFrame, preferences: DataFrame | None = None) -> DataFrame:
    """The source that speaks for a metric: the preferred one, else that of most samples, else of the least id."""
    if preferences is None:
        covered = covered.withColumn("preferred", F.lit(False))
    else:
        wanted = preferences.select("tenant_id", "metric_type", F.col("primary_source_id").alias("_wanted"))
        covered = covered.join(wanted, ["tenant_id", "metric_type"], "left").withColumn("preferred", F.coalesce(F.col("_wanted") == F.col("source_id"), F.lit(False))).drop("_wanted")
    order = Window.partitionBy("tenant_id", "metric_type").orderBy(F.col("preferred").desc(), F.col("samples").desc(), "source_id")
    reason = F.when(F.col("preferred"), "preference").when(F.col("_of") == 1, "only_source").otherwise("coverage")
    ranked = covered.withColumn("_n", F.row_number().over(order)).withColumn("_of", F.count("*").over(Window.partitionBy("tenant_id", "metric_type")))
    return ranked.where("_n = 1").withColumn("reason", reason).drop("_n", "_of", "preferred")


def weekly(day_states: DataFrame, *keys: str) -> DataFrame:
    """Weeks from Monday, merged from the states of days."""
    return merge(day_states.withColumn("week_start", F.date_trunc("week", "bucket_start").cast("timestamp_ntz")), *keys, "week_start")


def evenly_sampled(series: DataFrame, count: int, *keys: str) -> DataFrame:
    """At most ``count`` rows of each series, evenly spaced, the ends included."""
    by_time = Window.partitionBy(*keys).orderBy("bucket_start")
    numbered = series.withColumn("_n", F.row_number().over(by_time) - 1).withColumn("_of", F.count("*").over(Window.partitionBy(*keys)))
    picks = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.rint(i * (F.col("_of") - 1) / (count - 1)).cast("int"))
    return numbered.where((F.col("_of") <= count) | F.array_contains(picks, F.col("_n"))).drop("_n", "_of")


def every_nth(rows: DataFrame, most: int, order: str, *keys: str) -> DataFrame:
    """Every n-th row in order, n as small as leaves at most ``most``."""
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order, "point_id")) - 1).withColumn("_of", F.count("*").over(Window.partitionBy(*keys)))
    stride = F.greatest(F.ceil(F.col("_of") / most), F.lit(1))
    return numbered.where(F.pmod("_n", stride.cast("int")) == 0).drop("_n", "_of")
