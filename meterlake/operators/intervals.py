"""Gaps and islands: half-open ranges of time, what they cover and what they leave open.

Ranges are rows with a key and the columns start and end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.registry import with_definition


def merge_adjacent(ranges: DataFrame, *keys: str) -> DataFrame:
    """Ranges that overlap or touch become one."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.when(reached.isNull() | (F.col("start") > reached), 1).otherwise(0)
    islands = ranges.where(F.col("start") < F.col("end")).withColumn("_new", opened).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def subtract(outer: DataFrame, holes: DataFrame, *keys: str) -> DataFrame:
    """What the holes of a key leave of each of its outer ranges; equal outer ranges count once."""
    own = outer.select(*keys, F.col("start").alias("_from"), F.col("end").alias("_to")).where("_from < _to").distinct()
    ids = [*keys, "_from", "_to"]
    cut = (
        merge_adjacent(holes, *keys)
        .join(own, [*keys])
        .where((F.col("end") > F.col("_from")) & (F.col("start") < F.col("_to")))
        .select(*ids, F.greatest("start", "_from").alias("start"), F.least("end", "_to").alias("end"))
    )
    # Each hole's end and the range's own start open a piece, which the next hole's start or the range's end closes.
    none = F.lit(None).cast(outer.schema["end"].dataType)
    edges = cut.select(*ids, F.col("end").alias("start"), F.col("start").alias("_stop")).unionByName(own.select(*ids, F.col("_from").alias("start"), none.alias("_stop")))
    order = Window.partitionBy(*ids).orderBy("start", F.col("_stop").asc_nulls_first())
    pieces = edges.withColumn("_next", F.lead("_stop").over(order))
    return pieces.select(*keys, "start", F.coalesce("_next", "_to").alias("end")).where("start < end")


def intersect(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """The parts that both sides' ranges share. They meet by day, on the day on which the shared part begins."""
    by_day = lambda r: r.withColumn("_day", F.explode(F.sequence(F.to_date("start"), F.to_date("end"))))
    other = by_day(right).withColumnsRenamed({"start": "_from", "end": "_to"})
    shared = F.greatest("start", "_from")
    met = by_day(left).join(other, [*keys, "_day"]).where((F.col("start") < F.col("_to")) & (F.col("_from") < F.col("end")) & (F.col("_day") == F.to_date(shared)))
    return met.select(*keys, shared.alias("start"), F.least("end", "_to").alias("end"))


def covered_by_all(ranges: DataFrame, expected: DataFrame, of: str, *keys: str) -> DataFrame:
    """Where the ranges of every ``of`` (a column) that ``expected`` has for a key overlap, so that none's holes are
    hidden by another; one without ranges leaves nothing covered."""
    merged = merge_adjacent(ranges, *keys, of)
    wanted = expected.select(*keys, of).distinct().groupBy(*keys).agg(F.count("*").alias("_of"))
    edges = merged.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("step")))).alias("e"))
    steps = edges.groupBy(*keys, F.col("e.at").alias("start")).agg(F.sum("e.step").alias("_step"))
    order = Window.partitionBy(*keys).orderBy("start")
    open_ = steps.withColumn("_open", F.sum("_step").over(order)).withColumn("end", F.lead("start").over(order))
    found = open_.join(wanted, [*keys]).where(F.col("_open") == F.col("_of")).select(*keys, "start", "end")
    return merge_adjacent(found, *keys)


def deltas(points: DataFrame, *keys: str) -> DataFrame:
    """Seconds since the point before, for distinct times.

    Points are ordered within a day of a key; the first of a day follows the last of its key's day before,
    which is told from one row for each day, so that no window holds the whole history of a key.
    """
    times = points.select(*keys, "timestamp").distinct().withColumn("_day", F.to_date("timestamp"))
    days = times.groupBy(*keys, "_day").agg(F.max("timestamp").alias("_last"))
    ended = days.select(*keys, "_day", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_day")).alias("_before"))
    within = times.withColumn("previous", F.lag("timestamp").over(Window.partitionBy(*keys, "_day").orderBy("timestamp")))
    joined = within.join(ended, [*keys, "_day"]).withColumn("previous", F.coalesce("previous", "_before")).drop("_day", "_before")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return joined.withColumn("seconds", (micros("timestamp") - micros("previous")) / 1e6)


def _usual(steps: DataFrame, *keys: str) -> DataFrame:
    return steps.where("seconds > 0").groupBy(*keys).agg(F.median("seconds").alias("interval_seconds"), F.count("*").alias("intervals"))


def expected_interval(points: DataFrame, *keys: str) -> DataFrame:
    """The median of the seconds between points."""
    return _usual(deltas(points, *keys), *keys)


def of_cadence(points: DataFrame, cadence: str) -> DataFrame:
    """Points of metrics that are expected at a cadence; of others a gap tells nothing."""
    return with_definition(points, ("cadence",)).where(F.col("cadence") == cadence).drop("cadence")


def cadence_gaps(points: DataFrame, start: str, end: str, *keys: str, tolerance: float = 2.5) -> DataFrame:
    """Stretches of a window that are longer than ``tolerance`` times the usual interval: between points, before the
    first and after the last. Keys that have points elsewhere and none in the window miss all of it; those with a
    single time there have no usual interval and no gaps."""
    low, high = (F.lit(t).cast("timestamp_ntz") for t in (start, end))
    within = points.where(F.col("timestamp").between(low, high))
    steps = deltas(within, *keys)
    ends = within.groupBy(*keys).agg(F.min("timestamp").alias("_first"), F.max("timestamp").alias("_last"))
    seconds = (F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / 1e6
    edges = ends.select(*keys, F.explode(F.array(F.struct(low.alias("start"), F.col("_first").alias("end")), F.struct(F.col("_last").alias("start"), high.alias("end")))).alias("e")).select(*keys, "e.*")
    spans = steps.where("previous IS NOT NULL").select(*keys, F.col("previous").alias("start"), F.col("timestamp").alias("end")).unionByName(edges).withColumn("seconds", seconds)
    gaps = spans.join(_usual(steps, *keys), [*keys]).where(F.col("seconds") > tolerance * F.col("interval_seconds")).select(*keys, "start", "end", "seconds")
    silent = points.select(*keys).distinct().join(ends, [*keys], "left_anti").select(*keys, low.alias("start"), high.alias("end")).withColumn("seconds", seconds)
    return gaps.unionByName(silent)


def daily_gaps(points: DataFrame, start: str, end: str, *keys: str, offset_minutes: int = 0) -> DataFrame:
    """Days of a reader's zone without a point, for keys that have any."""
    local = F.to_date(F.col("timestamp") + F.make_dt_interval(mins=F.lit(offset_minutes)))
    seen = points.select(*keys, local.alias("day")).distinct()
    grid = seen.select(*keys).distinct().withColumn("day", F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 day"))))
    return grid.join(seen, [*keys, "day"], "left_anti")


def current_streak(days: DataFrame, today: str, *keys: str) -> DataFrame:
    """Days in a row up to today, or to yesterday as today isn't over; 0 where the last row of days ended before.

    Rows are days on which something was; with a column ``count`` only those count where it is above zero."""
    distinct = (days.where(F.col("count") > 0) if "count" in days.columns else days).select(*keys, "day").distinct()
    island = F.date_sub("day", F.row_number().over(Window.partitionBy(*keys).orderBy("day")))
    runs = distinct.where(F.col("day") <= F.lit(today).cast("date")).withColumn("_island", island).groupBy(*keys, "_island").agg(F.count("*").alias("_n"), F.max("day").alias("_last"))
    alive = F.when(F.col("_last") >= F.date_sub(F.lit(today).cast("date"), 1), F.col("_n")).otherwise(0)
    found = runs.groupBy(*keys).agg(F.max(alive).alias("streak"))
    return days.select(*keys).distinct().join(found, [*keys], "left").withColumn("streak", F.coalesce("streak", F.lit(0))) if keys else found


def bucket_counts(points: DataFrame, seconds: int, *keys: str) -> DataFrame:
    """Points in buckets of any width, counted from the epoch."""
    at = F.unix_seconds(F.col("timestamp").cast("timestamp"))
    return points.groupBy(*keys, (F.floor(at / seconds) * seconds).alias("bucket_epoch")).agg(F.count("*").alias("n"))


def classify(buckets: DataFrame, fullness: float, *keys: str) -> DataFrame:
    """Full, partial or empty, against the median of the buckets that have any points."""
    usual = buckets.where("n > 0").groupBy(*keys).agg(F.median("n").alias("expected"))
    state = F.when(F.col("n") == 0, "empty").when(F.col("n") >= fullness * F.col("expected"), "full").otherwise("partial")
    return buckets.join(usual, [*keys], "left").withColumn("state", state)


def overlap_hours(poll_hours: float) -> int:
    """How far an import reaches back: twice the interval, at least 2 and at most 72 hours."""
    return min(72, max(2, -int(-2 * poll_hours // 1)))


#: Widths of buckets, in seconds.
WIDTHS = (900, 3600, 21_600, 86_400, 604_800)


def choose_bucket_seconds(window_seconds: float, target: int = 200) -> int:
    return next((w for w in WIDTHS if window_seconds / w <= target), WIDTHS[-1])
