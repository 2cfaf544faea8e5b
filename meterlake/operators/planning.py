"""What to import: coverage of several metrics, import plans, windows of synchronisation, due work.

Plans are decisions over a handful of ranges, which the driver takes; the ranges come from jobs.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import bucket_counts, classify, merge_adjacent, overlap_hours

Range = tuple[dt.datetime, dt.datetime]


def dense_counts(points: DataFrame, start: str, end: str, seconds: int, *keys: str) -> DataFrame:
    """Counts of every bucket of a window, zeros included. Buckets are counted from the window's start."""
    origin = F.unix_seconds(F.lit(start).cast("timestamp"))
    within = points.where((F.col("timestamp") >= F.lit(start).cast("timestamp_ntz")) & (F.col("timestamp") < F.lit(end).cast("timestamp_ntz")))
    shifted = within.withColumn("timestamp", F.timestamp_seconds(F.unix_seconds(F.col("timestamp").cast("timestamp")) - origin))
    counts = bucket_counts(shifted, seconds, *keys).withColumn("bucket_epoch", F.col("bucket_epoch") + origin)
    stops = F.sequence(origin, F.unix_seconds(F.lit(end).cast("timestamp")) - 1, F.lit(seconds).cast("long"))
    grid = within.select(*keys).distinct().withColumn("bucket_epoch", F.explode(stops))
    return grid.join(counts, [*keys, "bucket_epoch"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def coverage_ranges(points: DataFrame, start: str, end: str, seconds: int, *keys: str, fullness: float = 0.9) -> DataFrame:
    """Ranges of full buckets of each key. One aggregate at the finest width takes the place of a search for their ends."""
    states = classify(dense_counts(points, start, end, seconds, *keys), fullness, *keys).where("state = 'full'")
    at = F.timestamp_seconds("bucket_epoch").cast("timestamp_ntz")
    ranges = states.select(*keys, at.alias("start"), F.timestamp_seconds(F.col("bucket_epoch") + seconds).cast("timestamp_ntz").alias("end"))
    return merge_adjacent(ranges, *keys)


@dataclass
class ImportPlan:
    import_ranges: list[Range]
    skipped_ranges: list[Range] = field(default_factory=list)
    reason: str = ""


def holes(window: Range, covered: list[Range]) -> list[Range]:
    """What of a window is left open by sorted, disjoint ranges."""
    left, at = [], window[0]
    for a, b in sorted(covered):
        a, b = max(a, window[0]), min(b, window[1])
        if a >= b:
            continue
        if a > at:
            left.append((at, a))
        at = max(at, b)
    if at < window[1]:
        left.append((at, window[1]))
    return left


def plan_import(window: Range, covered: list[Range] | None, mode: str = "smart") -> ImportPlan:
    """Force imports all; smart skips what is covered for sure, and all else, unknown coverage included, is imported."""
    if window[0] >= window[1]:
        return ImportPlan([], [], "empty_window")
    if mode == "force":
        return ImportPlan([window], [], "forced")
    if covered is None:
        return ImportPlan([window], [], "coverage_unknown")
    clipped = [(max(a, window[0]), min(b, window[1])) for a, b in covered if max(a, window[0]) < min(b, window[1])]
    return ImportPlan(holes(window, clipped), sorted(clipped), "covered" if clipped else "nothing_covered")


def sync_window(now: dt.datetime, poll_hours: float, lookback: dt.timedelta, last_end: dt.datetime | None = None, earliest_gap: dt.datetime | None = None) -> tuple[Range, str]:
    """From the last success less an overlap, further back for a known gap, never before the lookback."""
    floor = now - lookback
    if last_end is None:
        return (floor, now), "first_sync"
    start, reason = last_end - dt.timedelta(hours=overlap_hours(poll_hours)), "overlap"
    if earliest_gap is not None and earliest_gap < start:
        start, reason = earliest_gap, "gap"
    if start < floor:
        start, reason = floor, "lookback"
    if start >= now:  # a last success that is stamped ahead
        start, reason = now - dt.timedelta(hours=overlap_hours(poll_hours)), "recheck"
    return (start, now), reason


def progress(processed: Column, expected: Column) -> Column:
    """A share from 0 to 1; null where nothing is expected."""
    return F.when(expected > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), processed / expected)))


def due(last_run: Column, poll_hours: Column, now: str) -> Column:
    """Never run, or longer ago than the interval; an interval of zero is none."""
    hours = (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(last_run.cast("timestamp"))) / 3600
    return (poll_hours > 0) & (last_run.isNull() | (hours >= poll_hours))


def stale(reports: DataFrame, high_water: DataFrame) -> DataFrame:
    """Whether newer data than a report covers has come for its tenant since."""
    joined = reports.join(high_water, "tenant_id", "left")
    return joined.withColumn("stale", F.coalesce("covers_through", F.lit("1970-01-01").cast("timestamp_ntz")) < F.col("high_water")).withColumn("stale", F.coalesce("stale", F.lit(False)))


#: Windows over so many days wait for the reader's night, in hours of theirs, at most so long.
DEFER_OVER_DAYS, QUIET_HOURS, MOST_DEFERRED_HOURS, MOST_OFFSET_MINUTES = 90, (1, 5), 36, 14 * 60


def deferred(now: str, finished_at: Column, window_days: Column, offset_minutes: Column) -> Column:
    """Whether a scheduled report of a long window waits for the reader's night; never the first one, never for
    longer than MOST_DEFERRED_HOURS, never for a reader whose hour isn't known."""
    at = F.lit(now).cast("timestamp_ntz")
    waited = (F.unix_seconds(at.cast("timestamp")) - F.unix_seconds(finished_at.cast("timestamp"))) / 3600
    hour = F.hour(at + F.make_dt_interval(mins=F.when(F.abs(offset_minutes) <= MOST_OFFSET_MINUTES, offset_minutes)))
    quiet = (hour >= QUIET_HOURS[0]) & (hour < QUIET_HOURS[1])
    return F.coalesce((window_days > DEFER_OVER_DAYS) & (waited < MOST_DEFERRED_HOURS) & ~quiet, F.lit(False))


def due_reports(runs: DataFrame, imports: DataFrame, kinds: list[str], now: str, most_age_hours: float, stuck_hours: float) -> DataFrame:
    """Reports to compute anew: tenant_id, kind and reason (no_report, new_data or max_age).

    ``runs``: tenant_id, kind, status, started_at, finished_at, covers_through, window_days, offset_minutes.
    ``imports``: tenant_id, status, finished_at. A tenant without a successful import has nothing to report;
    a report that runs is left alone unless it is stuck. The newest successful run speaks for a kind.
    """
    hours = lambda c: (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col(c).cast("timestamp"))) / 3600
    water = imports.where("status = 'success'").groupBy("tenant_id").agg(F.max("finished_at").alias("high_water"))
    running = runs.where(F.col("status").isin("pending", "running") & (hours("started_at") <= stuck_hours)).select("tenant_id", "kind").distinct()
    last = runs.where("status = 'success'").groupBy("tenant_id", "kind").agg(F.max(F.struct("finished_at", "window_days", "offset_minutes", "covers_through")).alias("last"))
    wanted = water.withColumn("kind", F.explode(F.array(*map(F.lit, kinds)))).join(running, ["tenant_id", "kind"], "left_anti").join(last, ["tenant_id", "kind"], "left")
    behind = F.col("last.covers_through").isNull() | (F.col("last.covers_through") < F.col("high_water"))
    reason = F.when(F.col("last").isNull(), "no_report").when(behind, "new_data").when(hours("last.finished_at") >= most_age_hours, "max_age")
    waits = deferred(now, F.col("last.finished_at"), F.col("last.window_days"), F.col("last.offset_minutes"))
    return wanted.withColumn("reason", reason).where(F.col("reason").isNotNull() & ~waits).select("tenant_id", "kind", "reason")


def pending_backfills(reports: DataFrame, today: str, most_days: int = 90) -> DataFrame:
    """Fields that are supported now but whose history wasn't: the window of each source, at most ``most_days``."""
    open_ = reports.where(F.col("supported_since").isNotNull() & F.col("history_backfilled_at").isNull())
    floor = F.date_sub(F.lit(today).cast("date"), most_days)
    told = open_.groupBy("tenant_id", "source_id").agg(F.min("first_seen").alias("first"), F.max("last_seen").alias("last"), F.array_join(F.sort_array(F.collect_set("field_path")), ",").alias("fields"))
    return told.withColumn("first", F.greatest(F.to_date("first"), floor)).withColumn("last", F.to_date("last"))
