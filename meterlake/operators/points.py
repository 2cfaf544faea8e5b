"""Scans, filters, ranking and paging of metric points.

A point has the columns point_id, tenant_id, source_id, metric_type, timestamp, value and metadata (JSON).
Every function that answers a query takes the tenant first; there is no way to read across tenants.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scan(
    points: DataFrame,
    tenant: str,
    metrics: Iterable[str] | None = None,
    sources: Iterable[str] | None = None,
    start: str | None = None,
    end: str | None = None,
    least: float | None = None,
    most: float | None = None,
    inclusive_end: bool = True,
) -> DataFrame:
    """Points of a tenant within bounds that are stated; bounds on the value leave out points without one."""
    at, value = F.col("timestamp"), F.col("value")
    found = points.where(F.col("tenant_id") == tenant)
    if metrics is not None:
        found = found.where(F.col("metric_type").isin(list(metrics)))
    if sources is not None:
        found = found.where(F.col("source_id").isin(list(sources)))
    if start:
        found = found.where(at >= F.lit(start).cast("timestamp_ntz"))
    if end:
        bound = F.lit(end).cast("timestamp_ntz")
        found = found.where(at <= bound if inclusive_end else at < bound)
    if least is not None:
        found = found.where(value >= least)
    if most is not None:
        found = found.where(value <= most)
    return found


def json_text(key: str, column: str = "metadata") -> Column:
    """A member of the metadata as text; null where it is absent."""
    return F.get_json_object(column, f"$.{key}")


def json_number(key: str, column: str = "metadata") -> Column:
    """A member of the metadata that is a JSON number; null for any other kind, text that looks like one included."""
    member = F.try_variant_get(F.try_parse_json(F.col(column)), f"$.{key}", "variant")
    return F.when(F.schema_of_variant(member).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(member, "$", "double"))


def any_metric(names: Iterable[str], prefixes: Iterable[str] = ()) -> Column:
    """Whether the metric is one of ``names`` or begins with one of ``prefixes`` (as text, no wildcards)."""
    found = F.col("metric_type").isin(list(names))
    for prefix in prefixes:
        found = found | F.col("metric_type").startswith(prefix)
    return found


#: Which metrics make up a session, the diary and a stream.
SESSION_PREFIXES = ("workout_", "strength_set_", "strength_session_")
STREAM_METRICS = ("workout_heart_rate",)
LOGGED_METRICS = ("nutrition_meal_energy", "nutrition_item_energy", "nutrition_item_amount", "nutrition_recipe_portions")


def is_session() -> Column:
    return any_metric((), SESSION_PREFIXES)


def is_stream() -> Column:
    return any_metric(STREAM_METRICS)


def is_sessionable() -> Column:
    return is_session() & ~is_stream()


def is_purgeable() -> Column:
    """Raw and second resolution, or none stated."""
    stated = json_text("ingest_resolution")
    return stated.isNull() | stated.isin("raw", "second")


def without_tenant(points: DataFrame, tenant: str) -> DataFrame:
    """What is left of a table once a tenant's rows are wiped; rows of no tenant stay."""
    return points.where(~F.col("tenant_id").eqNullSafe(F.lit(tenant)))


def page(points: DataFrame, size: int, after: tuple[str, int] | None = None) -> DataFrame:
    """A page in ascending order of (timestamp, point_id), after a key, with one row more to tell of a next page."""
    if after:
        at = F.lit(after[0]).cast("timestamp_ntz")
        points = points.where((F.col("timestamp") > at) | ((F.col("timestamp") == at) & (F.col("point_id") > after[1])))
    return points.orderBy("timestamp", "point_id").limit(size + 1)


def ranked(points: DataFrame, count: int, descending: bool = True) -> DataFrame:
    """The points of the most extreme values; equal values in the order of their ids."""
    value = F.col("value").desc() if descending else F.col("value").asc()
    return points.where(F.col("value").isNotNull()).orderBy(value, F.col("point_id")).limit(count)


def newest_each(points: DataFrame, *keys: str, prefer: Column | None = None) -> DataFrame:
    """The last point of each key, by (timestamp, point_id); among those of the largest ``prefer``, where stated."""
    rest = [c for c in points.columns if c not in keys]
    order = F.struct(*([prefer.alias("prefer")] if prefer is not None else []), "timestamp", "point_id")
    return points.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in points.columns])


#: What speaks for a bucket if several do, the worst first.
RESOLUTION_RANK = ("raw", "second", "minute", "hour", "day")


def preference(resolution: Column, from_provider: Column) -> Column:
    """A coarser resolution before a finer one, what a provider states before what is derived."""
    return F.coalesce(F.array_position(F.array(*[F.lit(r) for r in RESOLUTION_RANK]), resolution), F.lit(0)) * 2 + F.coalesce(from_provider, F.lit(False)).cast("int")
