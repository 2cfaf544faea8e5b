"""Rules that users write for names that the registry doesn't have, and policies of ingestion."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.registry import metrics, registry, unit_factors

#: Fixed values.
ACTIONS = ("map", "adopt", "discard", "keep")
AGGREGATIONS = ("sum", "average", "max", "last")
CADENCES = ("daily", "event", "continuous")
MAX_RULE_NAME = 128
CUSTOM = re.compile("custom_[a-z0-9_]+")
RESOLUTIONS = ("raw", "second", "minute", "hour", "day")


def rule_error(raw: str, action: str, target: str | None = None, source_unit: str | None = None, target_unit: str | None = None, aggregation: str | None = None, cadence: str | None = None) -> str | None:
    """What is wrong with a rule; None for a valid one.

    Keep and discard take nothing else. Map goes to a catalogued metric in its own unit, adopt to a name that
    begins with custom_ and states its unit, aggregation and cadence; both state a unit that converts.
    """
    settings = (target, source_unit, target_unit, aggregation, cadence)
    if action not in ACTIONS:
        return "unknown_action"
    if not raw.strip():
        return "missing_name"
    if len(raw.strip()) > MAX_RULE_NAME:
        return "name_too_long"
    if action in ("discard", "keep"):
        return "target_not_allowed" if any(settings) else None
    if not (target or "").strip():
        return "missing_target"
    target = target.strip()
    if len(target) > MAX_RULE_NAME:
        return "target_too_long"
    if action == "map":
        if target not in metrics():
            return "unknown_target"
        unit = metrics()[target].unit
        if target_unit and target_unit != unit:
            return "unit_not_of_metric"
    else:
        if not CUSTOM.fullmatch(target):
            return "target_outside_namespaces"
        if aggregation not in AGGREGATIONS:
            return "unknown_aggregation"
        if cadence not in CADENCES:
            return "unknown_cadence"
        unit = target_unit
    if not source_unit or not unit:
        return "missing_unit"
    return None if source_unit == unit or (source_unit, unit) in unit_factors() else "no_conversion"


def custom_definitions(rules: DataFrame) -> DataFrame:
    """Metrics that a tenant's rules adopt; a name that is defined in several ways is left out."""
    told = rules.where("action = 'adopt'").select("tenant_id", F.col("target_metric_type").alias("metric_type"), F.struct(F.col("target_unit").alias("unit"), "aggregation", "cadence").alias("d"))
    return told.groupBy("tenant_id", "metric_type").agg(F.count_distinct("d").alias("n"), F.first("d").alias("d")).where("n = 1").select("tenant_id", "metric_type", "d.*")


def effective_policies(spark: SparkSession, overrides: DataFrame) -> DataFrame:
    """Resolution and retention of each catalogued metric for each tenant that has a policy of its own.
    A resolution that is none of the known ones is as if it wasn't stated."""
    own = overrides.select("tenant_id", "metric_type", F.when(F.col("resolution").isin(*RESOLUTIONS), F.col("resolution")).alias("_r"), F.col("raw_retention_days").alias("_d"), F.lit(True).alias("_own"))
    base = overrides.select("tenant_id").distinct().crossJoin(F.broadcast(registry(spark).select("metric_type", "resolution", "retention_days")))  # 145 rows for each tenant asked for
    joined = base.join(own, ["tenant_id", "metric_type"], "left")
    return joined.select("tenant_id", "metric_type", F.coalesce("_r", "resolution").alias("resolution"), F.when(F.col("_own"), F.col("_d")).otherwise(F.col("retention_days")).alias("retention_days"))


def tagged_sessions(points: DataFrame, provider_id: str) -> DataFrame:
    """Points that have no session yet get one from their provider's id; the others stay as they are.

    Tagged is what has a member session_id itself, null or not; members of members don't count. The new
    member is put before the others, which keep their text. Metadata that isn't an object stays as it is.
    """
    members = F.json_object_keys("metadata")
    given = F.get_json_object("metadata", f"$.{provider_id}")
    session = F.concat(F.lit("backfill:"), F.substring(F.sha2(F.concat_ws("|", "source_id", given), 256), 1, 16))
    rest = F.regexp_replace("metadata", r"^\s*\{\s*", "")
    merged = F.concat(F.lit('{"session_id":"'), session, F.when(F.size(members) == 0, '"').otherwise('",'), rest)
    changed = F.coalesce(~F.array_contains(members, "session_id") & given.isNotNull(), F.lit(False))
    return points.withColumns({"metadata": F.when(changed, merged).otherwise(F.col("metadata")), "changed": changed})
