"""From events to accepted points: validation, mapping, deduplication, quarantine and pre-aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.registry import canonical, converted, with_definition
from ..functions.text import idempotency_key

#: Bounds of names, and of quarantine for each source.
MAX_NAME = 200
QUARANTINE_NAMES, QUARANTINE_ROWS = 100, 100_000
#: Bytes of metadata that a point may have, and characters of a unit that is kept of larger ones.
MAX_METADATA_BYTES, MAX_UNIT = 32 * 1024, 64


def reject_reason(canonical_name: Column | None = None, supplied_key: Column | None = None) -> Column:
    """The first rule that an event breaks; null for a valid one.

    With its canonical name, an event under a legacy alias is rejected, as its key was made from that name;
    with the key that came with it, one whose key isn't that of its canonical or, if unknown, its own name.
    """
    value = F.col("value")
    rules = [
        ("missing_tenant", F.coalesce(F.col("tenant_id"), F.lit("")) == ""),
        ("missing_source", F.coalesce(F.col("source_id"), F.lit("")) == ""),
        ("missing_metric", F.trim(F.coalesce(F.col("metric_type"), F.lit(""))) == ""),
        ("metric_too_long", F.length("metric_type") > MAX_NAME),
        ("bad_timestamp", F.col("timestamp").isNull()),
        ("not_finite", F.isnan(value) | (F.abs(value) == float("inf"))),
    ]
    name = F.trim("metric_type")
    if supplied_key is not None:
        known = name if canonical_name is None else F.coalesce(canonical_name, name)
        rules.append(("wrong_key", supplied_key.isNotNull() & (supplied_key != event_key(known))))
    if canonical_name is not None:
        rules.append(("legacy_alias", canonical_name.isNotNull() & (canonical_name != name)))
    return reduce(lambda otherwise, rule: F.when(rule[1], F.lit(rule[0])).otherwise(otherwise), reversed(rules), F.lit(None).cast("string"))


def deduplicated(events: DataFrame, order: Column | str = "arrival") -> DataFrame:
    """The first arrival of each tenant, key and time."""
    first = Window.partitionBy("tenant_id", "idempotency_key", "timestamp").orderBy(order)
    return events.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def new_only(events: DataFrame, stored: DataFrame) -> DataFrame:
    """Events whose key isn't stored yet."""
    return events.join(stored.select("tenant_id", "idempotency_key", "timestamp"), ["tenant_id", "idempotency_key", "timestamp"], "left_anti")


def event_key(metric: Column) -> Column:
    return idempotency_key(F.col("tenant_id"), F.col("source_id"), metric, F.col("timestamp").cast("string"))


def keyed(events: DataFrame) -> DataFrame:
    return events.withColumn("idempotency_key", event_key(F.col("metric_type")))


def rules_in_force(rules: DataFrame) -> DataFrame:
    """Versions of rules with the time from which they hold, and ``_until``, when the next one of the same name does.
    Of versions from the same time the last by action and target holds."""
    key = ("tenant_id", "source_id", "metric_type")
    latest = rules.groupBy(*key, "valid_from").agg(F.max(F.struct("action", "target_metric_type", "source_unit", "target_unit")).alias("_r"))
    return latest.select(*key, "_r.*", "valid_from", F.lead("valid_from").over(Window.partitionBy(*key).orderBy("valid_from")).alias("_until"))


def mapped(events: DataFrame, rules: DataFrame, arrived: str = "arrived_at") -> DataFrame:
    """Events under the rules of their source: map renames and converts, adopt keeps under a target name,
    discard and keep are told. The columns action and metric_type hold the outcome; unknown names without a
    rule have the action quarantine. Rules with a valid_from have versions; an event has the one that held when it arrived.
    """
    key = ["tenant_id", "source_id", "metric_type"]
    named = canonical(events)
    if "valid_from" in rules.columns:
        versions = rules_in_force(rules)
        held = (named[arrived] >= versions["valid_from"]) & (versions["_until"].isNull() | (named[arrived] < versions["_until"]))
        on = [named[k] == versions[k] for k in key]
        told = named.join(versions, [*on, held], "left").drop(*[versions[k] for k in key], "valid_from", "_until")
    else:
        told = named.join(rules, key, "left")
    known = F.col("canonical").isNotNull()
    action = F.when(known, "accept").otherwise(F.coalesce("action", F.lit("quarantine")))
    target = F.when(known, F.col("canonical")).when(F.col("action").isin("map", "adopt"), F.col("target_metric_type")).otherwise(F.col("metric_type"))
    out = converted(told, "value", "source_unit", "target_unit").withColumn("raw_metric_type", F.col("metric_type"))
    value = F.when(~known & (F.col("action") == "map") & F.col("source_unit").isNotNull(), F.col("converted")).otherwise(F.col("value"))
    return out.withColumn("value", value).withColumn("metric_type", target).withColumn("action", action).drop("canonical", "converted", "target_metric_type", "source_unit", "target_unit")


def within_first(rows: DataFrame, order: str, most: Column, *keys: str, slots: int = 4096) -> DataFrame:
    """Adds ``within``: whether a row is among the first ``most`` of its key by ``order`` (a number or time).

    No key is sorted as a whole: rows are counted by slots of equal width between the key's least and largest
    order; the running count over slots tells which are in or out, and only rows of the slot in which it passes
    ``most`` are numbered. Equal orders are numbered by chance. Keys may be null."""
    at = F.col(order).cast("double")
    ends = rows.groupBy(*keys).agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    slot = F.when(F.col("_hi") > F.col("_lo"), F.floor((at - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * (slots - 1))).otherwise(0).cast("int")

    def met(a: DataFrame, b: DataFrame, *on: str) -> DataFrame:
        same = [a[k].eqNullSafe(b[k]) for k in on]
        return a.join(b, same, "inner").drop(*[b[k] for k in on])

    placed = met(rows, ends, *keys).withColumn("_slot", slot).drop("_lo", "_hi")
    counts = placed.groupBy(*keys, "_slot").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))
    told = met(placed, counts.withColumn("_before", F.coalesce(before, F.lit(0))), *keys, "_slot").withColumn("_most", most)
    crossing = (F.col("_before") < F.col("_most")) & (F.col("_before") + F.col("_n") > F.col("_most"))
    clear = told.where(~crossing).withColumn("within", F.col("_before") < F.col("_most"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    mixed = told.where(crossing).withColumn("_i", number).withColumn("within", F.col("_before") + F.col("_i") <= F.col("_most")).drop("_i")
    return clear.unionByName(mixed).drop("_slot", "_n", "_before", "_most")


def quarantine_split(unknown: DataFrame, names: int | None = QUARANTINE_NAMES, rows: int | None = QUARANTINE_ROWS, held: DataFrame | None = None) -> DataFrame:
    """Unknown events by what happens to them: quarantined, or refused as there are too many names or rows.

    Names count in the order of their first arrival, rows in that of theirs. The bound on rows is that of
    the quarantine itself; refused events are told with a reason and counted. None is no bound. ``held`` (tenant_id,
    source_id, metric_type, n) is what the quarantine has already: these names come first, their rows take of the bound.
    """
    if names is None and rows is None:
        return unknown.withColumn("outcome", F.lit("quarantined"))
    key = ("tenant_id", "source_id")
    first = unknown.groupBy(*key, "metric_type").agg(F.min("arrival").alias("_first"))
    if held is None:
        held = unknown.sparkSession.createDataFrame([], "tenant_id string, source_id string, metric_type string, n long")
    old = held.groupBy(*key, "metric_type").agg(F.sum("n").alias("_n"))
    every = first.join(old, [*key, "metric_type"], "full")
    by_source = Window.partitionBy(*key)
    order = every.withColumn("_name", F.row_number().over(by_source.orderBy(F.col("_n").isNull(), "_first", "metric_type"))).withColumn("_held", F.coalesce(F.sum("_n").over(by_source), F.lit(0))).drop("_first", "_n")
    placed = unknown.join(order, [*key, "metric_type"])
    taken = placed if names is None else placed.where(F.col("_name") <= names)
    known = taken.withColumn("within", F.lit(True)) if rows is None else within_first(taken, "arrival", rows - F.col("_held"), *key)
    told = known.withColumn("outcome", F.when(F.col("within"), "quarantined").otherwise("too_many_rows")).drop("within")
    if names is None:
        return told.drop("_name", "_held")
    rest = placed.where(F.col("_name") > names).withColumn("outcome", F.lit("too_many_names"))
    return told.unionByName(rest).drop("_name", "_held")


def preaggregated(events: DataFrame, resolution: str) -> DataFrame:
    """Events of each source, metric and bucket as one: the registry's aggregate, how many there were and their
    spread. A provider's total (is_total) replaces the other samples of its day where the metric is summed."""
    keys, day, order = ("tenant_id", "source_id", "metric_type", "aggregation"), F.date_trunc("day", "timestamp"), F.struct("timestamp", "point_id")
    bucket = F.date_trunc(resolution, "timestamp")
    # Samples and totals of each bucket apart; what follows sees these states, not points.
    states = with_definition(events, ("aggregation",)).groupBy(*keys, day.alias("_day"), bucket.alias("_bucket"), F.coalesce("is_total", F.lit(False)).alias("_total")).agg(
        F.sum("value").alias("_sum"), F.max("value").alias("_max"), F.min("value").alias("_min"), F.count("value").alias("_values"), F.count("*").alias("_n"), F.max_by("value", order).alias("_last"), F.max(order).alias("_at")
    )
    total_day = F.max(F.col("_total") & (F.col("aggregation") == "sum")).over(Window.partitionBy(*keys, "_day"))
    counted = states.withColumn("provider_total", total_day).where(~F.col("provider_total") | F.col("_total"))
    merged = counted.groupBy(*keys, "provider_total", F.when(F.col("provider_total"), F.col("_day")).otherwise(F.col("_bucket")).cast("timestamp_ntz").alias("bucket_start")).agg(
        F.sum("_sum").alias("_sum"), F.max("_max").alias("bucket_max"), F.min("_min").alias("bucket_min"), F.sum("_values").alias("_values"), F.sum("_n").alias("bucket_samples"), F.max_by("_last", "_at").alias("_last")
    )
    kind = F.col("aggregation")
    value = F.when(F.col("provider_total") | (kind == "last"), F.col("_last")).when(kind == "sum", F.col("_sum")).when(kind == "max", F.col("bucket_max")).otherwise(F.try_divide("_sum", "_values"))
    return merged.withColumn("value", value).drop("_sum", "_values", "_last")


def exploded(batches: DataFrame) -> DataFrame:
    """Children of batch envelopes. A child that names another tenant or source than its envelope is a mismatch."""
    child = batches.select("batch_id", F.col("tenant_id").alias("_t"), F.col("source_id").alias("_s"), F.posexplode("events").alias("position", "e"))
    mismatch = (F.coalesce("e.tenant_id", "_t") != F.col("_t")) | (F.coalesce("e.source_id", "_s") != F.col("_s"))
    return child.select("batch_id", "position", F.coalesce("e.tenant_id", "_t").alias("tenant_id"), F.coalesce("e.source_id", "_s").alias("source_id"), "e.metric_type", "e.timestamp", "e.value", mismatch.alias("mismatch"))


def purgeable(points: DataFrame, as_of: str, overrides: DataFrame | None = None) -> DataFrame:
    """Points past the retention of their metric, by the registry or a tenant's own policy. Never is no limit."""
    known = with_definition(points, ("retention_days", "category"))
    # A metric that the registry doesn't have is kept for 90 days; those that it keeps for good have no number.
    days = F.when(F.col("category") == "custom", 90).otherwise(F.col("retention_days"))
    if overrides is not None:
        own = overrides.select("tenant_id", "metric_type", F.col("raw_retention_days").alias("_own"), F.lit(True).alias("_stated"))
        known = known.join(own, ["tenant_id", "metric_type"], "left")
        days = F.when(F.col("_stated"), F.col("_own")).otherwise(days)  # a stated null keeps points for good
    age = F.datediff(F.lit(as_of).cast("date"), F.to_date("timestamp"))
    return known.where(age > days).select(points.columns)


def field_reports(reports: DataFrame) -> DataFrame:
    """Shapes that providers sent, over all reports: occurrences add up, the first and last time are kept."""
    return reports.groupBy("tenant_id", "source_id", "field_path").agg(F.sum("occurrences").alias("occurrences"), F.max("metric_type").alias("metric_type"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))


def capacity_warning(rows: Column, names: Column, refused: Column) -> Column:
    full = (rows >= QUARANTINE_ROWS) | (names >= QUARANTINE_NAMES) | (refused > 0)
    near = (rows >= 0.8 * QUARANTINE_ROWS) | (names >= 0.8 * QUARANTINE_NAMES)
    return F.when(full, "critical").when(near, "warning").otherwise("ok")


def bounded_metadata(metadata: Column, value: Column) -> Column:
    """Metadata (JSON) as it is, up to 32 KiB; of more, and of what isn't JSON, the provider's value and unit and that it was cut."""
    fits = (F.octet_length(metadata) <= MAX_METADATA_BYTES) & F.json_object_keys(metadata).isNotNull()
    stated = F.get_json_object(metadata, "$.provider_value").try_cast("double")
    usable = F.when(~F.isnan(stated) & (F.abs(stated) < float("inf")), stated)
    unit = F.get_json_object(metadata, "$.units")
    short = F.struct(F.coalesce(usable, value).alias("provider_value"), F.when(F.char_length(unit) <= MAX_UNIT, unit).alias("units"), F.lit(True).alias("metadata_truncated"))
    return F.when(fits, metadata).otherwise(F.to_json(short, {"ignoreNullFields": "false"}))


def with_provenance(mapped_events: DataFrame) -> DataFrame:
    """Mapped events whose metadata says where a renamed or adopted one comes from (mapped_from, mapping_action), bounded."""
    told = F.concat(F.lit('{"mapped_from":'), F.to_json(F.struct(F.col("raw_metric_type").alias("x"))), F.lit(""))
    name = F.regexp_extract(told, r'"x":(".*")\}$', 1)
    rest = F.regexp_replace(F.coalesce("metadata", F.lit("{}")), r"^\s*\{\s*", "")
    merged = F.concat(F.lit('{"mapped_from":'), name, F.lit(',"mapping_action":"'), F.col("action"), F.when(rest.startswith("}"), '"').otherwise('",'), rest)
    changed = F.col("action").isin("map", "adopt")
    return mapped_events.withColumn("metadata", bounded_metadata(F.when(changed, merged).otherwise(F.col("metadata")), F.col("value")))
