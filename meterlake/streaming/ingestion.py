"""The stream from events to stored points: checks, rules as they hold, quarantine, refusals and a ledger of runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ingest as I
from .store import Store

QUARANTINE = "tenant_id string, source_id string, metric_type string, timestamp timestamp_ntz, value double, arrival long, event_key string"
REFUSALS = "tenant_id string, source_id string, metric_type string, reason string, n long"
COUNTS = "tenant_id string, source_id string, metric_type string, n long"
RUNS = "tenant_id string, run_id string, first_batch int"
LEDGER = "tenant_id string, run_id string, event_key string, outcome string"


def _null_safe(a: DataFrame, b: DataFrame, how: str, *on: str) -> DataFrame:
    return a.join(b, [a[k].eqNullSafe(b[k]) for k in on], how)


def with_identity(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds ``identity``: null if the tenant has the source and it is of the stated type, else what is wrong."""
    own = sources.groupBy("tenant_id", "source_id").agg(F.first("source_type").alias("_type"))
    met = events.join(own, ["tenant_id", "source_id"], "left")
    wrong = F.when(F.col("_type").isNull(), "unknown_source").when(F.col("source_type").isNotNull() & (F.col("source_type") != F.col("_type")), "wrong_source_type")
    return met.withColumn("identity", wrong).drop("_type")


def settle(events: DataFrame, rules: DataFrame, sources: DataFrame) -> DataFrame:
    """Events with ``outcome``: accept, map, adopt, keep, discard, quarantine, or refused (under its own name) with a
    reason, the first that holds."""
    checked = with_identity(events, sources).withColumn("_reason", F.coalesce(I.reject_reason(), F.col("identity")))
    told = I.mapped(checked, rules)
    refused = F.col("_reason").isNotNull()
    named = told.withColumn("metric_type", F.when(refused, F.col("raw_metric_type")).otherwise(F.col("metric_type")))
    return named.withColumn("outcome", F.when(refused, "refused").otherwise(F.col("action"))).withColumnRenamed("_reason", "reason").drop("identity", "action")


def process(store: Store, events: DataFrame, stream: str, number: int, rules: DataFrame, sources: DataFrame, names: int | None = I.QUARANTINE_NAMES, rows: int | None = I.QUARANTINE_ROWS) -> None:
    """One batch into the store: points with their states, quarantine, refusals and ledger under one commit.

    ``events`` has event_key, run_id, arrival (a number that grows), arrived_at, source_type and the columns of
    points but for point_id. An event counts once for its run, however often it is delivered: those that
    the ledger has are left out, and of equal ones in the batch the first stays. Of the ledger the batches
    since the first of these runs are read, of the quarantine its counts. ``names`` and ``rows`` bound the quarantine of
    each source; None is no bound.
    """
    if number <= store.versions().get(stream, -1):
        return
    own = ("tenant_id", "run_id", "event_key")
    first = F.min_by(F.struct(*[c for c in events.columns if c not in own]), "arrival")
    given = events.groupBy(*own).agg(first.alias("_e")).select(*own, "_e.*").persist()
    begun = store.read("runs", RUNS)
    mine = given.select("tenant_id", "run_id").distinct()
    since = _null_safe(begun.drop("batch"), mine, "left_semi", "tenant_id", "run_id").agg(F.min("first_batch")).first()[0]
    fresh = given
    if since is not None:
        fresh = _null_safe(given, store.read("ledger", LEDGER).where(F.col("batch") >= since).select(*own), "left_anti", *own)
    settled = settle(fresh, rules, sources).persist()
    held = store.read("quarantine_counts", COUNTS).groupBy("tenant_id", "source_id", "metric_type").agg(F.sum("n").alias("n"))
    split = I.quarantine_split(settled.where("outcome = 'quarantine'").drop("outcome"), names, rows, held)
    split = split.withColumn("reason", F.when(F.col("outcome") != "quarantined", F.col("outcome"))).withColumn("outcome", F.when(F.col("outcome") == "quarantined", "quarantine").otherwise("refused")).persist()
    try:
        refused = settled.where("outcome = 'refused'").unionByName(split.where("outcome = 'refused'"))
        done = settled.where("outcome <> 'quarantine'").unionByName(split)
        kept = split.where("outcome = 'quarantine'")
        points = settled.where("outcome IN ('accept', 'map', 'adopt')")
        store.append(
            points.withColumn("point_id", F.col("arrival")).withColumn("idempotency_key", F.col("event_key")),
            (stream, number),
            quarantine=kept.select("tenant_id", "source_id", "metric_type", "timestamp", "value", "arrival", "event_key"),
            quarantine_counts=kept.groupBy("tenant_id", "source_id", "metric_type").agg(F.count("*").alias("n")),
            refusals=refused.groupBy("tenant_id", "source_id", "metric_type", "reason").agg(F.count("*").alias("n")),
            ledger=done.select(*own, "outcome"),
            runs=_null_safe(mine, begun, "left_anti", "tenant_id", "run_id").withColumn("first_batch", F.lit(store.newest() + 1)),
        )
    finally:
        for used in (given, settled, split):
            used.unpersist()


def ingest(stream: DataFrame, store: Store, rules: Callable[[], DataFrame], sources: Callable[[], DataFrame], name: str = "events", names: int | None = I.QUARANTINE_NAMES, rows: int | None = I.QUARANTINE_ROWS) -> None:
    """Run a stream of events into the store until it has no more. ``rules`` and ``sources`` are called for each
    batch, so that a batch meets the versions that are there when it runs. ``names`` and ``rows``: see ``process``."""
    job = stream.writeStream.foreachBatch(lambda batch, number: process(store, batch, name, number, rules(), sources(), names, rows))
    job.option("checkpointLocation", f"{store.folder}/checkpoint-{name}").trigger(availableNow=True).start().awaitTermination()


def run_counts(store: Store) -> DataFrame:
    """What each run has brought so far: received, stored, quarantined, refused and discarded or kept events."""
    outcomes = {"stored": ("accept", "map", "adopt"), "quarantined": ("quarantine",), "refused": ("refused",), "left_out": ("discard", "keep")}
    counts = [F.count_if(F.col("outcome").isin(*names)).alias(c) for c, names in outcomes.items()]
    return store.read("ledger", LEDGER).groupBy("tenant_id", "run_id").agg(F.count("*").alias("received"), *counts)
