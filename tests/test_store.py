"""The store of points and states, and the stream into it."""

from __future__ import annotations

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from meterlake.operators.ingest import quarantine_split, within_first
from meterlake.streaming.ingestion import QUARANTINE, REFUSALS, ingest, process, run_counts
from meterlake.streaming.store import POINTS, Store, day_states, valued

T = lambda day, hour=0: dt.datetime(2024, 1, day, hour)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/{uuid.uuid4().hex}")


def point(k, day, hour, value, metric="steps", tenant="t1", total=None):
    return (k, f"k{k}", tenant, "s1", metric, T(day, hour), value, total, None)


def frame(spark, rows):
    return spark.createDataFrame(rows, POINTS)


def told(df):
    return {r.metric_type: (r.sample_count, r.sum_value, r.value) for r in df.collect()}


@pytest.fixture
def scans(spark):
    """What a query's file scans read, as its plan has it."""
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    yield lambda df: "\n".join(x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x)
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_counted_days_are_never_scanned(spark, store, scans):
    store.append(frame(spark, [point(1, 1, 1, 5.0), point(2, 1, 2, 7.0), point(3, 2, 1, 1.0, "body_weight"), point(4, 2, 2, 3.0, "body_weight")]))
    assert told(store.summary("t1")) == {"steps": (2, 12.0, 12.0), "body_weight": (2, 4.0, 3.0)}
    plan = scans(store.summary("t1"))
    assert "/states" in plan and "/points" not in plan
    store.append(frame(spark, [point(5, 2, 1, 9.0)]), counted=False)
    assert told(store.summary("t1"))["steps"] == (3, 21.0, 21.0)
    plan = scans(store.summary("t1"))
    of_points = next(x for x in plan.split("\n") if "/points" in x)
    assert "2024-01-02" in of_points and "2024-01-01" not in of_points and "EqualTo(tenant_id,t1)" in of_points
    store.rebuild()
    assert told(store.summary("t1")) == {"steps": (3, 21.0, 21.0), "body_weight": (2, 4.0, 3.0)}
    assert "/points" not in scans(store.summary("t1"))
    assert {(r.day, r.stored, r.counted) for r in store.manifest().collect()} == {("2024-01-01", 2, 2), ("2024-01-02", 3, 3)}


def test_late_points_change_the_answer_and_repeated_ones_do_not(spark, store):
    rows = [point(k, 1 + k % 3, k % 24, float(k)) for k in range(30)]
    store.append(frame(spark, rows))
    assert store.append(frame(spark, [*rows, point(50, 1, 0, 1000.0), point(50, 1, 0, 1000.0)]))
    assert told(store.summary("t1"))["steps"] == (31, sum(range(30)) + 1000.0, sum(range(30)) + 1000.0)
    days = {(r.day, r.written) for r in store.manifest().collect()}
    assert days == {("2024-01-01", 1), ("2024-01-02", 0), ("2024-01-03", 0)}
    assert store.drop_superseded() >= 1
    assert told(store.summary("t1"))["steps"][0] == 31
    assert {tuple(r) for r in valued(day_states(store.points())).select("day", "value").collect()} == {tuple(r) for r in store.series().select("day", "value").collect()}


def test_provider_totals(spark, store):
    store.append(frame(spark, [point(1, 1, 1, 5.0), point(2, 1, 23, 80.0, total=True)]))
    store.append(frame(spark, [point(3, 1, 2, 70.0, total=True), point(4, 2, 2, 2.0), point(5, 2, 3, None)]))
    assert {r.day: (r.value, r.is_provider_total) for r in store.series().collect()} == {"2024-01-01": (80.0, True), "2024-01-02": (2.0, False)}
    assert store.summary("t1").first().sum_value == 82.0


@pytest.mark.parametrize("lost_after", ["points", "states", "manifest"])
def test_a_writer_lost_between_tables_changes_nothing(spark, store, monkeypatch, lost_after):
    store.append(frame(spark, [point(1, 1, 1, 5.0)]), ("s", 0))
    write = Store.write

    def dies(self, name, *rest, **more):
        write(self, name, *rest, **more)
        if name == lost_after:
            raise OSError("lost")

    monkeypatch.setattr(Store, "write", dies)
    with pytest.raises(OSError, match="lost"):
        store.append(frame(spark, [point(2, 1, 2, 7.0), point(3, 2, 2, 7.0)]), ("s", 1))
    monkeypatch.undo()
    again = Store(spark, store.folder)
    assert told(again.summary("t1")) == {"steps": (1, 5.0, 5.0)} and again.points().count() == 1
    assert again.append(frame(spark, [point(2, 1, 2, 7.0)]), ("s", 1))
    assert not again.append(frame(spark, [point(4, 1, 2, 7.0)]), ("s", 1))
    assert told(again.summary("t1")) == {"steps": (2, 12.0, 12.0)} and again.points().count() == 2


def test_empty_store_and_batch(spark, store):
    assert store.summary("t1").count() == 0 and store.manifest().count() == 0 and store.coverage().count() == 0
    store.append(frame(spark, []))
    assert store.summary("t1").count() == 0
    store.append(frame(spark, [point(1, 1, 1, 5.0), (2, "k2", "t1", "s1", "steps", None, 1.0, None, None)]))
    assert told(store.summary("t1")) == {"steps": (1, 5.0, 5.0)}


@pytest.mark.parametrize("slots", [4096, 3])
def test_first_rows_of_keys(spark, slots):
    rows = [("a", k) for k in range(0, 300, 3)] + [("b", 5)] + [(None, k) for k in range(4)] + [("c", 1)] * 10
    got = within_first(spark.createDataFrame(rows, "g string, at long").repartition(3), "at", F.lit(7), "g", slots=slots).collect()
    assert len(got) == len(rows)
    assert sorted(r["at"] for r in got if r.within and r.g == "a") == list(range(0, 21, 3))
    assert sum(r.within for r in got if r.g == "c") == 7 and all(r.within for r in got if r.g in ("b", None))


def test_quarantine_goes_on_where_it_was(spark):
    rows = [("t", "s", m, a) for a, m in enumerate("abcabcabcd")]
    held = spark.createDataFrame([("t", "s", "c", 2), ("t", "s", "z", 1)], "tenant_id string, source_id string, metric_type string, n long")
    got = quarantine_split(spark.createDataFrame(rows, "tenant_id string, source_id string, metric_type string, arrival long"), names=4, rows=6, held=held)
    by = {r.arrival: r.outcome for r in got.collect()}
    assert by == {a: "too_many_names" if m == "d" else "quarantined" if a < 3 else "too_many_rows" for a, (*_, m, a2) in enumerate(rows)}


EVENTS = "event_key string, run_id string, arrival long, arrived_at timestamp_ntz, source_type string, tenant_id string, source_id string, metric_type string, timestamp timestamp_ntz, value double, is_total boolean, metadata string"
RULES = "tenant_id string, source_id string, metric_type string, action string, target_metric_type string, source_unit string, target_unit string, valid_from timestamp_ntz"


def event(k, metric, value=1.0, hour=0, run="r1", source="s1", kind="watch", tenant="t1", at=T(1)):
    return (f"e{k}", run, k, T(5, hour), kind, tenant, source, metric, at, value, False, None)


def test_stream_into_the_store(spark, store, tmp_path):
    events, rules = f"{tmp_path}/events", f"{tmp_path}/rules"
    sources = spark.createDataFrame([("t1", "s1", "watch"), ("t1", "s2", "scale")], "tenant_id string, source_id string, source_type string")
    schema = spark.createDataFrame([], EVENTS).schema

    def land(rows):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(events)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(events)
        ingest(stream, store, lambda: spark.read.schema(RULES).parquet(rules), lambda: sources)

    spark.createDataFrame([("t1", "s1", "Kg", "map", "body_weight", "g", "kg", T(5, 2))], RULES).write.parquet(rules)
    land([event(1, "steps", 10.0), event(2, "Kg", 5000.0, 1), event(3, "Mood"), event(4, "steps", source="s9"), event(5, "steps", kind="scale"), event(6, "steps", at=None), event(1, "steps", 10.0)])
    run()
    # The unit's rule holds from two o'clock; another comes only now, and is told from the next batch on.
    spark.createDataFrame([("t1", "s1", "Mood", "adopt", "custom_mood", None, None, T(5, 0)), ("t1", "s1", "Kg", "discard", None, None, None, T(5, 4))], RULES).write.mode("append").parquet(rules)
    land([event(11, "Kg", 5000.0, 3), event(12, "Mood", 4.0), event(13, "Kg", 1.0, 4), event(1, "steps", 10.0), event(14, "steps", 3.0, run="r2")])
    run()
    run()
    stored = {(r.metric_type, r.value) for r in store.points().collect()}
    assert stored == {("steps", 10.0), ("body_weight", 5.0), ("custom_mood", 4.0), ("steps", 3.0)}
    assert {(r.metric_type, r.event_key) for r in store.read("quarantine", QUARANTINE).collect()} == {("Kg", "e2"), ("Mood", "e3")}
    assert {(r.reason, r.n) for r in store.read("refusals", REFUSALS).collect()} == {("unknown_source", 1), ("wrong_source_type", 1), ("bad_timestamp", 1)}
    counts = {r.run_id: (r.received, r.stored, r.quarantined, r.refused, r.left_out) for r in run_counts(store).collect()}
    assert counts == {"r1": (9, 3, 2, 3, 1), "r2": (1, 1, 0, 0, 0)}
    assert told(store.summary("t1"))["steps"] == (2, 13.0, 13.0)


def test_a_batch_delivered_twice_counts_once(spark, store):
    sources = spark.createDataFrame([("t1", "s1", "watch")], "tenant_id string, source_id string, source_type string")
    rules = spark.createDataFrame([], RULES)
    batch = spark.createDataFrame([event(1, "steps", 10.0), event(2, "Mood")], EVENTS)
    for number in (0, 0, 1):
        process(store, batch, "events", number, rules, sources)
    process(store, batch, "other stream", 0, rules, sources)
    assert [tuple(r)[2:] for r in run_counts(store).collect()] == [(2, 1, 1, 0, 0)]
    assert store.points().count() == 1 and store.versions() == {"events": 1, "other stream": 0}
