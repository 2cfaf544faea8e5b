"""Points as a stream: windows, deduplication and totals of days."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType


def event_stream(spark: SparkSession, folder: str, names: str = "*.parquet", files_per_trigger: int = 8) -> DataFrame:
    """New files of a folder as a stream; how many a batch takes bounds its size."""
    schema = spark.read.option("pathGlobFilter", names).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", names).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed(points: DataFrame, width: str, *keys: str, late: str = "1 hour") -> DataFrame:
    """Samples, sum and spread of tumbling windows of event time. What is later than ``late`` is dropped once
    its window has been given out."""
    return points.withWatermark("timestamp", late).groupBy(*keys, F.window("timestamp", width)).agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most")
    )


def deduplicated(points: DataFrame, *keys: str, late: str = "1 day") -> DataFrame:
    """Each key once among what comes within ``late`` of it."""
    return points.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(list(keys))


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors see. Only a local master may do without ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="stream-")
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def store_new(stream: DataFrame, folder: str, *keys: str) -> None:
    """Append what a table doesn't hold yet, batch by batch, until the stream has nothing more.

    The table lies by ``day`` of its timestamp, and equal keys are of one day, so a batch reads its own days only.
    Files are written under the batch's number and replace those of an earlier try; a batch that is
    delivered again finds its own rows and adds none.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        distinct = batch.withColumn("day", F.date_format("timestamp", "yyyy-MM-dd")).dropDuplicates(list(keys)).persist()
        days = [r.day for r in distinct.select("day").distinct().collect()]
        new = distinct
        if number and days:
            held = spark.read.schema(StructType([*distinct.schema.fields, StructField("batch", IntegerType())])).parquet(f"{folder}/points")
            held = held.where((F.col("batch") < number) & F.col("day").isin(*days))
            new = distinct.join(held.select("day", *keys), ["day", *keys], "left_anti")
        new.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("day").parquet(f"{folder}/points/batch={number}")
        distinct.unpersist()

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


DAY_TOTALS = "tenant_id string, source_id string, metric_type string, day string, value double, is_provider_total boolean, samples long, revision int"


class DayTotals(StatefulProcessor):
    """Days of one source and metric: what came of each, whether that has been told, and how often.

    A day is over once a later one has begun, or once nothing has come for ``quiet_ms``. It is told then, and again,
    with the next revision, if late samples or totals come. A day for which nothing has come for ``keep_ms`` is
    forgotten: what comes even later would make a day of its own. Both times are those of arrivals, which the
    watermark follows, so a run gives the same rows whenever it is run.
    """

    def __init__(self, quiet_ms: int, keep_ms: int):
        self.quiet_ms, self.keep_ms = quiet_ms, max(quiet_ms, keep_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        state = "total double, samples long, stated double, stated_at long, stated_id long, revision int, untold boolean, touched long"
        self.days = handle.getMapState("days", "day string", state)
        self.newest = handle.getValueState("newest", "day string")

    def _told(self, key: tuple, before: str, watermark: int) -> Iterator[pd.DataFrame]:
        """Rows of days before ``before`` that have changed; old days go, and the next timer is set."""
        told, next_at = [], []
        for (day,), (total, samples, stated, at, id_, revision, untold, touched) in list(self.days.iterator()):
            if untold and day < before:
                told.append([*key, day, total if at is None else stated, at is not None, samples, revision + 1])
                self.days.updateValue((day,), (total, samples, stated, at, id_, revision + 1, False, touched))
                untold = False
            due = touched + (self.quiet_ms if untold else self.keep_ms)
            if not untold and due <= watermark:
                self.days.removeKey((day,))
            else:
                next_at.append(max(due, watermark + 1))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if next_at:
            self.handle.registerTimer(min(next_at))
        if told:
            yield pd.DataFrame(sorted(told), columns=[c.split()[0] for c in DAY_TOTALS.split(", ")])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        newest = self.newest.get()[0] if self.newest.exists() else ""
        for batch in rows:
            batch = batch[batch["value"].notna() & batch["day"].notna()]
            for day, own in batch.groupby("day"):
                newest = max(newest, day)
                held = self.days.getValue((day,)) if self.days.containsKey((day,)) else (0.0, 0, None, None, None, 0, True, 0)
                total, samples, stated, at, id_, revision, _, touched = held
                is_total = own["is_total"].eq(True)
                totals = own[is_total].sort_values(["timestamp", "point_id"])
                if len(totals):
                    last = totals.iloc[-1]
                    place = int(last["timestamp"].value), int(last["point_id"])
                    if at is None or place > (at, id_):
                        stated, (at, id_) = float(last["value"]), place
                total += float(own["value"][~is_total].sum())
                touched = max(touched, int(own["arrived_at"].max().value) // 1_000_000)
                self.days.updateValue((day,), (total, samples + int((~is_total).sum()), stated, at, id_, revision, True, touched))
        if newest:
            self.newest.update((newest,))
        yield from self._told(key, newest, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        quiet = all(state[7] + self.quiet_ms <= watermark for _, state in list(self.days.iterator()) if state[6])
        yield from self._told(key, "~" if quiet else self.newest.get()[0], watermark)

    def close(self) -> None:
        pass


def day_totals(points: DataFrame, quiet_ms: int = 6 * 3_600_000, keep_ms: int = 30 * 86_400_000, late: str = "10 minutes") -> DataFrame:
    """The total of each day once it is over: the sum of its samples, or the latest total that a provider stated.

    ``points`` has point_id, arrived_at (a timestamp) and a boolean is_total (null: no). Points without a value or
    time are no samples; what arrives out of order by more than ``late`` is left out. Times of samples may
    be as late as they like, see ``DayTotals``. Readers take the last revision of a day, or the first, if what was
    told is to stay. Batches that are delivered again must be dropped before (``deduplicated``, or a store).
    """
    dated = points.withWatermark("arrived_at", late).withColumn("day", F.date_format("timestamp", "yyyy-MM-dd"))
    by_source = dated.select("tenant_id", "source_id", "metric_type", "day", "timestamp", "point_id", "value", "is_total", "arrived_at").groupBy("tenant_id", "source_id", "metric_type")
    # The driver's own worker for states doesn't see packages that are shipped to executors, so the class goes by value.
    here = sys.modules[__name__]
    cloudpickle.register_pickle_by_value(here)
    try:
        return by_source.transformWithStateInPandas(DayTotals(quiet_ms, keep_ms), DAY_TOTALS, "Append", "EventTime")
    finally:
        cloudpickle.unregister_pickle_by_value(here)


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries started meanwhile keep their state in RocksDB, which ``day_totals`` needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def appended(stream: DataFrame, folder: str) -> None:
    """Run a stream until it has no more, adding its rows to ``folder``/out."""
    with state_on_disk(stream.sparkSession):
        query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def collected(stream: DataFrame, mode: str) -> DataFrame:
    """The rows of a stream that ends, as a table in the shared folder of its last state."""
    spark = stream.sparkSession
    folder = shared_folder(spark)
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    else:
        query = stream.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/out")).option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
