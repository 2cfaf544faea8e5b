"""The driver's points in a store: day states that queries read instead of points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.jobs import shared_folder
from ..streaming.store import Store
from .driver_tables import points

#: When the store's states were begun anew: what came that afternoon lies in the store without being counted.
NOON, NIGHT = "2024-01-20 12:00:00", "2024-01-21 00:00:00"
_MADE: dict[tuple, str] = {}


def stored_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = points(spark, sf_dir)
    return own.withColumn("idempotency_key", F.col("point_id").cast("string")).withColumn("is_total", F.lit(False))


def build_store(spark: SparkSession, sf_dir: str) -> Store:
    """Points up to a noon with their states, those of the afternoon without, and the later ones with."""
    store = Store(spark, shared_folder(spark))
    own = stored_points(spark, sf_dir)
    store.append(own.where(F.col("timestamp") < NOON))
    store.append(own.where(F.col("timestamp").between(NOON, NIGHT) & (F.col("timestamp") < NIGHT)), counted=False)
    store.append(own.where(F.col("timestamp") >= NIGHT))
    return store


def table_state(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    """What tells a table of this session from a changed one: its place, its files' newest time and their length."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    newest = max(f.getModificationTime() for f in system.listStatus(path))
    return spark.sparkContext.applicationId, sf_dir, newest, system.getContentSummary(path).getLength()


def stored(spark: SparkSession, sf_dir: str) -> Store:
    """The store of a folder's events: made on first use in a session, and again if the table's files have changed."""
    key = table_state(spark, sf_dir, "events")
    if key not in _MADE:
        _MADE[key] = build_store(spark, sf_dir).folder
    return Store(spark, _MADE[key])
