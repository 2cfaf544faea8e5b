"""Points and their day states in one store, of which each batch is seen whole or not at all.

A batch writes ``<table>/batch=<number>`` of each of its tables and then one file, ``commits/<number>``, which
names the last version of each stream that the store holds. Batches count up; readers take those up to the
newest commit, so what a lost writer left isn't seen, and the next try replaces it. There is one writer at a time. Points lie by day. A day's states are written anew, merged, by
each batch that adds to the day; the manifest of a batch says for each day how many points are stored, how
many its states have counted, and which batch wrote these. A day whose counts agree is never scanned.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ..functions.registry import with_definition
from ..operators import rollups as R

POINTS = "point_id long, idempotency_key string, tenant_id string, source_id string, metric_type string, timestamp timestamp_ntz, value double, is_total boolean, metadata string"
KEY = ("tenant_id", "idempotency_key", "timestamp")
DAYS = "day string, stored long, counted long, written int"


def day_of(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd")


def day_states(points: DataFrame) -> DataFrame:
    """Mergeable states of each source, metric and day; a provider's totals apart, the latest of which counts."""
    order = F.struct("timestamp", "point_id")
    total = F.when(F.col("is_total") & F.col("value").isNotNull(), order)
    dated = points.withColumn("day", day_of(F.col("timestamp")))
    states = R.partial_states(F.col("value"), F.col("timestamp"), order=order)
    return dated.groupBy(*R.KEYS, "day").agg(*states, F.max(total).alias("total_key"), F.max_by("value", total).alias("total_value"))


def merged(states: DataFrame, *keys: str) -> DataFrame:
    return states.groupBy(*keys).agg(*R.merged_states(), F.max("total_key").alias("total_key"), F.max_by("total_value", "total_key").alias("total_value"))


def valued(states: DataFrame) -> DataFrame:
    """States with the value of their metric's aggregation; a provider's total stands for a day of summed values."""
    own = with_definition(states, ("aggregation",))
    stated = (F.col("aggregation") == "sum") & F.col("total_key").isNotNull()
    return own.withColumn("is_provider_total", F.col("total_key").isNotNull()).withColumn("value", F.when(stated, F.col("total_value")).otherwise(R.final_value()))


_STATE_SCHEMA: list[StructType] = []


def _state_schema(spark: SparkSession) -> StructType:
    """The columns of ``day_states``, made out once in a process."""
    if not _STATE_SCHEMA:
        _STATE_SCHEMA.append(day_states(spark.createDataFrame([], POINTS)).schema)
    return _STATE_SCHEMA[0]


class Store:
    """Tables under ``folder``, which the driver and all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._root = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: object) -> object:
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *map(str, parts)]))

    def newest(self) -> int:
        """The newest batch that is committed; -1 if there is none."""
        at = self._path("commits")
        return max((int(f.getPath().getName()) for f in self._fs.listStatus(at)), default=-1) if self._fs.exists(at) else -1

    def versions(self) -> dict[str, int]:
        """The last version of each stream that the newest commit holds."""
        newest = self.newest()
        if newest < 0:
            return {}
        stream = self._fs.open(self._path("commits", newest))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, batch: int, versions: dict[str, int]) -> None:
        made = self._path("commits.new", batch)
        out = self._fs.create(made, True)
        out.write(json.dumps(versions).encode())
        out.close()
        self._fs.mkdirs(self._path("commits"))
        if not self._fs.rename(made, self._path("commits", batch)):
            raise RuntimeError(f"batch {batch} is committed already")
        for k in range(max(0, batch - 8), batch):  # the newest commit stands for all before it
            self._fs.delete(self._path("commits", k), False)

    def write(self, name: str, rows: DataFrame, batch: int, by_day: bool = False) -> None:
        """The rows of a batch, in place of what an earlier try left."""
        if by_day:
            out = rows.hint("rebalance", "day").write.partitionBy("day")
        else:
            out = rows.write
        out.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{self.folder}/{name}/batch={batch}")

    def read(self, name: str, schema: str | StructType, at: int | None = None) -> DataFrame:
        """Rows of a table in the batches committed up to ``at`` (all), with their batch."""
        kind = StructType.fromDDL(schema) if isinstance(schema, str) else StructType(list(schema.fields))
        kind = kind.add("batch", IntegerType())
        newest = self.newest() if at is None else at
        if newest < 0 or not self._fs.exists(self._path(name)):
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(f"{self.folder}/{name}").where(F.col("batch") <= newest)

    def manifest(self, at: int | None = None) -> DataFrame:
        """One row a day: stored, counted, and the batch that wrote its states."""
        newest = self.newest() if at is None else at
        if newest < 0:
            return self.spark.createDataFrame([], DAYS)
        return self.spark.read.schema(DAYS).parquet(f"{self.folder}/manifest/batch={newest}")

    def points(self, days: Iterable[str] | None = None, at: int | None = None) -> DataFrame:
        """Stored points, of some days: others aren't listed as tasks."""
        own = self.read("points", f"{POINTS}, day string", at)
        return (own if days is None else own.where(F.col("day").isin(*days))).drop("batch")

    def states(self, days: Sequence[tuple[str, int]], at: int | None = None) -> DataFrame:
        """The states of days, each from the batch that wrote it; others aren't listed as tasks."""
        found = self.read("states", _state_schema(self.spark), at)
        wanted = [f"{day}/{written}" for day, written in days]
        return found.where(F.concat_ws("/", "day", "batch").isin(*wanted)).drop("batch")

    def append(self, points: DataFrame, version: tuple[str, int] | None = None, keys: Sequence[str] = KEY, counted: bool = True, **sides: DataFrame) -> bool:
        """Add the points whose keys the store doesn't hold, count them in the states of their days, and commit both,
        along with the rows of other tables (``sides``). Returns whether anything was to be done.

        ``version`` is a stream and its batch number: one that the store holds already changes nothing. Of equal
        keys in a batch one row stays. Points of equal keys are of one day, so only days of the batch
        are read. Points without a time have no day and aren't stored. With ``counted`` false the states stay as
        they are, as for points from before there were states; readers then scan their days.
        """
        newest, versions = self.newest(), self.versions()
        if version is not None:
            if version[1] <= versions.get(version[0], -1):
                return False
            versions[version[0]] = version[1]
        batch = newest + 1
        columns = [f.name for f in StructType.fromDDL(POINTS).fields]
        given = points.select(*columns).where("timestamp IS NOT NULL").withColumn("day", day_of(F.col("timestamp"))).dropDuplicates(list(keys))
        given = given.persist()
        try:
            days = [r.day for r in given.select("day").distinct().collect()]
            held = self.points(days, newest).select("day", *keys)
            same = [given[k].eqNullSafe(held[k]) for k in ("day", *keys)]
            new = given.join(held, same, "left_anti") if newest >= 0 and days else given
            self.write("points", new, batch, by_day=True)
            mine = self.spark.read.schema(f"{POINTS}, day string").parquet(f"{self.folder}/points/batch={batch}")
            added = mine.groupBy("day").agg(F.count("*").alias("_new"))
            before = self.manifest(newest)
            known = before.join(added, "day", "full").withColumn("_new", F.coalesce("_new", F.lit(0)))
            if counted:
                old = [(r.day, r.written) for r in before.where(F.col("day").isin(*days)).collect() if r.written is not None]
                states = day_states(mine)
                if old:
                    states = merged(self.states(old, newest).unionByName(states), *R.KEYS, "day")
                self.write("states", states, batch, by_day=True)
            more = F.col("_new") if counted else F.lit(0)
            written = F.when((F.col("_new") > 0) & F.lit(counted), batch).otherwise(F.col("written"))
            days_now = known.select("day", (F.coalesce("stored", F.lit(0)) + F.col("_new")).alias("stored"), (F.coalesce("counted", F.lit(0)) + more).alias("counted"), written.cast("int").alias("written"))
            for name, rows in sides.items():
                self.write(name, rows, batch)
            self.write("manifest", days_now.coalesce(1), batch)  # a row a day
            self.commit(batch, versions)
        finally:
            given.unpersist()
        return True

    def rebuild(self) -> int:
        """Count the points of all days whose counts disagree, from the points themselves, and commit their states."""
        newest = self.newest()
        days = [r.day for r in self.manifest(newest).where("stored <> counted").select("day").collect()]
        batch = newest + 1
        self.write("states", day_states(self.points(days, newest)), batch, by_day=True)
        done = F.col("day").isin(*days)
        self.write("manifest", self.manifest(newest).select("day", "stored", F.when(done, F.col("stored")).otherwise(F.col("counted")).alias("counted"), F.when(done, batch).otherwise(F.col("written")).cast("int").alias("written")), batch)
        self.commit(batch, self.versions())
        return batch

    def drop_superseded(self) -> int:
        """Delete the states that later batches have replaced, and older manifests; how many folders went.

        Readers of an older commit must be done."""
        newest, gone = self.newest(), 0
        kept = {(r.written, r.day) for r in self.manifest(newest).collect()}
        for table in ("states", "manifest"):
            at = self._path(table)
            for folder in self._fs.listStatus(at) if self._fs.exists(at) else ():
                batch = int(folder.getPath().getName().removeprefix("batch="))
                if table == "manifest":
                    gone += batch < newest and self._fs.delete(folder.getPath(), True)
                    continue
                days = [d.getPath() for d in self._fs.listStatus(folder.getPath()) if d.isDirectory()] if batch <= newest else []
                gone += sum(self._fs.delete(d, True) for d in days if (batch, d.getName().removeprefix("day=")) not in kept)
        return gone

    def current(self, tenant: str | None = None) -> DataFrame:
        """Day states of all points: stored ones of days whose counts agree, of other days made from their points.

        What is collected is the manifest, a row a day. Both reads are pruned to their days, and a tenant's
        rows are picked where they are read.
        """
        at = self.newest()
        days = self.manifest(at).collect()
        agree = [(r.day, r.written) for r in days if r.stored == r.counted]
        scan = [r.day for r in days if r.stored != r.counted]
        own = F.lit(True) if tenant is None else F.col("tenant_id") == tenant
        parts = ([self.states(agree, at).where(own)] if agree else []) + ([day_states(self.points(scan, at).where(own))] if scan else [])
        found = parts[0] if parts else self.states([], at)
        return found.unionByName(parts[1]) if len(parts) > 1 else found

    def summary(self, tenant: str) -> DataFrame:
        """The whole history of each metric of a tenant; where it is summed, a provider's total is the sum of its day."""
        days = self.current(tenant).withColumn("_stated", F.coalesce("total_value", "sum_value"))
        own = with_definition(days.groupBy("metric_type").agg(*R.merged_states(), F.sum("_stated").alias("_stated")), ("aggregation",))
        summed = F.when(F.col("aggregation") == "sum", F.col("_stated")).otherwise(F.col("sum_value"))
        return own.withColumn("sum_value", summed).withColumn("value", R.final_value()).drop("_stated")

    def series(self, tenant: str | None = None) -> DataFrame:
        """The value of each source, metric and day."""
        return valued(self.current(tenant)).withColumn("bucket_start", F.col("day").cast("timestamp_ntz"))

    def coverage(self) -> DataFrame:
        """How many values each source has of each metric."""
        return self.current().groupBy("tenant_id", "metric_type", "source_id").agg(F.sum("sample_count").alias("samples"))
