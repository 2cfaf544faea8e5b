"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_RECORDS: list[list[Scratch]] = []


class Scratch:
    """A folder below ``spark.checkpoint.dir`` for tables that cut a job's lineage.

    The setting is read from the session. Where it is unset, a local master gets a temporary folder; on a
    cluster, where executors don't share one, that is an error. ``release()`` deletes what was written;
    call it once results that read the tables are stored.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="scratch-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.path = f"{root.rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self._tables = 0
        for made in _RECORDS:
            made.append(self)

    def table(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as Parquet and return the reread table."""
        self._tables += 1
        at = f"{self.path}/{self._tables}"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def release(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def recorded() -> Iterator[list[Scratch]]:
    """What is made meanwhile, so that it can be released together."""
    made: list[Scratch] = []
    _RECORDS.append(made)
    try:
        yield made
    finally:
        _RECORDS.remove(made)
