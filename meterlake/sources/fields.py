"""Which members the payloads of a provider hold, of which kind and how often, and which of them nobody maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..streaming.jobs import shared_folder

FIELDS = "path string, kind string, n long, documents long"
#: What schema_of_variant says of a value, and the kind that it stands for.
KINDS = {"OBJECT": "object", "ARRAY": "array", "BOOLEAN": "boolean", "STRING": "string", "VOID": "null"}


def value_kind(value: Column) -> Column:
    """object, array, boolean, string, null or number (all others) of a variant."""
    name = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    kind = F.lit("number")
    for said, told in KINDS.items():
        kind = F.when(name == said, told).otherwise(kind)
    return kind


def collected_fields(payloads: DataFrame, payload_col: str = "payload", most_depth: int = 32) -> DataFrame:
    """Each path and kind in the payloads (JSON texts): n, how often it occurs, and in how many ``documents``.

    Members of objects are told by name, those of arrays by ``[]``. Each level of nesting is exploded as a variant
    and counted where it lies; only counts are shuffled, and written to the shared folder. Nesting goes on as long as there is any: beyond
    ``most_depth`` levels a container is told, not what it holds. Payloads that are no JSON, and null ones, are left out.
    """
    level = payloads.select(F.monotonically_increasing_id().alias("_d"), F.try_parse_json(payload_col).alias("v"), F.lit("").alias("path")).where("v IS NOT NULL").persist()
    counts = f"{shared_folder(payloads.sparkSession)}/fields"
    held = [level]
    for _ in range(most_depth):
        kind = value_kind(F.col("v"))
        opened = level.where(kind.isin("object", "array")).select("_d", "path", F.col("v"))
        rows = opened.lateralJoin(opened.sparkSession.tvf.variant_explode(F.col("v").outer()).select("key", F.col("value").alias("w")))
        named = F.when(F.col("key").isNull(), F.concat("path", F.lit("[]"))).when(F.col("path") == "", F.col("key")).otherwise(F.concat("path", F.lit("."), "key"))
        level = rows.select("_d", F.col("w").alias("v"), named.alias("path")).persist()
        held.append(level)
        if level.isEmpty():
            break
        own = level.groupBy("_d", "path", value_kind(F.col("v")).alias("kind")).agg(F.count("*").alias("_n"))
        own.groupBy("path", "kind").agg(F.sum("_n").alias("n"), F.count("*").alias("documents")).write.mode("append").parquet(counts)
    for used in held:
        used.unpersist()
    if len(held) <= 2:
        return payloads.sparkSession.createDataFrame([], FIELDS)
    return payloads.sparkSession.read.schema(FIELDS).parquet(counts)


def unmapped(fields: DataFrame, mapped: DataFrame) -> DataFrame:
    """The fields whose path nobody maps."""
    return fields.join(mapped.select("path"), "path", "left_anti")
