"""Labelled rows to learn from, and which rows are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """The CRC-32 of the id as text, modulo ``modulus``; of a null id that of the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def training_texts(documents: DataFrame, labels: DataFrame, label_col: str, modulus: int, held_out: int, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns _text and _y of at most ``max_rows`` labelled ids that are not held out.

    The ids are those of the smallest hashes, the same at each run. A null label is none; an id that is
    labelled both ways counts as 1. ``max_rows`` bounds what is broadcast to the scan of the documents.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id IS NOT NULL AND _y IS NOT NULL")
    known = known.where(id_remainder(F.col("_id"), modulus) != held_out).groupBy("_id").agg(F.max("_y").alias("_y"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    texts = documents.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return texts.join(F.broadcast(sample), "_id").select("_text", "_y")
