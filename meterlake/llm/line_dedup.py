"""Lines that repeat across documents are kept in one document only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .names import free_names
from .scratch import Scratch
from .workers import frugal

BLANKS = b" \t\n\x0b\f\r"


def line_key(line: bytes) -> bytes:
    """The line without blanks at its ends, A-Z lower-cased."""
    return line.strip(BLANKS).lower()


def long_keys(text: str | None, min_chars: int) -> list[bytes]:
    """The distinct keys of at least ``min_chars`` code points, in their order."""
    keys = dict.fromkeys(map(line_key, (text or "").encode().split(b"\n")))
    return [k for k in keys if len(k) >= min_chars and (len(k) >= 4 * min_chars or len(k.decode()) >= min_chars)]


def key_hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))


def drop_repeated_lines(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 3,
    min_chars: int = 20,
    log2_bits: int | None = None,
    most_log2_bits: int = 29,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Drop lines whose key is in ``min_docs`` or more documents, except in the document of the largest id.

    Returns the columns of ``documents`` with the remaining text, and n_lines and n_dropped (longs; input
    columns of these names are replaced). A null or empty text is one empty line and comes back empty.
    Each row counts as a document, also where ids repeat; rows with a null id count too, and lose a
    repeated line unless no row that holds it has an id. Extra columns of any other name pass through.

    1. Every task fills two Bloom filters of ``2**log2_bits`` bits with hashes of its documents' keys, for
       keys seen once and seen twice; these merge without counting, and the second one is broadcast. Without
       ``log2_bits`` they have 8 bits for each line of the corpus, up to ``2**most_log2_bits`` bits (64 MB). A
       corpus that outgrows this has more suspects and shuffles more; the result stays exact.
    2. Only suspects shuffle, by the key itself, with partial counts before it, so that a key in a third
       of the documents arrives as one row of each task.
    3. Documents meet the keys that they lose by a join on the id, those without an id on a hash of the text.
    """
    spark = documents.sparkSession
    scratch = scratch or Scratch(spark)
    tag = F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(0)
    texts = documents.select(F.col(id_col).alias("_id"), tag.alias("_tag"), F.col(text_col).alias("_text"))
    if log2_bits is None:
        lines = texts.agg(F.sum(1 + F.octet_length("_text") - F.octet_length(F.replace("_text", F.lit("\n"), F.lit(""))))).first()[0] or 0
        log2_bits = min(most_log2_bits, max(16, (8 * lines).bit_length()))

    @frugal
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [key_hashes(long_keys(t.as_py(), min_chars)).view(np.int64) for t in batch.column(0)]
            yield pa.record_batch([pa.array(own, pa.list_(pa.int64()))], ["_hashes"])

    filled = spark.sparkContext.broadcast(bloom.repeated_filter(texts.select("_text").mapInArrow(hashes, "_hashes array<bigint>"), log2_bits))

    @frugal
    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [long_keys(t.as_py(), min_chars) for t in batch.column(2)]
            rows = np.repeat(np.arange(len(batch)), [len(k) for k in keys])
            flat = [k for own in keys for k in own]
            hit = bloom.has_bits(filled.value, bloom.positions(key_hashes(flat), log2_bits)) if flat else np.zeros(0, bool)
            found = [k for k, h in zip(flat, hit.tolist(), strict=True) if h]
            own = batch.select([0, 1]).take(pa.array(rows[hit]))
            yield pa.record_batch([*own.columns, pa.array(found, pa.binary()).cast(pa.string())], ["_id", "_tag", "_key"])

    id_type = documents.schema[id_col].dataType.simpleString()
    suspects = scratch.table(texts.mapInArrow(suspected, f"_id {id_type}, _tag long, _key string"))
    counts = suspects.groupBy("_key").agg(F.count("*").alias("_n"), F.max("_id").alias("_keeper"))
    repeated = scratch.table(counts.where(F.col("_n") >= min_docs).drop("_n"))  # apart, so that the join can split a hot key
    lost = (
        suspects.join(repeated, "_key")
        .where(~F.col("_id").eqNullSafe(F.col("_keeper")))
        .groupBy("_id", "_tag")
        .agg(F.collect_set("_key").alias("_lost"))
    )

    @F.arrow_udf("struct<text: string, dropped: bigint>")
    def without(texts: pa.Array, lost_keys: pa.Array) -> pa.Array:
        kept, dropped = [], []
        for text, own in zip(texts, lost_keys, strict=True):
            if not own.is_valid:
                kept.append(text.as_py())
                dropped.append(0)
                continue
            gone = {k.as_py().encode() for k in own}
            before = text.as_py().encode().split(b"\n")
            after = [x for x in before if line_key(x) not in gone]
            kept.append(b"\n".join(after).decode())
            dropped.append(len(before) - len(after))
        return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(dropped, pa.int64())], ["text", "dropped"])

    key, tag_key, own_tag, drops, out = free_names(documents, "_key_of", "_tag_of", "_own_tag", "_drops", "_out")
    lost = lost.select(F.col("_id").alias(key), F.col("_tag").alias(tag_key), F.col("_lost").alias(drops)).hint("shuffle_hash")
    rows = documents.withColumn(own_tag, tag).withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))
    joined = rows.join(lost, F.col(id_col).eqNullSafe(F.col(key)) & (F.col(own_tag) == F.col(tag_key)), "left")
    return (
        joined.withColumn(out, without(F.col(text_col), F.col(drops)))
        .withColumn("n_lines", F.size(F.split(F.col(text_col), "\n")).cast("long"))
        .withColumn("n_dropped", F.col(f"{out}.dropped"))
        .withColumn(text_col, F.col(f"{out}.text"))
        .drop(key, tag_key, own_tag, drops, out)
    )
