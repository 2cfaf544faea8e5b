"""How filters of documents interact: each order of them is replayed over the same flags."""

from __future__ import annotations

import string
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
WORD_GAP = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """Whether a text fails each filter that needs nothing but the text; an empty text fails A alone."""
    stripped = F.btrim(text, F.lit(BLANKS))
    words = F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, WORD_GAP))
    capitals = F.char_length(text) - F.char_length(F.translate(text, string.ascii_uppercase, ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * capitals.cast("long") > 10 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def document_flags(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row a document: part, fails (letters of the filters that it fails, in order), good and toxic.

    E fails a document if a smaller id has the same text, whatever other filters say. The least id of each
    text comes from a partial aggregate over digests of 256 bits; documents meet it by digest and id, so a text that
    many documents share is spread over all tasks. A null text is empty, a null part an empty string. A row
    with a null id fails no E and makes none fail, and has no label; rows of equal id and text share their E.
    A document is good (toxic) if any of its labels has quality (toxic) 1.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(text, 256))
    flags = text_failures(text)
    fails = F.concat(*[F.when(failed, letter).otherwise("") for letter, failed in flags.items()])
    read = documents.select(F.col(id_col).alias("_id"), digest.alias("_digest"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), fails.alias("_fails"))
    firsts = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_first"), digest.alias("_of")).groupBy("_of").agg(F.min("_first").alias("_first"))
    told = labels.select(F.col(id_col).alias("_labelled"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where("_labelled IS NOT NULL")
    told = told.groupBy("_labelled").agg(F.coalesce(F.bool_or("good"), F.lit(False)).alias("good"), F.coalesce(F.bool_or("toxic"), F.lit(False)).alias("toxic"))
    placed = read.join(firsts, (F.col("_digest") == F.col("_of")) & (F.col("_id") == F.col("_first")), "left")
    repeated = F.col("_id").isNotNull() & F.col("_first").isNull()
    # Rows without an id match no label; dealt by their digests, they don't gather in one task.
    spread = F.when(F.col("_id").isNull(), F.xxhash64("_digest")).otherwise(0)
    known = placed.join(told.withColumn("_spread", F.lit(0).cast("long")), (F.col("_id") == F.col("_labelled")) & (spread == F.col("_spread")), "left")
    return known.select(
        "part",
        F.concat("_fails", F.when(repeated, "E").otherwise("")).alias("fails"),
        F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"),
    )


def interactions(flags: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """For each part, order of the filters and step in it: what the filter removes there, and what others did before.

    ``flags`` has part, fails, good and toxic of each document. Documents of equal flags are counted first, on
    the map side, and meet the orders (120 for five letters, broadcast) with their count as weight; each
    order's steps are exploded, the first failure is the failing letter that comes first, and
    conditional sums with partial aggregation make the rows. Every part has all rows, zeros included; no documents, no rows.
    """
    spark = flags.sparkSession
    weighed = flags.groupBy("part", "fails", "good", "toxic").agg(F.count("*").alias("n"))
    orders = spark.createDataFrame([("".join(p),) for p in permutations(letters)], "filter_order string")
    first = F.least(*[F.when(F.contains("fails", F.lit(c)), F.instr("filter_order", F.lit(c))) for c in letters], F.lit(len(letters) + 1))
    replayed = weighed.crossJoin(F.broadcast(orders)).withColumn("first", first)
    steps = replayed.withColumn("step", F.explode(F.array(*[F.lit(k) for k in range(1, len(letters) + 1)])))
    steps = steps.withColumn("letter", F.expr("substring(filter_order, step, 1)"))
    here, failing = F.col("first") == F.col("step"), F.contains("fails", "letter")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    counted = steps.groupBy("part", "filter_order", "step", "letter").agg(
        total(F.col("first") > F.col("step")).alias("kept"),
        total(here).alias("removed"),
        total(failing & (F.col("first") < F.col("step"))).alias("redundant"),
        total(F.col("fails") == F.col("letter")).alias("unique_fails"),
        total(here & F.col("good")).alias("good_lost"),
        total(here & F.col("toxic")).alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter"))  # as many rows as there are orders
    return counted.withColumn("shapley", shapley).drop("letter")


def filter_interactions(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters A to E over all documents, in all orders; see ``document_flags`` and ``interactions``."""
    return interactions(document_flags(documents, labels))
