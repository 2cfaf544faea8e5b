"""Near-duplicate texts by SimHash fingerprints that differ in few bits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import xor

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .names import free_names
from .scratch import Scratch

#: Sets of four of the eight byte positions, whose numbers cancel by exclusive or: every three positions are in
#: exactly one of the fourteen. First the six that are made of twos of positions: any two positions miss one of these.
FOURS = sorted((q for q in combinations(range(8), 4) if not reduce(xor, q)), key=lambda q: not (q[0] ^ q[1] == q[2] ^ q[3] == 1))
OF_TWOS = 6
STRETCH = 1 << 17


def text_fingerprint(text: str | None, shingle_words: int) -> int:
    """SimHash over XXH64 (seed 42) of the word shingles, repeats included; 0 for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle_words + 1)
    last = ends[shingle_words - 1 :] if len(words) >= shingle_words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, STRETCH):
        spans = zip(starts[at : min(n, at + STRETCH)].tolist(), last[at : at + STRETCH].tolist(), strict=True)
        h = np.fromiter([digest(line[a:b], 42) for a, b in spans], np.uint64)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def with_fingerprint(documents: DataFrame, id_col: str, text_col: str, shingle_words: int) -> DataFrame:
    """Columns _id and _fp (the fingerprint as a signed long)."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [text_fingerprint(t.as_py(), shingle_words) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64))], ["_id", "_fp"])

    return documents.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(prints, "_id long, _fp long")


def least_meetings(max_bits: int) -> int:
    """In how many lists two fingerprints meet at least that differ in ``max_bits`` bits, so in as many bytes at most."""
    return min(sum(not set(q) & set(gone) for q in FOURS) for gone in combinations(range(8), max_bits))


def fingerprint_links(prints: DataFrame, max_bits: int, crowd: int = 64) -> DataFrame:
    """Links between distinct fingerprints (one column _fp) that differ in at most ``max_bits`` (at most 2) bits.

    The inverted index posts each fingerprint under its bytes at four positions, fourteen times. Lists of
    single bytes would hold one in 256 of all fingerprints; those of four bytes grow only with what is alike.
    The lists in which a pair meets are tallied, which tells its shared positional bytes: three lists or more
    for six or more shared bytes, one at most for five or fewer. A pair that differs in two bits shares six
    bytes at least, so those with fewer than three meetings go; the bits of the others are compared.

    A list of more than ``crowd`` fingerprints isn't paired. A pair's guaranteed meetings are then less by the
    crowded lists that the first is in. Pairs that meet in crowded lists alone meet in one made of twos:
    there each fingerprint is posted again under itself without any two of the 32 open bits, and all that
    share such a posting differ in at most two bits, so that each links to the least of them. The links give
    the same components as all links, and their number stays in proportion to the fingerprints.
    """
    assert 0 <= max_bits <= 2
    need = least_meetings(max_bits)
    keys = [sum(0xFF << (8 * k) for k in q) for q in FOURS]
    signed = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)
    posted = prints.select("_fp", F.posexplode(F.array(*[F.col("_fp").bitwiseAND(F.lit(signed(k))) for k in keys])).alias("_list", "_key"))
    sizes = posted.groupBy("_list", "_key").agg(F.count("*").alias("_n")).where("_n > 1")
    lists = posted.join(sizes, ["_list", "_key"])

    crowds = lists.where(F.col("_n") > crowd).groupBy("_fp").agg(F.count("*").alias("_crowds"))
    small = lists.where(F.col("_n") <= crowd).join(crowds, "_fp", "left").select("_list", "_key", "_fp", F.coalesce("_crowds", F.lit(0)).alias("_crowds"))
    a, b = small.select("_list", "_key", F.col("_fp").alias("a"), "_crowds"), small.select("_list", "_key", F.col("_fp").alias("b"))
    tally = a.join(b, ["_list", "_key"]).where("a < b").groupBy("a", "b", "_crowds").agg(F.count("*").alias("_meetings"))
    enough = tally.where(F.col("_meetings") + F.col("_crowds") >= need)
    pairs = enough.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b")

    open_bits = [[signed(~sum(1 << i for i in bits)) for bits in combinations([i for i in range(64) if not k >> i & 1], max_bits)] for k in keys[:OF_TWOS]]
    per_list = F.get(F.array(*[F.array(*[F.lit(m) for m in own]) for own in open_bits]), F.col("_list"))
    crowded = lists.where((F.col("_n") > crowd) & (F.col("_list") < OF_TWOS))
    masked = crowded.select("_fp", F.explode(per_list).alias("_mask")).select("_fp", "_mask", F.col("_fp").bitwiseAND(F.col("_mask")).alias("_key"))
    least = masked.groupBy("_mask", "_key").agg(F.min("_fp").alias("b"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    stars = masked.join(least, ["_mask", "_key"]).where("_fp <> b").select(F.col("_fp").alias("a"), "b")
    return pairs.unionByName(stars).distinct()


def near_duplicate_classes(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 3,
    max_bits: int = 2,
    scratch: Scratch | None = None,
) -> DataFrame:
    """The near-duplicate class of each document: columns doc_id, fingerprint, component_id.

    Words are runs of anything but ASCII blanks, A-Z lower-cased; fingerprints are 16 lowercase hex
    digits. A null or empty text has the fingerprint zero and is linked like any other. component_id is
    the least doc_id that is reachable by links of at most ``max_bits`` differing bits. Rows with a null
    id get a fingerprint but are in no class, unless all rows of a fingerprint are such: component_id is
    null then. Repeated rows come back each. Other columns are not read.

    Texts become fingerprints where they are read; only ids and fingerprints shuffle. Copies collapse to
    one distinct fingerprint by a partial aggregate before any comparison.
    """
    scratch = scratch or Scratch(documents.sparkSession)
    prints = scratch.table(with_fingerprint(documents, id_col, text_col, shingle_words))
    distinct = scratch.table(prints.groupBy("_fp").agg(F.min("_id").alias("_rep")))
    links = scratch.table(fingerprint_links(distinct.where("_rep IS NOT NULL").select("_fp"), max_bits))
    rep = distinct.select("_fp", "_rep")
    edges = (
        links.join(rep.withColumnsRenamed({"_fp": "a", "_rep": "ra"}), "a")
        .join(rep.withColumnsRenamed({"_fp": "b", "_rep": "rb"}), "b")
        .select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    )
    reached = connected_components(edges, scratch)
    classes = distinct.join(reached, F.col("_rep") == F.col("node"), "left").select("_fp", F.coalesce("component", "_rep").alias("component_id"))
    return prints.join(classes, "_fp").select(
        F.col("_id").alias("doc_id"), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_first_of_class(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None, **options) -> DataFrame:
    """The documents of the least id in each near-duplicate class; rows with a null id stay."""
    classes = near_duplicate_classes(documents, id_col, text_col, scratch=scratch, **options)
    (gone,) = free_names(documents, "_gone")
    later = classes.where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    return documents.join(later, F.col(id_col) == F.col(gone), "left_anti")
