"""Document fingerprints by one-permutation MinHash, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 128
WORD_GAP = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
VALUE_BITS = 57
EMPTY = (1 << VALUE_BITS) - 1
PROBES = 8


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is made once: the only element of an array is bound to a name."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def shingle_hashes(text: Column, shingle_words: int) -> Column:
    """A hash of each run of ``shingle_words`` words; of all words if there are fewer; none without words."""
    stripped = F.btrim(text, F.lit(BLANKS))

    def of_words(h: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(h) - shingle_words), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(shingle_words)]))
        return F.when(F.size(h) >= shingle_words, runs).otherwise(F.array(F.xxhash64(h)))

    hashed = bound(F.transform(F.split(stripped, WORD_GAP), lambda w: F.xxhash64(w)), of_words)
    return F.when(stripped == "", F.array().cast("array<bigint>")).otherwise(hashed)


def _probe(j: Column, t: int) -> Column:
    """The bin that empty bin j turns to at its t-th try, by a hash of both."""
    return F.get(F.array(*[F.lit(xxhash.xxh64_intdigest(bytes([b, t])) % BINS) for b in range(BINS)]), j)


def fingerprint(text: Column, shingle_words: int = 5) -> Column:
    """Low-order bytes of the least hash in each of BINS bins (array<tinyint>).

    A hash's leading bits are its bin. One value for each bin that stands for none is added, all are
    sorted, and the first of each bin stays. An empty bin takes the value of the first bin of its PROBES
    tries that isn't empty, else of that of the least hash with it. Each try is a hash of its own, so what a
    bin takes depends on which bins are empty and on nothing else. A text without words has zeros.
    """
    guards = F.array(*[F.lit((b - BINS // 2) * (EMPTY + 1) + EMPTY) for b in range(BINS)])
    bin_of = lambda v: F.shiftright(v, VALUE_BITS)

    def firsts(s: Column) -> Column:
        return F.filter(s, lambda v, i: (i == 0) | (bin_of(v) != bin_of(F.get(s, F.greatest(i - 1, F.lit(0))))))

    def packed(mins: Column) -> Column:
        return F.transform(mins, lambda v: F.when(v.bitwiseAND(EMPTY) != EMPTY, (v.bitwiseAND(255) - 128).cast("int")))

    def densified(values: Column) -> Column:
        full = F.array_compact(values)

        def far(j: Column) -> Column:
            """For a text of few shingles: the bin of the least hash with j among those not empty."""
            ranked = F.transform(values, lambda v, b: F.when(v.isNotNull(), F.struct(F.xxhash64(j, b).alias("h"), v.alias("v"))))
            return F.array_min(ranked)["v"]

        near = lambda v, j: F.coalesce(v, *[F.get(values, _probe(j, t)) for t in range(PROBES)], far(j))
        return F.when(F.size(full) == BINS, values).when(F.size(full) == 0, F.array_repeat(F.lit(-128), BINS)).otherwise(F.transform(values, near))

    ordered = F.sort_array(F.concat(shingle_hashes(text, shingle_words), guards))
    return bound(bound(bound(ordered, firsts), packed), densified).cast("array<tinyint>")


def as_hex(print_: Column) -> Column:
    digits = F.array(*[F.lit(f"{b:02x}") for b in range(256)])
    return F.array_join(F.transform(print_, lambda v: F.get(digits, v.cast("int") + 128)), "")


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity: the share of equal bytes, less the 1 in 256 that agree by chance."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / F.lit(float(BINS))
    return F.greatest(F.lit(0.0), (same - 1 / 256) / (1 - 1 / 256))


def with_next(documents: DataFrame, id_col: str, columns: list[str], rows_per_chunk: int, most_chunks: int, more: dict[str, Column] | None = None) -> DataFrame:
    """Each row with the ``columns`` of the next row in ascending id, as next_<column>; the first follows the last.
    ``more``: columns to add to each row before, which may be among ``columns``.

    Ids are cut into chunks at approximate quantiles; each chunk also gets the first row of the next one as
    a guard, so that a window over a chunk finds the follower of its last row too. Texts shuffle once.
    A null id comes before all others.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    ids = documents.select(key.alias("_k"))
    chunks = max(1, min(most_chunks, ids.count() // rows_per_chunk))
    cuts = sorted({int(x) for x in ids.approxQuantile("_k", [i / chunks for i in range(1, chunks)], 1 / (8 * chunks))}) if chunks > 1 else []
    coarse, step = cuts[::100], 100

    def below(k: Column) -> Column:
        """How many cuts are at most k: among every hundredth, then among those after the last of these."""
        if not cuts:
            return F.lit(0)
        near = F.size(F.filter(F.array(*[F.lit(c) for c in coarse]), lambda c: c <= k))
        within = F.array(*[F.array(*[F.lit(c) for c in cuts[a : a + step]]) for a in range(0, len(cuts), step)])
        return bound(near, lambda n: F.when(n == 0, 0).otherwise((n - 1) * step + F.size(F.filter(F.get(within, n - 1), lambda c: c <= k))))

    keyed = documents.withColumn("_k", key).withColumn("_chunk", below(F.col("_k"))).withColumn("_guard", F.lit(0))
    by_chunk = Window.orderBy("_chunk")
    heads = ids.withColumn("_chunk", below(F.col("_k"))).groupBy("_chunk").agg(F.min("_k").alias("_head"))
    ring = heads.select("_chunk", F.coalesce(F.lead("_head").over(by_chunk), F.min("_head").over(Window.orderBy(F.lit(0)))).alias("_k"))
    guards = keyed.drop("_chunk", "_guard").join(F.broadcast(ring), "_k").withColumn("_guard", F.lit(1))  # ring: most_chunks rows at most
    rows = keyed.unionByName(guards).withColumns(more or {})  # only here, so that guards are told apart before
    follow = Window.partitionBy("_chunk").orderBy("_guard", "_k", *columns)
    led = rows.select("*", *[F.lead(c).over(follow).alias(f"next_{c}") for c in columns])
    return led.where("_guard = 0").drop("_chunk", "_guard", "_k")


def fingerprints(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    rows_per_chunk: int = 1000,
    most_chunks: int = 10_000,
) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how like they are.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex), near_edited and near_next.
    The edited text has the last half of its code points replaced by as many from the start of the next
    text in ascending id. A null text is empty; texts without words are like each other only. Ids are
    meant to be unique: rows that repeat an id follow each other in the order of their texts. Other columns
    are not read; an empty table gives no rows.
    """
    texts = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    led = with_next(texts, "doc_id", ["text", "print"], rows_per_chunk, most_chunks, {"print": fingerprint(F.col("text"), shingle_words)})
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = led.withColumn("edited", F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 2) as int))"), F.substring(F.col("next_text"), F.lit(1), half)))
    both = edited.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "print",
        "next_print",
        fingerprint(F.col("edited"), shingle_words).alias("edited_print"),
    )
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_hex(F.col("print")).alias("fingerprint"),
        as_hex(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
