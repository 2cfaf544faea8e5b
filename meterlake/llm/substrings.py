"""Removal of passages that occur earlier in the corpus, found by difference-cover anchors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .names import free_names
from .scratch import Scratch
from .workers import frugal

#: A perfect difference set: any two residues modulo 13 have a common shift into the set.
PERIOD = 13
COVER = (0, 1, 3, 9)
BASE, OTHER_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
WINDOW = 20
CHUNK_WORDS = 500_000
#: Hashes of so many bytes of text meet at a time.
BUCKET_BYTES = 32 << 20
BLOBS = "bucket int, hashes binary, checks binary, docs binary, counts binary, starts binary"
BLOB_COLUMNS = [c.split()[0] for c in BLOBS.split(", ")]
MARKS = "_id long, _tag long, _flags binary"


class WordHashes(dict):
    """XXH64 of words, kept for the next time; cleared when it has ``limit`` entries."""

    limit = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def windows(h: np.ndarray, starts: np.ndarray, length: int, base: np.uint64 = BASE) -> np.ndarray:
    """A hash of the ``length`` word hashes from each start."""
    total = np.zeros(len(starts), np.uint64)
    for k in range(length):
        total = total * base + h[starts + k]
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(32))


class Chunk:
    """Documents of one task, up to about CHUNK_WORDS words: id, tag and word hashes of each."""

    def __init__(self):
        self.ids, self.tags, self.hashes, self.picked, self.size = [], [], [], [], 0

    def add(self, doc_id: int, tag: int, h: np.ndarray, starts: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.tags.append(tag)
        self.hashes.append(h)
        self.picked.append(starts)
        self.size += len(h)

    def group(self, length: int, checked: bool) -> tuple[np.ndarray, ...]:
        """Hash, check, document and start of each picked window in order of these, documents by id and tag;
        which are not the first row of their hash and check; and which of these are after it in id, tag or
        start. The check is a second hash; it is zero without ``checked``."""
        offsets = np.concatenate([[0], np.cumsum([len(h) for h in self.hashes])])[:-1]
        doc = np.repeat(np.arange(len(self.ids)), [len(s) for s in self.picked])
        start = np.concatenate(self.picked) if self.picked else np.zeros(0, np.int64)
        h = check = np.zeros(len(start), np.uint64)
        if len(start):
            words, at = np.concatenate(self.hashes), start + offsets[doc]
            h, check = windows(words, at, length), windows(words, at, length, OTHER_BASE) if checked else check
        rank = np.unique(np.array([self.ids, self.tags], np.int64), axis=1, return_inverse=True)[1].ravel()
        order = np.lexsort((start, rank[doc], check, h) if checked else (start, rank[doc], h))
        h, check, doc, start = h[order], check[order], doc[order], start[order]
        later, after = _not_first(h, check, rank[doc], start)
        return h, check, doc, start, later, after


def _not_first(h: np.ndarray, check: np.ndarray, *place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are not the first of their hash and check, and which of these are in another place than the first."""
    later = np.concatenate([[False], (h[1:] == h[:-1]) & (check[1:] == check[:-1])]) if len(h) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(later, 0, np.arange(len(h))))
    moved = np.zeros(len(h), bool)
    for p in place:
        moved |= p != p[first]
    return later, moved


def _row(bucket: int, *columns: np.ndarray | None) -> pa.RecordBatch:
    return pa.record_batch([pa.array([bucket], pa.int32())] + [pa.array([None if c is None else c.tobytes()], pa.binary()) for c in columns], BLOB_COLUMNS)


def _blobs(chunk: Chunk, h: np.ndarray, check: np.ndarray | None, doc: np.ndarray, start: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """One row for each bucket of hashes: sorted by document, so that ids are stated once for each run."""
    bucket = (h % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((start, doc, bucket))
    h, check, doc, start, bucket = h[order], None if check is None else check[order], doc[order], start[order], bucket[order]
    ids = np.stack([np.array(chunk.ids, np.int64), np.array(chunk.tags, np.int64)], axis=1)
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        part = slice(edges[b], edges[b + 1])
        runs = np.flatnonzero(np.concatenate([[True], doc[part][1:] != doc[part][:-1]]))
        counts = np.diff(np.concatenate([runs, [edges[b + 1] - edges[b]]]))
        yield _row(b, h[part], None if check is None else check[part], ids[doc[part][runs]], counts.astype(np.uint32), start[part].astype(np.uint32))


def _marks(ids: np.ndarray, doc: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """One row for each document of the given (document, start) pairs; ids holds id and tag of a document."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order].astype(np.uint32)
    edges = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]])) if len(doc) else np.zeros(1, np.int64)
    own = ids[doc[edges[:-1]]] if len(doc) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(own[:, 0], pa.int64()), pa.array(own[:, 1], pa.int64()), pa.array([start[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())],
        ["_id", "_tag", "_flags"],
    )


def _by_document(ids: np.ndarray, doc: np.ndarray, start: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """One row for each bucket of documents, as in _blobs but without hashes."""
    mixed = (ids[:, 0].astype(np.uint64) * BASE) ^ ids[:, 1].astype(np.uint64)
    bucket = ((mixed >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)[doc]
    order = np.lexsort((doc, bucket))
    doc, start, bucket = doc[order], start[order], bucket[order]
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        part = slice(edges[b], edges[b + 1])
        runs = np.flatnonzero(np.concatenate([[True], doc[part][1:] != doc[part][:-1]]))
        counts = np.diff(np.concatenate([runs, [edges[b + 1] - edges[b]]]))
        yield _row(b, None, None, ids[doc[part][runs]], counts.astype(np.uint32), start[part].astype(np.uint32))


def _of_bucket(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, checks (zeros where there are none), documents, counts and starts of a bucket's rows."""
    read = lambda c, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(r[c], kind) for r in rows if r[c] is not None)])
    h, check = read("hashes", np.uint64), read("checks", np.uint64)
    return h, check if len(check) else np.zeros(len(h), np.uint64), read("docs", np.int64).reshape(-1, 2), read("counts", np.uint32), read("starts", np.uint32)


def _by_bucket(batches: Iterator[pa.RecordBatch], settled: Callable[[dict], bool]) -> Iterator[pa.RecordBatch | tuple]:
    """The arrays of each bucket of rows that come in the order of their bucket; rows that are settled pass as they are."""
    held: list[dict] = []
    for batch in batches:
        for k in range(len(batch)):
            one = batch.slice(k, 1)
            row = one.to_pylist()[0]
            if settled(row):
                yield one
                continue
            if held and held[0]["bucket"] != row["bucket"]:
                yield _of_bucket(held)
                held = []
            held.append(row)
    if held:
        yield _of_bucket(held)


@frugal
def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The marks of each document, from all rows of its bucket."""
    for _, _, ids, counts, starts in _by_bucket(batches, lambda row: False):
        distinct, index = np.unique(ids, axis=0, return_inverse=True)
        yield _marks(distinct, np.repeat(index.ravel(), counts), starts)


def _repeats(picked: DataFrame, mode: str, length: int, buckets: int) -> DataFrame:
    """Marks (document, starts) of the windows that occur more than once.

    ``picked``: columns _id, _tag, _text and _flags (binary: anchor starts as 32-bit numbers; ignored for anchors).
    ``mode`` "all" marks every occurrence of a repeated window, "later" all but the first in the order of
    id, tag and start; rows that tie with the first are no repeat. For "all" 64 bits tell windows, as one
    told too many costs time only; for "later" 128 bits do. Equal windows of a task's chunk are settled
    there, and one of them goes on. So the rows that meet for one window are at most one for each chunk,
    however often it occurs. ``buckets`` follow from the size of the text; tasks take them one after the
    other, sorted by Spark, so that a worker holds one bucket's hashes at a time.
    """
    cover, anchors = np.array(COVER), mode == "all"

    @frugal
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, chunk = WordHashes(), Chunk()

        def flush() -> Iterator[pa.RecordBatch]:
            if not chunk.ids:
                return
            h, check, doc, start, later, after = chunk.group(length, not anchors)
            told = later | np.concatenate([later[1:], [False]]) if anchors else after
            ids = np.stack([np.array(chunk.ids, np.int64), np.array(chunk.tags, np.int64)], axis=1)
            if told.any():
                yield from _by_document(ids, doc[told], start[told], buckets)
            yield from _blobs(chunk, h[~later], None if anchors else check[~later], doc[~later], start[~later], buckets)

        for batch in batches:
            for i in range(len(batch)):
                words = (batch.column(2)[i].as_py() or "").encode().split()
                if len(words) < WINDOW:
                    continue
                n = len(words) - length + 1
                if anchors:
                    at = (np.arange(0, n, PERIOD)[:, None] + cover).ravel()
                else:
                    flags = np.frombuffer(batch.column(3)[i].as_py(), np.uint32).astype(np.int64)
                    at = np.unique((flags[:, None] - np.arange(PERIOD)).ravel())
                chunk.add(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), at[(at >= 0) & (at < n)])
                if chunk.size >= CHUNK_WORDS:
                    yield from flush()
                    chunk = Chunk()
        yield from flush()

    @frugal
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _by_bucket(batches, lambda row: row["hashes"] is None):
            if isinstance(found, pa.RecordBatch):
                yield found
                continue
            h, check, ids, counts, start = found
            doc = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
            order = np.argsort(h, kind="stable") if anchors else np.lexsort((check, h))
            same = (h[order][1:] == h[order][:-1]) & (check[order][1:] == check[order][:-1])
            order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(h) else order
            if not anchors and len(order):
                o = order[np.lexsort((start[order], ids[doc[order], 1], ids[doc[order], 0], check[order], h[order]))]
                order = o[_not_first(h[o], check[o], ids[doc[o], 0], ids[doc[o], 1], start[o])[1]]
            yield from _by_document(ids, doc[order], start[order], buckets)

    partitions = int(picked.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartitionById(partitions, F.pmod("bucket", F.lit(partitions))).sortWithinPartitions("bucket")

    by_hash = dealt(picked.mapInArrow(spread, BLOBS))
    return dealt(by_hash.mapInArrow(settle, BLOBS)).mapInArrow(_assemble, MARKS)


#: Ids of up to this many documents are broadcast (16 bytes each); beyond, texts meet their marks by a shuffle of all.
BROADCAST_ROWS = 500_000


def remove_repeated_passages(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rejoin: bool = False,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Remove each word that a window of 20 words covers which also starts earlier in the corpus.

    Earlier is a smaller id, or an earlier start in the same document; words are runs of anything but
    ASCII blanks. Windows are judged on the input. Returns the columns of ``documents`` with the text
    that is left, and n_words and n_removed (longs; input columns of these names are replaced). A text
    that loses words becomes its other words joined by one space; others stay as they are, or are joined
    so too with ``rejoin``. A null text has no words and stays null (empty with ``rejoin``). Rows of equal
    id and text keep the same words; rows of equal id and unequal text are ordered by a hash of the text;
    a null id comes before all others. Texts shorter than a window keep everything.

    1. Anchors: hashes of 8 words at starts whose residue modulo 13 is in a difference cover. Equal windows
       of 20 words, wherever they start, share an aligned anchor. Anchor hashes shuffle, and repeats are told.
    2. Only windows around repeated anchors are extended to 20 words and hashed; these hashes shuffle, and
       all but the first occurrence are told.
    3. Documents meet their marks and drop the words that marked windows cover.
    Hashes shuffle as packed arrays, once for each chunk of documents; marks shuffle by document. Windows are
    told by 128 bits.
    """
    spark = documents.sparkSession
    scratch = scratch or Scratch(spark)
    size = documents.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), F.xxhash64(text_col)]
    texts = documents.select(key[0].alias("_id"), key[1].alias("_tag"), F.col(text_col).alias("_text"))

    def met(marks: DataFrame, docs: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame | None]:
        """Documents with their marks; apart from them those without, where the marked ids are few enough."""
        if marks.count() > BROADCAST_ROWS:
            return docs.join(marks.hint("shuffle_hash"), on, "left"), None
        ids = F.broadcast(marks.select(*on))
        return docs.join(ids, on, "left_semi").join(marks.hint("shuffle_hash"), on), docs.join(ids, on, "left_anti")

    flagged = scratch.table(_repeats(texts.withColumn("_flags", F.lit(None).cast("binary")), "all", WINDOW - PERIOD + 1, buckets))
    suspects = met(flagged, texts, ["_id", "_tag"])[0].where("_flags IS NOT NULL").select("_id", "_tag", "_text", "_flags")
    doomed = scratch.table(_repeats(suspects, "later", WINDOW, buckets))

    @F.arrow_udf("struct<text: string, words: bigint, removed: bigint>")
    def left(text_column: pa.Array, marks: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(text_column, marks, strict=True):
            text = text.as_py()
            words = (text or "").encode().split()
            if own.is_valid:
                at = np.frombuffer(own.as_py(), np.uint32).astype(np.int64)
                step = np.zeros(len(words) + 1, np.int64)
                np.add.at(step, at, 1)
                np.add.at(step, at + WINDOW, -1)
                stay = (np.cumsum(step)[:-1] == 0).tolist()
                kept = [w for w, s in zip(words, stay, strict=True) if s]
                out.append((b" ".join(kept).decode(), len(words), len(words) - len(kept)))
            else:
                out.append((b" ".join(words).decode() if rejoin else text, len(words), 0))
        columns = [list(c) for c in zip(*out, strict=True)] or [[], [], []]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["text", "words", "removed"])

    id_key, tag_key, marks, out = free_names(documents, "_id", "_tag", "_flags", "_out")
    doomed = doomed.withColumnsRenamed({"_id": id_key, "_tag": tag_key, "_flags": marks})
    marked, rest = met(doomed, documents.select("*", key[0].alias(id_key), key[1].alias(tag_key)), [id_key, tag_key])
    rows = marked if rest is None else marked.unionByName(rest.withColumn(marks, F.lit(None).cast("binary")))
    return (
        rows.withColumn(out, left(F.col(text_col), F.col(marks)))
        .withColumn(text_col, F.col(f"{out}.text"))
        .withColumn("n_words", F.col(f"{out}.words"))
        .withColumn("n_removed", F.col(f"{out}.removed"))
        .drop(id_key, tag_key, marks, out)
    )
