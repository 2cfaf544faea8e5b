"""Documents cut into pieces and packed into sequences of a fixed number of tokens."""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sentencepieces import ahead
from .workers import frugal

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
STRETCH = 1 << 20
LOOK_AHEAD = 256
CACHE_BYTES = 64 << 20
#: How the tokenizers split texts that ChunkIds was made for.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Marks that end a chunk, and what isn't Latin.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
NOT_LATIN = re.compile("[^\0-\u024f]")


class ChunkIds(dict):
    """Ids of each blank-separated chunk of text, as little-endian bytes, kept for the next time.

    The pre-tokenizer of these files splits at white space, which it drops, and between letters and other
    characters; so chunks tokenize alone as they do in the text, and a word with marks at its end as both
    one after the other. Many words tokenize in one call, as a token of the vocabulary tells where a word
    ends. About ``limit`` bytes are kept; chunks of over 64 characters are not. Texts of a tokenizer that
    splits otherwise are tokenized whole.
    """

    def __init__(self, tokenizer_json: str, limit: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.limit, self.used = limit, 0
        told = json.loads(tokenizer_json)
        kinds = [n.get("type") for n in (told.get("normalizer") or {}).get("normalizers", [])]
        split = ((told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.by_chunk = kinds == ["NFC", "Replace", "Lowercase"] and split.get("pattern", {}).get("Regex") == SPLIT and split.get("behavior") == "Removed"
        if not self.by_chunk:
            return
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.added = [t["content"].lower() for t in told.get("added_tokens") or []]

    def ids(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def __missing__(self, chunk: str) -> bytes:
        return self.ids([chunk])[0]

    def folded(self, text: str) -> str:
        """The text in lower case, as the normalizer has it, so that it has fewer different chunks.

        As it is where that could tell: outside of Latin letters, whose lower case hangs on no neighbour,
        and beside added tokens, which are found before the normalizer's turn."""
        low = text.lower()
        plain = text.isascii() or not NOT_LATIN.search(text)
        return low if plain and not any(token in low for token in self.added) else text

    def keep(self, chunks: Iterable[tuple[str, bytes]]) -> None:
        for chunk, ids in chunks:
            self[chunk] = ids
            self.used += 180 + len(chunk) + len(ids)

    def learn(self, chunks: set[str]) -> None:
        if self.used > self.limit:
            first = list(islice(self.items(), len(self) // 4))  # what a task meets first is what it meets most
            self.clear()
            self.used = 0
            self.keep(first)
        marked, words, other = [], set(), set()
        for chunk in [c for c in chunks if c not in self and len(c) <= 64]:
            word = chunk.rstrip(MARKS)
            if not word.isalpha() or not (word.isascii() or max(word) < "\u0250"):
                other.add(chunk)
                continue
            words.add(word)
            if len(word) < len(chunk):
                marked.append(chunk)
                other.add(chunk[len(word) :])
        words, other = ([c for c in found if c not in self] for found in (words, other))
        if words:
            ids = np.frombuffer(self.ids([" ".join(words)])[0], "<u4")
            cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            buffer = ids.tobytes()
            parts = [buffer[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] if len(cuts) == len(words) + 1 else self.ids(words)
            self.keep(zip(words, parts, strict=True))
        self.keep(zip(other, self.ids(other), strict=True))
        ends = [len(c.rstrip(MARKS)) for c in marked]
        self.keep((c, self[c[:n]] + self[c[n:]]) for c, n in zip(marked, ends, strict=True))


_LOADED: dict[int, ChunkIds] = {}


def _known(tokenizer: Broadcast) -> ChunkIds:
    """Read once in each worker. Each task learns anew: many tasks' words would crowd each other out."""
    if hash(tokenizer.value) not in _LOADED:
        _LOADED.clear()
        _LOADED[hash(tokenizer.value)] = ChunkIds(tokenizer.value)
    known = _LOADED[hash(tokenizer.value)]
    _forget(known)
    return known


def _forget(known: ChunkIds) -> None:
    known.clear()
    known.used = 0


def stretches(text: str) -> Iterator[list[str]]:
    """The chunks of a text, by stretches of about a million characters."""
    text = text.replace("\n", " ")
    at = 0
    while at < len(text):
        end = text.find(" ", at + STRETCH) if at + STRETCH < len(text) else -1
        end = len(text) if end < 0 else end
        yield text[at:end].split(" ")
        at = end


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. Lengths are in decreasing order and at most ``capacity``.

    A tournament tree holds the largest free capacity below each node; the first bin that fits is found
    by going left wherever the left winner is large enough.
    """
    leaves = 1 << max(0, (len(lengths) - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, need in enumerate(lengths.tolist()):
        i = 1
        while i < leaves:
            i *= 2
            if tree[i] < need:
                i += 1
        bins[k], offsets[k] = i - leaves, capacity - tree[i]
        tree[i] -= need
        while i > 1:
            i //= 2
            best = max(tree[2 * i], tree[2 * i + 1])
            if tree[i] == best:
                break
            tree[i] = best
    return bins, offsets


def pack(
    documents: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 1,
    docs_per_group: int = 2048,
) -> DataFrame:
    """Tokenize, cut at multiples of ``capacity`` and pack the pieces by first-fit decreasing.

    Returns one row for each piece: doc_id, start, length, ids_crc32 (of its ids as little-endian unsigned
    32-bit numbers), doc_tokens, sequence_id and offset. A document's ids are those of its text and
    ``end_id``, so a null or empty text is one piece of one id. Pieces of full length are a sequence of
    their own; the rest of each document is packed within a group. Groups are random but repeatable, by
    a hash of the id, about ``docs_per_group`` documents each, so that a task's memory does not grow with
    the input. Equal lengths are ordered by doc_id. Repeated rows are packed each; rows with a null id are
    packed with a null doc_id, spread over the groups by where they were read. Other columns are not read; an empty table gives no rows.

    Only spans and check sums shuffle, not ids. The tokenizer file is read once, by the driver.
    """
    spark = documents.sparkSession
    tokenizer = spark.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))

    @frugal
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(tokenizer)
        last = np.array([end_id], "<u4").tobytes()
        task, nameless = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            docs = iter(batch.column(0).to_pylist())
            for texts in ahead((t.as_py() or "" for t in batch.column(1)), LOOK_AHEAD):
                texts = [known.folded(t) for t in texts] if known.by_chunk else texts
                split = [list(stretches(t)) if known.by_chunk and len(t) < STRETCH else [] for t in texts]
                if known.by_chunk:
                    known.learn(set().union(*(chunks for own in split for chunks in own)))
                for doc, text, own in zip(islice(docs, len(texts)), texts, split, strict=True):
                    parts = []
                    for chunks in own or (stretches(text) if known.by_chunk else [[text]]):
                        if not own and known.by_chunk:
                            known.learn(set(chunks))
                        parts.append(b"".join(map(known.__getitem__, chunks)))
                    parts.append(last)
                    nameless += doc is None
                    salt = task << 32 | nameless // 256 if doc is None else 0
                    ids = b"".join(parts)
                    total = len(ids) // 4
                    out += [(doc, s, min(capacity, total - s), zlib.crc32(ids[4 * s : 4 * (s + capacity)]), total, salt) for s in range(0, total, capacity)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 6,
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_salt"],
            )
        _forget(known)  # an idle worker holds no words

    def fill(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(pieces["length"].to_numpy(), capacity)
        pieces["sequence_id"], pieces["offset"] = (int(key[0]) << 32) + bins, offsets
        return pieces.drop(columns=["_group", "_salt"])

    groups = max(1, math.ceil(documents.count() / docs_per_group))
    pieces = documents.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(cut, f"{PIECES}, _salt long")
    grouped = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "_salt"), F.lit(groups)))
    return grouped.groupBy("_group").applyInPandas(fill, f"{PIECES}, sequence_id long, offset long")
