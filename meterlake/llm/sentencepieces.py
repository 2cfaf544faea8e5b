"""SentencePiece encoding by suffix-array matching, and decoding."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .names import free_names

SPACE = "▁"
SEPARATOR = 1
#: A run of spaces and what follows it: no piece has a space after another character.
CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
STRETCH = 1 << 20
LOOK_AHEAD = 1024
LONG = 64
CALL_CHARS = 1 << 17
CACHE_BYTES = 160 << 20
UNKNOWN = "�".encode()


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """The order of all suffixes by their first ``depth`` codes at least, by prefix doubling."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
    done = 1
    while True:
        after = np.zeros_like(rank)
        after[: len(rank) - done if done < len(rank) else 0] = rank[done:]
        pair = rank * (int(rank.max(initial=0)) + 1) + after
        order = np.argsort(pair)
        done *= 2
        if done >= depth:
            return order
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(np.concatenate([[1], pair[order][1:] != pair[order][:-1]]))


def _twos(codes: np.ndarray) -> np.ndarray:
    """Each two neighbouring codes as one number."""
    return (codes[:-1].astype(np.uint64) << np.uint64(32)) | codes[1:]


class Pieces:
    """The vocabulary of a model of the byte-pair kind with byte fallback, read from its file's bytes."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        self.byte_ids, self.bytes_of, names, ids = {}, [], [], []
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:-1], 16)] = i.to_bytes(4, "little")
                self.bytes_of.append(bytes([int(piece[3:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
                names.append(piece)
                ids.append(i)
        self.bigrams = {p[k : k + 2] for p in names for k in range(len(p) - 1)}
        self.longest = max(map(len, names))
        self.names = np.array(names, f"<U{self.longest}")
        self.upper = np.array([p + "\U0010ffff" * (self.longest - len(p)) for p in names], f"<U{self.longest}")
        self.first_two = np.array([int(_twos(np.frombuffer(p[:2].encode("utf-32-le"), np.uint32))[0]) if len(p) > 1 else 0 for p in names], np.uint64)
        self.lengths = np.array([len(p) for p in names], np.int64)
        self.ids = np.array(ids, "<u4")
        self.id_bytes = [i.to_bytes(4, "little") for i in ids]
        self.scores = np.array([sp.get_score(i) for i in ids])

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and piece of all occurrences, by start: each piece is a range of the suffix array.

        Pieces whose first two characters nowhere stand together aren't searched.
        """
        order = suffix_array(codes, self.longest)
        padded = np.concatenate([codes, np.zeros(self.longest, np.uint32)])
        prefixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, self.longest)[order]).view(f"<U{self.longest}").ravel()
        tried = np.flatnonzero((self.lengths == 1) | np.isin(self.first_two, np.unique(_twos(codes))))
        low, high = np.searchsorted(prefixes, self.names[tried], "left"), np.searchsorted(prefixes, self.upper[tried], "right")
        count = high - low
        piece = np.repeat(tried, count)
        start = order[np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())]
        by = np.argsort(start)
        return start[by], piece[by]

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk as little-endian 32-bit numbers, all chunks at once.

        In a model of this kind the encoding isn't the cheapest path over the edges. They are relaxed in the
        order that such models state: in each chunk the best edge that joins two symbols does so, the
        leftmost of equals, until none is left; for short chunks all at once, for a long one from a heap.
        """
        if not chunks:
            return []
        text = chr(SEPARATOR).join(chunks) + chr(SEPARATOR)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(codes)
        at, piece = self.edges(codes)
        known = np.full((n + 1, self.longest + 1), -1, np.int32)
        known[at, self.lengths[piece]] = piece
        lengths = np.array([len(c) for c in chunks], np.int64)
        starts = np.cumsum(lengths + 1) - lengths - 1
        end = np.arange(1, n + 2)  # of the symbol that starts here
        alive = np.ones(n + 1, bool)  # whether a symbol starts here
        short = lengths <= LONG
        self._relax_together(known, end, alive, starts[short], lengths[short])
        for a, length in zip(starts[~short].tolist(), lengths[~short].tolist(), strict=True):
            self._relax_one(known, end, alive, a, a + length)
        alive[starts + lengths] = alive[n] = False
        symbols = np.flatnonzero(alive)
        found = known[symbols, end[symbols] - symbols]
        buffer = self.ids[found].tobytes()
        cuts = np.searchsorted(symbols, starts).tolist() + [len(symbols)]
        out = [buffer[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:], strict=False)]
        for k in np.unique(np.searchsorted(starts, symbols[found < 0], "right") - 1).tolist():
            own = zip(symbols[cuts[k] : cuts[k + 1]].tolist(), found[cuts[k] : cuts[k + 1]].tolist(), strict=True)
            out[k] = b"".join([self.id_bytes[f] if f >= 0 else self.bytes_of_character(text[a]) for a, f in own])
        return out

    def bytes_of_character(self, c: str) -> bytes:
        return b"".join([self.byte_ids[x] for x in c.encode("utf-8", "surrogatepass")])

    def _relax_together(self, known: np.ndarray, end: np.ndarray, alive: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        """Join symbols of many short chunks, one in each chunk a round."""
        n = len(end) - 1
        back = np.arange(-1, n)  # start of the symbol before
        scores = np.append(self.scores, -np.inf)

        def joined(p: np.ndarray) -> np.ndarray:
            """The score of joining the symbol at p with the next one."""
            stop = end[np.minimum(end[p], n)]
            length = stop - p
            fits = (length <= self.longest) & (stop <= n)
            return np.where(fits, scores[known[p, np.where(fits, length, 0)]], -np.inf)

        score = np.append(joined(np.arange(n)), -np.inf)
        active = np.arange(len(starts))
        while len(active):
            own = lengths[active]
            first = np.cumsum(own) - own
            where = np.repeat(starts[active] - first, own) + np.arange(own.sum())
            best = np.maximum.reduceat(score[where], first)
            hit = np.flatnonzero(score[where] == np.repeat(best, own))
            owner = np.searchsorted(first, hit, "right") - 1
            _, once = np.unique(owner, return_index=True)
            go = best > -np.inf
            p = where[hit[once]][go]
            active = active[go]
            gone = end[p]
            alive[gone] = False
            end[p] = end[gone]
            back[np.minimum(end[p], n)] = p
            score[gone] = -np.inf
            score[p] = joined(p)
            left = back[p]
            fine = left >= 0
            score[left[fine]] = joined(left[fine])

    def _relax_one(self, known: np.ndarray, end: np.ndarray, alive: np.ndarray, a: int, b: int) -> None:
        """Join symbols of one chunk, the best edge first, in time n log n."""
        stop, back = list(range(1, b - a + 1)), list(range(-1, b - a - 1))
        there, own, scores, longest = bytearray(b"\x01") * (b - a), known[a:b], self.scores, self.longest

        def edge(p: int) -> tuple[float, int, int] | None:
            if p < 0 or stop[p] >= len(stop):
                return None
            length = stop[stop[p]] - p
            k = own[p, length] if length <= longest else -1
            return (-scores[k], p, p + length) if k >= 0 else None

        heap = [e for e in map(edge, range(b - a)) if e]
        heapify(heap)
        while heap:
            _, p, to = heappop(heap)
            q = stop[p]
            if not there[p] or q >= len(stop) or stop[q] != to or q == to:
                continue
            there[q] = 0
            stop[p] = to
            if to < len(stop):
                back[to] = p
            for e in (edge(p), edge(back[p])):
                if e:
                    heappush(heap, e)
        end[a:b] = np.array(stop) + a
        alive[a:b] = np.frombuffer(there, bool)

    def decode(self, ids: Iterable[int | None]) -> str:
        """The text of ids; one that is null or outside of the vocabulary gives U+FFFD."""
        size, bytes_of = len(self.bytes_of), self.bytes_of
        text = b"".join([bytes_of[i] if i is not None and 0 <= i < size else UNKNOWN for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class ChunkPieces(dict):
    """Ids of chunks, kept for the next time, in about ``limit`` bytes.

    A chunk is cut where no piece reaches across: a short one before its last character only, so that a
    word needs one entry with and without a stop after it; a long one at all such places, and what is left
    of it is not kept as a whole.
    """

    def __init__(self, pieces: Pieces, limit: int = CACHE_BYTES):
        super().__init__()
        self.pieces, self.limit, self.used = pieces, limit, 0

    def cut(self, chunk: str) -> list[str]:
        bigrams = self.pieces.bigrams
        if len(chunk) <= LONG:
            return [chunk[:-1], chunk[-1]] if len(chunk) > 1 and chunk[-2:] not in bigrams else [chunk]
        at = [0, *(i for i in range(1, len(chunk)) if chunk[i - 1 : i + 1] not in bigrams), len(chunk)]
        return [chunk[a:b] for a, b in zip(at, at[1:], strict=False)]

    def __missing__(self, chunk: str) -> bytes:
        parts = self.cut(chunk)
        return b"".join(map(self.__getitem__, parts)) if len(parts) > 1 else self.pieces.encode_chunks(parts)[0]

    def keep(self, chunk: str, ids: bytes) -> None:
        self[chunk] = ids
        self.used += 240 + 2 * len(chunk) + len(ids)

    def learn(self, chunks: set[str]) -> None:
        if self.used > self.limit:
            first = list(islice(self.items(), len(self) // 4))  # what a task meets first is what it meets most
            self.clear()
            self.used = 0
            for chunk, ids in first:
                self.keep(chunk, ids)
        new = [(c, self.cut(c)) for c in chunks if c not in self]
        alone = list({p for _, parts in new for p in parts if p not in self and len(p) < CALL_CHARS})
        call, size = [], 0
        for k, part in enumerate(alone):
            call.append(part)
            size += len(part) + 1
            if size >= CALL_CHARS or k == len(alone) - 1:
                for c, ids in zip(call, self.pieces.encode_chunks(call), strict=True):
                    self.keep(c, ids)
                call, size = [], 0
        for c, parts in new:
            if len(parts) > 1 and len(c) <= LONG:
                self.keep(c, self[parts[0]] + self[parts[1]])


def chunks_of(text: str) -> Iterator[list[str]]:
    """The chunks of a text with its leading space, by stretches of about a million characters."""
    text = SPACE + text.replace(" ", SPACE)
    at = 0
    while at < len(text):
        end = at + STRETCH
        while end < len(text) and (text[end] != SPACE or text[end - 1] == SPACE):
            end += 1
        yield CHUNK.findall(text[at:end])
        at = end


def ahead(texts: Iterable[str], rows: int = LOOK_AHEAD) -> Iterator[list[str]]:
    """Texts in groups of at most ``rows`` and about STRETCH characters."""
    group, size = [], 0
    for text in texts:
        if group and (len(group) == rows or size + len(text) > STRETCH):
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def encoded(known: ChunkPieces, texts: Iterable[str]) -> Iterator[np.ndarray]:
    """Ids of each text; an empty text has none."""
    for group in ahead(texts):
        split = [list(chunks_of(t)) if 0 < len(t) < STRETCH else [] for t in group]
        known.learn({c for own in split for part in own for c in part})
        for text, own in zip(group, split, strict=True):
            parts = []
            for chunks in own or (chunks_of(text) if text else ()):
                if not own:
                    known.learn(set(chunks))
                parts.append(b"".join(map(known.__getitem__, chunks)))
            yield np.frombuffer(b"".join(parts), "<u4").astype(np.int32)


_LOADED: dict[int, ChunkPieces] = {}


def _known(model: Broadcast) -> ChunkPieces:
    """Read once in each worker, which keeps what it learned for its later tasks."""
    if hash(model.value) not in _LOADED:
        _LOADED.clear()
        _LOADED[hash(model.value)] = ChunkPieces(Pieces(model.value))
    return _LOADED[hash(model.value)]


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


CODED = pa.struct([("ids", pa.list_(pa.int32())), ("ids_crc32", pa.int64()), ("decoded", pa.string())])


def with_pieces(documents: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """Add ids (array<int>), ids_crc32 (of these as unsigned little-endian 32-bit numbers) and decoded, the text
    that the ids give.

    The ids are those that the model's own library gives: a space stands before the text, characters
    without a piece become their bytes' ids, strings of control pieces are ordinary text. An empty text
    has no ids, a null one null in all three columns. Input columns of the three names are replaced, others
    pass through without going to Python; repeated rows give the same; an empty table gives no rows.

    One Python worker for each task reads texts, encodes and decodes. What it learns of chunks it keeps, in
    about CACHE_BYTES. Texts of any length are taken in stretches of about a million
    characters; only a run in which every two neighbours stand together in some piece is encoded at once,
    at about 150 bytes for each character. The model file is read by the driver and broadcast (500 kB).
    """
    model = documents.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())

    @F.arrow_udf("struct<ids: array<int>, ids_crc32: bigint, decoded: string>")
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _known(model)
        for texts in batches:
            ids, sums, decoded, at = [], [], [], 0
            for own in encoded(known, (t.as_py() or "" for t in texts)):
                there = texts[at].is_valid
                at += 1
                ids.append(own)
                sums.append(crc32_of(own) if there else None)
                decoded.append(known.pieces.decode(own.tolist()) if there else None)
            offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            mask = texts.is_null() if texts.null_count else None
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])), mask=mask)
            yield pa.StructArray.from_arrays([lists, pa.array(sums, pa.int64()), pa.array(decoded, pa.string())], fields=list(CODED))

    (out,) = free_names(documents, "_out")
    told = documents.withColumn(out, code.asNondeterministic()(F.col(text_col)))  # else each column of it would be encoded anew
    return told.withColumns({c.name: F.col(f"{out}.{c.name}") for c in CODED}).drop(out)


def decoder(spark: SparkSession, model_path: str):
    """A function on columns: ids (array<int>) to text. Bytes that aren't UTF-8 become U+FFFD, and so do ids that
    are null or outside of the vocabulary; a null list gives null, one without ids an empty text."""
    model = spark.sparkContext.broadcast(Path(model_path).read_bytes())

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        pieces = _known(model).pieces
        return pa.array([pieces.decode(x.as_py()) if x.is_valid else None for x in ids], pa.string())

    return decode
