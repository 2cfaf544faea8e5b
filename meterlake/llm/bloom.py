"""A mergeable pair of Bloom filters: hashes seen at least once, and hashes seen at least twice."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .workers import frugal

PROBES = 3
SEGMENT_BITS = 21
SEGMENT_SCHEMA = "segment int, once binary, twice binary"


def positions(hashes: np.ndarray, log2_bits: int) -> np.ndarray:
    """Bit positions of each hash, one row for each probe, by double hashing."""
    h = hashes.view(np.uint64) if hashes.dtype == np.int64 else hashes.astype(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    mask = np.uint64((1 << log2_bits) - 1)
    return np.stack([(h + np.uint64(i) * step) & mask for i in range(PROBES)])


def set_bits(bits: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bits, at >> np.uint64(3), np.left_shift(1, at & np.uint64(7)).astype(np.uint8))


def has_bits(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


class SeenTwice:
    """Both filters of one task. ``add`` takes the distinct hashes of any number of documents."""

    def __init__(self, log2_bits: int):
        self.log2_bits = log2_bits
        self.once = np.zeros(1 << (log2_bits - 3), np.uint8)
        self.twice = np.zeros(1 << (log2_bits - 3), np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        distinct, counts = np.unique(hashes, return_counts=True)
        at = positions(distinct, self.log2_bits)
        again = has_bits(self.once, at) | (counts > 1)
        set_bits(self.twice, at[:, again].ravel())
        set_bits(self.once, at.ravel())

    def segments(self) -> Iterator[pa.RecordBatch]:
        """The non-empty pieces of the filters, compressed; a mostly empty piece is small."""
        size = 1 << (min(SEGMENT_BITS, self.log2_bits) - 3)
        for k in range(len(self.once) // size):
            part = slice(k * size, (k + 1) * size)
            if self.once[part].any():
                yield pa.record_batch(
                    [pa.array([k], pa.int32())] + [pa.array([zlib.compress(x[part].tobytes(), 1)], pa.binary()) for x in (self.once, self.twice)],
                    ["segment", "once", "twice"],
                )


def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A hash that each side saw once has been seen twice: all its bits are in both ``once`` filters."""
    return a[0] | b[0], a[1] | b[1] | (a[0] & b[0])


def repeated_filter(hashes: DataFrame, log2_bits: int) -> np.ndarray:
    """The filter of hashes seen in two or more rows of ``hashes`` (one column, array<bigint> without repeats).

    Each task fills filters of a fixed size, tasks shuffle only compressed segments of these, and the
    driver receives the merged second filter, ``2**log2_bits / 8`` bytes at any input size.
    """

    @frugal
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = SeenTwice(log2_bits)
        for batch in batches:
            seen.add(batch.column(0).flatten().to_numpy(zero_copy_only=False))
        yield from seen.segments()

    @frugal
    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                own = tuple(np.frombuffer(zlib.decompress(row[c]), np.uint8) for c in ("once", "twice"))
                k = row["segment"]
                total[k] = merge(total[k], own) if k in total else own
        for k, (_, twice) in total.items():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())], ["segment", "twice"])

    merged = hashes.mapInArrow(fill, SEGMENT_SCHEMA).repartition("segment").mapInArrow(combine, "segment int, twice binary")
    bits = np.zeros(1 << (log2_bits - 3), np.uint8)
    size = 1 << (min(SEGMENT_BITS, log2_bits) - 3)
    for row in merged.toLocalIterator():
        bits[row["segment"] * size : (row["segment"] + 1) * size] = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
    return bits
