"""Bucket counts over a whole corpus as bitmaps of a fixed size.

A task counts into BUCKETS small counters, up to LIMIT each, and sends those that are not 0 by ranges of buckets. The
counters of a range are added as they stream by, and turned into bits. A bitmap has BUCKETS bits (8 MB), whatever the
corpus, which bounds what the driver holds and broadcasts. Bits only let something through: a bucket that several values
share can pass one too many, and never loses one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

BUCKETS = 1 << 26
RANGE = 1 << 16
LIMIT = 100
_SHIFT = np.uint64(64 - 26)
_CODEC = pa.Codec("zstd", compression_level=1)


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _SHIFT).astype(np.int64)


def unpacked(counters: bytes) -> np.ndarray:
    return np.frombuffer(_CODEC.decompress(counters, RANGE, asbytes=True), np.uint8)


class Counters:
    """The counters of one task."""

    def __init__(self) -> None:
        self.table = np.zeros(BUCKETS, np.uint8)

    def add(self, buckets: np.ndarray, counts: np.ndarray) -> None:
        """Counts of buckets, which may repeat."""
        order = np.argsort(buckets, kind="stable")
        buckets, counts = buckets[order], np.minimum(counts[order], LIMIT)
        first = np.flatnonzero(np.diff(buckets, prepend=-1))
        if len(first):
            total = np.minimum(np.add.reduceat(counts, first), LIMIT)
            self.table[buckets[first]] = np.minimum(self.table[buckets[first]] + total, LIMIT)

    def rows(self) -> Iterator[tuple[int, bytes]]:
        """(range, packed counters) of the ranges that are not empty."""
        for k, part in enumerate(self.table.reshape(-1, RANGE)):
            if part.any():
                yield k, _CODEC.compress(part.tobytes(), asbytes=True)


def bitmap(counters: DataFrame, least: int, tasks: int) -> Broadcast:
    """Of rows (range int, packed binary): the buckets whose counts sum to ``least`` (at most LIMIT) or more."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = -1, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"range": pa.array([at], pa.int32()), "bits": pa.array([np.packbits(total >= least).tobytes()], pa.binary())})

        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if k != at:
                    if total is not None:
                        yield done()
                    at, total = k, np.zeros(RANGE, np.uint8)
                total = np.minimum(total + unpacked(packed.as_py()), LIMIT)
        if total is not None:
            yield done()

    ordered = counters.select("range", "packed").repartition(tasks, "range").sortWithinPartitions("range")
    bits = np.zeros((BUCKETS // RANGE, RANGE // 8), np.uint8)
    for row in ordered.mapInArrow(fold, "range int, bits binary").collect():  # BUCKETS bits in all, by one job
        bits[row.range] = np.frombuffer(row.bits, np.uint8)
    return counters.sparkSession.sparkContext.broadcast(bits.ravel())


def within(bits: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Whether the bitmap has these buckets."""
    return (bits[buckets >> 3] >> (7 - (buckets & 7)).astype(np.uint8)) & 1 == 1
