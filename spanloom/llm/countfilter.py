"""Counting Bloom filters of hashes, made by all tasks and merged segment by segment.

Counters stop at two. A hash belongs to one segment and raises the same counters there
wherever it occurs, so pieces of tasks add up. The filter is broadcast with one bit a
counter; it has 16 counters a row up to a bound of bytes, and beyond that bound it
lets more through, never less.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Counters of one segment, as a power of two, and the counters of a hash.
SEGMENT, PROBES = 18, 4
COUNTERS_A_ROW = 16


def places(hashes: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment of each hash, and its different counters there, one row a hash."""
    h = hashes.view(np.uint64)
    of = ((h >> np.uint64(32)) % np.uint64(segments)).astype(np.int64)
    step = (h >> np.uint64(SEGMENT)) | np.uint64(1)          # odd, so counters differ
    at = h[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)
    return of, (at & np.uint64((1 << SEGMENT) - 1)).astype(np.int64)


def _pieces(segments: int):
    """(segment, once, twice): counters that a batch of hashes raises to one, and beyond."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, at = places(batch.column(0).to_numpy(zero_copy_only=False), segments)
            place, n = np.unique(of[:, None] << SEGMENT | at, return_counts=True)
            own, first = np.unique(place >> SEGMENT, return_index=True)
            low = (place & (1 << SEGMENT) - 1).astype(np.uint32)
            ends = [*first[1:], len(place)]
            cut = [(low[a:b], n[a:b] > 1) for a, b in zip(first, ends)]
            yield pa.RecordBatch.from_arrays([
                pa.array(own, pa.int64()), pa.array([x[~t].tobytes() for x, t in cut], pa.binary()),
                pa.array([x[t].tobytes() for x, t in cut], pa.binary())], ["segment", "once", "twice"])
    return run


def _merged(least: int):
    """(segment, bits): the counters of ``least`` or more; all pieces of a segment are in one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for seg, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
                counters = held.setdefault(seg, np.zeros(1 << SEGMENT, np.uint8))
                for raw, more in ((once, 1), (twice, 2)):
                    at = np.frombuffer(raw, np.uint32)
                    counters[at] = np.minimum(counters[at] + more, 2)
        for seg, counters in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([seg], pa.int64()), pa.array(
                [np.packbits(counters >= least, bitorder="little").tobytes()], pa.binary())],
                ["segment", "bits"])
    return run


def filter_bits(hashes: DataFrame, least: int, max_bytes: int = 1 << 26) -> np.ndarray:
    """Bits (segment, byte) of the counters that ``least`` rows of ``hashes`` raised, 1 or 2.

    ``hashes`` has one column of longs without nulls. ``max_bytes`` at most come to the driver.
    """
    size = 1 << SEGMENT
    rows = hashes.count()
    segments = min(max(1, -(-rows * COUNTERS_A_ROW // size)), max(1, max_bytes * 8 // size))
    merged = hashes.mapInArrow(_pieces(segments), "segment long, once binary, twice binary") \
        .repartition("segment").mapInArrow(_merged(least), "segment long, bits binary")
    bits = np.zeros((segments, size // 8), np.uint8)
    for row in merged.toLocalIterator():
        bits[row["segment"]] = np.frombuffer(row["bits"], np.uint8)
    return bits


def hits(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether all counters of a hash are set; False is certain."""
    of, at = places(hashes, len(bits))
    return (bits[of[:, None], at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1)
