"""A count-min sketch that partitions build and Spark merges, kept as one bit per counter once it is thresholded."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from colsight.llm.common import mix

#: Counters of one row of the sketch, as a power of two, and rows. The thresholded sketch is what a broadcast holds:
#: one bit for each counter, 16 MB here, whatever the data. A sketch too small for them only passes more keys on.
WIDTH_BITS, DEPTH = 26, 2

CHUNK_BITS = 16

#: Keys a task gathers before it hands on a partial sketch.
FLUSH = 1 << 20

SCHEMA = T.StructType([T.StructField("chunk", T.IntegerType()), T.StructField("cells", T.BinaryType())])
_SALTS = mix(np.arange(11, 11 + DEPTH, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def cells(keys: np.ndarray, width_bits: int) -> np.ndarray:
    """The counter of each key in each row of the sketch, rows behind each other."""
    shift, rows = np.uint64(64 - width_bits), np.arange(DEPTH, dtype=np.uint64) << np.uint64(width_bits)
    return (mix(keys[None, :] ^ _SALTS[:, None]) >> shift) + rows[:, None]


def partial_sketches(
    keys: Iterable[np.ndarray], width_bits: int = WIDTH_BITS, least: int = 2
) -> Iterator[pa.RecordBatch]:
    """Sketches of a partition: by chunk of counters, the counters in use, each as often as it was hit up to ``least``."""
    held, size = [], 0
    for part in keys:
        held.append(part)
        size += len(part)
        if size >= FLUSH:
            yield _packed(np.concatenate(held), width_bits, least)
            held, size = [], 0
    if size:
        yield _packed(np.concatenate(held), width_bits, least)


def _packed(keys: np.ndarray, width_bits: int, least: int) -> pa.RecordBatch:
    hit, count = np.unique(cells(keys, width_bits), return_counts=True)
    hit = np.repeat(hit, np.minimum(count, least))
    chunk = (hit >> np.uint64(CHUNK_BITS)).astype(np.int32)
    names, first = np.unique(chunk, return_index=True)
    low = (hit & np.uint64((1 << CHUNK_BITS) - 1)).astype("<u2")
    parts = [x.tobytes() for x in np.split(low, first[1:])]
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(parts, pa.binary())], names=SCHEMA.names)


def merged(partial: DataFrame, least: int = 2, width_bits: int = WIDTH_BITS) -> np.ndarray:
    """The bits of all counters that reached ``least``, from the partial sketches of all partitions.

    Each chunk is summed by one task as a stream of its parts; what comes to the driver is one bit per counter.
    """
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = None, None
        for batch in batches:
            for name, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if name != now:
                    if now is not None:
                        yield _bits(now, counts, least)
                    now, counts = name, np.zeros(1 << CHUNK_BITS, np.int64)
                counts += np.bincount(np.frombuffer(part.as_buffer(), "<u2"), minlength=1 << CHUNK_BITS)
        if now is not None:
            yield _bits(now, counts, least)

    bits = np.zeros((DEPTH << width_bits) >> 3, np.uint8)
    size = 1 << (CHUNK_BITS - 3)
    dealt = partial.repartition("chunk").sortWithinPartitions("chunk")
    for row in dealt.mapInArrow(add, SCHEMA).toLocalIterator():
        bits[row.chunk * size:(row.chunk + 1) * size] = np.frombuffer(row.cells, np.uint8)
    return bits


def _bits(chunk: int, counts: np.ndarray, least: int) -> pa.RecordBatch:
    packed = np.packbits(counts >= least, bitorder="little").tobytes()
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([packed], pa.binary())], names=SCHEMA.names)


def passed(bits: np.ndarray, keys: np.ndarray, width_bits: int = WIDTH_BITS) -> np.ndarray:
    """Whether all counters of a key are set: never false for a key that was counted often enough."""
    at = cells(keys, width_bits)
    return ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)
