"""Reading tables, cutting Arrow batches into pieces, and hashes of words and spans over NumPy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch: batches carry whole texts, so few rows already make megabytes.
BATCH_ROWS = 256

#: Bytes of text that a step over NumPy arrays takes at a time (a longer text is a piece of its own).
PIECE_BYTES = 1 << 20

#: Characters that separate words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b" \t\n\x0b\x0c\r"

_ODD = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_texts(df: DataFrame) -> DataFrame:
    """The same rows, for Arrow functions: few rows per batch, as texts may be long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def drawn(df: DataFrame, draw: str, most: int) -> DataFrame:
    """About ``most`` rows, those with the least values of the hash ``draw``.

    The share of hashes that holds them follows from a count, so what the final sort meets is bounded at any size.
    """
    share = min(1.0, 1.2 * (most + 20) / max(1, df.count()))
    near = df.where(F.shiftrightunsigned(draw, 1) <= F.lit(min(int(share * 2**63), 2**63 - 1)))
    return near.orderBy(draw, *(c for c in df.columns if c != draw)).limit(most)


def heavy_keys(counted: DataFrame, held: str, least: int = 4096, most: int = 50_000) -> DataFrame:
    """The rows of ``counted`` (one per key) whose count ``held`` stands out, at most ``most`` of them.

    A key is heavy with ``least`` rows or more and at least a share of 1 / ``most`` of all rows, so there is a bound on how
    many there are whatever the data, and what is not heavy is small beside the whole.
    """
    total = counted.agg(F.sum(held)).first()[0] or 0
    return counted.where(F.col(held) >= max(least, -(-total // most)))


def pieces(batch: pa.RecordBatch, text: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``most`` bytes of text each, or of one row."""
    sizes = np.diff(_offsets(batch.column(text)))
    begin, held = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if row > begin and held + size > most:
            yield batch.slice(begin, row - begin)
            begin, held = row, 0
        held += size
    if batch.num_rows > begin:
        yield batch.slice(begin)


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[1], kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column behind each other, and the row limits in them; a null text is empty."""
    if column.null_count:
        column = column.fill_null("")
    limits = _offsets(column)
    data = column.buffers()[2] if len(column) else None
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[limits[0]:limits[-1]], limits - limits[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHash:
    """Polynomial hashes modulo 2^64 of any span of a sequence of 64-bit symbols, after one pass over it."""

    def __init__(self, base: int):
        self.base = np.uint64(base | 1)
        self.inverse = np.uint64(pow(base | 1, -1, 1 << 64))
        self._up = self._down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self._up) < n:
            size = max(n, 2 * len(self._up))
            for name, factor in (("_up", self.base), ("_down", self.inverse)):
                steps = np.full(size, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, symbols: np.ndarray) -> np.ndarray:
        self._powers(len(symbols) + 1)
        sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * self._up[:len(symbols)], out=sums[1:])
        return sums

    def spans(self, prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of symbols[begin:end] for each pair; equal spans anywhere have equal hashes."""
        return mix((prefix[end] - prefix[begin]) * self._down[begin] + (end - begin).astype(np.uint64) * _ODD)


BYTE_SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.isin(np.arange(256), list(SPACES))
FIRST, SECOND = SpanHash(0xD6E8FEB86659FD93), SpanHash(0xA0761D6478BD642F)


def word_spans(raw: np.ndarray, limits: np.ndarray, outside: np.ndarray = BLANK) -> tuple[np.ndarray, ...]:
    """Begin, end and row of every word; a word is a maximal run of bytes not ``outside``, within one row."""
    inside = ~outside[raw]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    cuts = limits[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    opens[cuts] |= inside[cuts]
    closes[cuts - 1] |= inside[cuts - 1]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return begin, end, np.searchsorted(limits, begin, side="right") - 1


def word_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, taken over pieces of the bytes that end between words."""
    out, at = np.empty(len(begin), np.uint64), 0
    while at < len(begin):
        to = max(at + 1, int(np.searchsorted(end, begin[at] + PIECE_BYTES, side="right")))
        first = begin[at]
        prefix = FIRST.prefix(BYTE_SYMBOLS[raw[first:end[to - 1]]])
        out[at:to] = FIRST.spans(prefix, begin[at:to] - first, end[at:to] - first)
        at = to
    return out
