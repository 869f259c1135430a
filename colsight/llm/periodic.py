"""Stretches of texts that repeat with a period: every run of words, found on a run-length grammar.

For each period, positions on a grid as wide as a run of that period must cover are compared with the word a period later;
where they agree, longest common extensions to both sides on the grammar give the whole stretch. The grids of all periods
together have about n log n points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsight.llm.common import pieces, whole_texts
from colsight.llm.recompression import Grammar

#: A run has at least this many words, and two periods.
LEAST_WORDS = 12

#: Grid points that are looked at together.
STEP = 1 << 19

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def _grids(lengths: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sequence, position and period of the points of all grids, some at a time.

    A run of period p and of max(least, 2 p) words has so many positions less p whose word returns a period later, in a
    row; a grid of that width meets one of them.
    """
    most = np.where(lengths >= least, lengths // 2, 0)
    ends = np.cumsum(most)
    at, pairs = 0, int(ends[-1]) if len(ends) else 0
    while at < pairs:
        # Periods of up to a quarter of the points at a time, then as many of them as the points allow.
        to = min(pairs, at + STEP // 4)
        number = np.arange(at, to)
        sequence = np.searchsorted(ends, number, side="right")
        period = number - (ends - most)[sequence] + 1
        width = np.maximum(period, least - period)
        points = -(-(lengths[sequence] - period) // width)
        sums = np.cumsum(points)
        use = max(1, int(np.searchsorted(sums, STEP, side="right")))
        sequence, period, width, points = (a[:use] for a in (sequence, period, width, points))
        first = np.cumsum(points) - points
        place = (np.arange(int(points.sum())) - np.repeat(first, points)) * np.repeat(width, points)
        yield np.repeat(sequence, points), place, np.repeat(period, points)
        at += use


def find_runs(numbers: np.ndarray, lengths: np.ndarray, least: int = LEAST_WORDS) -> np.ndarray:
    """Rows (sequence, start, length, period) of all runs, in that order but for the length.

    A run is a stretch of at least ``least`` symbols and two of its smallest periods that cannot be extended.
    """
    out = np.zeros((0, 4), np.int64)
    if not (lengths >= least).any():
        return out
    grammar = Grammar(numbers, lengths)
    symbols = grammar.levels[0].symbols
    for sequence, place, period in _grids(lengths, least):
        x = grammar.begins[sequence] + place
        same = np.flatnonzero(symbols[x] == symbols[x + period])
        x, period, sequence = x[same], period[same], sequence[same]
        before, after = grammar.backward(x, x + period), grammar.forward(x, x + period)
        length = before + after + period
        long = length >= np.maximum(least, 2 * period)
        start = (x - before - grammar.begins[sequence])[long]
        found = np.stack([sequence[long], start, length[long], period[long]], axis=1)
        # A stretch is met from many points and under the multiples of its period; the smallest one is its period.
        out = np.concatenate([out, found])
        out = out[np.lexsort((out[:, 3], out[:, 2], out[:, 1], out[:, 0]))]
        new = np.ones(len(out), bool)
        new[1:] = (out[1:, :3] != out[:-1, :3]).any(axis=1)
        out = out[new]
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _kept(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds behind its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if g == 0])


def collapse_runs(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS
) -> DataFrame:
    """One row (id, n_words, runs, collapsed) per row of ``documents``.

    Words are separated by ASCII blanks. ``runs`` are (start, length, period) in words by start, then period; ``collapsed``
    has the words that are in no run, or among the first period of each run that holds them, joined by one space. A null
    or empty text has no words and no runs. Repeated rows stay and null ids are kept; other columns are not looked at.
    """
    rows = documents.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([
        T.StructField(id_col, rows.schema["id"].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType()),
    ])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                texts = [(t or "").encode().split() for t in piece.column("text").to_pylist()]
                names: dict[bytes, int] = {}
                numbers = np.array([names.setdefault(w, len(names)) for words in texts for w in words], np.int64)
                runs = find_runs(numbers, np.array([len(words) for words in texts], np.int64), least)
                cuts = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
                shown = [
                    _kept(words, runs[a:b, 1:]) if b > a else b" ".join(words)
                    for words, a, b in zip(texts, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)
                ]
                fields = [pa.array(runs[:, k]) for k in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays([
                    piece.column("id"), pa.array([len(words) for words in texts], pa.int64()),
                    pa.ListArray.from_arrays(
                        pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"])
                    ), pa.array(shown, pa.binary()).cast(pa.string()),
                ], names=schema.names)

    return whole_texts(rows).mapInArrow(scan, schema)
