"""Substring dedup of words behind a count-min prefilter: later copies of passages are cut out of documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsight.llm.common import pieces, utf8, whole_texts, word_hashes, word_spans
from colsight.llm.repeats import Windows, repeated_starts


def word_symbols(raw: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin, end, row = word_spans(raw, limits)
    return word_hashes(raw, begin, end), np.searchsorted(row, np.arange(len(limits)))


def rows_of(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return documents.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).select(
        "id", F.xxhash64("text").alias("digest"), "text"
    )


def with_runs(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Every row with its runs; both sides are dealt by (id, digest), so no key is hot."""
    right = runs.select(F.col("id").alias("run_id"), F.col("digest").alias("run_digest"), "runs").hint("shuffle_hash")
    same = F.col("id").eqNullSafe(F.col("run_id")) & (F.col("digest") == F.col("run_digest"))
    return rows.join(right, same, "left").select("id", "text", "runs")


def removed(runs: list | None, length: int, count: int) -> np.ndarray:
    """Which of ``count`` symbols a window of ``length`` covers that begins in one of the runs."""
    edge = np.zeros(count + 1, np.int64)
    for run in runs or ():
        edge[run["first"]] += 1
        edge[run["last"] + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def cut_repeated_words(
    documents: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", texts: bool = False
) -> DataFrame:
    """One row (id, n_words, n_removed, kept_sha256[, kept_text]) per row of ``documents``.

    A word goes if a window of ``length`` words covers it whose words also begin, in sequence, in a document of smaller
    id. Windows are judged on the input. The sketches of all partitions overestimate how often the words from a window's
    anchor on occur; only windows that may be repeated are grouped, and that is exact. Kept words are joined by one
    blank. Null and empty texts, and those shorter than a window, lose nothing. Rows of equal id don't count as earlier
    for each other; a null id is later than all others. An empty table gives an empty result.
    """
    windows = Windows(word_symbols, length, max(1, length // 2 - 1), min(3, length // 2 + 1))
    rows = rows_of(documents, id_col, text_col)
    schema = T.StructType([
        T.StructField("id", rows.schema["id"].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()),
        *([T.StructField("kept_text", T.StringType())] if texts else []),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                out = [_kept(t, r, length) for t, r in zip(piece.column("text"), piece.column("runs"), strict=True)]
                words, gone, kept = zip(*out, strict=True)
                sums = [hashlib.sha256(k).hexdigest() for k in kept]
                columns = [pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums, pa.string())]
                if texts:
                    columns.append(pa.array([k.decode() for k in kept], pa.string()))
                yield pa.RecordBatch.from_arrays([piece.column("id"), *columns], names=schema.names)

    joined = with_runs(rows, repeated_starts(rows, windows, earlier_only=True))
    return whole_texts(joined).mapInArrow(cut, schema).withColumnRenamed("id", id_col)


def _kept(text: pa.Scalar, runs: pa.Scalar, length: int) -> tuple[int, int, bytes]:
    words = text.as_buffer().to_pybytes().split()
    gone = removed(runs.as_py(), length, len(words))
    return len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
