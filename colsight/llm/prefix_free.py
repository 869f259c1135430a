"""Substring dedup of bytes by prefix-free parsing: repeated byte strings are cut out of documents.

A rolling hash of 16 bytes cuts each text into phrases: a phrase ends at a trigger, the least hash of a neighbourhood, so
the cuts depend on nearby content alone and equal passages are cut alike. A text's phrases in sequence are its parse;
the dictionary holds the distinct ones. A suffix of the corpus begins with a suffix of a phrase and goes on with a suffix
of the parse, so its place in corpus order is that pair of ranks, and two suffixes share their first ``length`` bytes if
no two neighbours between them in this order part earlier.

Only the first ``length`` bytes matter, so parse suffixes are ordered to that depth, among those that agree in the bytes
behind the trigger that all such strings share. Phrases that occur once there, or in one context only, are settled
without any order. The rest is dealt by those shared bytes, and each task builds the suffix array of its dictionary and
of its parse, with the common prefixes of the latter, and combines them. Where one phrase has more contexts than a task
should hold, the same pairs are named by hashes and meet in a shuffle instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from colsight.llm.common import BYTE_SYMBOLS, pieces, whole_texts
from colsight.llm.repeats import Windows, repeated_starts, spread_out
from colsight.llm.substring_dedup import removed, rows_of, with_runs

TRIGGER_BYTES = 16


def byte_symbols(raw: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return raw, limits


def phrase_suffix_ranks(symbols: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes of some byte strings at all places: equal for equal suffixes, in their order.

    Prefix doubling: the rank to twice the depth is that of a pair of ranks. ``begin`` and ``end`` bound each string;
    places outside all strings have rank zero.
    """
    size = np.zeros(len(symbols) + 1, np.int64)
    owner = np.repeat(np.arange(len(begin)), end - begin)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin) + begin[owner]
    size[place] = end[owner] - place
    rank = np.zeros(len(symbols) + 1, np.int64)
    rank[place] = symbols[place].astype(np.int64) + 1
    depth = 1
    while depth < size.max(initial=0):
        behind = np.where(size[place] > depth, rank[np.minimum(place + depth, len(symbols))], 0)
        pairs = rank[place] * (behind.max(initial=0) + 1) + behind
        rank[place] = np.unique(pairs, return_inverse=True)[1] + 1
        depth *= 2
    return rank


def parse_suffix_order(core: np.ndarray, tails: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each context among all, ordered by core and bytes, and the common prefix of each rank and the one before.

    Contexts of different cores have no common prefix.
    """
    order = sorted(range(len(tails)), key=lambda i: (core[i], tails[i]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    width = max(map(len, tails), default=0)
    sizes = np.array([len(tails[i]) for i in order], np.int64)
    grid = np.frombuffer(b"".join(tails[i].ljust(width, b"\0") for i in order), np.uint8).reshape(len(order), width)
    apart = np.ones((max(0, len(order) - 1), width + 1), bool)
    apart[:, :width] = grid[1:] != grid[:-1]
    common = np.minimum(apart.argmax(axis=1), np.minimum(sizes[1:], sizes[:-1]))
    common[core[order][1:] != core[order][:-1]] = -1
    return rank, np.concatenate([[-1], common]) if len(order) else np.zeros(0, np.int64)


def least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values[low + 1 : high + 1] for each pair low < high, by a table of runs of doubling length."""
    levels = [values]
    while 2 << (len(levels) - 1) <= len(values):
        half = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    span = high - low
    level = np.frexp(span.astype(float))[1] - 1
    out = np.empty(len(low), np.int64)
    for k, table in enumerate(levels):
        some = level == k
        out[some] = np.minimum(table[low[some] + 1], table[high[some] + 1 - (1 << k)])
    return out


def corpus_order(core: np.ndarray, lead: np.ndarray, around: list[bytes], windows: Windows) -> tuple[np.ndarray, ...]:
    """Names of the windows of some classes, taken in corpus order: a name ends where two neighbours part too early.

    A window begins with the suffix of a phrase, of ``left`` bytes before the trigger, and ends so many bytes before the
    end of the context behind the core. Sorted by core, phrase suffix and parse suffix, neighbours are the same window if
    the first two agree and the contexts have as much in common as the window takes of them.
    """
    symbols, limits, owner, number = spread_out(around, windows)
    ranks = phrase_suffix_ranks(symbols, limits[:-1], limits[:-1] + lead)
    tails = [x[n:] for x, n in zip(around, lead.tolist(), strict=True)]
    parse, common = parse_suffix_order(core, tails)
    left = lead[owner] - number
    suffix = np.where(left > 0, ranks[limits[owner] + number], 0)
    group = np.unique(core, return_inverse=True)[1][owner]
    order = np.lexsort((parse[owner], suffix, group))
    low, high = order[:-1], order[1:]
    same = (group[low] == group[high]) & (suffix[low] == suffix[high])
    shared = np.full(len(same), -1)
    shared[same] = least_between(common, parse[owner[low[same]]], parse[owner[high[same]]])
    fresh = np.ones(len(order), bool)
    fresh[1:] = ~same | (shared < windows.reach - 1 - left[high])
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(fresh)
    return names, owner, number


def cut_repeated_bytes(
    documents: DataFrame, length: int = 400, reach: int = 96, id_col: str = "doc_id", text_col: str = "text",
    texts: bool = False,
) -> DataFrame:
    """One row (id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) per row of ``documents``.

    A byte goes if a string of ``length`` bytes covers it that begins anywhere else too, in any document or in the same
    one, overlaps included; strings don't cross documents and are judged on the input. ``n_spans`` counts maximal removed
    runs, ``kept`` has the other bytes. The text is taken as UTF-8, a null text as empty; texts shorter than ``length``
    lose nothing. A repeated row is another document, so both lose all that is long enough. Ids play no part. An empty
    table gives an empty result. ``reach`` bounds the distance of triggers: phrases are half as long on average.
    """
    gram = min(TRIGGER_BYTES, max(1, length // 2))
    windows = Windows(byte_symbols, length, max(1, min(reach, length - gram + 1)), gram, BYTE_SYMBOLS)
    rows = rows_of(documents, id_col, text_col)
    schema = T.StructType([
        T.StructField("id", rows.schema["id"].dataType),
        *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")),
        T.StructField("kept_sha256", T.StringType()),
        *([T.StructField("kept", T.BinaryType())] if texts else []),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                out = [_kept(t, r, length) for t, r in zip(piece.column("text"), piece.column("runs"), strict=True)]
                *figures, kept = zip(*out, strict=True)
                columns = [pa.array(x, pa.int64()) for x in figures]
                columns.append(pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()))
                if texts:
                    columns.append(pa.array(kept, pa.binary()))
                yield pa.RecordBatch.from_arrays([piece.column("id"), *columns], names=schema.names)

    joined = with_runs(rows, repeated_starts(rows, windows, earlier_only=False, name=corpus_order))
    return whole_texts(joined).mapInArrow(cut, schema).withColumnRenamed("id", id_col)


def _kept(text: pa.Scalar, runs: pa.Scalar, length: int) -> tuple[int, int, int, bytes]:
    raw = np.frombuffer(text.as_buffer(), np.uint8)
    if not runs.is_valid:
        return len(raw), 0, 0, raw.tobytes()
    gone = removed(runs.as_py(), length, len(raw))
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    return len(raw), int(gone.sum()), spans, raw[~gone].tobytes()
