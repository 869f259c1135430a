"""Benchmark decontamination by a distributed positional inverted index of the training text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsight.llm.common import LOWER, pieces, utf8, whole_texts, word_hashes, word_spans
from colsight.session import materialize

#: Bytes that are no part of a word: all ASCII but digits and lower-case letters (A-Z are lower-cased before).
OUTSIDE = np.array([b < 128 and not re.match(r"[0-9a-z]", chr(b)) for b in range(256)])

#: Bytes of test items that are compiled and broadcast at a time (or one longer item); each block of them is one pass
#: over the index.
BLOCK_BYTES = 8 << 20

#: Free places between the documents of a segment, so that neither phrases nor near terms run across.
GAP = 64

#: An index row is a segment: the postings of about this many bytes of documents.
SEGMENT_BYTES = 1 << 20


@dataclass(frozen=True)
class Windows:
    """The windows of test items; terms are numbers of sorted word hashes."""

    vocabulary: np.ndarray  # sorted hashes
    terms: np.ndarray  # windows by size; -1 behind the end of a shorter one
    sizes: np.ndarray
    items: list[list[str]]  # ids of the items that have the window


def item_windows(rows: list[tuple], size: int) -> Windows:
    """Windows of ``size`` consecutive words of each item; an item of fewer words, but not none, is one window."""
    found: dict[tuple[int, ...], set[str]] = {}
    for item, text in rows:
        raw = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
        begin, end, _ = word_spans(raw, np.array([0, len(raw)]), OUTSIDE)
        words = word_hashes(raw, begin, end).tolist()
        for k in range(max(1, len(words) - size + 1) if words else 0):
            found.setdefault(tuple(words[k:k + size]), set()).add(str(item))
    vocabulary = np.unique(np.array([w for window in found for w in window], np.uint64))
    terms = np.full((len(found), size), -1, np.int64)
    for k, window in enumerate(found):
        terms[k, :len(window)] = np.searchsorted(vocabulary, np.array(window, np.uint64))
    sizes = np.array([len(w) for w in found], np.int64)
    return Windows(vocabulary, terms, sizes, [sorted(v) for v in found.values()])


def build_index(
    documents: DataFrame, vocabulary: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The index as rows of segments, without a shuffle.

    A segment holds some documents: their ids and numbers of words, the distinct terms as sorted word hashes, the end of
    each term's list in ``places``, and there the places of its occurrences in the segment in ascending order. A
    document's words have consecutive places from its entry in ``begins``. With ``vocabulary`` only postings of these terms are stored: those that queries can use.
    """
    rows = documents.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([
        T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)),
        T.StructField("begins", T.ArrayType(T.LongType())),
        T.StructField("n_words", T.ArrayType(T.LongType())),
        T.StructField("terms", T.ArrayType(T.LongType())),
        T.StructField("ends", T.ArrayType(T.LongType())),
        T.StructField("places", T.ArrayType(T.IntegerType())),
    ])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, most=SEGMENT_BYTES):
                raw, limits = utf8(piece.column("text"))
                raw = LOWER[raw]
                begin, end, row = word_spans(raw, limits, OUTSIDE)
                hashes = word_hashes(raw, begin, end)
                counts = np.bincount(row, minlength=piece.num_rows)
                begins = np.concatenate([[0], np.cumsum(counts + GAP)[:-1]])
                places = np.arange(len(hashes)) + row * GAP
                if vocabulary is not None:
                    kept = _among(vocabulary, hashes) >= 0
                    hashes, places = hashes[kept], places[kept]
                order = np.argsort(hashes, kind="stable")
                terms, first = np.unique(hashes[order], return_index=True)
                ends = np.append(first[1:], len(order))[:len(terms)]
                lists = [begins, counts, terms.view(np.int64), ends]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([piece.column("id").to_pylist()], pa.list_(piece.column("id").type))]
                    + [pa.array([x.astype(np.int64)], pa.list_(pa.int64())) for x in lists]
                    + [pa.array([places[order].astype(np.int32)], pa.list_(pa.int32()))],
                    names=schema.names,
                )

    return whole_texts(rows).mapInArrow(index, schema)


def _among(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted value in the sorted ones, or -1."""
    if not len(sorted_values):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return np.where(sorted_values[at] == wanted, at, -1)


class Segment:
    """One row of the index, seen through the terms of some windows."""

    def __init__(self, vocabulary: np.ndarray, terms: np.ndarray, ends: np.ndarray, places: np.ndarray):
        at = _among(terms.view(np.uint64), vocabulary)
        begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        self.first = np.where(at >= 0, begins[at] if len(begins) else 0, 0)
        self.count = np.where(at >= 0, (ends - begins)[at] if len(begins) else 0, 0)
        self.places = places

    def postings(self, term: int) -> np.ndarray:
        return self.places[self.first[term]:self.first[term] + self.count[term]]

    def phrases(self, windows: Windows) -> Iterator[tuple[int, np.ndarray]]:
        """Windows that occur, with the places where they start: lists are intersected from the rarest term on."""
        counts = np.where(windows.terms >= 0, self.count[windows.terms], np.iinfo(np.int64).max)
        for w in np.flatnonzero(counts.min(axis=1, initial=1) > 0):
            size = windows.sizes[w]
            order = np.argsort(counts[w, :size], kind="stable")
            starts = self.postings(windows.terms[w, order[0]]) - order[0]
            for offset in order[1:]:
                if not len(starts):
                    break
                starts = starts[_among(self.postings(windows.terms[w, offset]), starts + offset) >= 0]
            if len(starts):
                yield int(w), starts

    def near(self, windows: Windows, anchors: int, span: int) -> Iterator[tuple[int, np.ndarray]]:
        """Windows whose ``anchors`` rarest terms all lie within ``span`` places, with the places of the rarest."""
        counts = np.where(windows.terms >= 0, self.count[windows.terms], np.iinfo(np.int64).max)
        for w in np.flatnonzero(counts.min(axis=1, initial=1) > 0):
            rare = windows.terms[w, np.argsort(counts[w, :windows.sizes[w]], kind="stable")[:anchors]]
            places = self.postings(rare[0])
            for term in rare[1:]:
                other = self.postings(term)
                to = np.searchsorted(other, places)
                below = places - other[np.maximum(to - 1, 0)]
                above = other[np.minimum(to, len(other) - 1)] - places
                gap = np.minimum(np.where(to > 0, below, span), np.where(to < len(other), above, span))
                places = places[gap < span]
            if len(places):
                yield int(w), places


def search(index: DataFrame, windows: Windows, anchors: int = 3, span: int = 20) -> DataFrame:
    """Matches of the windows in every document of the index.

    Rows are (segment, ordinal, id, n_words, hit_from, hit_to, items, near_items), the first two naming the document.

    ``hit_from`` and ``hit_to`` are the maximal runs of words inside occurrences, ends exclusive; ``items`` are the ids
    of items with an exact phrase, ``near_items`` of those with the rarest terms of a window near each other. Segments
    are self-contained, so the search is one pass over the index and needs no shuffle.
    """
    if not 0 < span <= GAP:
        raise ValueError(f"a span of 1 to {GAP} words")
    sent = index.sparkSession.sparkContext.broadcast(windows)
    kind = index.schema["ids"].dataType.elementType
    texts = T.ArrayType(T.StringType())
    schema = T.StructType([
        T.StructField("segment", T.LongType()), T.StructField("ordinal", T.LongType()),
        T.StructField("id", kind), T.StructField("n_words", T.LongType()),
        T.StructField("hit_from", T.ArrayType(T.LongType())), T.StructField("hit_to", T.ArrayType(T.LongType())),
        T.StructField("items", texts), T.StructField("near_items", texts),
    ])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for k in range(batch.num_rows):
                yield _looked(batch.slice(k, 1), known, anchors, span)

    return index.mapInArrow(look, schema)


def _looked(row: pa.RecordBatch, windows: Windows, anchors: int, span: int) -> pa.RecordBatch:
    begins, counts, terms, ends, places = (
        row.column(n)[0].values.to_numpy(zero_copy_only=False)
        for n in ("begins", "n_words", "terms", "ends", "places")
    )
    ids = row.column("ids")[0].values
    segment = Segment(windows.vocabulary, terms, ends, places)
    total = int(begins[-1] + counts[-1]) if len(begins) else 0
    cover = np.zeros(total + 2, np.int64)
    items: list[set[str]] = [set() for _ in begins]
    close: list[set[str]] = [set() for _ in begins]
    for w, starts in segment.phrases(windows):
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + windows.sizes[w], -1)
        for d in np.unique(np.searchsorted(begins, starts, side="right") - 1):
            items[d].update(windows.items[w])
    for w, at in segment.near(windows, anchors, span):
        for d in np.unique(np.searchsorted(begins, at, side="right") - 1):
            close[d].update(windows.items[w])
    edge = np.diff(np.concatenate([[0], (np.cumsum(cover) > 0).astype(np.int8)]))
    run_from, run_to = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    owner = np.searchsorted(begins, run_from, side="right") - 1
    cut = np.concatenate([np.searchsorted(owner, np.arange(len(begins))), [len(owner)]]).astype(np.int32)
    shift = begins[owner] if len(begins) else owner
    return pa.RecordBatch.from_arrays([
        pa.array([row.column("segment")[0].as_py()] * len(ids), pa.int64()), pa.array(range(len(ids)), pa.int64()),
        ids, pa.array(counts, pa.int64()),
        pa.ListArray.from_arrays(pa.array(cut), pa.array(run_from - shift, pa.int64())),
        pa.ListArray.from_arrays(pa.array(cut), pa.array(run_to - shift, pa.int64())),
        pa.array([sorted(x) for x in items], pa.list_(pa.string())),
        pa.array([sorted(x) for x in close], pa.list_(pa.string())),
    ], names=["segment", "ordinal", "id", "n_words", "hit_from", "hit_to", "items", "near_items"])


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    size: int = 10,
    anchors: int = 3,
    span: int = 20,
    block_bytes: int = BLOCK_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row (id, n_words, hit_from, hit_to, items, near_items) per row of ``documents``; see :func:`search`.

    Words are runs of digits, letters and non-ASCII characters, with A-Z in lower case; a null text has none. Items
    without words have no window. The index of ``documents`` is written once. Items are taken in blocks of
    ``block_bytes``; a block is what a search broadcasts, and each further block is one more pass over the index. Of
    one block only the postings of its terms are stored, else those of all words. Repeated rows and null ids stay rows
    of their own, as matches are united by their place in the index; repeated items are united by their id. An empty
    benchmark leaves every document unhit, empty documents give an empty result.
    """
    items = benchmark.select(
        F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text}`").cast("string").alias("text")
    )
    held = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-held // block_bytes))
    index, found = None, []
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        windows = item_windows([tuple(r) for r in part.collect()], size)
        if index is None:
            stored = build_index(documents, windows.vocabulary if blocks == 1 else None, id_col, text_col)
            index = materialize(stored.withColumn("segment", F.monotonically_increasing_id()), "postings")
        found.append(search(index, windows, anchors, span))
    return (found[0] if blocks == 1 else _united(found)).drop("segment", "ordinal").withColumnRenamed("id", id_col)


def _united(found: list[DataFrame]) -> DataFrame:
    """Matches of all blocks of items, document by document; runs that meet become one."""
    runs = """aggregate(
        array_sort(flatten(collect_list(arrays_zip(hit_from, hit_to)))),
        cast(array() as array<struct<f: bigint, t: bigint>>),
        (acc, r) -> if(
            size(acc) > 0 and element_at(acc, -1).t >= r.hit_from,
            concat(
                slice(acc, 1, size(acc) - 1),
                array(struct(element_at(acc, -1).f as f, greatest(element_at(acc, -1).t, r.hit_to) as t))
            ),
            concat(acc, array(struct(r.hit_from as f, r.hit_to as t)))
        )
    )"""
    union = found[0]
    for part in found[1:]:
        union = union.unionByName(part)
    return union.groupBy("segment", "ordinal").agg(
        F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.expr(runs).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("near_items"),
    ).select(
        "segment", "ordinal", "id", "n_words", F.col("runs.f").alias("hit_from"), F.col("runs.t").alias("hit_to"),
        "items", "near_items",
    )
