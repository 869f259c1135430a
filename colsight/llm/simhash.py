"""SimHash near duplicates by covering locality-sensitive hashing: no pair within the radius is missed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsight.llm.common import LOWER, pieces, utf8, whole_texts, word_spans
from colsight.llm.components import components
from colsight.session import materialize

BITS = 64


def _shingle_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, size: int, step: int = 1 << 16):
    """Hashes of the shingles of one document, in blocks; words are joined by one blank."""
    digest = xxhash.xxh64_intdigest
    count = max(1, len(begin) - size + 1)
    for at in range(0, count, step):
        first, last = at, min(len(begin), at + step + size - 1)
        sizes = end[first:last] - begin[first:last]
        places = np.concatenate([[0], np.cumsum(sizes + 1)])
        words = raw[begin[first]:end[last - 1]].tobytes()
        offsets = begin[first:last] - begin[first]
        text = b" ".join([words[a:a + n] for a, n in zip(offsets.tolist(), sizes.tolist(), strict=True)])
        starts = places[:min(step, count - at)].tolist()
        if len(begin) < size:
            ends = [len(text)]
        else:
            ends = (places[size:size + len(starts)] - 1).tolist()
        yield np.fromiter((digest(text[a:b], 42) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))


def fingerprints(documents: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) per row of ``documents``; fp is the signed form of the 64-bit fingerprint, zero for no words.

    A-Z are lower-cased, words are runs without white space, and a text of fewer words is one shingle of all of them.
    """
    rows = documents.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                raw, limits = utf8(piece.column("text"))
                raw = LOWER[raw]
                begin, end, row = word_spans(raw, limits)
                cuts = np.searchsorted(row, np.arange(piece.num_rows + 1))
                out = np.zeros(piece.num_rows, np.uint64)
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    if b > a:
                        out[k] = _voted(_shingle_hashes(raw, begin[a:b], end[a:b], shingle))
                yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(out.view(np.int64))], names=["id", "fp"])

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("fp", T.LongType())])
    return whole_texts(rows).mapInArrow(scan, schema)


def _voted(blocks: Iterator[np.ndarray]) -> int:
    """The fingerprint of some hashes: bit b is set if it is set in more than half of them."""
    votes, total = np.zeros(BITS, np.int64), 0
    for hashes in blocks:
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(votes * 2 > total, bitorder="little").view("<u8")[0])


def covering_masks(radius: int, seed: int = 1, bits: int = BITS) -> list[int]:
    """Masks over ``bits`` places such that any ``radius`` differing ones lie outside at least one of them.

    Every place gets a nonzero vector of radius + 1 binary digits. The mask of a nonzero vector v holds the places whose
    vector has an odd product with v. For any ``radius`` places their vectors span less than the whole space, so some v
    is orthogonal to all of them, and its mask avoids them.
    """
    size = 1 << (radius + 1)
    order = np.random.default_rng(seed).permutation(bits)
    vectors = np.empty(bits, int)
    vectors[order] = 1 + np.arange(bits) % (size - 1)
    return [
        sum(1 << bit for bit in range(bits) if (int(vectors[bit]) & v).bit_count() % 2)
        for v in range(1, size)
    ]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def near_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp`` that connect the same ones as all pairs within the radius do.

    Each table groups fingerprints by their bits under one mask; a pair within the radius meets in at least one. Inside
    a bucket two members differ outside the mask only. No pairs are listed there, as a bucket may be large: for a radius
    of 2 each member names itself and its neighbours at one free bit, and members that name the same neighbour are at
    most 2 bits apart, so each is linked to the smallest of them. For a radius of 1 two members linked this way differ
    in one bit at most, as one of them is the neighbour itself. Rows grow in proportion to the members.
    """
    if radius not in (1, 2):
        raise ValueError("a radius of 1 or 2 bits")
    tables = F.array(*(
        F.struct(F.lit(i).alias("t"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(covering_masks(radius))
    ))
    keyed = prints.select("fp", F.inline(tables)).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    shared = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key")
    members = keyed.join(shared, ["t", "key"])
    free = F.expr("filter(sequence(0, 63), b -> (shiftrightunsigned(mask, b) & 1L) = 0)")
    centres = F.expr("concat(array(fp), transform(free, b -> fp ^ shiftleft(1L, b)))")
    named = members.withColumn("free", free).select("fp", F.explode(centres).alias("centre")).distinct()
    if radius == 1:
        return named.join(prints.select(F.col("fp").alias("centre")), "centre", "left_semi").where(
            "fp <> centre"
        ).select(F.col("fp").alias("u"), F.col("centre").alias("v"))
    least = named.groupBy("centre").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1")
    return named.join(least, "centre").where("fp <> v").select(F.col("fp").alias("u"), "v").distinct()


def near_duplicates(
    documents: DataFrame, radius: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row (id, fingerprint, component_id) per row of ``documents``.

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id`` is the smallest id reachable over links.
    Texts without words, null or empty, have fingerprint zero and are linked like any other. Rows of one fingerprint are
    one node, so copies are no links, however many there are. Repeated rows stay; rows with a null id take part and
    keep it, and their component is named by the smallest id that is not null. An empty table gives an empty result.
    """
    prints = materialize(fingerprints(documents, shingle, id_col, text_col), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "prints")
    reached = components(near_links(nodes.select("fp"), radius))
    named = nodes.join(reached, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    owners = named.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = named.join(owners, "component").select("fp", "component_id")
    return prints.join(labels, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
