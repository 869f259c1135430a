"""Words that differ by one code point, found by a frontier of states over a distributed trie.

The trie is a table of edges between prefixes of words. Only prefixes behind which words go on differently need to be
nodes, so a chain without a branch is one edge with a longer label. A state is (word, position, node, edits). A word's own
path is known, so the frontier starts where words part: at each node of a word's path the edges that leave it are taken
with one edit, and from then on states follow equal labels level by level until they end as a word.

Of two words one edit apart the longer one, or of equally long ones the one with the smaller code point where they part,
finds the other. They agree either in the first half of its code points or, read backwards, in the other one. One trie holds
words as written and one reversed, both only from the middle of words on, and edits happen there alone: close to the root,
where everything branches, no state is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsight.llm import sketch
from colsight.llm.common import FIRST, heavy_keys, mix
from colsight.session import materialize

#: Words of an Arrow batch.
BATCH_WORDS = 4096

#: Symbols of words read as written and reversed are drawn apart, so that one table holds both tries.
_ODD = np.uint64(0x9E3779B97F4A7C15)
_TURNED = np.uint64(0xD1B54A32D192ED03)


class _Prefixes:
    """The prefixes of many words, from the middle of each word to the whole, and 64-bit names of them."""

    def __init__(self, words: list[str], reverse: bool):
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        if reverse:
            points, words = points[::-1], [w[::-1] for w in words[::-1]]
        self.words = words
        self.lengths = np.array([len(w) for w in words], np.int64)
        begin = np.cumsum(self.lengths) - self.lengths
        low = (self.lengths + int(reverse)) // 2
        counts = self.lengths - low + 1
        first = np.cumsum(counts) - counts
        self.word = np.repeat(np.arange(len(words)), counts)
        self.depth = np.arange(int(counts.sum())) - np.repeat(first - low, counts)
        turned = _TURNED if reverse else np.uint64(0)
        sums = FIRST.prefix(mix((points.astype(np.uint64) + np.uint64(1)) * _ODD + turned))
        begins = begin[self.word]
        self.names = FIRST.spans(sums, begins, begins + self.depth) + turned
        #: What follows a prefix: a code point, or the end.
        self.follows = np.append(points.astype(np.int32), np.int32(-1))[np.minimum(begins + self.depth, len(points))]
        self.follows[self.depth == self.lengths[self.word]] = -1


def _both(words: DataFrame, rows, schema: str) -> DataFrame:
    """``rows`` of the prefixes of a batch of words, read as written and reversed."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for reverse in (False, True):
                    yield rows(_Prefixes(batch.column("word").to_pylist(), reverse), reverse)

    words.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_WORDS))
    return words.select("word").mapInArrow(scan, schema)


def _branches(words: DataFrame) -> DataFrame:
    """(node, held): the prefixes behind which words go on differently, and how many words have them."""
    def rows(found: _Prefixes, reverse: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(found.names.view(np.int64)), pa.array(found.follows)], names=["node", "follows"]
        )

    return _both(words, rows, "node long, follows int").groupBy("node").agg(
        F.min("follows").alias("low"), F.max("follows").alias("high"), F.count("*").alias("held")
    ).where("low < high").select("node", "held")


def _parts(words: DataFrame, branches: DataFrame) -> DataFrame:
    """(node, depth, label, child, read, reverse): the edges of every word's own path; the last one ends it.

    Nodes are looked up in a sketch of fixed size. It knows all branching prefixes and takes a few others for such, the
    same ones for every word, which only parts an edge in two. ``child`` is null on the edge that ends a word; its label is
    empty where the word's end is itself a node.
    """
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from sketch.partial_sketches((b.column("node").to_numpy().view(np.uint64) for b in batches), least=1)

    bits = sketch.merged(branches.select("node").mapInArrow(keys, sketch.SCHEMA), least=1)
    sent = words.sparkSession.sparkContext.broadcast(bits)

    def rows(found: _Prefixes, reverse: bool) -> pa.RecordBatch:
        kept = np.flatnonzero(sketch.passed(sent.value, found.names))
        word, depth, names = found.word[kept], found.depth[kept], found.names[kept].view(np.int64)
        last = np.append(word[1:] != word[:-1], True) if len(word) else np.zeros(0, bool)
        stops = np.where(last, found.lengths[word], np.append(depth[1:], 0) if len(word) else depth)
        labels = [found.words[w][a:b] for w, a, b in zip(word.tolist(), depth.tolist(), stops.tolist(), strict=True)]
        child = np.append(names[1:], 0) if len(word) else names
        return pa.RecordBatch.from_arrays([
            pa.array(names), pa.array(depth.astype(np.int32)), pa.array(labels, pa.string()), pa.array(child, mask=last),
            pa.array(found.words, pa.string()).take(pa.array(word)), pa.array(np.full(len(word), reverse)),
        ], names=["node", "depth", "label", "child", "read", "reverse"])

    return _both(words, rows, "node long, depth int, label string, child long, read string, reverse boolean")


def _dealt(states: DataFrame, counted: DataFrame, edges: DataFrame, on: list[str]) -> DataFrame:
    """States joined with the edges of their nodes; those at a node that very many are at are dealt over copies of it.

    ``counted`` has the states (``held``) at each node.
    """
    parts = F.ceil(F.col("held") / 4096).cast("int").alias("parts")
    heavy = materialize(heavy_keys(counted, "held").select("node", parts), "heavy-nodes")
    part = F.coalesce(F.pmod(F.xxhash64("read"), F.col("parts")), F.lit(0)).cast("int")
    left = states.join(F.broadcast(heavy), "node", "left").withColumn("part", part).drop("parts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))
    right = edges.join(F.broadcast(heavy), "node", "left").withColumn("part", copies).drop("parts")
    return left.join(right, [*on, "part"]).drop("part")


def _from(place: Column, count: Column | None = None) -> Column:
    """The part of the word from a position (counted from 0) on, of ``count`` code points if given."""
    return F.col("read").substr(place + 1, count if count is not None else F.length("read"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near): every pair of distinct words that differ by one inserted, deleted or replaced code point, once.

    ``words`` has one row per distinct, non-empty ``word`` without nulls. The number of rounds is that of nodes in the
    latter half of a word's path, whatever its length; states are written after each round.
    """
    branches = materialize(_branches(words), "branches")
    parts = materialize(_parts(words, branches), "path-edges")
    first = F.substring("label", 1, 1).alias("first")
    inner = parts.where("child is not null").select("node", "label", "child").distinct()
    leaves = parts.where("child is null").select("node", first, "label", "child", F.col("read").alias("end"))
    edges = materialize(
        inner.select("node", first, "label", "child", F.lit(None).cast("string").alias("end")).unionByName(leaves), "edges"
    )
    # Edits where the word's path and another edge part: the words' first difference is at the node itself.
    seeds = parts.where("label <> ''").select("node", "read", "reverse", "depth", F.substring("label", 1, 1).alias("own"))
    m, f = F.length("label"), F.col("depth")
    replaced = (F.col("first") > F.col("own")) & (
        _from(f + 1, F.greatest(m - 1, F.lit(0))) == F.col("label").substr(F.lit(2), m)
    )
    deleted = (F.col("first") != F.col("own")) & (_from(f + 1, m) == F.col("label"))
    # A state that ends a word must have used up its own one; others go on at the child.
    going = F.col("end").isNull() | (F.col("place") == F.length("read"))
    moves = F.filter(F.array(F.when(replaced, f + m), F.when(deleted, f + m + 1)), lambda x: x.isNotNull())
    states = materialize(
        _dealt(seeds, branches, edges, ["node"]).where(replaced | deleted).select(
            "read", "reverse", F.explode(moves).alias("place"), F.col("child").alias("node"), "end"
        ).where(going), "states",
    )
    found = states.where("end is not null").select("read", "reverse", "end")
    while True:
        states = states.where("node is not null").select(
            "read", "reverse", "place", "node", _from(F.col("place"), F.lit(1)).alias("first")
        )
        if states.isEmpty():
            break
        counted = states.groupBy("node").agg(F.count("*").alias("held"))
        met = _dealt(states, counted, edges, ["node", "first"]).where(_from(F.col("place"), m) == F.col("label"))
        states = materialize(
            met.withColumn("place", F.col("place") + m).select(
                "read", "reverse", "place", F.col("child").alias("node"), "end"
            ).where(going), "states",
        )
        found = found.unionByName(states.where("end is not null").select("read", "reverse", "end"))
    as_written = lambda c: F.when(F.col("reverse"), F.reverse(c)).otherwise(F.col(c))
    half = F.floor(F.length("word") / 2).cast("int")
    again = F.col("reverse") & (F.substring("word", F.lit(1), half) == F.substring("near", F.lit(1), half))
    # Names of nodes are hashes, so the edit is checked on the words; what agrees in the first half was found as written.
    return found.where(F.levenshtein("read", "end", 1) == 1).select(
        as_written("read").alias("word"), as_written("end").alias("near"), "reverse"
    ).where(~again).select("word", "near")


def near_words(words: DataFrame) -> DataFrame:
    """:func:`near_pairs` in both orders."""
    pairs = materialize(near_pairs(words), "near-pairs")
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near")))
