"""TF-IDF weights and cosine retrieval over any table of texts."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsight.functions.numbers import col
from colsight.functions.text import tokens
from colsight.operators.postings import (
    best_documents, block_bounds, block_postings, document_blocks, flat_postings, scores,
)
from colsight.session import materialize

#: Scores below this are shown as this.
SCORE_FLOOR = 0.1

#: Score given to the first rows when there is nothing to search for.
EMPTY_QUERY_SCORE = 0.85

#: Terms that hold at least this share of all (document, term) pairs; there are at most 1/share of them.
_HOT_TERM_SHARE = 1e-6

#: Parts of the terms of a document whose key comes in several rows, so that no part is large.
_PARTS = 64


#: English words that say little about a text: articles, pronouns, prepositions, conjunctions, auxiliaries.
STOP_WORDS = tuple("""
a about after again all also an and any are as at be because been before being between both but by can could did do does
during each few for from had has have he her here him his how i if in into is it its just may me more most my no nor not
of on only or other our out over own same she should so some such than that the their them then there these they this
those through to too under until up very was we were what when where which while who whom why will with would you your
""".split())


def english_stop_words() -> list[str]:
    """The default list; pass another sequence to the functions below to use that instead."""
    return list(STOP_WORDS)


def _counted(batches: Iterator[pa.RecordBatch], skip: pa.Array) -> Iterator[pa.RecordBatch]:
    """``doc, terms`` from ``doc, words``: the distinct words of each row, but those of ``skip``, with their counts.

    Rows without such words go.
    """
    for batch in batches:
        words = batch.column("words")
        coded = words.flatten().dictionary_encode()
        size = max(1, len(coded.dictionary))
        row = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(words), 0).to_numpy())
        found, tf = np.unique(row * size + coded.indices.to_numpy(), return_counts=True)
        wanted = ~pc.is_in(coded.dictionary, value_set=skip).to_numpy(zero_copy_only=False)[found % size]
        found, tf = found[wanted], tf[wanted]
        kept, starts = np.unique(found // size, return_index=True)
        terms = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(found % size)), pa.array(tf)], ["term", "tf"])
        limits = pa.array(np.append(starts, len(found)).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc").take(pa.array(kept)), pa.ListArray.from_arrays(limits, terms)], names=["doc", "terms"]
        )


def term_counts(docs: DataFrame, key: str, text: str, stop_words: Sequence[str] = ()) -> DataFrame:
    """``doc, terms``: the terms (term, tf) of a document, whose equal terms are combined within its row.

    Nothing is shuffled but keys, unless keys come in several rows. The terms of such documents are added up and stand in
    up to ``_PARTS`` rows; all other documents with terms have one row.
    """
    texts = docs.select(col(key).alias("doc"), col(text).alias("text"))
    skip = list(stop_words)
    schema = T.StructType([texts.schema["doc"], T.StructField("terms", T.ArrayType(T.StructType([
        T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())
    ])))])
    rows = texts.select("doc", tokens(F.col("text")).alias("words")).mapInArrow(
        lambda batches: _counted(batches, pa.array(skip, pa.string())), schema
    )
    keys = texts.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc").alias("known"))
    repeated = materialize(keys, "repeated-keys")
    if repeated.isEmpty():
        return rows
    same = F.col("doc").eqNullSafe(F.col("known"))
    added = rows.join(repeated, same, "left_semi").select("doc", F.inline("terms")).groupBy("doc", "term").agg(
        F.sum("tf").alias("tf")
    ).groupBy("doc", F.pmod(F.hash("term"), F.lit(_PARTS)).alias("part")).agg(
        F.collect_list(F.struct("term", "tf")).alias("terms")
    )
    return rows.join(repeated, same, "left_anti").unionByName(added.select("doc", "terms"))


def vocabulary(counts: DataFrame, n_docs: int, max_terms: int | None = None) -> DataFrame:
    """``term, df, idf``: all terms, or the ``max_terms`` most frequent in the corpus, with smooth idf."""
    terms = counts.select(F.inline("terms")).groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")
    )
    if max_terms is not None:
        terms = terms.orderBy(F.desc("total"), "term").limit(max_terms)
    idf = F.log((F.lit(1.0) + n_docs) / (F.col("df") + 1)) + 1
    return terms.select("term", "df", idf.alias("idf"))


@dataclass(frozen=True)
class TextIndex:
    """Written block postings of a table of texts and its vocabulary; build once, search often."""

    documents: DataFrame
    postings: DataFrame
    bounds: DataFrame
    terms: DataFrame
    stop_words: tuple[str, ...]


def build_index(
    docs: DataFrame, key: str, text: str, *, stop_words: Sequence[str] | None = None,
    max_terms: int | None = None,
) -> TextIndex:
    """Tokenises every text once and writes block postings, ranged and sorted by term.

    Weights have unit length per document. A search reads the row groups of its terms alone, and of these the blocks that
    may hold one of the best documents.

    Terms with at least a millionth of all pairs, a million at most, are broadcast; only pairs of the others are joined by
    shuffle, and written with their idf. Frequent pairs stay packed by document until its block is known, so they are
    shuffled once packed and once when they are ranged by term.
    """
    stop_words = tuple(english_stop_words() if stop_words is None else stop_words)
    counts = materialize(term_counts(docs, key, text, stop_words), "term-counts", "zstd")
    terms = materialize(vocabulary(counts, docs.count(), max_terms), "vocabulary")
    hot = F.col("df") >= (terms.agg(F.sum("df")).first()[0] or 0) * _HOT_TERM_SHARE
    frequent, rare = F.broadcast(terms.where(hot).select("term", "idf")), terms.where(~hot).select("term", "idf")
    raw = (F.col("tf") * F.col("idf")).alias("raw")
    seldom = None
    if not rare.isEmpty():
        others = counts.select("doc", F.inline("terms")).join(frequent.select("term"), "term", "left_anti")
        seldom = materialize(others.join(rare, "term").select("doc", "term", "tf", raw), "rare-terms", "zstd")

    def raws(packed: DataFrame, *more: str) -> DataFrame:
        return packed.select("doc", *more, F.inline("terms")).join(frequent, "term").select("doc", *more, "term", "tf", raw)

    pairs = raws(counts) if seldom is None else raws(counts).unionByName(seldom)
    norms = pairs.groupBy("doc").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    blocks = materialize(document_blocks(materialize(norms, "norms")), "blocks").withColumnRenamed("doc", "known")
    same = F.col("doc").eqNullSafe(F.col("known"))
    placed = raws(counts.join(blocks, same), "block", "norm")
    if seldom is not None:
        placed = placed.unionByName(seldom.join(blocks, same).drop("known"))
    weighed = placed.select("doc", "block", "term", "tf", (F.col("raw") / F.col("norm")).alias("weight"))
    stored = materialize(block_postings(weighed), "postings", "zstd")
    return TextIndex(docs.select(col(key).alias("doc")), flat_postings(stored), block_bounds(stored), terms, stop_words)


def index_weights(index: TextIndex) -> DataFrame:
    """``doc, term, tf, weight`` with unit length per document."""
    return index.postings.select("doc", "term", "tf", "weight")


def tfidf_weights(docs: DataFrame, key: str, text: str, **options) -> DataFrame:
    """:func:`index_weights` of a new index."""
    return index_weights(build_index(docs, key, text, **options))


def query_terms(query: str, stop_words: Sequence[str]) -> Counter:
    """Terms of a query with their counts, split as documents are."""
    skip = set(stop_words)
    return Counter(w for w in re.findall(r"\w{2,}", query.lower()) if w not in skip)


def search_index(
    index: TextIndex, query: str, *, k: int | None = 3, floor: float = SCORE_FLOOR
) -> DataFrame:
    """``doc, cosine, score``: the ``k`` best documents for a query (all of them with ``k=None``).

    Only postings of the query's terms are read, by a filter the scan applies, and for the ``k`` best only the blocks of
    them that may hold one. Documents without any of them are looked at only if all are wanted or fewer than ``k`` have one. ``score`` is the cosine raised
    to ``floor``. An empty query gives the first ``k`` rows.
    """
    if not query.strip():
        return _first_documents(index.documents.distinct(), k)
    asked = query_terms(query, index.stop_words)
    known = (
        {r["term"]: r["idf"] for r in index.terms.where(F.col("term").isin(*asked)).collect()} if asked else {}
    )
    weights = {t: asked[t] * idf for t, idf in known.items()}
    length = math.sqrt(sum(w * w for w in weights.values()))
    score = F.greatest(F.col("cosine"), F.lit(floor)).alias("score")
    if not length:
        rest = index.documents.distinct().withColumn("cosine", F.lit(0.0)).orderBy("doc")
        return (rest if k is None else rest.limit(k)).select("doc", "cosine", score)
    unit = {t: w / length for t, w in weights.items()}
    best = scores(index.postings, unit) if k is None else best_documents(index.postings, index.bounds, unit, k).best
    if k is None or (missing := k - best.count()) > 0:
        hits = scores(index.postings, unit).select("doc")
        rest = index.documents.distinct().join(hits, "doc", "left_anti").withColumn("cosine", F.lit(0.0))
        best = best.unionByName(rest if k is None else rest.orderBy("doc").limit(missing))
    return best.orderBy(F.desc("cosine"), "doc").select("doc", "cosine", score)


def _first_documents(documents: DataFrame, k: int | None) -> DataFrame:
    first = documents.orderBy("doc")
    first = first if k is None else first.limit(k)
    return first.select("doc", F.lit(None).cast("double").alias("cosine"), F.lit(EMPTY_QUERY_SCORE).alias("score"))


def search(
    docs: DataFrame, key: str, text: str, query: str, *, k: int | None = 3, floor: float = SCORE_FLOOR, **options
) -> DataFrame:
    """:func:`search_index` on a new index, which an empty query does without."""
    if not query.strip():
        return _first_documents(docs.select(col(key).alias("doc")).distinct(), k)
    return search_index(build_index(docs, key, text, **options), query, k=k, floor=floor)
