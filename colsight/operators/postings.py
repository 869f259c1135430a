"""Block postings: weights of terms in blocks of documents, the largest one of each block, and a top-k that skips blocks.

Documents are put in order of the length of their vector and cut into blocks, the same for all terms. Postings are sorted by
term and block, a row for each, with the largest weight and the number of postings beside them as columns of their own. A query
adds up the largest weights of its terms to a bound per block; a block whose bound is below the k-th best score found cannot
hold a better document, and its postings are left out by a filter on the sort order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsight.session import materialize

#: Documents of a block, as a power of two. Vectors of about one length are in a block, so its weights are alike.
BLOCK_BITS = 6

#: Blocks of the first round of a search, and how many times as many each further one reads until few are left.
FIRST_BLOCKS, GROWTH, ROUNDS = 16, 8, 2


def document_blocks(norms: DataFrame) -> DataFrame:
    """(doc, norm, block): documents with a vector, ``doc`` and ``norm``, put in blocks by length.

    Every task numbers its own documents, so blocks are made without an order over all rows in one place; blocks at the
    end of a task's range may be smaller.
    """
    ordered = norms.repartitionByRange("norm", "doc").sortWithinPartitions("norm", "doc")
    return ordered.select("doc", "norm", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS).alias("block"))


def block_postings(weighed: DataFrame) -> DataFrame:
    """(term, block, most, n, held): the postings (doc, tf, weight) of each term in each block as one row.

    ``weighed`` has doc, block, term, tf and weight. Rows are ranged and sorted by term and block; a block holds few
    documents, so a row is small, and the largest weight and the number of postings are found where they lie.
    """
    ranged = weighed.repartitionByRange("term", "block")
    return ranged.groupBy("term", "block").agg(
        F.max("weight").alias("most"), F.count("*").alias("n"), F.collect_list(F.struct("doc", "tf", "weight")).alias("held")
    ).sortWithinPartitions("term", "block")


def flat_postings(stored: DataFrame) -> DataFrame:
    """(doc, block, term, tf, weight) of :func:`block_postings`; filters by term and block reach the scan."""
    return stored.select("term", "block", F.inline("held")).select("doc", "block", "term", "tf", "weight")


def block_bounds(stored: DataFrame) -> DataFrame:
    """(term, block, most, n): the largest weight and the number of postings of each term in each block."""
    return stored.select("term", "block", "most", "n")


@dataclass(frozen=True)
class Found:
    """The best documents (doc, cosine), and how many postings were read of how many that the terms have."""

    best: DataFrame
    read: int
    held: int


def _weight(weights: dict[str, float]) -> Column:
    pairs = (x for t, w in weights.items() for x in (F.lit(t), F.lit(w)))
    return F.try_element_at(F.create_map(*pairs), F.col("term"))


def scores(postings: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(doc, cosine) of the documents in ``postings`` of the terms in ``weights``."""
    rows = postings.where(F.col("term").isin(*weights))
    return rows.groupBy("doc").agg(F.sum(F.col("weight") * _weight(weights)).alias("cosine"))


def best_documents(postings: DataFrame, bounds: DataFrame, weights: dict[str, float], k: int) -> Found:
    """The ``k`` documents of highest product with ``weights`` (term to weight, none negative); the smaller id first.

    Bounds per block are written once. Rounds read the blocks of highest bound, few at first, which raises the score to
    beat; the last round reads all others that may still hold a document as good as the k-th. A document is in one block,
    so every round has whole scores and the result is exact. ``k`` rows are kept on the driver between rounds.
    """
    asked = postings.where(F.col("term").isin(*weights))
    bounds = materialize(
        bounds.where(F.col("term").isin(*weights)).groupBy("block").agg(
            F.sum(F.col("most") * _weight(weights)).alias("bound"), F.sum("n").alias("n")
        ), "block-bounds",
    )
    blocks, held = bounds.agg(F.count("*"), F.sum("n")).first()
    spark, schema = postings.sparkSession, scores(postings, weights).schema
    best, done, read, count, more = [], [], 0, FIRST_BLOCKS, blocks > 0
    for last in (*[False] * ROUNDS, True):
        left = bounds.where(~F.col("block").isin(*done)) if done else bounds
        if len(best) == k:
            # Bounds add up the same numbers as scores or larger ones, in another order.
            left = left.where(F.col("bound") >= best[-1].cosine * (1 - 1e-9))
        if last:
            left = materialize(left.select("block", "n"), "blocks") if more else left.limit(0)
            read += left.agg(F.sum("n")).first()[0] or 0
            rows = asked.join(left, "block", "left_semi")
        else:
            picked = left.orderBy(F.desc("bound"), "block").limit(count).collect() if more else []
            # Few enough to be named in a filter of the scan.
            done += [r.block for r in picked]
            read += sum(r.n for r in picked)
            more = len(picked) == count
            rows = asked.where(F.col("block").isin(*(r.block for r in picked))) if picked else None
            count *= GROWTH
        if rows is not None and (more or not last):
            found = spark.createDataFrame(best, schema).unionByName(scores(rows, weights))
            best = found.orderBy(F.desc("cosine"), "doc").limit(k).collect()
        if not more:
            break
    return Found(spark.createDataFrame(best, schema), read, held or 0)
