import random

import pytest
from pyspark.sql import functions as F

from colsight.operators import postings
from colsight.operators.postings import best_documents, scores
from colsight.operators.retrieval import build_index, index_weights, search_index


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(4)
    rows = []
    for k in range(6000):
        words = ["common"] * rnd.choice([1, 1, 1, 2, 5]) + ["often"] * (k % 3 == 0) + ["rare"] * (k % 997 == 0)
        words += [f"w{rnd.randrange(400)}" for _ in range(rnd.randint(3, 60))]
        rows.append((k, " ".join(words)))
    return spark.createDataFrame(rows, "id int, body string").repartition(4)


@pytest.fixture(scope="module")
def index(corpus):
    return build_index(corpus, "id", "body", stop_words=())


@pytest.mark.parametrize("weights", [
    {"common": 1.0}, {"often": 1.0}, {"common": 0.2, "rare": 0.9}, {"common": 0.6, "often": 0.8}, {"w1": 0.5, "w2": 0.5, "w3": 0.1},
])
@pytest.mark.parametrize("k", [1, 3, 40])
def test_the_best_are_those_of_all_scores(index, weights, k):
    every = sorted(scores(index.postings, weights).collect(), key=lambda r: (-r.cosine, r.doc))[:k]
    found = best_documents(index.postings, index.bounds, weights, k)
    got = sorted(found.best.collect(), key=lambda r: (-r.cosine, r.doc))
    assert [r.doc for r in got] == [r.doc for r in every]
    assert [r.cosine for r in got] == pytest.approx([r.cosine for r in every])
    assert found.read <= found.held == index.postings.where(F.col("term").isin(*weights)).count()


def test_few_postings_of_a_frequent_term_are_read(index):
    found = best_documents(index.postings, index.bounds, {"common": 1.0}, 3)
    assert found.held == 6000 and found.read < found.held / 5
    # The share falls as the term's postings grow: the first round has a fixed number of blocks.
    assert found.read <= 64 * (postings.FIRST_BLOCKS + 3)


def test_blocks_are_bounded_and_whole(index, corpus):
    assert index.bounds.agg(F.max("n")).first()[0] <= 1 << postings.BLOCK_BITS
    assert index.bounds.agg(F.sum("n")).first()[0] == index.postings.count()
    joined = index.postings.join(index.bounds, ["term", "block"])
    assert joined.where("weight > most").isEmpty() and index.postings.groupBy("doc").agg(
        F.countDistinct("block").alias("b")).where("b > 1").isEmpty()
    lengths = index_weights(index).groupBy("doc").agg(F.sum(F.col("weight") * F.col("weight")).alias("s"))
    assert lengths.count() == 6000 and lengths.where(F.abs(F.col("s") - 1) > 1e-9).isEmpty()
    assert index_weights(index).groupBy("doc", "term").count().where("count > 1").isEmpty()


def test_a_round_filters_the_scan(index):
    rows = scores(index.postings.where(F.col("block").isin(1, 2)), {"common": 1.0})
    plan = rows._jdf.queryExecution().toString()
    assert "In(block, [1,2])" in plan and "EqualTo(term,common)" in plan


def test_more_wanted_than_there_are(spark, index):
    rows = search_index(index, "rare", k=10).collect()
    assert [r.doc for r in rows if r.cosine > 0] == [r.doc for r in rows][:7] and len(rows) == 10
    assert [r.doc for r in rows if r.cosine == 0] == [1, 2, 3]
    tiny = build_index(spark.createDataFrame([(None, "a1 b1"), (1, None), (2, ""), (3, "a1 a1")], "id int, body string"), "id", "body")
    assert {r.doc: round(r.cosine, 3) for r in search_index(tiny, "a1", k=2).collect()} == {3: 1.0, None: 0.619}
    assert build_index(spark.createDataFrame([], "id int, body string"), "id", "body").postings.count() == 0
