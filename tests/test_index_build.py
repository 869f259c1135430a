import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colsight.operators import retrieval
from colsight.operators.postings import block_postings
from colsight.operators.retrieval import build_index, index_weights, term_counts, tfidf_weights

STOP = ("the", "of")


def pairs(counts):
    return {(r.doc, r.term): r.tf for r in counts.select("doc", F.inline("terms")).collect()}


def brute(rows):
    total = Counter()
    for doc, text in rows:
        total.update((doc, w) for w in re.findall(r"\w{2,}", (text or "").lower()) if w not in STOP)
    return dict(total)


def test_terms_are_counted_in_their_rows_without_a_shuffle(spark):
    rows = [(k, f"the cat of w{k % 7} cat ünï w{k % 3}") for k in range(50)] + [(90, None), (91, "the of"), (92, "")]
    counts = term_counts(spark.createDataFrame(rows, "id int, body string"), "id", "body", STOP)
    assert "Exchange" not in counts._jdf.queryExecution().toString()
    assert pairs(counts) == brute(rows) and counts.count() == 50


def test_rows_of_one_key_are_one_document(spark):
    rows = [(1, "aa bb aa"), (1, "aa the cc"), (None, "aa dd"), (None, "dd ee"), (None, None), (2, "aa"), (3, None)]
    counts = term_counts(spark.createDataFrame(rows, "id int, body string"), "id", "body", STOP)
    assert pairs(counts) == brute(rows)
    assert counts.select("doc", F.inline("terms")).groupBy("doc", "term").count().where("count > 1").isEmpty()


@pytest.mark.parametrize("share", [1e-6, 0.05, 2.0])
def test_broadcast_and_shuffled_terms_have_the_same_weights(spark, monkeypatch, share):
    rows = [(k, " ".join(f"w{j}" for j in range(k % 9 + 1)) + f" only{k}") for k in range(40)]
    docs = spark.createDataFrame(rows, "id int, body string")
    want = {(r.doc, r.term): (r.tf, r.weight) for r in tfidf_weights(docs, "id", "body").collect()}
    monkeypatch.setattr(retrieval, "_HOT_TERM_SHARE", share)
    got = {(r.doc, r.term): (r.tf, r.weight) for r in tfidf_weights(docs, "id", "body").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_postings_and_bounds_are_one_table_of_one_shuffle(spark):
    index = build_index(spark.createDataFrame([(k, "aa bb" + " cc" * (k % 4)) for k in range(300)], "id int, body string"), "id", "body")
    assert set(index.bounds.inputFiles()) == set(index.postings.inputFiles())
    most = index_weights(index).groupBy("term").agg(F.max("weight").alias("w"), F.count("*").alias("n"))
    held = index.bounds.groupBy("term").agg(F.max("most").alias("w"), F.sum("n").alias("n"))
    assert {tuple(r) for r in most.collect()} == {tuple(r) for r in held.collect()}
    plan = block_postings(index.postings)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
