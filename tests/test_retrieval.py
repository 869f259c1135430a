import math
import re
from collections import Counter

import pytest

from colsight.operators.retrieval import search, tfidf_weights

TEXTS = {
    1: "the cat sat on the mat", 2: "A dog and a cat; the dog barked!", 3: "naïve été words, été again", 4: "x y",
    5: "cat " * 50 + "mat",
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "id int, body string")


def brute(stop, limit):
    counts = {d: Counter(w for w in re.findall(r"\w{2,}", t.lower()) if w not in stop) for d, t in TEXTS.items()}
    totals = Counter()
    for c in counts.values():
        totals.update(c)
    terms = [t for t, _ in sorted(totals.items(), key=lambda x: (-x[1], x[0]))][:limit]
    df = {t: sum(t in c for c in counts.values()) for t in terms}
    idf = {t: math.log((1 + len(TEXTS)) / (1 + df[t])) + 1 for t in terms}
    weights = {}
    for d, c in counts.items():
        raw = {t: c[t] * idf[t] for t in terms if c[t]}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        weights[d] = {t: w / norm for t, w in raw.items()}
    return weights, idf


@pytest.mark.parametrize("limit", [None, 1000, 3])
def test_weights_and_scores_match_brute_force(docs, limit):
    stop = ("the", "on")
    weights, idf = brute(stop, limit)
    got = {(r["doc"], r["term"]): r["weight"] for r in tfidf_weights(
        docs, "id", "body", stop_words=stop, max_terms=limit).collect()}
    assert got == pytest.approx({(d, t): w for d, ws in weights.items() for t, w in ws.items()})
    asked = {t: n * idf[t] for t, n in Counter(["cat", "cat", "mat", "zebra"]).items() if t in idf}
    norm = math.sqrt(sum(w * w for w in asked.values()))
    want = {d: sum(w * asked.get(t, 0) for t, w in ws.items()) / norm for d, ws in weights.items()}
    rows = search(docs, "id", "body", "Cat cat mat zebra", k=None, stop_words=stop, max_terms=limit).collect()
    assert {r["doc"]: r["cosine"] for r in rows} == pytest.approx(want)
    assert all(r["score"] == max(0.1, r["cosine"]) for r in rows)
    assert [r["doc"] for r in rows] == [d for d, _ in sorted(want.items(), key=lambda x: (-round(x[1], 12), x[0]))]


def test_queries_without_terms(docs):
    assert [tuple(r) for r in search(docs, "id", "body", "  ").collect()] == [(i, None, 0.85) for i in (1, 2, 3)]
    assert [r["score"] for r in search(docs, "id", "body", "zebra").collect()] == [0.1] * 3
    assert [r["doc"] for r in search(docs, "id", "body", "barked", k=1).collect()] == [2]
