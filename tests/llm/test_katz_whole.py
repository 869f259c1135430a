import pytest

from colsight.llm import katz
from colsight.llm.catalog import QUERIES
from colsight.llm.katz import katz_discounts, split, train
from tests.llm.test_katz import Brute, some_rows


def test_all_bigrams_are_stored(documents):
    rows = some_rows()
    model, brute = train(split(documents(rows), 5, 1).where("not held_out")), Brute(rows)
    assert sorted(r.n for r in model.bigrams.collect()) == sorted(brute.pairs.values())
    assert model.discounts == brute.cuts and {1, 2} <= model.discounts.keys()


def test_discounts_set_free_the_singletons():
    counts = {1: 1000, 2: 400, 3: 220, 4: 140, 5: 100, 6: 75, 7: 58, 8: 46}
    cuts = katz_discounts(counts, 7)
    assert all(0 < d < 1 for d in cuts.values())
    assert sum((1 - d) * r * counts[r] for r, d in cuts.items()) == pytest.approx(counts[1])


def test_the_query_keeps_rare_bigrams(spark, monkeypatch):
    rare = []

    def watched(rows):
        model = train(rows)
        rare.append(model.bigrams.where("n < 3").count())
        return model

    monkeypatch.setattr(katz, "train", watched)
    QUERIES["op9_lm_scores"](spark, "/root/testdata/sf0.001")
    assert rare[0] > 0
