import random
import re

import pytest
from pyspark.sql import functions as F

from colsight.llm.decontaminate import build_index, decontaminate
from tests.llm.conftest import ODD, rows_of


def words(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(rows, items, size):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add(str(item))
    out = []
    for d, t, *_ in rows:
        w, hit, found = words(t), set(), set()
        for window, ids in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i:i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    found |= ids
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def figures(found):
    return sorted(
        ((r.doc_id, r.n_words, sum(t - f for f, t in zip(r.hit_from, r.hit_to)), sorted(r.items)) for r in found.collect()),
        key=repr,
    )


def tables(spark, documents, seed):
    rnd = random.Random(seed)
    vocabulary = ["a", "b", "é", "c1", "D", "漢", "e-f"]
    items = [(k % 9, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 9)))) for k in range(14)]
    items += [(99, None), (100, "..."), (None, "a b c1 D")]
    rows = [(k, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 80)))) for k in range(30)]
    rows += [(k, f"x. {rnd.choice(items)[1]} y " + rows[k][1]) for k in range(10)] + [(0, rows[0][1]), (None, rows[1][1])]
    return rows, items, documents(rows), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_as_brute_force(spark, documents, block_bytes):
    rows, items, docs, bench = tables(spark, documents, 7)
    assert figures(decontaminate(docs, bench, size=4, block_bytes=block_bytes)) == brute(rows, items, 4)


def test_proximity(spark, documents):
    bench = spark.createDataFrame([(1, "red fox jumps over lazy dogs")], "item_id long, text string")
    rows = [(1, "the fox was red and jumps over " + "z " * 50), (2, "red " + "z " * 30 + "fox jumps over lazy dogs"),
            (3, "lazy over jumps fox red dogs"), (4, "lazy over jumps"), (5, "fox red dogs")]
    got = {r.doc_id: (r.items, r.near_items) for r in decontaminate(documents(rows), bench, anchors=3, span=10).collect()}
    assert got[3] == ([], ["1"]) and got[4] == got[5] == ([], []) and got[1][0] == got[2][0] == []


def test_index_holds_all_words(documents):
    index = build_index(documents([(1, "a b a"), (2, "b")]).coalesce(1)).select(F.sum(F.size("places")).alias("n"))
    assert index.first().n == 4


def test_odd_tables(spark, odd, clashing, documents):
    bench = spark.createDataFrame([(1, "beta gamma")], "item_id long, text string")
    want = brute(ODD, [(1, "beta gamma")], 10)
    assert figures(decontaminate(odd, bench)) == figures(decontaminate(clashing, bench)) == want
    none = spark.createDataFrame([], "item_id long, text string")
    assert figures(decontaminate(odd, none)) == brute(ODD, [], 10)
    assert decontaminate(documents([]), bench).count() == 0
    assert rows_of(decontaminate(documents([(1, "x")]), none), "doc_id", "n_words") == [(1, 1)]
