import hashlib
import random
import zlib

import numpy as np
import pytest

from colsight.llm import catalog, periodic
from colsight.llm.periodic import collapse_runs, find_runs
from colsight.llm.recompression import Grammar
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"


def brute_runs(words, least=12):
    """(start, length, period) by comparing every word with the one q later, for every q."""
    names = {}
    numbers = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    smallest = {}
    for q in range(1, len(words) // 2 + 1):
        same = np.concatenate([[0], (numbers[:-q] == numbers[q:]).astype(np.int8), [0]])
        turns = np.flatnonzero(np.diff(same)).reshape(-1, 2)
        for a, b in turns.tolist():
            if b - a + q >= max(least, 2 * q):
                smallest.setdefault((a, b - a + q), q)
    return sorted(((s, n, q) for (s, n), q in smallest.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = set()
    for s, length, q in runs:
        gone.update(range(s + q, s + length))
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (
        doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
    )


def sequences(rnd):
    for _ in range(rnd.randrange(1, 6)):
        n = rnd.randrange(0, rnd.choice([3, 20, 90]))
        some = [rnd.randrange(rnd.choice([1, 2, 3, 5])) for _ in range(n)]
        if n and rnd.random() < 0.5:
            a, p = rnd.randrange(n), rnd.randrange(1, n + 1)
            some = [x if i < a else some[min(n - 1, a + (i - a) % p)] for i, x in enumerate(some)]
        yield some


@pytest.mark.parametrize("seed", range(40))
def test_extensions_and_runs_by_definition(seed, monkeypatch):
    monkeypatch.setattr(periodic, "STEP", 16 if seed % 2 else 1 << 19)
    many = list(sequences(random.Random(seed)))
    lengths, joined = np.array([len(s) for s in many]), np.array([x for s in many for x in s], np.int64)
    grammar = Grammar(joined, lengths)
    for s, begin in zip(many, grammar.begins.tolist(), strict=True):
        pairs = [(x, y) for y in range(len(s)) for x in range(y)]
        x, y = (np.array([p[k] for p in pairs], np.int64) + begin for k in (0, 1))
        ahead = [next((k for k in range(len(s) - b) if s[a + k] != s[b + k]), len(s) - b) for a, b in pairs]
        back = [next((k for k in range(a) if s[a - 1 - k] != s[b - 1 - k]), a) for a, b in pairs]
        assert grammar.forward(x, y).tolist() == ahead and grammar.backward(x, y).tolist() == back
    for least in (2, 5, 12):
        want = [[k, *r] for k, s in enumerate(many) for r in brute_runs(s, least)]
        assert find_runs(joined, lengths, least).tolist() == want


def test_every_sequence_becomes_one_name():
    rnd = np.random.default_rng(3)
    lengths = np.array([0, 1, 700, 2, 5000, 0])
    grammar = Grammar(rnd.integers(0, 40, lengths.sum()), lengths)
    top = grammar.levels[-1]
    assert len(top.symbols) == len(lengths) + np.count_nonzero(lengths) and len(grammar.levels) < 80
    assert top.spans.tolist() == [n for k in lengths.tolist() for n in ([k, 1] if k else [1])]


def rows_of(spark, documents):
    docs = spark.createDataFrame([(r[0], r[1]) for r in documents], "doc_id long, text string").repartition(3)
    found = collapse_runs(docs)
    return {r.doc_id: r for r in found.collect()}


def test_spans_and_collapsed_text(spark):
    got = rows_of(spark, [
        (1, "x " + "a b c " * 5 + "y"), (2, "a " * 12), (3, "a " * 11), (4, "a b " * 6 + "c d e " * 4), (5, None),
        (6, "a b c d e f g " * 2), (7, " \t"), (8, "q " * 200_000),
    ])
    assert [tuple(r) for r in got[1].runs] == [(1, 15, 3)] and got[1].collapsed == "x a b c y"
    assert [tuple(r) for r in got[2].runs] == [(0, 12, 1)] and got[2].collapsed == "a"
    assert got[3].runs == [] and got[3].collapsed == " ".join("a" * 11)
    assert [tuple(r) for r in got[4].runs] == [(0, 12, 2), (12, 12, 3)] and got[4].collapsed == "a b c d e"
    assert [tuple(r) for r in got[6].runs] == [(0, 14, 7)] and got[6].collapsed == "a b c d e f g"
    for empty in (5, 7):
        assert (got[empty].n_words, got[empty].runs, got[empty].collapsed) == (0, [], "")
    assert got[8].collapsed == "q" and got[8].n_words == 200_000


def test_odd_rows_clashing_columns_and_empty_tables(odd, clashing, documents):
    assert collapse_runs(documents([])).count() == 0
    plain = sorted(map(repr, collapse_runs(odd).collect()))
    assert len(plain) == len(ODD) and sorted(map(repr, collapse_runs(clashing).collect())) == plain


def test_planting_as_defined(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(k, " \n".join(f"w{rnd.randrange(300)}" for _ in range(rnd.choice([0, 1, 2, 5, 40, 200])))) for k in range(300)]
    rows += [(k, None) for k in range(300, 340)] + [(None, "a b c " * 9), (0, "A a " * 20), (0, "A a " * 20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in catalog.op11_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((brute_row(*r) for r in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 4


def test_query_by_definition(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in catalog.op11_periodic_runs(spark, SF).collect()), key=repr)
    assert got == sorted((brute_row(*r) for r in rows), key=repr)


def test_columns(spark):
    kinds = dict(catalog.op11_periodic_runs(spark, SF).dtypes)
    longs = ("n_runs", "start", "length", "period", "exponent_milli")
    assert {k: kinds[k] for k in longs} == dict.fromkeys(longs, "bigint")
    assert kinds["runs_sha256"] == kinds["collapsed_sha256"] == "string"
