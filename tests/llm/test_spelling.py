import random
import re
import zlib
from collections import Counter

import pytest

from colsight.llm import catalog, common, trie
from colsight.llm.spelling import spelling_variants, vocabulary
from colsight.llm.trie import near_words
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    """The definition: one code point replaced, or put in on either side."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1:] == short for k in range(len(long)))


def brute_near(words):
    """All pairs, with those that share neither half left out by lengths only."""
    words = sorted(words)
    return {(a, b) for a in words for b in words if a != b and abs(len(a) - len(b)) <= 1 and one_edit(a, b)}


def deletions(word):
    return {word[:k] + word[k + 1:] for k in range(len(word))}


def quick_near(words):
    """The same through deletions: words one edit apart share one, or one is a deletion of the other."""
    words, at = set(words), {}
    for w in words:
        for d in deletions(w):
            at.setdefault(d, set()).add(w)
    pairs = {(a, b) for group in at.values() for a in group for b in group if a != b and one_edit(a, b)}
    for w in words:
        for d in deletions(w) & words:
            pairs |= {(w, d), (d, w)}
    return pairs


def brute_rows(documents):
    count = Counter()
    for doc_id, text in documents:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            if doc_id is not None:
                h = zlib.crc32(f"{doc_id}:{run}".encode())
                if h % 31 == 0:
                    k = h % len(run)
                    run = run[:k] + run[k + 1:]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    beside = {w: [] for w in words}
    for a, b in quick_near(words):
        beside[a].append(b)
    form = {}
    for w, others in beside.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(beside[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def got_rows(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def near(spark, words):
    table = spark.createDataFrame([(w,) for w in words], "word string").repartition(3)
    rows = [tuple(r) for r in near_words(table).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("letters,sizes,n", [("ab", (1, 7), 120), ("abcé", (5, 10), 700), ("a", (1, 30), 30), ("abcdefgh", (7, 9), 1500)])
def test_pairs_as_all_pairs(spark, letters, sizes, n):
    rnd = random.Random(n)
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randint(*sizes))) for _ in range(n)}
    for w in sorted(words)[::3]:
        k = rnd.randrange(len(w))
        words.add(w[:k] + rnd.choice(letters) + w[k + rnd.randrange(2):])
    words = {w for w in words if w}
    want = brute_near(words)
    assert quick_near(words) == want and near(spark, words) == want


def test_pairs_of_long_and_odd_words(spark):
    rnd = random.Random(1)
    base = "".join(rnd.choice("abc") for _ in range(20_000))
    words = {base, base[:7] + base[8:], base[:-1], base + "x", "z" + base[1:], base[:15_000] + "é" + base[15_001:], "𝒳" * 7, "𝒳" * 8}
    assert near(spark, words) == quick_near(words)


def test_one_prefix_of_very_many_words(spark, monkeypatch):
    monkeypatch.setattr(trie, "heavy_keys", lambda counted, held: common.heavy_keys(counted, held, 8, 50))
    rnd = random.Random(2)
    words = {"international" + "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))) for _ in range(200)}
    assert near(spark, words) == brute_near(words)


def test_forms_and_roots(spark, documents):
    rows = [(1, "Letters " * 200 + "leters " * 20 + "leterss " * 2 + "lettersx " * 3 + "once_upon abcdefg abcdefg abcdefgh", "a")]
    got = {r.word: r for r in spelling_variants(documents(rows)).collect()}
    assert set(got) == {"letters", "leterss", "lettersx", "abcdefg"}
    assert (got["lettersx"].form, got["lettersx"].form_n, got["letters"].form) == ("letters", 200, None)
    # Of "leterss" the more frequent neighbour would be "leters", which is too short to be a word.
    assert (got["leterss"].form, got["leterss"].root, got["leterss"].n_near) == (None, "leterss", 0)
    chain = [(1, "abcdefghij " * 400 + "abcdefghi " * 40 + "abcdefgh " * 4 + "abcdefg " * 2, "a")]
    got = {r.word: r for r in spelling_variants(documents(chain)).collect()}
    assert [got[w].root for w in ("abcdefg", "abcdefgh", "abcdefghi")] == ["abcdefg", "abcdefghij", "abcdefghij"]


def test_odd_rows_clashing_columns_and_empty_tables(odd, clashing, documents, spark):
    assert spelling_variants(documents([])).count() == 0
    assert spelling_variants(documents([(1, None), (2, ""), (3, "short")])).count() == 0
    assert spelling_variants(clashing, change=catalog.dropped_letter).columns[0] == "word"
    more = [*ODD, (None, "Fenêtres " * 30, None), (20, "fenêtre Fenêtre fenetres fenetres", "a"), (20, "fenêtre", "a")]
    want = brute_rows([(r[0], r[1]) for r in more])
    assert any(r[1] for r in want) and got_rows(spelling_variants(documents(more), change=catalog.dropped_letter)) == want
    assert near_words(spark.createDataFrame([], "word string")).count() == 0


def test_counts_are_whole_however_often_they_are_handed_on(odd, monkeypatch):
    from colsight.llm import spelling

    want = sorted(map(tuple, vocabulary(odd).collect()))
    monkeypatch.setattr(spelling, "FLUSH", 1)
    assert sorted(map(tuple, vocabulary(odd).collect())) == want


def test_query_by_definition(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_rows(rows)
    assert got_rows(catalog.op12_spelling_variants(spark, SF)) == want
    assert sum(r[1] is not None for r in want) > 0
