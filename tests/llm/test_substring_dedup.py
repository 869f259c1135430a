import collections
import hashlib
import random

import pytest

import colsight.llm.repeats as repeats
from colsight.llm import sketch
from colsight.llm.prefix_free import cut_repeated_bytes
from colsight.llm.substring_dedup import cut_repeated_words
from tests.llm.conftest import ODD, rows_of


def covered(hits, length, count):
    gone = [False] * count
    for i in hits:
        gone[i:i + length] = [True] * length
    return gone


def brute_bytes(rows, length):
    texts = [(d, (t or "").encode()) for d, t, *_ in rows]
    times = collections.Counter(b[i:i + length] for _, b in texts for i in range(len(b) - length + 1))
    out = []
    for d, b in texts:
        gone = covered([i for i in range(len(b) - length + 1) if times[b[i:i + length]] > 1], length, len(b))
        spans = sum(g and not before for g, before in zip(gone, [False, *gone]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def brute_words(rows, length):
    texts = [(d, (t or "").encode().split()) for d, t, *_ in rows]
    first = {}
    for d, w in texts:
        for i in range(len(w) - length + 1) if d is not None else ():
            key = tuple(w[i:i + length])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, w in texts:
        hits = []
        for i in range(len(w) - length + 1):
            least = first.get(tuple(w[i:i + length]))
            if least is not None and (d is None or least < d):
                hits.append(i)
        gone = covered(hits, length, len(w))
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def mixed_rows():
    """Texts pieced together from one another, with repeats inside, odd ids and shared passages."""
    rnd = random.Random(5)
    base = [" ".join(rnd.choice(["a", "bb", "c", "é", "dd"]) for _ in range(rnd.randint(0, 60))) for _ in range(30)]
    texts = list(base)
    for _ in range(40):
        one, other = rnd.choice(base), rnd.choice(base)
        texts.append(one[:rnd.randint(0, len(one))] + other[rnd.randint(0, len(other)):])
    texts += [None, "", "a" * 200, "x" * 37, base[3], base[3]]
    return [(rnd.choice([None, *range(50)]) if rnd.random() < 0.2 else k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("together", [4096, 0])
@pytest.mark.parametrize("length", [1, 2, 5, 40])
def test_bytes_as_brute_force(documents, monkeypatch, length, together):
    monkeypatch.setattr(repeats, "TOGETHER", together)
    rows = mixed_rows()
    assert rows_of(cut_repeated_bytes(documents(rows), length, reach=max(1, length // 3))) == brute_bytes(rows, length)


@pytest.mark.parametrize("together", [4096, 0])
@pytest.mark.parametrize("length", [1, 2, 5, 12])
def test_words_as_brute_force(documents, monkeypatch, length, together):
    monkeypatch.setattr(repeats, "TOGETHER", together)
    rows = mixed_rows()
    assert rows_of(cut_repeated_words(documents(rows), length)) == brute_words(rows, length)


def test_odd_tables(odd, clashing, documents):
    assert rows_of(cut_repeated_words(odd, 3)) == rows_of(cut_repeated_words(clashing, 3)) == brute_words(ODD, 3)
    assert rows_of(cut_repeated_bytes(odd, 9)) == rows_of(cut_repeated_bytes(clashing, 9)) == brute_bytes(ODD, 9)
    assert cut_repeated_words(documents([])).count() == cut_repeated_bytes(documents([])).count() == 0


def test_long_text_is_cut_into_steps(documents, monkeypatch):
    monkeypatch.setattr(repeats, "STEP", 64)
    rnd = random.Random(2)
    passage = "".join(rnd.choice("abcdef ") for _ in range(300))
    rows = [(k, "".join(rnd.choice("abcdef ") for _ in range(rnd.randint(0, 150))) + passage) for k in range(6)]
    assert rows_of(cut_repeated_bytes(documents(rows), 30, reach=10)) == brute_bytes(rows, 30)
    assert rows_of(cut_repeated_words(documents(rows), 6)) == brute_words(rows, 6)


def test_kept_texts(documents):
    rows = [(1, "a b c d e f"), (2, "x a b c d y")]
    got = {r.doc_id: r.kept_text for r in cut_repeated_words(documents(rows), 4, texts=True).collect()}
    assert got == {1: "a b c d e f", 2: "x y"}
    got = {r.doc_id: bytes(r.kept) for r in cut_repeated_bytes(documents(rows), 7, texts=True).collect()}
    assert got == {1: b"e f", 2: b"x y"}


def test_a_full_sketch_loses_nothing(documents, monkeypatch):
    """With far too few counters every key looks repeated, and results stay the same."""
    monkeypatch.setattr(sketch, "WIDTH_BITS", 16)
    for name in ("partial_sketches", "merged", "passed"):
        function = getattr(sketch, name)
        defaults = tuple(16 if d == 26 else d for d in function.__defaults__)
        monkeypatch.setattr(function, "__defaults__", defaults)
    rows = mixed_rows()
    assert rows_of(cut_repeated_words(documents(rows), 5)) == brute_words(rows, 5)
