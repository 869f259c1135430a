import collections
import math
import random
import zlib

import pytest

from colsight.llm import katz
from colsight.llm.katz import katz_discounts, score_texts, split, train
from tests.llm.conftest import ODD, rows_of


def tokens(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()


def is_held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 5 == 1


class Brute:
    def __init__(self, rows, most=7):
        self.one, pairs, self.texts = collections.Counter(), collections.Counter(), 0
        for d, t, *_ in rows:
            if not is_held(d):
                line = [*tokens(t), "end"]
                self.one.update(line)
                pairs.update(zip(["begin", *line], line))
                self.texts += 1
        self.total, self.distinct = sum(self.one.values()), len(self.one)
        self.pairs = pairs
        self.cuts = katz_discounts(collections.Counter(pairs.values()), most)
        mass, seen = collections.Counter(), collections.Counter()
        for (a, b), n in self.pairs.items():
            mass[a] += n * self.cuts.get(n, 1)
            seen[a] += self.p(b)
        self.alpha = {a: (1 - mass[a] / self.history(a)) / (1 - seen[a]) for a in mass}

    def p(self, word):
        return (self.one[word] + 0.5) / (self.total + 0.5 * (self.distinct + 1))

    def history(self, word):
        return (self.texts if word == "begin" else self.one[word]) + 0.5

    def conditional(self, a, b):
        n = self.pairs.get((a, b))
        return n * self.cuts.get(n, 1) / self.history(a) if n else self.alpha.get(a, 1) * self.p(b)

    def row(self, d, t):
        line = [*tokens(t), "end"]
        base = sum(math.log10(self.p(w)) for w in line)
        model = sum(math.log10(self.conditional(a, b)) for a, b in zip(["begin", *line], line))
        return d, is_held(d), len(line), sum(self.one[w] > 0 for w in line), self.total, base, model


def compare(got, rows):
    brute = Brute(rows)
    want = sorted((brute.row(d, t) for d, t, *_ in rows), key=lambda r: repr((r[:5], round(r[5], 4))))
    have = sorted((tuple(r) for r in got), key=lambda r: repr((r[:5], round(r[5], 4))))
    assert [r[:5] for r in have] == [r[:5] for r in want]
    for a, b in zip(have, want):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def some_rows(seed=3, count=120):
    rnd = random.Random(seed)
    words = ["a", "B", "c", "dd", "é", "Zz", "rare1", "rare2"] + [f"u{k}" for k in range(60)]
    odds = [40, 30, 20, 10, 10, 5, 1, 1] + [1] * 60
    rows = [(k, " ".join(rnd.choices(words, odds, k=rnd.randint(0, 40)))) for k in range(count)]
    return [*rows, (None, "a b c"), (7, None), (8, ""), (9, " \n"), (11, rows[3][1]), (11, rows[3][1])]


@pytest.mark.parametrize("heads", [(1 << 10, 1 << 10), (3, 4), (0, 0), (1 << 10, 0), (30, 1 << 10)])
def test_scores_as_brute_force(documents, monkeypatch, heads):
    monkeypatch.setattr(katz, "HEAD_TOKENS", heads[0])
    monkeypatch.setattr(katz, "HEAD_BIGRAMS", heads[1])
    monkeypatch.setattr(katz, "DEALT", 16)
    rows = some_rows()
    compare(score_texts(documents(rows)).collect(), rows)


def test_successors_sum_to_one():
    brute = Brute(some_rows())
    words = [*brute.one]
    unknown = 0.5 / (brute.total + 0.5 * (brute.distinct + 1))
    assert len(brute.alpha) > 5
    for a in brute.alpha:
        assert sum(brute.conditional(a, b) for b in words) + brute.alpha[a] * unknown == pytest.approx(1)


def test_model_beats_base_on_held_out_text(documents):
    rnd = random.Random(1)
    follow = {w: rnd.sample(range(40), 3) for w in range(40)}
    rows = []
    for k in range(300):
        line = [rnd.randrange(40)]
        for _ in range(30):
            line.append(rnd.choice(follow[line[-1]]))
        rows.append((k, " ".join(f"w{x}" for x in line)))
    got = [r for r in score_texts(documents(rows)).collect() if r.held_out]
    assert got and sum(r.score for r in got) > 0.6 * sum(r.base_score for r in got)


def test_small_flushes_count_alike(documents, monkeypatch):
    monkeypatch.setattr(katz, "FLUSH", 8)
    rows = some_rows(5)
    compare(score_texts(documents(rows)).collect(), rows)


def test_odd_tables(odd, clashing, documents):
    compare(score_texts(odd).collect(), ODD)
    assert rows_of(score_texts(odd), "doc_id", "n_tokens", "n_known") == rows_of(
        score_texts(clashing), "doc_id", "n_tokens", "n_known"
    )
    assert score_texts(documents([])).count() == 0
    held = next(k for k in range(100) if is_held(k))
    compare(score_texts(documents([(held, "only held out")])).collect(), [(held, "only held out")])


def test_tables_hold_the_model(documents):
    rows = some_rows()
    model = train(split(documents(rows), 5, 1).where("not held_out"))
    brute = Brute(rows)
    assert (model.total, model.distinct) == (brute.total, brute.distinct)
    assert sorted(r.n for r in model.bigrams.collect()) == sorted(brute.pairs.values())
    assert model.discounts == brute.cuts
