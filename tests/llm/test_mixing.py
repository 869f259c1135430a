import random

import pytest

from colsight.llm import mixing
from colsight.llm.mixing import mix_sources
from tests.llm.conftest import ODD, rows_of


def targets(rows, weights=(1, 2, 3), most=3.0):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").encode().split())
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        open_ones = [s for s in names if s not in capped]
        shares = {s: rest * weight[s] / sum(weight[x] for x in open_ones) for s in open_ones}
        over = {s for s in open_ones if shares[s] >= most * sizes[s]}
        if not over:
            return sizes, {s: shares.get(s, most * sizes[s]) for s in names}
        capped |= over


def check(rows, got):
    sizes, goal = targets(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted(
        (d is None, d or 0, len((t or "").encode().split())) for d, t, _ in rows
    )
    for source, target in goal.items():
        own = [r for r in got if r.source == source]
        assert all(r.target == pytest.approx(target) and r.source_size == sizes[source] for r in own)
        assert abs(sum(r.taken for r in own) - target) <= max(r.size for r in own) + 1e-6
    for r in got:
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        if r.source_size and r.size:
            assert r.copies in (int(r.target / r.source_size - 1e-9), int(r.target / r.source_size - 1e-9) + 1)


def some_rows(seed, count=400):
    rnd = random.Random(seed)
    names = ["hot"] * 10 + ["a", "B", "é", None, "zz", ""]
    return [(k, "w " * rnd.choice((0, 1, 3, 10, 50)), rnd.choice(names)) for k in range(count)]


@pytest.mark.parametrize("fan_in", [2, 5, 64])
def test_targets_are_met(documents, monkeypatch, fan_in):
    monkeypatch.setattr(mixing, "FAN_IN", fan_in)
    rows = some_rows(fan_in)
    check(rows, mix_sources(documents(rows)).collect())


def test_reruns_agree_in_any_layout(documents):
    rows = some_rows(1)
    once = rows_of(mix_sources(documents(rows)))
    assert once == rows_of(mix_sources(documents(rows[::-1]).repartition(7)))
    assert once != rows_of(mix_sources(documents(rows), seed=12))


def test_fractions_are_kept_on_average(documents):
    """Over many seeds each document gets its expected number of copies."""
    rows = [(k, "w " * (1 + k % 5), "ab"[k % 2]) for k in range(30)]
    total = {}
    for seed in range(30):
        for r in mix_sources(documents(rows), seed=seed).collect():
            total[r.doc_id] = total.get(r.doc_id, 0) + r.copies
            want = r.target / r.source_size
    assert abs(sum(total.values()) / (30 * 30) - 1) < 0.1
    assert all(v < 30 * 3 for v in total.values()) and want > 0


def test_odd_tables(odd, clashing, documents):
    got = mix_sources(odd).collect()
    check(ODD, got)
    assert sorted(r.replica for r in got if r.doc_id == 1 and r.source == "a") == [1, 2]
    assert rows_of(mix_sources(odd)) == rows_of(mix_sources(clashing))
    assert mix_sources(documents([])).count() == 0
    assert [r.taken for r in mix_sources(documents([(1, "", "a"), (2, None, "b")])).collect()] == [0, 0]
