import itertools
import random

import numpy as np
import pytest
import xxhash

from colsight.llm.components import components
from colsight.llm.simhash import covering_masks, near_duplicates, near_links
from tests.llm.conftest import ODD, rows_of


def fingerprint(text, size=3):
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = lower.split()
    grams = [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, radius=2):
    prints = [fingerprint(t) for _, t, *_ in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            group[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, f"{prints[i]:016x}", least.get(find(i))) for i, (d, *_) in enumerate(rows)), key=repr)


def test_as_brute_force(documents):
    rnd = random.Random(4)
    words = [f"w{k}" for k in range(50)]
    rows = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 6)))) for k in range(60)]
    for k in range(60, 120):
        text = rnd.choice(rows)[1].split()
        if text:
            text[rnd.randrange(len(text))] = rnd.choice(words)
        rows.append((k, " ".join(text * rnd.randint(1, 3))))
    assert rows_of(near_duplicates(documents(rows))) == brute(rows)


def test_odd_tables(odd, clashing, documents):
    assert rows_of(near_duplicates(odd)) == rows_of(near_duplicates(clashing)) == brute(ODD)
    assert near_duplicates(documents([])).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_pair(radius):
    masks = covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for bits in itertools.combinations(range(64), radius):
        assert any(all(not mask >> b & 1 for b in bits) for mask in masks)


@pytest.mark.parametrize("radius", [1, 2])
def test_links_join_what_all_pairs_join(spark, radius):
    rng = np.random.default_rng(radius)
    seeds = rng.integers(-2**63, 2**63, 12)
    prints = {int(s) for s in seeds}
    for s in seeds.tolist():
        for _ in range(25):
            for b in rng.integers(0, 64, rng.integers(0, 4)).tolist():
                s = int(np.int64(s) ^ np.int64(np.uint64(1) << np.uint64(b)))
            prints.add(s)
    prints = sorted(prints)
    table = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {r.node: r.component for r in components(near_links(table, radius)).collect()}
    group = {p: p for p in prints}

    def find(p):
        while group[p] != p:
            p = group[p]
        return p

    for a, b in itertools.combinations(prints, 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= radius:
            one, other = find(a), find(b)
            group[max(one, other)] = min(one, other)
    assert {p: got.get(p, p) for p in prints} == {p: find(p) for p in prints}


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    edges = spark.createDataFrame([*path, *star, (5, 5), (7, 6)], "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(101)}, **{1000 + i: 1000 for i in range(200)}}
    assert components(edges.limit(0)).count() == 0
