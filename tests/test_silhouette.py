import numpy as np
import pytest

from colsight.operators.silhouette import silhouette


def brute(points, labels):
    """Mean silhouette by all pairs."""
    gaps = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    out = []
    for i, own in enumerate(labels):
        if (labels == own).sum() == 1:
            out.append(0.0)
            continue
        a = gaps[i, labels == own].sum() / ((labels == own).sum() - 1)
        b = min(gaps[i, labels == other].mean() for other in set(labels.tolist()) - {own})
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


def frame(spark, points, labels):
    rows = [(int(c), [float(v) for v in p]) for c, p in zip(labels, points, strict=True)]
    return spark.createDataFrame(rows, "cluster int, features array<double>").repartition(4)


@pytest.mark.parametrize("d,spread", [(2, 0.3), (2, 2.0), (4, 1.0)])
def test_within_the_bound_and_a_thousandth(spark, d, spread):
    rng = np.random.default_rng(d)
    labels = rng.integers(0, 4, 3000)
    points = rng.normal(size=(4, d))[labels] * 3 + spread * rng.normal(size=(3000, d)) + 1000
    true = brute(points, labels)
    found = silhouette(frame(spark, points, labels), cells=1200)
    assert 0 < found.error and abs(found.value - true) <= min(found.error + 1e-9, 1e-3) and found.n_rows == 3000
    coarse = silhouette(frame(spark, points, labels), cells=40)
    assert abs(coarse.value - true) <= coarse.error and coarse.error > found.error
    exact = silhouette(frame(spark, points, labels))
    assert exact.error < 1e-9 and exact.value == pytest.approx(true, abs=1e-8)


def test_copies_single_rows_and_gaps(spark):
    points = np.array([[0.0, 0]] * 400 + [[1.0, 0]] * 3 + [[5.0, 5], [9.0, 9], [5.0, 5.5]])
    labels = np.array([0] * 403 + [1, 2, 1])
    found = silhouette(frame(spark, points, labels))
    assert found.value == pytest.approx(brute(points, labels), abs=1e-8) and found.error < 1e-9
    gaps = spark.createDataFrame([(None, [1.0, 2.0]), (0, None)], "cluster int, features array<double>")
    with_gaps = silhouette(frame(spark, points, labels).unionByName(gaps))
    assert with_gaps.n_rows == len(points) and with_gaps.value == pytest.approx(found.value)


def test_one_cluster_or_none(spark):
    assert silhouette(frame(spark, np.ones((5, 2)), np.zeros(5))) is None
    assert silhouette(frame(spark, np.zeros((0, 2)), np.zeros(0))) is None
    same = silhouette(frame(spark, np.ones((6, 2)), np.array([0, 0, 0, 1, 1, 1])))
    assert same.value == 0.0


def test_distance_sums_hold_little_at_a_time():
    import tracemalloc

    from colsight.operators.silhouette import _sums

    rng = np.random.default_rng(3)
    x, mean, n, spread = rng.normal(size=(1001, 4)), rng.normal(size=(4096, 4)), rng.integers(1, 9, 4096) * 1.0, rng.random(4096)
    x[7] = mean[5]
    tracemalloc.start()
    low, high = _sums(x, (n, mean, spread))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 << 20
    for i in (0, 7, 500, 1000):
        gaps = ((x[i] - mean) ** 2).sum(axis=1)
        assert low[i] == pytest.approx(np.sqrt(gaps) @ n) and high[i] == pytest.approx(np.sqrt(gaps + spread) @ n)


def test_rows_are_dealt_over_the_partitions_asked_for(spark, monkeypatch):
    from colsight.operators import silhouette as module

    written = []
    keep = module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, label: keep(df, label) if written.append(df.rdd.getNumPartitions()) is None else None)
    rng = np.random.default_rng(4)
    points, labels = rng.normal(size=(300, 2)), rng.integers(0, 3, 300)
    found = silhouette(frame(spark, points, labels).coalesce(1), partitions=6)
    assert written == [6] and found.value == pytest.approx(brute(points, labels), abs=1e-8)


def celled(d, n_rows=40_000, n_cells=700, seed=5):
    """Rows of three clusters, and the cells, trees and leaves of these as the operator has them."""
    from colsight.operators.silhouette import _planted_tree

    rng = np.random.default_rng(seed)
    labels = rng.integers(0, 3, n_rows)
    x = rng.normal(size=(3, d))[labels] + rng.normal(size=(n_rows, d)) * 0.6
    known, leaves, trees = {}, {}, {}
    for c in range(3):
        own = x[labels == c]
        trees[str(c)] = _planted_tree(own[::4], n_cells // 3)
        cell = trees[str(c)].cells(own)
        n = np.bincount(cell).astype(float)
        leaves[str(c)] = np.flatnonzero(n)
        n = n[n > 0]
        mean = np.column_stack([np.bincount(cell, v)[leaves[str(c)]] for v in own.T]) / n[:, None]
        known[str(c)] = (n, mean, np.bincount(cell, ((own - mean[np.searchsorted(leaves[str(c)], cell)]) ** 2).sum(axis=1))[leaves[str(c)]] / n)
    return x, labels, known, leaves, trees


def far_of(known, cells):
    from colsight.operators.silhouette import _Expansion, _Far

    n, mean, spread = (np.concatenate([cell[i] for cell in known.values()]) for i in range(3))
    expansion = _Expansion(n.copy(), mean, spread, np.cumsum([0, *(len(cell[0]) for cell in known.values())]))
    near, reach, sums, tail = zip(*(expansion.of(cell) for cell in cells), strict=True)
    row = np.full(len(n), -1)
    row[cells] = np.arange(len(cells))
    return _Far(np.array(cells), row, np.array(near), np.array(reach), np.array(sums).reshape(len(cells), 6, -1), np.array(tail)), expansion.n


@pytest.mark.parametrize("d", [1, 2, 4])
def test_far_cells_by_polynomials_within_the_bound(monkeypatch, d):
    """Rows of full cells are not taken to all cells, and what they get holds what the sums over all cells give."""
    from colsight.operators import silhouette as module

    monkeypatch.setattr(module, "NEAR", 64)
    x, labels, known, leaves, trees = celled(d)
    cells = list(range(len(known["0"][0]) + len(known["1"][0])))
    far, left = far_of(known, cells)
    assert (left == np.concatenate([cell[0] for cell in known.values()])).all()
    taken, plain = [], module._sums
    monkeypatch.setattr(module, "_sums", lambda rows, cell: taken.append(len(rows)) or plain(rows, cell))
    with_far, without = (module._Judge(known, leaves, trees, f) for f in (far, None))
    for c in range(3):
        own = x[labels == c]
        taken.clear()
        low, value, high = with_far.sums(str(c), own) / len(own)
        assert sum(taken) == 3 * len(own) if c == 2 else sum(taken) <= 3 * len(own) * {1: 0.01, 2: 0.05, 4: 0.5}[d]
        least, likely, most = without.sums(str(c), own) / len(own)
        assert low <= least + 1e-9 and most <= high + 1e-9
        assert value == pytest.approx(likely, abs=1e-4) and high - low <= 1.2 * (most - least) + 1e-9


def test_a_polynomial_is_off_by_its_cut_at_most(monkeypatch):
    from colsight.operators import silhouette as module

    monkeypatch.setattr(module, "NEAR", 64)
    _, _, known, leaves, trees = celled(4)
    far, _ = far_of(known, [7])
    judged, got = module._Judge(known, leaves, trees, far), []
    monkeypatch.setattr(judged, "_silhouettes", lambda c, *sums: got.extend(sums))
    rng = np.random.default_rng(8)
    off = rng.normal(size=(500, 4))
    length = far.reach[0] * rng.uniform(0, 0.5, 500)
    off *= (length / np.sqrt((off * off).sum(axis=1)))[:, None]
    judged._shared(0, 0, off, length)
    low, high, cut = got
    for c, cell in enumerate(known.values()):
        least, most = module._sums(judged.mean[7] + off, cell)
        assert (abs(low[c] - least) <= cut[c] + 1e-6 * least).all() and (abs(high[c] - most) <= cut[c] + 1e-6 * most).all()


def test_full_cells_against_all_pairs(spark):
    """With more cells than are near and many rows in each, so that most rows go by polynomials."""
    rng = np.random.default_rng(9)
    labels = rng.integers(0, 3, 12_000)
    points = rng.normal(size=(3, 2))[labels] * 2 + rng.normal(size=(12_000, 2))
    sums = np.empty((12_000, 3))
    for at in range(0, 12_000, 500):
        gaps = np.sqrt(((points[at:at + 500, None] - points[None]) ** 2).sum(axis=2))
        sums[at:at + 500] = np.column_stack([gaps[:, labels == c].sum(axis=1) for c in range(3)])
    sizes = np.bincount(labels)
    rows = np.arange(12_000)
    a = sums[rows, labels] / (sizes[labels] - 1)
    others = sums / sizes
    others[rows, labels] = np.inf
    b = others.min(axis=1)
    found = silhouette(frame(spark, points, labels), cells=360)
    true = float(((b - a) / np.maximum(a, b)).mean())
    assert found.n_rows == 12_000 and abs(found.value - true) <= min(found.error, 1e-3)


def test_segments_have_the_same_points_as_rows(spark):
    from colsight.operators.cluster import segments

    rng = np.random.default_rng(10)
    rows = [(float(a), float(b), k) for k, (a, b) in enumerate(rng.normal(size=(300, 2)) * [3, 50])] + [(None, 1.0, -1)]
    found = segments(spark.createDataFrame(rows, "a double, b double, k int"), ["a", "b"], 3)
    wide = sorted((r.cluster, *r.features.toArray().tolist()) for r in found.rows.collect())
    assert sorted((r.cluster, *r.features) for r in found.points.collect()) == wide and len(wide) == 300
