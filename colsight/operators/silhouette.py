"""Silhouettes of all rows with Euclidean distance, from distance sums over the cells of a space-partitioning tree.

A cell knows how many rows it has, their mean m and their mean squared distance v from it. For a point at distance d from
m the distances to the rows of the cell sum up to at least n d (they are convex) and at most n sqrt(d^2 + v) (Cauchy and
Schwarz). Sums over all cells so lie between two known numbers, and so does every silhouette; in k dimensions rows scattered
alike to all sides are 1 - 1/k of the way up, which is the value given. Cells come from a tree over a
bounded sample of distinct points, but their figures cover all rows, so the bound holds for all rows whatever the sample;
where there are fewer distinct points than cells, both numbers are the same and the result is exact.

Rows of one cell see the cells far from it almost alike. For a cell of many rows the sums over far cells are written once
as a Taylor polynomial in the rows' offset h from its mean, and each row takes the cells nearby one by one. Along a line the
fourth derivative of a distance D is at most 3 / D^3, so cutting off behind the cubes changes a distance by no more than
|h|^4 / 8 (D - |h|)^3, which widens both numbers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations_with_replacement, permutations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsight.functions.numbers import col
from colsight.session import dealt, materialize

#: Cells of all clusters together, and distinct points per cell that the tree is made from.
CELLS, POINTS_PER_CELL = 16_384, 4

#: Distances a task computes at a time.
STEP = 1 << 16

#: Cells nearby that each row is taken to one by one, and rows from which a cell has a polynomial for the others.
NEAR, SHARED = 256, 24

#: Dimensions up to which there are polynomials, and bytes that those of all cells may take, as they are sent to all tasks.
AXES, TABLE = 6, 64 << 20

#: Rows a task sorts by cell at a time, and cells it measures at a time for a polynomial.
ROWS, PART = 1 << 20, 2048


@dataclass(frozen=True)
class Silhouette:
    """The mean over all rows; the true one differs from it by no more than ``error``."""

    value: float
    error: float
    n_rows: int


@dataclass(frozen=True)
class _Tree:
    """Cuts of the cells of one cluster: inner nodes have an axis, leaves (axis -1) the number of their cell in ``low``."""

    axis: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def cells(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        open_ = np.flatnonzero(self.axis[node] >= 0)
        while len(open_):
            at = node[open_]
            up = points[open_, self.axis[at]] > self.cut[at]
            node[open_] = np.where(up, self.high[at], self.low[at])
            open_ = open_[self.axis[node[open_]] >= 0]
        return self.low[node]


def _planted_tree(points: np.ndarray, cells: int) -> _Tree:
    """Cuts the cell of widest scatter at the middle of its points along its widest axis, until there are enough."""
    nodes: list[list] = [[-1, 0.0, 0, 0]]
    heap = [(-float(points.var(axis=0).sum()) * len(points), 0, np.arange(len(points)))]
    made = 1
    while heap and made < cells:
        scatter, node, held = heapq.heappop(heap)
        if scatter == 0:
            break
        part = points[held]
        axis = int(part.var(axis=0).argmax())
        values = np.sort(part[:, axis])
        # The last value below the middle that has larger ones behind it.
        cut = values[max(0, min(len(values) // 2 - 1, np.searchsorted(values, values[-1]) - 1))]
        up = part[:, axis] > cut
        nodes[node][:] = [axis, float(cut), len(nodes), len(nodes) + 1]
        for side in (~up, up):
            own = held[side]
            nodes.append([-1, 0.0, 0, 0])
            heapq.heappush(heap, (-float(points[own].var(axis=0).sum()) * len(own), len(nodes) - 1, own))
        made += 1
    leaf = 0
    for node in nodes:
        if node[0] < 0:
            node[2] = leaf
            leaf += 1
    axis, cut, low, high = zip(*nodes, strict=True)
    return _Tree(np.array(axis), np.array(cut), np.array(low), np.array(high))


def _points(rows: DataFrame, cluster: str, features: str) -> DataFrame:
    """(c, x): cluster and coordinates of the rows that have both."""
    kind = rows.schema[features].dataType.typeName()
    x = col(features) if kind == "array" else vector_to_array(col(features))
    return rows.where(col(cluster).isNotNull() & col(features).isNotNull()).select(
        col(cluster).cast("string").alias("c"), x.cast("array<double>").alias("x")
    )


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch], middle: np.ndarray) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Clusters, the number of each row's one and its coordinates less ``middle``, in blocks of about ``ROWS`` rows."""
    names: dict[str, int] = {}
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        coded = batch.column("c").dictionary_encode()
        numbers = np.array([names.setdefault(c, len(names)) for c in coded.dictionary.to_pylist()])
        held.append((numbers[coded.indices.to_numpy()], _matrix(batch.column("x")) - middle))
        size += batch.num_rows
        if size >= ROWS:
            yield list(names), *map(np.concatenate, zip(*held, strict=True))
            held, size = [], 0
    if held:
        yield list(names), *map(np.concatenate, zip(*held, strict=True))


def _trees(points: DataFrame, centre: np.ndarray, cells: int) -> dict[str, _Tree]:
    """A tree for each cluster from the distinct points of lowest hash, at most ``POINTS_PER_CELL`` times ``cells``."""
    most = cells * POINTS_PER_CELL
    distinct = points.agg(F.approx_count_distinct(F.struct("c", "x"))).first()[0]
    share = min(1.0, 1.1 * most / max(1, distinct))
    drawn = points.withColumn("draw", F.xxhash64("c", "x")).where(F.shiftrightunsigned("draw", 2) <= int(share * 2.0**62))
    rows = drawn.select("c", "x", "draw").distinct().orderBy("draw").limit(most).collect()
    held: dict[str, list] = {}
    for r in rows:
        held.setdefault(r.c, []).append(r.x)
    total = len(rows)
    return {c: _planted_tree(np.array(x) - centre, max(1, round(cells * len(x) / total))) for c, x in held.items()}


def _cells(
    points: DataFrame, trees: dict[str, _Tree], centre: np.ndarray
) -> tuple[dict[str, tuple[np.ndarray, ...]], dict[str, np.ndarray]]:
    """Per cluster the rows (n), means and mean squared deviations (v) of its cells, over all points, and their leaves."""
    d = len(centre)
    sent = points.sparkSession.sparkContext.broadcast((trees, centre))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, middle = sent.value
        sums: dict[str, np.ndarray] = {}
        for names, number, x in _blocks(batches, middle):
            for i, c in enumerate(names):
                own = x[number == i]
                tree = known.get(c)
                cell = tree.cells(own) if tree else np.zeros(len(own), np.int64)
                size = int(tree.low[tree.axis < 0].max()) + 1 if tree else 1
                total = sums.setdefault(c, np.zeros((size, d + 2)))
                for k, figure in enumerate((None, (own * own).sum(axis=1), *own.T)):
                    total[:, k] += np.bincount(cell, figure, size)
        for c, total in sums.items():
            used = np.flatnonzero(total[:, 0])
            yield pa.RecordBatch.from_arrays(
                [pa.array([c] * len(used)), pa.array(used), *(pa.array(v) for v in total[used].T)],
                names=["c", "cell", "n", "square", *(f"s{i}" for i in range(d))],
            )

    schema = "c string, cell long, n double, square double, " + ", ".join(f"s{i} double" for i in range(d))
    names = ["n", "square", *(f"s{i}" for i in range(d))]
    rows = points.mapInArrow(add, schema).groupBy("c", "cell").agg(*(F.sum(n).alias(n) for n in names)).collect()
    sent.destroy()
    found: dict[str, list] = {}
    leaves: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.c, r.cell)):
        found.setdefault(r.c, []).append(r[2:])
        leaves.setdefault(r.c, []).append(r.cell)
    out = {}
    for c, values in found.items():
        table = np.array(values)
        n, mean = table[:, 0], table[:, 2:] / table[:, :1]
        spread = table[:, 1] / n - (mean * mean).sum(axis=1)
        # What is left of two equal numbers after rounding is no spread.
        out[c] = (n, mean, np.where(spread > 1e-12 * table[:, 1] / n, np.maximum(spread, 0), 0.0))
    return out, {c: np.array(v) for c, v in leaves.items()}


class _Terms:
    """The products of up to three of d coordinates: 1, single ones, products of two and of three, a row each."""

    def __init__(self, d: int):
        self.d = d
        pairs, triples = (list(combinations_with_replacement(range(d), k)) for k in (2, 3))
        self.one, self.other = zip(*pairs, strict=True)
        first = {pair: k for k, pair in enumerate(pairs)}
        self.two, self.third = zip(*((first[t[:2]], t[2]) for t in triples), strict=True)
        # How often a product comes in a power of a sum.
        self.twice, self.thrice = (np.array([len(set(permutations(t))) for t in some]) for some in (pairs, triples))
        self.squares = [first[i, i] for i in range(d)]
        place = {t: k for k, t in enumerate(triples)}
        self.cubes = np.array([[place[tuple(sorted((i, i, j)))] for j in range(d)] for i in range(d)])
        self.singles, self.count = slice(1, 1 + d), 1 + d + len(pairs) + len(triples)
        self.pairs, self.triples = slice(1 + d, 1 + d + len(pairs)), slice(1 + d + len(pairs), self.count)

    def of(self, x: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        """The terms of points, of which x has a column each."""
        out = np.empty((self.count, x.shape[1])) if out is None else out
        out[0] = 1
        out[self.singles] = x
        pairs, triples = out[self.pairs], out[self.triples]
        for k, (i, j) in enumerate(zip(self.one, self.other, strict=True)):
            np.multiply(x[i], x[j], out=pairs[k])
        for k, (i, j) in enumerate(zip(self.two, self.third, strict=True)):
            np.multiply(pairs[i], x[j], out=triples[k])
        return out

    def polynomial(self, lengths: float, first: np.ndarray, third: np.ndarray, fifth: np.ndarray) -> np.ndarray:
        """The sum over cells of n sqrt(E^2 + 2 p h + h h) up to the cubes of h, as a coefficient for each term of h.

        ``lengths`` is the sum of n E; ``first``, ``third`` and ``fifth`` are the terms of p summed up with n / E, n / E^3
        and n / E^5.
        """
        out = np.empty(self.count)
        out[0], out[self.singles] = lengths, first[self.singles]
        two, three = out[self.pairs], out[self.triples]
        two[:] = -0.5 * self.twice * third[self.pairs]
        two[self.squares] += 0.5 * first[0]
        three[:] = 0.5 * self.thrice * fifth[self.triples]
        for row in self.cubes:
            three[row] -= 0.5 * third[self.singles]
        return out


@dataclass(frozen=True)
class _Far:
    """Polynomials of ``cells``, a row each; ``row`` gives a cell's row or -1.

    ``near`` holds the numbers of the cells nearby; the others are at ``reach`` or further. ``sums`` has a row for each
    cluster's least and largest sum over those, ``tail`` their sums of n / 8 D^3 by cluster.
    """

    cells: np.ndarray
    row: np.ndarray
    near: np.ndarray
    reach: np.ndarray
    sums: np.ndarray
    tail: np.ndarray


class _Expansion:
    """Makes rows of :class:`_Far`; ``starts`` says where clusters begin among the cells."""

    def __init__(self, n: np.ndarray, mean: np.ndarray, spread: np.ndarray, starts: np.ndarray):
        self.n, self.mean, self.spread, self.starts = n, np.ascontiguousarray(mean.T), spread, starts.tolist()
        self.terms = _Terms(len(self.mean))
        # Arrays used again, as fresh ones cost more than what is done in them.
        self.apart, self.gap, self.products = np.empty(self.mean.shape), np.empty(len(n)), np.empty(self.terms.count * PART)
        self.weights, self.square = np.empty(6 * PART), np.empty(3 * PART)

    def of(self, cell: int) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
        """A cell's near cells, reach, sums and tail."""
        apart, gap, terms = self.apart, self.gap, self.terms
        np.subtract(self.mean[:, cell:cell + 1], self.mean, out=apart)
        np.einsum("ij,ij->j", apart, apart, out=gap)
        near = np.argpartition(gap, NEAR)[:NEAR + 1]
        # Of one more the farthest, from which the others begin.
        last = near[gap[near].argmax()]
        near, reach = near[near != last], float(np.sqrt(gap[last]))
        # Cells nearby weigh nothing; at a distance of 1 they cause no division by zero.
        kept, self.n[near] = self.n[near], 0.0
        gap[near] = 1.0
        sums, tail = np.zeros((len(self.starts) - 1, 2, terms.count)), np.zeros(len(self.starts) - 1)
        for c, (begin, end) in enumerate(zip(self.starts[:-1], self.starts[1:], strict=True)):
            lengths, parts = np.zeros(2), np.zeros((terms.count, 6))
            for at in range(begin, end, PART):
                part, size = slice(at, min(at + PART, end)), min(PART, end - at)
                weights, (square, once, inverse) = self.weights[:6 * size].reshape(6, -1), self.square[:3 * size].reshape(3, -1)
                for k in range(2):
                    np.add(gap[part], self.spread[part] if k else 0.0, out=square)
                    np.divide(1.0, square, out=inverse)
                    np.multiply(np.sqrt(square, out=once), self.n[part], out=once)
                    lengths[k] += once.sum()
                    for i in range(3 * k, 3 * k + 3):
                        once = np.multiply(once, inverse, out=weights[i])
                    once = self.square[size:2 * size]
                parts += terms.of(apart[:, part], self.products[:terms.count * size].reshape(-1, size)) @ weights.T
                tail[c] += weights[1].sum() / 8
            for k in range(2):
                sums[c, k] = terms.polynomial(lengths[k], *parts[:, 3 * k:3 * k + 3].T)
        self.n[near] = kept
        return near, reach, sums, tail


def _polynomials(points: DataFrame, known: dict[str, tuple[np.ndarray, ...]]) -> _Far | None:
    """The polynomials of the cells with ``SHARED`` rows or more, those of most rows first if not all of them may be held."""
    n, mean, spread = (np.concatenate([cell[i] for cell in known.values()]) for i in range(3))
    starts, d = np.cumsum([0, *(len(cell[0]) for cell in known.values())]), mean.shape[1]
    if d > AXES or len(n) <= NEAR:
        return None
    most = TABLE // (8 * (2 * _Terms(d).count + 1) * len(known) + 4 * NEAR)
    wanted = np.sort(np.argsort(-n, kind="stable")[:most])
    wanted = wanted[n[wanted] >= SHARED]
    if not len(wanted):
        return None
    spark = points.sparkSession
    sent = spark.sparkContext.broadcast((n, mean, spread, starts, wanted))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *cells, asked = sent.value
        # A copy of the rows, as the expansion writes there.
        expansion = _Expansion(cells[0].copy(), *cells[1:])
        for batch in batches:
            rows = batch.column("id").to_numpy()
            made = [expansion.of(cell) for cell in asked[rows].tolist()]
            yield pa.RecordBatch.from_arrays([
                pa.array(rows), pa.array([near.astype(np.int32).tobytes() for near, *_ in made], pa.binary()),
                pa.array([reach for _, reach, *_ in made], pa.float64()),
                pa.array([sums.tobytes() for *_, sums, _ in made], pa.binary()),
                pa.array([tail.tobytes() for *_, tail in made], pa.binary()),
            ], names=["row", "near", "reach", "sums", "tail"])

    asked = spark.range(0, len(wanted), 1, min(len(wanted), 4 * spark.sparkContext.defaultParallelism))
    found = sorted(asked.mapInArrow(expand, "row long, near binary, reach double, sums binary, tail binary").collect())
    sent.destroy()
    row = np.full(len(n), -1)
    row[wanted] = np.arange(len(wanted))
    k = len(known)
    return _Far(
        wanted, row, np.array([np.frombuffer(r.near, np.int32) for r in found]), np.array([r.reach for r in found]),
        np.array([np.frombuffer(r.sums).reshape(2 * k, -1) for r in found]),
        np.array([np.frombuffer(r.tail) for r in found]),
    )


def _sums(x: np.ndarray, cell: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest that the distances of each point to the rows of all cells may sum up to."""
    n, mean, spread = cell
    low, high = np.empty(len(x)), np.empty(len(x))
    square = (x * x).sum(axis=1)
    # Squared distances as one product of (x, 1, x^2) and (-2 mean, mean^2, 1).
    outward = np.column_stack([x, np.ones(len(x)), square])
    inward = np.vstack([-2 * mean.T, (mean * mean).sum(axis=1), np.ones(len(n))])
    least = 1e-12 * (1 + square)[:, None]
    step, scattered = max(1, STEP // len(n)), bool(spread.any())
    # Arrays that fit a core's cache and are used again: fresh ones cost more than the roots.
    gaps, wide = np.empty((step, len(n))), np.empty((step, len(n)))
    for at in range(0, len(x), step):
        gap = gaps[:len(x) - at]
        np.matmul(outward[at:at + step], inward, out=gap)
        # Points that are a cell's mean are at no distance from it, up to rounding.
        np.multiply(gap, gap > least[at:at + step], out=gap)
        if scattered:
            far = np.add(gap, spread, out=wide[:len(gap)])
            np.dot(np.sqrt(far, out=far), n, out=high[at:at + step])
        np.dot(np.sqrt(gap, out=gap), n, out=low[at:at + step])
    return low, high if scattered else low.copy()


def _of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    most = np.maximum(a, b)
    return np.divide(b - a, most, out=np.zeros(len(a)), where=most > 0)


class _Judge:
    """Sums of silhouettes of rows of one cluster at a time: least, most likely and largest."""

    def __init__(self, clusters: dict, leaves: dict, trees: dict, far: _Far | None):
        self.clusters, self.leaves, self.trees, self.far = clusters, leaves, trees, far
        self.names = list(clusters)
        self.sizes = np.array([cell[0].sum() for cell in clusters.values()])
        self.starts = np.cumsum([0, *(len(cell[0]) for cell in clusters.values())])
        self.n, self.mean, self.spread = (np.concatenate([cell[i] for cell in clusters.values()]) for i in range(3))
        self.owner = np.repeat(np.arange(len(clusters)), np.diff(self.starts))
        self.d = self.mean.shape[1]
        self.terms = _Terms(self.d) if far else None
        # Arrays used again, as in the sums over all cells.
        self.held = np.empty((2, max(STEP, NEAR)))

    def sums(self, name: str, x: np.ndarray) -> np.ndarray:
        c = self.names.index(name)
        if self.sizes[c] == 1 or not len(x):
            return np.zeros(3)
        if self.far is None:
            return self._all(c, x)
        tree = self.trees.get(name)
        leaf = tree.cells(x) if tree else np.zeros(len(x), np.int64)
        cell = self.starts[c] + np.searchsorted(self.leaves[name], leaf)
        row = self.far.row[cell]
        off = x - self.mean[cell]
        length = np.sqrt((off * off).sum(axis=1))
        # A polynomial serves up to half the way to where the far cells begin.
        shared = (row >= 0) & (2 * length < self.far.reach[row])
        total = self._all(c, x[~shared])
        order = np.flatnonzero(shared)
        order = order[np.argsort(row[order], kind="stable")]
        cuts = np.flatnonzero(np.diff(row[order], prepend=-1, append=-1))
        for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            mine = order[begin:end]
            total += self._shared(c, int(row[mine[0]]), off[mine], length[mine])
        return total

    def _all(self, c: int, x: np.ndarray) -> np.ndarray:
        """By the distances to all cells."""
        sums = [_sums(x, cell) for cell in self.clusters.values()]
        return self._silhouettes(c, *(np.array([s[i] for s in sums]) for i in range(2)))

    def _shared(self, c: int, row: int, off: np.ndarray, length: np.ndarray) -> np.ndarray:
        """By the distances to the cells nearby and the polynomials of the others, for rows of one cell."""
        far, near = self.far, self.far.near[row]
        mean, spread = self.mean[near] - self.mean[far.cells[row]], self.spread[near][:, None]
        square = (mean * mean).sum(axis=1)[:, None]
        weights = np.zeros((len(self.names), len(near)))
        weights[self.owner[near], np.arange(len(near))] = self.n[near]
        others = far.sums[row] @ self.terms.of(off.T)
        low, high = others[0::2], others[1::2]
        mean *= -2
        step = max(1, STEP // len(near))
        for at in range(0, len(off), step):
            part = off[at:at + step].T
            own = (part * part).sum(axis=0)
            gap, wide = (held[:len(near) * len(own)].reshape(len(near), -1) for held in self.held)
            np.matmul(mean, part, out=gap)
            gap += square
            gap += own
            # Points that are a cell's mean are at no distance from it, up to rounding.
            np.multiply(gap, gap > 1e-12 * (1 + own), out=gap)
            np.add(gap, spread, out=wide)
            high[:, at:at + step] += weights @ np.sqrt(wide, out=wide)
            low[:, at:at + step] += weights @ np.sqrt(gap, out=gap)
        cut = length ** 4 / (1 - length / far.reach[row]) ** 3
        return self._silhouettes(c, low, high, far.tail[row][:, None] * cut)

    def _silhouettes(self, c: int, low: np.ndarray, high: np.ndarray, cut: np.ndarray | float = 0.0) -> np.ndarray:
        """From the least and largest sums, a row for each cluster, which may be off by ``cut``."""
        sums = np.array([np.maximum(low - cut, 0), low + (1 - 1 / self.d) * (high - low), high + cut])
        a = sums[:, c] / (self.sizes[c] - 1)
        sums /= self.sizes[:, None]
        sums[:, c] = np.inf
        b = sums.min(axis=1)
        return np.array([_of(a[2 - k], b[k]).sum() for k in range(3)])


def silhouette(
    rows: DataFrame, cluster: str = "cluster", features: str = "features", cells: int = CELLS, partitions: int | None = None
) -> Silhouette | None:
    """Mean silhouette over all rows with Euclidean distance; None below two clusters.

    ``features`` is a vector or an array of numbers of one length. Rows without it or without a cluster do not count. A
    row alone in its cluster has silhouette 0. Four passes over the rows: mean, sample, cells, silhouettes; the last one
    takes each row to at most ``cells`` cells, in cells of many rows to ``NEAR`` of them and a polynomial for the others.
    More cells give a smaller error. ``partitions`` deals the rows of a table of fewer splits anew, which would leave most
    cores idle in the last pass.
    """
    points = _points(rows, cluster, features)
    few = partitions and points.rdd.getNumPartitions() < partitions
    points = materialize(dealt(points, partitions) if few else points, "silhouette-points")
    first = points.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    d = first.d
    centre = np.array(points.agg(*(F.avg(F.col("x")[i]) for i in range(d))).first(), dtype=float)
    trees = _trees(points, centre, cells)
    known, leaves = _cells(points, trees, centre)
    if len(known) < 2:
        return None
    far = _polynomials(points, known)
    sent = points.sparkSession.sparkContext.broadcast((known, leaves, trees, centre, far))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clusters, places, cuts, middle, others = sent.value
        judged = _Judge(clusters, places, cuts, others)
        total = np.zeros(4)
        for names, number, x in _blocks(batches, middle):
            for i, c in enumerate(names):
                own = x[number == i]
                total += [len(own), *judged.sums(c, own)]
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], names=["n", "low", "value", "high"])

    names = ["n", "low", "value", "high"]
    n, low, value, high = points.mapInArrow(judge, ", ".join(f"{c} double" for c in names)).agg(
        *(F.sum(c) for c in names)
    ).first()
    sent.destroy()
    return Silhouette(value / n, max(value - low, high - value) / n, int(n))
