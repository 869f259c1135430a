"""Standardised features, K-means segments, their profiles and names, and a two-dimensional projection."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsight.functions.numbers import as_number, col
from colsight.session import dealt, materialize

# Deviation from the overall mean that names a segment, and the guard in its denominator.
NAMING_DEVIATION = 0.15
NAMING_GUARD = 1e-5

#: Training stops once the squared moves of all centres sum to no more than this.
TOLERANCE = 1e-4

#: Distinct points from which starts are drawn, each weighed by its rows; training reads all rows.
SEED_ROWS = 20_000

#: Points whose distances to all centres a task holds at a time.
BLOCK = 2048


@dataclass(frozen=True)
class Scaling:
    """Population mean and standard deviation per column over complete rows."""

    names: list[str]
    means: list[float]
    stds: list[float]
    n_rows: int

    def columns(self, df: DataFrame) -> list[Column]:
        """Standardised columns; a constant column becomes zero."""
        return [
            (as_number(df, n) - (m or 0.0)) / (s if s else 1.0) for n, m, s in zip(self.names, self.means, self.stds)
        ]


def complete_rows(df: DataFrame, names: list[str]) -> DataFrame:
    keep = F.lit(True)
    for n in names:
        keep = keep & as_number(df, n).isNotNull()
    return df.where(keep)


def fit_scaling(df: DataFrame, names: list[str]) -> Scaling:
    rows = complete_rows(df, names)
    numbers = [as_number(rows, n) for n in names]
    row = rows.agg(
        F.count(F.lit(1)), *(F.avg(x) for x in numbers), *(F.stddev_pop(x) for x in numbers)
    ).first()
    p = len(names)
    return Scaling(list(names), list(row[1 : p + 1]), list(row[p + 1 :]), row[0])


def standardise(df: DataFrame, names: list[str], scaling: Scaling | None = None) -> DataFrame:
    """Complete rows with ``names`` at zero mean and unit population deviation."""
    scaling = scaling or fit_scaling(df, names)
    scaled = dict(zip(names, scaling.columns(df)))
    return complete_rows(df, names).select(*(scaled[c].alias(c) if c in scaled else col(c) for c in df.columns))


def _with_features(df: DataFrame, names: list[str], scaling: Scaling) -> DataFrame:
    """Complete rows plus a vector column ``features``; the original columns stay as they are."""
    rows = complete_rows(df, names)
    inputs = [f"_z{i}" for i in range(len(names))]
    wide = rows.select("*", *(z.alias(n) for z, n in zip(scaling.columns(rows), inputs)))
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(wide).drop(*inputs)


@dataclass(frozen=True)
class Segments:
    """A K-means result; ``rows`` holds the table's columns plus ``cluster`` (0-based) and ``features``.

    ``points`` holds these two alone, with features as an array: the same ones, from the columns that training wrote.
    """

    rows: DataFrame
    names: list[str]
    k: int
    inertia: float
    centers: np.ndarray
    scaling: Scaling
    points: DataFrame


@dataclass
class _Start:
    """One run of Lloyd's iterations."""

    centers: np.ndarray
    cost: float = math.inf
    moving: bool = True


def _first_centers(sample: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ on weighed points: each next centre is one drawn by its rows' squared distance to those before."""
    chosen = [sample[rng.choice(len(sample), p=weights / weights.sum())]]
    for _ in range(k - 1):
        gaps = weights * np.min([((sample - c) ** 2).sum(axis=1) for c in chosen], axis=0)
        total = gaps.sum()
        chosen.append(sample[rng.choice(len(sample), p=gaps / total) if total > 0 else rng.integers(len(sample))])
    return np.array(chosen)


def _settled(sample: np.ndarray, weights: np.ndarray, centers: np.ndarray, max_iter: int) -> np.ndarray:
    """Lloyd's iterations on the sample alone: a start from which few passes over all rows are left to do."""
    square = (sample * sample).sum(axis=1)
    for _ in range(max_iter):
        near = (square[:, None] - 2 * sample @ centers.T + (centers * centers).sum(axis=1)).argmin(axis=1)
        counts = np.bincount(near, weights=weights, minlength=len(centers))
        sums = np.column_stack([np.bincount(near, weights=weights * x, minlength=len(centers)) for x in sample.T])
        moved = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
        if ((moved - centers) ** 2).sum() <= TOLERANCE:
            return moved
        centers = moved
    return centers


def _sample(points: DataFrame, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``SEED_ROWS`` distinct points of lowest hash, or all if there are fewer, and the number of rows of each."""
    draw = F.shiftrightunsigned(F.xxhash64(*points.columns, F.lit(seed)), 2)
    distinct = points.agg(F.approx_count_distinct(F.struct(*points.columns))).first()[0]
    share = min(1.0, 1.2 * SEED_ROWS / max(1, distinct))
    while True:
        # Only points of low hash are grouped.
        near = points.where(draw <= int(share * 2.0**62)).groupBy(*points.columns).agg(F.count("*").alias("n"))
        lowest = near.orderBy(F.xxhash64(*points.columns, F.lit(seed)), *points.columns).limit(SEED_ROWS).collect()
        if len(lowest) == SEED_ROWS or share == 1.0:
            break
        # The estimate was too high.
        share = min(1.0, 2 * share)
    rows = np.array(lowest, dtype=float).reshape(len(lowest), len(points.columns) + 1)
    return rows[:, :-1], rows[:, -1]


def _blocks(batches):
    """The batches' columns as matrices with a row per column, of at most ``BLOCK`` points and few smaller ones."""
    held, size = [], 0
    for batch in batches:
        x = np.array([c.to_numpy() for c in batch.columns])
        for at in range(0, batch.num_rows, BLOCK):
            part = x[:, at:at + BLOCK]
            if size + part.shape[1] > BLOCK:
                yield np.concatenate(held, axis=1)
                held, size = [], 0
            held.append(part)
            size += part.shape[1]
    if size:
        yield np.concatenate(held, axis=1)


def _scan(points: DataFrame, starts: list[_Start]) -> dict[tuple[int, int], tuple]:
    """(start, cluster) to (rows, cost, sums of coordinates), for all moving starts in one pass over all rows."""
    axes = points.columns
    moving = [(i, s.centers) for i, s in enumerate(starts) if s.moving]
    sent = points.sparkSession.sparkContext.broadcast(([i for i, _ in moving], np.array([c for _, c in moving])))

    def add(batches):
        numbers, centers = sent.value
        s, k, p = centers.shape
        flat = centers.reshape(s * k, p)
        length = (flat * flat).sum(axis=1)
        # Times a point's (1, its square, coordinates): distance less that square, which does not change the nearest.
        inward = np.column_stack([length, np.zeros(s * k), -2.0 * flat])
        total, gaps, marks = np.zeros((s * k, p + 2)), np.empty((s * k, BLOCK)), np.empty((s * k, BLOCK))
        for x in _blocks(batches):
            size = x.shape[1]
            figures = np.vstack([np.ones(size), (x * x).sum(axis=0), x])
            # Arrays used again, as fresh ones of this size cost more than the sums.
            gap, mark = (whole.ravel()[:s * k * size].reshape(s * k, size) for whole in (gaps, marks))
            np.matmul(inward, figures, out=gap)
            split = gap.reshape(s, k, size)
            mine = split == split.min(axis=1, keepdims=True)
            if np.count_nonzero(mine) > s * size:
                # Of centres equally near the first.
                mine &= mine.cumsum(axis=1) == 1
            mark[:] = mine.reshape(s * k, size)
            total += mark @ figures.T
        n, square, sums = total[:, 0], total[:, 1], total[:, 2:]
        cost = np.maximum(square - 2 * (sums * flat).sum(axis=1) + n * length, 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(numbers, k), pa.int32()), pa.array(np.tile(np.arange(k), s), pa.int32()),
             pa.array(n), pa.array(cost), *(pa.array(column) for column in sums.T)],
            names=["start", "cluster", "n", "cost", *axes],
        )

    schema = "start int, cluster int, n double, cost double, " + ", ".join(f"{c} double" for c in axes)
    sums = points.mapInArrow(add, schema).groupBy("start", "cluster").agg(
        *(F.sum(c).alias(c) for c in ("n", "cost", *axes))
    )
    found = {(r[0], r[1]): (r[2], r[3], np.array(r[4:])) for r in sums.collect()}
    sent.destroy()
    return found


def segments(
    df: DataFrame, names: list[str], k: int = 4, *, seed: int = 42, restarts: int = 10, max_iter: int = 100,
    partitions: int | None = None,
) -> Segments | None:
    """K-means on standardised complete rows, best of several starts; None below two columns or three rows.

    The standardised columns are written once. Every iteration is one pass over all of them that moves all starts at
    once; only sums per start and cluster travel, so copies or one big segment do not skew the work, and a start that
    rests drops out. Starts are drawn by k-means++ from the ``SEED_ROWS`` distinct points of lowest hash, weighed by
    their rows, so they don't depend on the layout, and settle on these before the passes over all rows. Clusters are numbered by their centres in ascending order. ``partitions`` deals the rows anew before
    training, for a table of few splits.
    """
    if len(names) < 2:
        return None
    scaling = fit_scaling(df, names)
    k = min(k, scaling.n_rows)
    if scaling.n_rows < 3 or k < 2:
        return None
    complete = complete_rows(df, names)
    scaled = complete.select(*(z.cast("double").alias(f"z{i}") for i, z in enumerate(scaling.columns(complete))))
    points = materialize(dealt(scaled, partitions) if partitions else scaled, "points")
    sample, weights = _sample(points, seed)
    starts = [
        _Start(_settled(sample, weights, _first_centers(sample, weights, k, np.random.default_rng([seed, i])), max_iter))
        for i in range(restarts)
    ]
    for step in range(max_iter + 1):
        sums = _scan(points, starts)
        for i, start in enumerate(starts):
            if not start.moving:
                continue
            start.cost = sum(sums[i, c][1] for c in range(k) if (i, c) in sums)
            moved = start.centers.copy()
            for c in range(k):
                if (i, c) in sums and sums[i, c][0]:
                    moved[c] = sums[i, c][2] / sums[i, c][0]
            start.moving = step < max_iter and ((moved - start.centers) ** 2).sum() > TOLERANCE
            if start.moving:
                start.centers = moved
        if not any(s.moving for s in starts):
            break
    best = min(starts, key=lambda s: s.cost)
    centers = best.centers[np.lexsort(best.centers.T[::-1])]
    featured = _with_features(df, names, scaling)

    def nearest(axes: list[Column]) -> Column:
        gaps = F.array(*(sum(((z - float(v)) * (z - float(v)) for z, v in zip(axes, c)), F.lit(0.0)) for c in centers))
        return F.array_position(gaps, F.array_min(gaps)).cast("int") - 1

    axes = [F.col(c) for c in points.columns]
    return Segments(
        featured.withColumn("cluster", nearest(scaling.columns(featured))), list(names), k, float(best.cost), centers,
        scaling, points.select(nearest(axes).alias("cluster"), F.array(*axes).alias("features")),
    )


def sizes(rows: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Rows and share per cluster."""
    total = rows.agg(F.count(F.lit(1))).scalar()
    return (
        rows.groupBy(col(cluster)).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / total)
    )


def profiles(rows: DataFrame, names: list[str], cluster: str = "cluster") -> DataFrame:
    """Mean of each numeric column per cluster."""
    return rows.groupBy(col(cluster)).agg(*(F.avg(as_number(rows, n)).alias(n) for n in names))


def personas(rows: DataFrame, names: list[str], cluster: str = "cluster") -> DataFrame:
    """A name per cluster from the column whose mean deviates most, relative to its overall mean.

    Works on the profile table: clusters times columns, whatever the number of rows.
    """
    overall = rows.agg(*(F.avg(as_number(rows, n)).alias(f"m{i}") for i, n in enumerate(names)))
    means = rows.groupBy(col(cluster)).agg(*(F.avg(as_number(rows, n)).alias(f"c{i}") for i, n in enumerate(names)))
    means = means.withColumn("_overall", overall.select(F.array(*overall.columns)).scalar())
    centre = F.col("_overall")
    deviations = F.array(
        *(
            F.struct(
                ((F.col(f"c{i}") - centre[i]) / (F.abs(centre[i]) + NAMING_GUARD)).alias("dev"),
                F.lit(-i).alias("first"),
                F.lit(n).alias("name"),
                F.col(f"c{i}").alias("mean"),
            )
            for i, n in enumerate(names)
        )
    )
    flipped = F.transform(
        deviations, lambda d: F.struct((-d["dev"]).alias("dev"), d["first"], d["name"], d["mean"])
    )
    high, low = F.array_max(deviations), F.array_max(flipped)

    def shown(mean: Column, one_digit: bool) -> Column:
        small = F.format_string("%.2f", mean)
        middle = F.format_string("%,.1f", mean) if one_digit else small
        return (
            F.when(F.abs(mean) >= 100, F.format_string("%,.0f", mean)).when(F.abs(mean) >= 1, middle).otherwise(small)
        )

    # The texts of segment names.
    persona = (
        F.when(
            high["dev"] > NAMING_DEVIATION,
            F.concat(F.lit("High "), high["name"], F.lit(" (Avg "), shown(high["mean"], True), F.lit(")")),
        )
        .when(
            -low["dev"] < -NAMING_DEVIATION,
            F.concat(F.lit("Low "), low["name"], F.lit(" (Avg "), shown(low["mean"], False), F.lit(")")),
        )
        .otherwise(F.concat(F.lit("Moderate "), high["name"], F.lit(" Cohort")))
    )
    return means.select(col(cluster), persona.alias("persona"))


@dataclass(frozen=True)
class Projection:
    """Rows with ``pca1`` and ``pca2``, and the share of variance each one explains."""

    rows: DataFrame
    explained: list[float]


def project(df: DataFrame, names: list[str], scaling: Scaling | None = None) -> Projection:
    """First two principal components of the standardised columns.

    Signs are fixed so that the loading largest in size (the first of equals) is positive. Rows that carry
    ``features`` already are not standardised again. One column is its own first component, with a second of zero; an
    empty table keeps the schema.
    """
    scaling = scaling or fit_scaling(df, names)
    featured = df if "features" in df.columns else _with_features(df, names, scaling)
    if len(names) < 2 or not scaling.n_rows:
        own = vector_to_array(F.col("features"))[0] if names else F.lit(0.0)
        flat = featured.withColumn("pca1", own).withColumn("pca2", F.lit(0.0)).drop("features")
        return Projection(flat, [1.0 if scaling.n_rows else 0.0, 0.0])
    model = PCA(k=2, inputCol="features", outputCol="_pca").fit(featured)
    loadings = np.array(model.pc.toArray())
    signs = []
    for component in loadings.T:
        size = np.abs(component)
        first = int(np.flatnonzero(size >= size.max() - 1e-9)[0])
        signs.append(1.0 if component[first] > 0 else -1.0)
    parts = vector_to_array(F.col("_pca"))
    rows = (
        model.transform(featured)
        .withColumn("pca1", parts[0] * signs[0])
        .withColumn("pca2", parts[1] * signs[1])
        .drop("_pca", "features")
    )
    return Projection(rows, [float(x) for x in model.explainedVariance.toArray()])


def centroids(rows: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Mean projected point per cluster."""
    return rows.groupBy(col(cluster)).agg(F.avg("pca1").alias("pca1"), F.avg("pca2").alias("pca2"))


def silhouette_squared(rows: DataFrame, cluster: str = "cluster") -> float | None:
    """Mean silhouette over all rows with squared Euclidean distance, in one pass over per-cluster sums."""
    if rows.select(col(cluster)).distinct().limit(2).count() < 2:
        return None
    ready = rows.select("features", col(cluster).cast("double").alias("prediction"))
    return float(ClusteringEvaluator(metricName="silhouette").evaluate(ready))
