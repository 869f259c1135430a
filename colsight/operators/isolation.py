"""Isolation forest (Liu, Ting and Zhou, ICDM 2008) as Spark jobs."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsight.functions.numbers import as_number, col
from colsight.operators.quantiles import exact_quantiles
from colsight.session import dealt, materialize

TREES = 100
TREE_ROWS = 256

#: Copies of a row up to which each one's draws are hashed; of more copies only the lowest draws are made.
FEW = 8

_NODE_SCHEMA = "tree int, node int, feature int, split double, left int, right int, size int"
_EULER = 0.5772156649015329


def mean_path(n):
    """Expected depth of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    long = 2.0 * (np.log(np.maximum(n - 1, 1)) + _EULER) - 2.0 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def _grow(rows: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """One random tree over a few hundred rows, as (node, feature, split, left, right, size)."""
    limit = math.ceil(math.log2(max(len(rows), 2)))
    nodes: list[tuple] = []
    waiting = [(0, rows, 0)]
    free = 1
    while waiting:
        node, part, depth = waiting.pop()
        low, high = (part.min(axis=0), part.max(axis=0)) if len(part) else (np.zeros(0), np.zeros(0))
        varied = np.flatnonzero(high > low)
        if depth >= limit or len(part) <= 1 or not len(varied):
            nodes.append((node, -1, 0.0, -1, -1, len(part)))
            continue
        feature = int(rng.choice(varied))
        split = float(rng.uniform(low[feature], high[feature]))
        goes_left = part[:, feature] <= split
        nodes.append((node, feature, split, free, free + 1, len(part)))
        waiting += [(free, part[goes_left], depth + 1), (free + 1, part[~goes_left], depth + 1)]
        free += 2
    return nodes


@dataclass(frozen=True)
class Forest:
    """Fitted trees; ``nodes`` has at most 511 rows per tree whatever the size of the data."""

    names: list[str]
    fills: list[float]
    nodes: pd.DataFrame
    tree_rows: int


def _tree_samples(rows: DataFrame, n_rows: int, trees: int, tree_rows: int, seed: int) -> DataFrame:
    """Rows with a tree number and a draw of their own; ``rows`` holds distinct rows under a ``key``, ``n`` times each (once
    without that column).

    A tree takes the lowest draws. Only those below a bound reach it that leaves it four times as many as it takes. The
    draws of a few copies are seeded hashes of key, tree and copy. Of many copies the ``tree_rows`` lowest are made in
    ascending order, as sums of exponential gaps, so a row costs the same however many copies it has.
    """
    bound = int(min(1.0, 4.0 * tree_rows / n_rows) * 2.0**62)
    rows = rows if "n" in rows.columns else rows.withColumn("n", F.lit(1))
    values = [c for c in rows.columns if c not in ("key", "n")]

    def hashed(tree, *copy):
        return F.shiftrightunsigned(F.xxhash64("key", tree, F.lit(seed), *copy), 2)

    # Exploded and filtered in one generated loop: no list of draws is made for a row.
    copies = rows.where(F.col("n") <= FEW).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    drawn = copies.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    draw = F.when(F.col("copy") == 0, hashed("tree")).otherwise(hashed("tree", "copy"))
    few = drawn.withColumn("draw", draw).where(F.col("draw") <= bound).select(*values, "tree", "draw")

    def lowest(batches):
        for batch in batches:
            for row, key, n in zip(batch[values].to_numpy(dtype=float), batch["key"], batch["n"], strict=True):
                rng = np.random.default_rng([int(key) % 2**64, seed])
                left = n - np.arange(min(n, tree_rows))
                drawn = -np.expm1(-np.cumsum(rng.exponential(size=(trees, len(left))) / left, axis=1)) * 2.0**62
                tree, copy = np.nonzero(drawn <= bound)
                out = pd.DataFrame(np.broadcast_to(row, (len(tree), len(row))), columns=values)
                yield out.assign(tree=tree.astype(np.int32), draw=drawn[tree, copy].astype(np.int64))

    schema = ", ".join([*(f"{v} double" for v in values), "tree int", "draw long"])
    return few.unionByName(rows.where(F.col("n") > FEW).mapInPandas(lowest, schema))


def fit_forest(
    df: DataFrame, names: list[str], *, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 42
) -> Forest | None:
    """Trees on random rows, gaps filled with the column's median; None without columns or below five rows.

    Equal rows are counted first, and each copy has a draw of its own. One task per tree sees about a thousand sampled
    rows and keeps the ``tree_rows`` lowest draws, which follow from whole rows and their number: the same seed on the
    same rows gives the same forest in any layout.
    """
    if not names:
        return None
    n_rows = df.count()
    if n_rows < 5:
        return None
    medians = exact_quantiles(df, names, [0.5])
    fills = [float(medians[n][0] or 0.0) for n in names]
    numbers = df.select(
        F.xxhash64(*(col(c) for c in df.columns)).alias("key"),
        *(F.coalesce(as_number(df, n), F.lit(f)).cast("double").alias(f"x{i}") for i, (n, f) in enumerate(zip(names, fills))),
    )
    size = min(tree_rows, n_rows)
    values = numbers.columns[1:]

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        # Order first: what a tree sees must not depend on the order in which rows arrive.
        kept = rows.sort_values(["draw", *values], kind="stable").head(size)
        grown = _grow(kept[values].to_numpy(dtype=float), np.random.default_rng([seed, tree]))
        out = pd.DataFrame(grown, columns=["node", "feature", "split", "left", "right", "size"])
        out.insert(0, "tree", tree)
        return out

    counted = materialize(numbers.groupBy(*numbers.columns).agg(F.count("*").alias("n")), "counted-rows")
    samples = _tree_samples(counted, n_rows, trees, tree_rows, seed)
    nodes = samples.groupBy("tree").applyInPandas(build, _NODE_SCHEMA).toPandas()
    return Forest(list(names), fills, nodes.sort_values(["tree", "node"], ignore_index=True), size)


def _walk_table(forest: Forest) -> dict:
    """All trees in flat arrays: node ``i`` continues at ``after[2i]`` (left) or ``after[2i + 1]``; leaves stay put.

    ``path`` is the depth of a leaf plus the expected depth below it, read once when a row has arrived.
    """
    nodes = forest.nodes
    starts = np.flatnonzero(nodes["node"].to_numpy() == 0)
    base = np.repeat(starts, np.diff([*starts, len(nodes)]))
    leaf = nodes["feature"].to_numpy() < 0
    here = np.arange(len(nodes))
    left = np.where(leaf, here, base + nodes["left"].to_numpy())
    right = np.where(leaf, here, base + nodes["right"].to_numpy())
    depth = np.zeros(len(nodes))
    levels = math.ceil(math.log2(max(forest.tree_rows, 2)))
    reached = starts
    for level in range(1, levels + 1):
        inner = reached[~leaf[reached]]
        reached = np.concatenate([left[inner], right[inner]])
        depth[reached] = level
    return {
        "roots": starts,
        "feature": np.where(leaf, 0, nodes["feature"].to_numpy()).astype(np.intp),
        "split": np.where(leaf, np.inf, nodes["split"].to_numpy()),
        "after": np.column_stack([left, right]).ravel().astype(np.intp),
        "path": depth + mean_path(nodes["size"].to_numpy()),
        "levels": levels,
        "scale": len(starts) * float(mean_path(forest.tree_rows)),
    }


def score_rows(df: DataFrame, forest: Forest, name: str = "isolation") -> DataFrame:
    """Adds the score ``-2^(-E[depth]/c)`` in [-1, 0); the lower, the easier a row is to isolate.

    The forest is at most 511 nodes per tree and goes to each executor once; rows pass through in Arrow batches.
    """
    shared = df.sparkSession.sparkContext.broadcast(_walk_table(forest))

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        t = shared.value
        x = np.column_stack([c.to_numpy(dtype=float) for c in columns]).ravel()
        row = np.arange(len(columns[0]), dtype=np.intp) * len(columns)
        total, at, place = np.zeros(len(row)), np.empty_like(row), np.empty_like(row)
        value, split, right = np.empty(len(row)), np.empty(len(row)), np.empty(len(row), bool)
        # All places are known to exist: clipping leaves out the checks, and the arrays are used again.
        for root in t["roots"]:
            at.fill(root)
            for _ in range(t["levels"]):
                t["feature"].take(at, out=place, mode="clip")
                place += row
                x.take(place, out=value, mode="clip")
                t["split"].take(at, out=split, mode="clip")
                np.greater(value, split, out=right)
                at += at
                at += right
                t["after"].take(at, out=place, mode="clip")
                at, place = place, at
            total += t["path"].take(at, out=value, mode="clip")
        return pd.Series(-np.power(2.0, -total / t["scale"]))

    inputs = [F.coalesce(as_number(df, n), F.lit(f)) for n, f in zip(forest.names, forest.fills)]
    return df.withColumn(name, score(*inputs))


@dataclass(frozen=True)
class Outliers:
    """``rows``: the table plus ``anomaly_score`` (below zero means isolated) and ``is_outlier``."""

    rows: DataFrame
    names: list[str]
    forest: Forest
    threshold: float


def find_outliers(
    df: DataFrame, names: list[str], *, contamination: float = 0.05, trees: int = TREES, seed: int = 42,
    partitions: int | None = None,
) -> Outliers | None:
    """Rows whose isolation score lies below the ``contamination`` quantile of all scores.

    Every row is scored. The scored table is written once, so finding the cut reads the score column only and the
    forest does not run twice. ``partitions`` deals the rows anew before scoring, for a table of few splits.
    """
    forest = fit_forest(df, names, trees=trees, seed=seed)
    if forest is None:
        return None
    scored = materialize(score_rows(dealt(df, partitions) if partitions else df, forest), "isolation")
    threshold = exact_quantiles(scored, ["isolation"], [contamination])["isolation"][0]
    rows = (
        scored.withColumn("anomaly_score", F.col("isolation") - F.lit(threshold))
        .withColumn("is_outlier", F.col("anomaly_score") < 0)
        .drop("isolation")
    )
    return Outliers(rows, list(names), forest, float(threshold))


def outlier_summary(found: Outliers) -> DataFrame:
    """Flagged rows, their share in percent and the largest flagged value of the first column; all rows counted."""
    first = as_number(found.rows, found.names[0])
    return found.rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("is_outlier").alias("outliers"),
        (F.try_divide(F.count_if("is_outlier"), F.count(F.lit(1))) * 100).alias("outlier_pct"),
        F.max(F.when(F.col("is_outlier"), first)).alias("extreme_value"),
    )


def outlier_samples(found: Outliers, n: int = 10) -> DataFrame:
    """The ``n`` most isolated rows, ties in the order of the modelled columns."""
    order = [F.col("anomaly_score"), *(col(c) for c in found.names)]
    return found.rows.where("is_outlier").orderBy(*order).limit(n)


def outlier_points(found: Outliers, x: str, y: str) -> DataFrame:
    """Two columns and the flag, for a scatter chart."""
    return found.rows.select(col(x), col(y), "is_outlier")
