"""Pearson correlation of numeric columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsight.functions.numbers import as_number

#: Share of a sum of squares that rounding may leave behind.
NOISE = 1e-12

_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _products(values: DataFrame) -> DataFrame:
    """(i, j, sums over the rows that have both columns) for i <= j, by products of Arrow batches.

    Values come less their columns' means, which keeps large numbers exact. With gaps as zeros in X and their mask M all
    sums of all pairs are the matrices M'M, X'M, (X^2)'M and X'X; a task hands on one row per pair.
    """
    width = len(values.columns)
    upper = np.triu_indices(width)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, width, width))
        for batch in batches:
            if batch.num_rows:
                mask = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
                x = np.column_stack([c.fill_null(0.0).to_numpy() for c in batch.columns])
                total += np.stack([mask.T @ mask, x.T @ mask, (x * x).T @ mask, x.T @ x])
        n, first, square, product = total
        sums = (n, first, first.T, square, square.T, product)
        yield pa.RecordBatch.from_arrays(
            [pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), *(pa.array(s[upper]) for s in sums)],
            names=["i", "j", *_SUMS],
        )

    schema = "i int, j int, " + ", ".join(f"{s} double" for s in _SUMS)
    return values.mapInArrow(add, schema).groupBy("i", "j").agg(*(F.sum(s).alias(s) for s in _SUMS))


def _cells(df: DataFrame, names: list[str]) -> DataFrame:
    """``i, j, row, col, r`` for i <= j; on the diagonal 1 for a column that varies."""
    values = df.select(*(as_number(df, n).cast("double").alias(f"v{i}") for i, n in enumerate(names)))
    means = values.agg(*(F.avg(v) for v in values.columns)).first()
    centred = values.select(*((F.col(v) - F.lit(float(m or 0.0))).alias(v) for v, m in zip(values.columns, means)))
    n = F.col("n")
    sxy = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), n)
    sxx = F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), n)
    syy = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), n)
    # What rounding leaves of a constant column's deviations is no variance.
    varied = (sxx > F.col("sxx") * NOISE) & (syy > F.col("syy") * NOISE)
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(sxy, F.sqrt(sxx * syy))))
    width, named = len(names), F.array(*(F.lit(x) for x in names))
    number = df.sparkSession.range(width * width).select(
        F.floor(F.col("id") / width).cast("int").alias("i"), (F.col("id") % width).cast("int").alias("j")
    )
    figures = _products(centred).withColumn("r", F.when(varied, F.when(F.col("i") == F.col("j"), 1.0).otherwise(r)))
    return number.where("i <= j").join(figures.select("i", "j", "r"), ["i", "j"], "left").select(
        "i", "j", F.get(named, F.col("i")).alias("row"), F.get(named, F.col("j")).alias("col"), "r"
    )


def correlation_pairs(df: DataFrame, names: list[str]) -> DataFrame:
    """``i, j, row, col, r`` for each pair of columns, rows with a gap in either one left out of that pair.

    Two scans of the columns; the shuffle moves a row of sums per pair and task. A constant column gives null.
    """
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], "i int, j int, row string, col string, r double")
    return _cells(df, names).where("i < j")


def correlation_matrix(df: DataFrame, names: list[str]) -> DataFrame:
    """The full matrix in long form: both triangles, and 1 on the diagonal unless the column is constant."""
    if not names:
        return df.sparkSession.createDataFrame([], "row string, col string, r double")
    cells = _cells(df, names)
    other = cells.where("i < j").select(F.col("col").alias("row"), F.col("row").alias("col"), "r")
    return cells.select("row", "col", "r").unionByName(other)


def top_pairs(df: DataFrame, names: list[str], n: int = 4) -> DataFrame:
    """The ``n`` pairs furthest from zero."""
    return (
        correlation_pairs(df, names)
        .where(F.col("r").isNotNull())
        .orderBy(F.desc(F.abs("r")), "i", "j")
        .limit(n)
        .select(F.col("row").alias("col1"), F.col("col").alias("col2"), "r", F.abs("r").alias("abs_r"))
    )
