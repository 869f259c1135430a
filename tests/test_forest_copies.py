"""Tables of few distinct rows: every copy counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colsight.operators.isolation import _tree_samples, fit_forest


@pytest.mark.parametrize("copies", [2, 8_000])
def test_trees_meet_copies_by_their_share(spark, copies):
    n = 24_000
    rows = spark.range(n).select(
        F.when(F.col("id") < 8_000, F.floor(F.col("id") / copies)).otherwise(F.col("id")).alias("a"),
    ).groupBy("a").agg(F.count("*").alias("n")).select(F.xxhash64("a").alias("key"), F.col("a").cast("double").alias("x0"), "n")
    got = _tree_samples(rows, n, 100, 256, 42).toPandas()
    kept = got.sort_values("draw").groupby("tree").head(256)
    assert kept.groupby("tree").size().eq(256).all()
    share = (kept["x0"] < 8_000).groupby(kept["tree"]).mean()
    assert 0.31 < share.mean() < 0.36 and share.min() > 0.2
    assert got.groupby("tree").size().max() < 1_300


def test_forest_on_a_hot_row_is_the_same_in_any_layout(spark):
    rows = spark.range(9_000).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") * 1.0).alias("a"))
    one, two = (fit_forest(rows.repartition(p), ["a"]) for p in (2, 5))
    assert np.array_equal(one.nodes.to_numpy(), two.nodes.to_numpy())


def test_draws_are_filtered_before_lists_of_them_are_made(spark):
    rows = spark.range(2_000).select(
        F.xxhash64("id").alias("key"), (F.col("id") * 1.0).alias("x0"), (F.col("id") % 5 + 1).alias("n")
    )
    samples = _tree_samples(rows, 6_000, 20, 16, 7)
    assert "lambda" not in samples._jdf.queryExecution().optimizedPlan().toString()
    bound = int(4 * 16 / 6_000 * 2.0**62)
    copies = rows.selectExpr("key", "x0", "explode(sequence(0, int(n) - 1)) AS copy").selectExpr(
        "key", "x0", "copy", "explode(sequence(0, 19)) AS tree"
    ).withColumn("draw", F.expr(
        "shiftrightunsigned(if(copy = 0, xxhash64(key, tree, 7), xxhash64(key, tree, 7, copy)), 2)"
    )).where(F.col("draw") <= bound)
    assert sorted(map(tuple, samples.collect())) == sorted(map(tuple, copies.select("x0", "tree", "draw").collect()))
