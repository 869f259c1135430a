"""Tables of few distinct rows: every copy counts."""

import pytest
from pyspark.sql import functions as F

from colsight.operators import cluster
from colsight.operators.cluster import segments


def test_few_distinct_points_are_all_in_the_sample(spark, monkeypatch):
    monkeypatch.setattr(cluster, "SEED_ROWS", 50)
    rows = spark.range(20_000).select(
        (F.col("id") % 4 * 10.0).alias("a"), (F.col("id") % 2 * 7.0).alias("b")
    )
    found = segments(rows, ["a", "b"], 4)
    assert found.inertia == pytest.approx(0, abs=1e-6)
    assert len({tuple(c) for c in found.centers.round(6)}) == 4


def test_sample_weighs_points_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(cluster, "SEED_ROWS", 10)
    points = spark.range(1_000).select(F.when(F.col("id") < 900, 0.0).otherwise(F.col("id") % 5 + 1.0).alias("z0"))
    sample, weights = cluster._sample(points, 42)
    assert dict(zip(sample[:, 0], weights)) == {0.0: 900, 1.0: 20, 2.0: 20, 3.0: 20, 4.0: 20, 5.0: 20}


def test_sample_is_the_lowest_hashes_and_writes_no_table(spark, monkeypatch):
    monkeypatch.setattr(cluster, "SEED_ROWS", 30)
    points = spark.range(5_000).select((F.col("id") % 700 * 1.0).alias("z0"), (F.col("id") % 7 * 1.0).alias("z1"))
    draw = F.shiftrightunsigned(F.xxhash64("z0", "z1", F.lit(42)), 2)
    lowest = points.groupBy("z0", "z1").agg(F.count("*").alias("n")).orderBy(F.xxhash64("z0", "z1", F.lit(42))).where(
        draw <= int(1.2 * 30 / 700 * 2.0**62)
    ).limit(30).collect()

    def refuse(df, label):
        raise AssertionError(f"wrote {label}")

    monkeypatch.setattr(cluster, "materialize", refuse)
    sample, weights = cluster._sample(points, 42)
    known = {(r.z0, r.z1): r.n for r in lowest}
    assert len(sample) == 30
    assert {k: v for k, v in zip(map(tuple, sample.tolist()), weights) if k in known} == known


def test_scan_gives_equally_near_points_to_the_first_centre(spark):
    points = spark.range(5_000).select((F.col("id") % 3 * 1.0).alias("z0"), F.lit(0.0).alias("z1")).repartition(3)
    centers = cluster.np.array([[0.0, 0.0], [2.0, 0.0], [0.0, 0.0]])
    found = cluster._scan(points, [cluster._Start(centers), cluster._Start(centers, moving=False)])
    assert {key: row[0] for key, row in found.items()} == {(0, 0): 3334, (0, 1): 1666, (0, 2): 0}
    assert found[0, 0][1] == pytest.approx(1667) and found[0, 1][2].tolist() == [3332, 0]
