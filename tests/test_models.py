import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colsight.operators import cluster as seg
from colsight.operators.correlation import correlation_matrix, correlation_pairs, top_pairs
from colsight.operators.isolation import (
    find_outliers,
    fit_forest,
    mean_path,
    outlier_points,
    outlier_samples,
    outlier_summary,
)
from tests.fixtures import health, marketing, sales


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    parts = [rng.normal(c, 0.3, size=(100, 2)) for c in ((0, 0), (10, 0), (0, 10))]
    pdf = pd.DataFrame(np.vstack(parts), columns=["x", "y"])
    pdf["blob"] = np.repeat([0, 1, 2], 100)
    return spark.createDataFrame(pdf)


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(5)
    inner = pd.DataFrame(rng.normal(size=(1000, 3)), columns=["a", "b", "c"]).assign(odd=False)
    outer = pd.DataFrame(rng.normal(loc=12, size=(10, 3)), columns=["a", "b", "c"]).assign(odd=True)
    return spark.createDataFrame(pd.concat([inner, outer]))


def test_correlation_goldens(spark):
    df = sales(spark).dropDuplicates().na.fill({"Revenue": 610.0, "Quantity": 4})
    got = {(r["row"], r["col"]): round(r["r"], 4) for r in correlation_pairs(
        df, ["Revenue", "Quantity", "Customer_Rating"]).collect()}
    assert got == {
        ("Revenue", "Quantity"): 0.9822, ("Revenue", "Customer_Rating"): 0.6203,
        ("Quantity", "Customer_Rating"): 0.5058,
    }
    names = ["Age", "Blood_Pressure", "Cholesterol", "Hospital_Days"]
    best = [(r["col1"], r["col2"], round(r["r"], 4)) for r in top_pairs(
        health(spark).na.fill({"Cholesterol": 200}), names).collect()]
    assert best[0] == ("Age", "Blood_Pressure", 0.9814) and best[1][2] == 0.9705 and len(best) == 4
    names = ["Spend_USD", "Clicks", "Conversions", "ROI_Percent"]
    assert [round(r["r"], 4) for r in top_pairs(marketing(spark), names).collect()] == [
        0.9699, 0.9225, 0.8938, -0.7684,
    ]


def test_correlation_with_gaps_and_constants(spark):
    pdf = pd.DataFrame({"a": [1.0, 2, 3, None, 5], "b": [2.0, None, 1, 4, 7], "k": [3.0] * 5})
    df = spark.createDataFrame(pdf)
    want = pdf.corr()
    rows = {(r["row"], r["col"]): r["r"] for r in correlation_matrix(df, ["a", "b", "k"]).collect()}
    assert len(rows) == 9
    for (i, j), r in rows.items():
        if "k" in (i, j):
            assert r is None
        else:
            assert r == pytest.approx(want.loc[i, j]) and abs(r) <= 1 + 1e-12 and rows[(j, i)] == r
    assert correlation_pairs(df, ["a"]).count() == 0


def test_segments_recover_blobs(spark, blobs):
    found = seg.segments(blobs, ["x", "y"], 3, restarts=3)
    mixed = found.rows.groupBy("blob", "cluster").count().collect()
    assert len(mixed) == 3 and all(r["count"] == 100 for r in mixed)
    assert [r["n"] for r in seg.sizes(found.rows).collect()] == [100] * 3
    again = seg.segments(blobs, ["x", "y"], 3, restarts=3)
    assert again.inertia == pytest.approx(found.inertia) and np.allclose(again.centers, found.centers)
    assert found.centers[0][0] <= found.centers[1][0] <= found.centers[2][0]
    assert seg.silhouette_squared(found.rows) > 0.9
    projected = seg.project(found.rows, found.names, found.scaling)
    assert sum(projected.explained) == pytest.approx(1.0)
    assert seg.centroids(projected.rows).count() == 3


def test_too_little_data(spark):
    tiny = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0)], "x double, y double")
    assert seg.segments(tiny, ["x", "y"]) is None
    assert seg.segments(tiny, ["x"]) is None
    assert find_outliers(tiny, ["x"]) is None and find_outliers(tiny, []) is None


def test_projection_matches_eigenvectors(spark):
    df = health(spark)
    names = ["Age", "Blood_Pressure", "Cholesterol", "Hospital_Days"]
    pdf = df.toPandas().dropna()[names].astype(float)
    z = ((pdf - pdf.mean()) / pdf.std(ddof=0)).to_numpy()
    size, vectors = np.linalg.eigh(z.T @ z / len(z))
    projected = seg.project(df, names)
    assert projected.explained == pytest.approx((size[::-1] / size.sum())[:2])
    got = np.array([[r["pca1"], r["pca2"]] for r in projected.rows.select("pca1", "pca2").collect()])
    want = z @ vectors[:, ::-1][:, :2]
    assert np.allclose(np.sort(np.abs(got), axis=0), np.sort(np.abs(want), axis=0))


def test_standardise_and_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "x double, k double")
    assert sorted(tuple(r) for r in seg.standardise(df, ["x", "k"]).collect()) == [(-1.0, 0.0), (1.0, 0.0)]


def test_persona_wording(spark):
    rows = [(0, 1000.0, 1.0)] * 5 + [(1, 100.0, 1.0)] * 5 + [(2, 552.0, 1.01)] * 5
    df = spark.createDataFrame(rows, "cluster int, revenue double, rate double")
    titles = {r["cluster"]: r["persona"] for r in seg.personas(df, ["revenue", "rate"]).collect()}
    assert titles == {
        0: "High revenue (Avg 1,000)", 1: "Low revenue (Avg 100)", 2: "Moderate rate Cohort",
    }
    low = spark.createDataFrame([(0, 10.0)] * 9 + [(1, 2.5)], "cluster int, v double")
    assert {r["persona"] for r in seg.personas(low, ["v"]).collect()} == {"Moderate v Cohort", "Low v (Avg 2.50)"}


def test_mean_path():
    assert mean_path([0, 1, 2]).tolist() == [0.0, 0.0, 1.0]
    assert mean_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_forest_finds_planted_rows(planted):
    found = find_outliers(planted, ["a", "b", "c"], contamination=0.05)
    rows = found.rows.toPandas()
    assert len(rows) == 1010 and set(planted.columns) < set(rows.columns)
    assert rows.sort_values("anomaly_score").head(10)["odd"].all()
    assert rows.loc[rows["odd"], "is_outlier"].all()
    summary = outlier_summary(found).first()
    assert summary["outliers"] == pytest.approx(50.5, abs=2)
    assert summary["extreme_value"] > 8
    samples = outlier_samples(found, 10).collect()
    assert len(samples) == 10 and all(r["odd"] for r in samples)
    assert outlier_points(found, "a", "b").columns == ["a", "b", "is_outlier"]


def test_forest_is_repeatable_and_bounded(planted):
    first, again = (fit_forest(planted, ["a", "b", "c"], seed=7) for _ in range(2))
    pd.testing.assert_frame_equal(first.nodes, again.nodes)
    assert first.nodes.groupby("tree").size().max() <= 511 and first.nodes["tree"].nunique() == 100
    roots = first.nodes[first.nodes["node"] == 0]
    assert (roots["size"] == 256).all()


def test_forest_does_not_depend_on_the_layout(spark):
    rows = spark.range(20_000).selectExpr("id", "cast(id % 977 as double) as a", "cast(id * 7919 % 10007 as double) as b")
    one, other = (find_outliers(rows.repartition(n), ["a", "b"], trees=20) for n in (1, 7))
    pd.testing.assert_frame_equal(one.forest.nodes, other.forest.nodes)
    flagged = [sorted(r["id"] for r in f.rows.where("is_outlier").collect()) for f in (one, other)]
    assert flagged[0] == flagged[1] and 0 < len(flagged[0])


def test_tree_samples_are_bounded(spark):
    from colsight.operators.isolation import _tree_samples

    rows = spark.range(100_000).select(F.xxhash64("id").alias("key"), F.col("id").cast("double").alias("x0"))
    drawn = _tree_samples(rows, 100_000, 50, 256, 1)
    sizes = [r["count"] for r in drawn.groupBy("tree").count().collect()]
    assert len(sizes) == 50 and min(sizes) >= 256 and max(sizes) < 4 * 400


def test_empty_tables_and_single_columns(spark):
    empty = spark.createDataFrame([], "x double, y double")
    assert seg.standardise(empty, ["x", "y"]).columns == ["x", "y"]
    assert seg.project(empty, ["x", "y"]).rows.columns == ["x", "y", "pca1", "pca2"]
    one = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    projected = seg.project(one, ["x"])
    assert sorted(tuple(r) for r in projected.rows.collect()) == [(1.0, -1.0, 0.0), (3.0, 1.0, 0.0)]
    assert projected.explained == [1.0, 0.0]


def test_wide_correlation_with_gaps(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 60))
    x[:, 1] = x[:, 0] * 2 + rng.normal(size=300) * 0.1
    x[rng.random(x.shape) < 0.1] = np.nan
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(60)])
    got = {(r["row"], r["col"]): r["r"] for r in correlation_pairs(spark.createDataFrame(pdf), list(pdf.columns)).collect()}
    want = pdf.corr()
    assert len(got) == 60 * 59 // 2
    assert all(v == pytest.approx(want.loc[k[0], k[1]], abs=1e-9) for k, v in got.items())
