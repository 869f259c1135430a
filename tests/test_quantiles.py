import numpy as np
import pytest
from pyspark.sql import functions as F

from colsight.operators import quantiles
from colsight.operators.quantiles import exact_quantiles, grouped_quantiles

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 1.0]


@pytest.fixture(params=[10_000, 50, 1])
def picked(request, monkeypatch):
    """Rounds of narrowing down to none at all and down to single values."""
    monkeypatch.setattr(quantiles, "PICK_ROWS", request.param)
    return request.param


def test_whole_columns_as_numpy(spark, picked):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=2000), np.full(900, 0.25), rng.integers(0, 5, 1100)])
    k = rng.integers(0, 3, 4000)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, k)], "x double, k int").repartition(3)
    found = exact_quantiles(df, ["x", "k"], PROBS)
    assert found["x"] == pytest.approx(list(np.quantile(x, PROBS)))
    assert found["k"] == pytest.approx(list(np.quantile(k, PROBS)))


def test_two_heavy_values_around_the_rank(spark, picked):
    values = [0.0] * 5000 + [1.0, 2.0, 3.0] + [9.0] * 5000
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert exact_quantiles(df, ["x"], [0.5, 0.4999])["x"] == pytest.approx(list(np.quantile(values, [0.5, 0.4999])))


def test_groups_as_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [(None if g == 2 else f"g{g}", float(v)) for g, n in ((0, 3000), (1, 5), (2, 200)) for v in rng.normal(g, 1e-9, n)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    found = {r["g"]: r["quantiles"] for r in grouped_quantiles(df, ["g"], "x", PROBS).collect()}
    assert set(found) == {"g0", "g1", None}
    for g, quantile in found.items():
        assert quantile == pytest.approx(list(np.quantile([v for k, v in rows if k == g], PROBS)), rel=1e-12)
    whole = grouped_quantiles(df, [], "x", [0.5]).collect()
    assert whole[0]["quantiles"] == pytest.approx([np.quantile([v for _, v in rows], 0.5)])


def test_gaps_and_empty_columns(spark):
    df = spark.createDataFrame([(None, 1.0), (None, None)], "x double, y double")
    assert exact_quantiles(df, ["x", "y"], [0.5]) == {"x": [None], "y": [1.0]}
    assert exact_quantiles(df.limit(0), ["y"], [0.5]) == {"y": [None]}
    assert grouped_quantiles(df, ["x"], "y", [0.5]).collect()[0]["quantiles"] == [1.0]


def test_copies_of_one_value_stay_one_row(spark):
    df = spark.range(5000).select(F.lit("a").alias("g"), (F.col("id") % 2).cast("double").alias("x"))
    assert grouped_quantiles(df, ["g"], "x", [0.25, 0.5]).first()["quantiles"] == [0.0, 0.5]
