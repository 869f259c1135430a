import datetime as dt

import pytest
from pyspark.sql import functions as F

from colsight.operators.charts import (
    bar,
    box_summary,
    date_trend,
    histogram,
    line_pixels,
    pie_shares,
    points,
    scatter_cells,
    top_values,
)
from tests.fixtures import sales


def test_histogram_covers_all_rows_and_takes_the_maximum(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)] + [(None,), (float("nan"),)], "x double")
    rows = histogram(df, "x", 10).orderBy("bin").collect()
    assert [r["n"] for r in rows] == [10] * 9 + [11]
    assert rows[0]["bin_low"] == 0.0 and rows[-1]["bin_high"] == 100.0


def test_histogram_of_one_value_and_of_none(spark):
    rows = histogram(spark.createDataFrame([(5.0,)] * 5, "x double"), "x").collect()
    assert [(r["bin"], r["n"], r["bin_low"], r["bin_high"]) for r in rows] == [(1, 5, 5.0, 5.0)]
    assert histogram(spark.createDataFrame([(None,)], "x double"), "x").count() == 0


def test_months_without_rows_are_kept(spark):
    days = [dt.datetime(2025, 1, 5), dt.datetime(2025, 1, 6), dt.datetime(2025, 3, 20)]
    df = spark.createDataFrame([(d, float(i)) for i, d in enumerate(days)], "d timestamp, x double")
    assert [(str(r["bucket"]), r["mean"]) for r in date_trend(df, "d", "x").orderBy("bucket").collect()] == [
        ("2025-01-31", 0.5), ("2025-02-28", None), ("2025-03-31", 2.0),
    ]
    assert [r["n"] for r in date_trend(df, "d").orderBy("bucket").collect()] == [2, 0, 1]
    assert date_trend(df, "d", fill_gaps=False).count() == 2


def test_granularity_follows_the_range(spark):
    def buckets(days):
        df = spark.createDataFrame(
            [(dt.datetime(2024, 1, 1),), (dt.datetime(2024, 1, 1) + dt.timedelta(days=days),)], "d timestamp"
        )
        return date_trend(df, "d").count()

    assert (buckets(60), buckets(61), buckets(730), buckets(731)) == (61, 3, 24, 3)


def test_trend_of_nothing(spark):
    assert date_trend(spark.createDataFrame([], "d timestamp"), "d").count() == 0


def test_top_values_share_counts_missing_rows(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "s string")
    assert [tuple(r) for r in top_values(df, "s").collect()] == [("a", 2, 50.0), ("b", 1, 25.0)]


def test_bars(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), (None, 9.0)], "s string, x double")

    def got(how):
        return {r["s"]: r["value"] for r in bar(df, "s", "x", how).collect()}

    assert got("sum") == {"a": 4.0, "b": 0.0}
    assert got("count") == {"a": 2, "b": 0}
    assert got("mean") == {"a": 2.0, "b": None}
    assert got("median") == {"a": 2.0}
    with pytest.raises(ValueError):
        bar(df, "s", "x", "mode")


def test_box_and_pie(spark):
    df = spark.createDataFrame([(float(i), "k") for i in range(1, 10)] + [(100.0, "k")], "x double, s string")
    row = box_summary(df, "x", ["s"]).first()
    assert (row["q1"], row["median"], row["q3"]) == (3.25, 5.5, 7.75)
    assert row["upper_fence"] == 14.5 and row["lower_fence"] == 1.0
    assert pie_shares(df, "s", "x").first()["share"] == 1.0


def test_points_are_all_rows(spark):
    df = spark.range(500).select("id", (F.col("id") * 2).alias("y"))
    assert points(df, ["id", "y"]).count() == 500
    assert [r["id"] for r in points(df, ["id"], order_by=["id"]).take(3)] == [0, 1, 2]


def test_histogram_counts_infinite_values_apart(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (inf,), (-inf,)], "x double")
    rows = [tuple(r) for r in histogram(df, "x", 2).select("bin", "n", "bin_low", "bin_high").orderBy("bin").collect()]
    assert rows == [(0, 1, -inf, -inf), (1, 1, 1.0, 1.5), (2, 2, 1.5, 2.0), (3, 1, inf, inf)]
    only = spark.createDataFrame([(inf,)], "x double")
    assert [r["n"] for r in histogram(only, "x", 2).collect()] == [1]


def test_dates_as_text(spark):
    assert date_trend(sales(spark).where("Date like '2025%'"), "Date", "Revenue").count() == 42


def test_pixels_keep_what_a_line_shows(spark):
    rows = [(float(i * i % 97), float(i % 13)) for i in range(300)] + [(None, 1.0), (5.0, None), (float("inf"), 2.0), (3.0, float("nan"))]
    df = spark.createDataFrame(rows, "x double, y double")
    kept = sorted((x, y) for x, y in rows[:300])
    low, high = kept[0][0], kept[-1][0]
    want = {}
    for x, y in kept:
        want.setdefault(min(9, int((x - low) * 10 / (high - low))), []).append((x, y))
    got = {r["pixel"]: tuple(r)[1:] for r in line_pixels(df, "x", "y", 10).collect()}
    assert got == {
        p: (len(v), *v[0], *v[-1], min(y for _, y in v), max(y for _, y in v)) for p, v in want.items()
    }


def test_cells_count_every_row(spark):
    df = spark.createDataFrame([(1.0, 1.0)] * 5 + [(2.0, 3.0), (None, 1.0)], "x double, y double")
    assert sorted(map(tuple, scatter_cells(df, "x", "y", 4, 4).collect())) == [(0, 0, 5), (3, 3, 1)]


def test_one_value_and_no_rows_have_one_and_no_pixel(spark):
    df = spark.createDataFrame([(7.0, 1.0), (7.0, 4.0)], "x double, y double")
    assert [tuple(r) for r in line_pixels(df, "x", "y").collect()] == [(0, 2, 7.0, 1.0, 7.0, 4.0, 1.0, 4.0)]
    assert line_pixels(df.where("x < 0"), "x", "y").count() == 0
    when = spark.sql("SELECT DATE'2024-01-01' AS d, 1.0D AS y UNION ALL SELECT DATE'2024-01-03', 2.0D")
    assert [r["pixel"] for r in line_pixels(when, "d", "y", 10).orderBy("pixel").collect()] == [0, 9]
