import pytest
from pyspark.sql import functions as F

from colsight.operators.profile import (
    categorical_stats,
    detect_roles,
    hygiene_score,
    null_counts,
    profile,
    shape,
    telemetry,
)
from tests.fixtures import health, marketing, sales


def exact_roles(df, **options):
    return {r["column"]: r["role"] for r in profile(df, **options).collect()}


def test_sales_roles(spark):
    roles = detect_roles(sales(spark))
    assert roles.id_high_cardinality == ["Transaction_ID"]
    assert roles.date == ["Date"]
    assert roles.categorical == ["Region", "Product_Category"]
    assert roles.numeric == ["Revenue", "Quantity", "Customer_Rating"]


def test_health_and_marketing_roles(spark):
    roles = detect_roles(health(spark))
    assert roles.numeric == ["Age", "Blood_Pressure", "Cholesterol", "Hospital_Days"]
    assert roles.date == ["Admission_Date"] and roles.id_high_cardinality == ["Patient_ID"]
    roles = detect_roles(marketing(spark))
    assert roles.numeric == ["Spend_USD", "Clicks", "Conversions", "ROI_Percent"]
    assert roles.categorical == ["Channel"]


@pytest.mark.parametrize("make", [sales, health, marketing])
def test_screened_roles_equal_exact_ones(spark, make):
    df = make(spark)
    roles = detect_roles(df)
    assert {c: roles.role_of(c) for c in df.columns} == exact_roles(df)


def test_tiny_and_coded_integers(spark):
    tiny = spark.createDataFrame([(10, "Alpha"), (20, "Beta"), (30, "Gamma")], "ColA int, ColB string")
    assert exact_roles(tiny) == {"ColA": "categorical", "ColB": "categorical"}
    gap = spark.createDataFrame([(i % 3 if i else None,) for i in range(12)], "grade int")
    assert exact_roles(gap) == {"grade": "numeric"}
    assert exact_roles(spark.range(12).select(F.col("id").alias("n"))) == {"n": "id_high_cardinality"}
    assert exact_roles(spark.range(9).select(F.col("id").alias("n"))) == {"n": "numeric"}


def test_long_texts_and_switches(spark):
    rows = [(f"{i} some long text that goes on and on for a while", i % 2 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "body string, flag boolean")
    assert exact_roles(df) == {"body": "text", "flag": "categorical"}
    assert exact_roles(df, strict_order=True)["body"] == "id_high_cardinality"
    assert exact_roles(df, bool_as_numeric=True)["flag"] == "numeric"


def test_width_is_no_date_by_values(spark):
    df = spark.createDataFrame([(f"w{i}",) for i in range(50)] * 2, "width string")
    assert exact_roles(df) == {"width": "categorical"}


def test_unnamed_dates_need_a_separator(spark):
    df = spark.createDataFrame([(f"2025-01-{i:02d}", f"202501{i:02d}") for i in range(1, 29)], "seen string, c string")
    assert exact_roles(df) == {"seen": "date", "c": "id_high_cardinality"}


def test_empty_table(spark):
    df = sales(spark).limit(0)
    assert profile(df).count() == 0
    assert detect_roles(df).numeric == []
    row = hygiene_score(df).first()
    assert (row["n_rows"], row["null_cells"], row["duplicate_rows"], row["raw_score"]) == (0, 0, 0, 100.0)


def test_shape_counts_nan_as_missing_and_null_as_equal(spark):
    df = spark.createDataFrame(
        [(1.0, "a"), (float("nan"), None), (None, None), (1.0, "a"), (1.0, None)], "x double, s string"
    )
    row = shape(df).first()
    assert (row["n_rows"], row["null_cells"], row["duplicate_rows"]) == (5, 5, 2)


def test_score(spark):
    row = hygiene_score(sales(spark)).first()
    assert row["duplicate_rows"] == 1 and round(row["raw_score"], 4) == 98.4014
    assert round(hygiene_score(health(spark)).first()["raw_score"], 4) == 99.0476
    bad = spark.createDataFrame([(None, None)] * 4, "a int, b int")
    row = hygiene_score(bad).first()
    assert row["raw_score"] == 0.0 and row["hygiene_score"] == 85.0


def test_telemetry_samples(spark):
    rows = {r["column"]: r for r in telemetry(sales(spark), ["Transaction_ID"]).collect()}
    assert rows["Region"]["sample_values"] == " North , South, NORTH"
    assert rows["Revenue"]["nulls"] == 1 and rows["Revenue"]["missing_pct"] == 4.8
    assert rows["Product_Category"]["sample_values"] == "Electronics, Clothing, Electronics"
    wide = telemetry(sales(spark), ["Transaction_ID"], width=20).where("column = 'Date'").first()
    assert wide["sample_values"] == "2025-01-05, 2025-..."


def test_categorical_stats_ties_and_gaps(spark):
    df = spark.createDataFrame(
        [("b", 10), ("a", 9), ("a", 9), ("b", 10), (None, None)], "s string, n int"
    )
    rows = {r["column"]: r for r in categorical_stats(df, ["s", "n"]).collect()}
    assert (rows["s"]["top_value"], rows["s"]["top_count"], rows["s"]["top_share"]) == ("a", 2, 0.4)
    assert rows["n"]["top_value"] == "9"
    empty = categorical_stats(df.where("s is null"), ["s"]).first()
    assert (empty["n_unique"], empty["top_value"], empty["top_count"]) == (0, None, 0)


def test_null_counts(spark):
    rows = {r["column"]: r["nulls"] for r in null_counts(sales(spark)).collect()}
    assert rows["Revenue"] == 1 and rows["Quantity"] == 1 and rows["Date"] == 0


def test_exact_counts_of_every_type(spark):
    df = spark.range(300).selectExpr(
        "CASE WHEN id % 9 <> 0 THEN id % 40 END AS n", "CAST(id % 7 AS tinyint) AS small", "id % 2 = 0 AS flag",
        "CASE id % 4 WHEN 0 THEN 0D WHEN 1 THEN -0D WHEN 2 THEN double('NaN') ELSE id / 3 END AS f",
        "CAST(id % 11 AS decimal(30, 4)) AS dec", "CAST(concat('b', id % 5) AS binary) AS bin",
        "date_add(date'2024-01-01', int(id % 13)) AS d", "timestamp_seconds(id % 17) AS ts", "array(id % 3, id % 2) AS arr",
        "CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN concat('x', id % 50) END AS s",
    )
    want = df.selectExpr("*", "CASE WHEN NOT isnan(f) THEN f + 0D END AS g").drop("f").withColumnRenamed("g", "f").agg(
        *(F.count_distinct(c).alias(c) for c in df.columns)
    ).first()
    got = {r["column"]: r for r in profile(df).collect()}
    assert {c: got[c]["n_unique"] for c in df.columns} == want.asDict()
    assert got["n"]["nulls"] == df.where("n is null").count() and got["s"]["nulls"] == 100
    assert got["s"]["avg_len"] == pytest.approx(df.agg(F.avg(F.length("s"))).first()[0])
    assert got["n"]["avg_len"] is None and got["flag"]["n_unique"] == 2


def test_dates_are_found_beside_other_texts(spark):
    df = spark.range(50).selectExpr("concat(1 + id % 12, '/5/2024') AS seen", "concat('word ', id) AS note", "id AS n")
    roles = {r["column"]: (r["role"], r["date_share"]) for r in profile(df).collect()}
    assert roles["seen"] == ("date", 1.0) and roles["note"][1] == 0.0 and roles["n"][1] is None
    assert profile(df.limit(0)).count() == 0
