import pytest
from pyspark.sql import functions as F

from colsight.functions.dates import ISO_ONLY
from colsight.operators.clean import changed_cells, clean, column_audit, fill_values
from colsight.operators.profile import Roles, detect_roles
from tests.fixtures import health, marketing, sales

SALES_ROLES = Roles(
    numeric=["Revenue", "Quantity", "Customer_Rating"], categorical=["Region", "Product_Category"], date=["Date"],
    id_high_cardinality=["Transaction_ID"],
)


@pytest.fixture(scope="module")
def cleaned(spark):
    return clean(sales(spark), SALES_ROLES)


def test_sales_goldens(cleaned):
    data = cleaned.data
    assert data.count() == 20
    assert cleaned.fills == {"Revenue": 610.0, "Quantity": 4.0}
    regions = {r["Region"]: r["count"] for r in data.groupBy("Region").count().collect()}
    assert regions == {"East": 5, "North": 6, "South": 5, "West": 4}
    assert data.where("Date is null").count() == 0
    assert data.schema["Quantity"].dataType.simpleString() == "int"
    assert data.where("Transaction_ID = 'TXN-1001'").count() == 1
    row = cleaned.report.first()
    assert (row["initial_rows"], row["final_rows"], row["duplicates_removed"]) == (21, 20, 1)
    assert (row["numeric_imputed"], row["categorical_imputed"], row["total_imputed"]) == (2, 0, 2)
    assert row["dates_converted"] == ["Date"] and round(row["raw_score"], 4) == 98.4014


def test_strict_single_format_leaves_one_date_null(spark):
    assert clean(sales(spark), SALES_ROLES, formats=ISO_ONLY).data.where("Date is null").count() == 1


def test_steps_and_audit(cleaned):
    steps = {r["tag"]: r["rows_or_cells"] for r in cleaned.steps.collect()}
    assert steps == {
        "dedup": 1, "impute_numeric": 2, "impute_categorical": 0, "string_hygiene": 80, "date_coercion": 20,
    }
    audit = {r["column"]: r for r in column_audit(cleaned).collect()}
    assert audit["Revenue"]["imputed"] == 1 and audit["Revenue"]["strategy"] == "numeric fill"
    assert audit["Customer_Rating"]["strategy"] == "validated"
    assert all(r["nulls_after"] == 0 for r in audit.values())


def test_diff(cleaned):
    changed = {r["column"]: r["changed"] for r in changed_cells(cleaned).collect()}
    assert changed["Revenue"] == 1 and changed["Quantity"] == 1 and changed["Transaction_ID"] == 0
    assert changed["Date"] == 1
    assert changed["Region"] == 5  # " North ", "NORTH", "south", " East ", "WEST"


def test_clean_is_idempotent(spark, cleaned):
    again = clean(cleaned.data, SALES_ROLES)
    assert again.data.exceptAll(cleaned.data).count() == 0 and cleaned.data.exceptAll(again.data).count() == 0


def test_health_and_marketing(spark):
    done = clean(health(spark), detect_roles(health(spark)))
    assert done.fills == {"Cholesterol": 200.0} and done.data.count() == 15
    done = clean(marketing(spark), detect_roles(marketing(spark)))
    assert done.fills == {} and done.report.first()["hygiene_score"] == 100.0


def test_order_of_steps(spark):
    rows = [("x",), ("x",), ("",), (" null ",), (None,)]
    df = spark.createDataFrame([(i, v) for i, (v,) in enumerate(rows)], "n int, kind string")
    roles = Roles(categorical=["kind"])
    tidy_first = clean(df, roles)
    assert tidy_first.data.where("kind is null").count() == 0
    assert tidy_first.report.first()["categorical_imputed"] == 3
    fill_first = clean(df, roles, order="impute_first")
    assert fill_first.data.where("kind is null").count() == 2
    assert fill_first.report.first()["categorical_imputed"] == 1
    changed = [{r["column"]: r["changed"] for r in changed_cells(c).collect()} for c in (tidy_first, fill_first)]
    assert changed == [{"n": 0, "kind": 5}, {"n": 0, "kind": 5}]


def test_policies(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 6.0), (4, None)], "i int, x double")
    roles = Roles(numeric=["x"])
    assert clean(df, roles, policy="mean").fills == {"x": 3.0}
    dropped = clean(df, roles, policy="drop")
    assert dropped.data.count() == 3 and dropped.report.first()["final_rows"] == 3
    assert dropped.report.first()["duplicates_removed"] == 0
    with pytest.raises(ValueError):
        clean(df, roles, policy="guess")


def test_columns_without_values(spark):
    df = spark.createDataFrame([(i, None, None) for i in range(5)], "i int, x double, s string")
    done = clean(df, Roles(numeric=["x"], categorical=["s"]))
    assert done.fills == {"x": 0.0, "s": "Unknown"}
    assert {(r["x"], r["s"]) for r in done.data.collect()} == {(0.0, "Unknown")}


def test_whole_numbers_turn_double_only_for_a_fraction(spark):
    df = spark.createDataFrame([(i, i) for i in range(4)] + [(9, None)], "i int, n int")
    done = clean(df, Roles(numeric=["n"]))
    assert done.fills == {"n": 1.5} and done.data.schema["n"].dataType.simpleString() == "double"


def test_mode_ties_and_coded_categories(spark):
    df = spark.createDataFrame([(1, "b", 10), (2, "a", 9), (3, None, None)], "i int, s string, k int")
    assert fill_values(df, Roles(categorical=["s", "k"])) == {"s": "a", "k": "9"}
    done = clean(df, Roles(categorical=["s", "k"]))
    assert done.data.where("i = 3").select("s", "k").first() == ("A", 9)


def test_hot_duplicates_and_nan(spark):
    hot = spark.range(3000).select(F.lit("same").alias("s"), F.lit(float("nan")).alias("x"))
    rest = spark.range(50).select(F.col("id").cast("string").alias("s"), F.col("id").cast("double").alias("x"))
    done = clean(hot.unionByName(rest), Roles(numeric=["x"]))
    assert done.report.first()["duplicates_removed"] == 2999
    assert done.fills == {"x": 24.5}


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1.0, "a"), (1.0, "a"), (None, " null "), (None, " null "), (2.0, None)]])
def test_counts_are_taken_while_rows_are_written(spark, rows):
    df = spark.createDataFrame(rows, "x double, `a.b` string")
    out = clean(df, Roles(numeric=["x"], categorical=["a.b"]))
    report = out.report.first()
    assert report.initial_rows == len(rows) and report.initial_nulls == sum(v is None for r in rows for v in r)
    assert report.duplicates_removed == len(rows) - len(set(rows)) and report.final_rows == len(set(rows))
    assert out.data.columns == ["x", "a.b"] and out.data.count() == len(set(rows))
    # Tokens for nulls are gaps as well.
    gaps = {r["column"]: r["imputed"] for r in out.imputed.collect()}
    assert gaps == {"x": len({r for r in rows if r[0] is None}), "a.b": len({r for r in rows if r[1] in (None, " null ")})}


def test_the_report_scans_the_table_no_more(spark):
    """Counts come with the write: without texts to read as dates the report has no scan left."""
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, y string")
    report = clean(df, Roles(numeric=["x"], categorical=["y"])).report
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "parquet" not in plan
    assert report.first().final_rows == 2
