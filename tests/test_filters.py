import pytest

from colsight.operators.nlfilter import filter_rows
from colsight.operators.profile import Roles
from colsight.plans.ask import ask, intent_of, top_sql
from tests.fixtures import sales
from tests.test_clean import SALES_ROLES

PATIENTS = Roles(numeric=["age", "rating"], categorical=["sex", "city"])


@pytest.fixture(scope="module")
def patients(spark):
    rows = [
        (30, 4.5, "Male", "North"), (41, 3.0, "Female", "South"), (52, 5.0, "female ", "North End"),
        (63, None, None, "East"), (5, 1.0, "Male", "South"),
    ]
    return spark.createDataFrame(rows, "age int, rating double, sex string, city string")


def ages(df, phrase, roles=PATIENTS, **options):
    return sorted(r["age"] for r in filter_rows(df, roles, phrase, **options).data.collect())


@pytest.mark.parametrize(
    ("phrase", "expected"),
    [
        ("", [5, 30, 41, 52, 63]),
        ("age above 41", [52, 63]),
        ("age >= 41", [41, 52, 63]),
        ("age at most 41", [5, 30, 41]),
        ("age smaller than 30", [5]),
        ("age above 10 and rating below 4.75", [30, 41]),
        ("age > 10 rating > 4", [30, 52]),
        ("show me female patients", [41, 52]),
        ("male", [5, 30]),
        ("north or south", [5, 30, 41]),
        ("male from the south", [5]),
        ("people over 40 in north end", [52]),
        ("age equals 63", [63]),
        ("rating is 5", [52]),
        ("rating over 1,000", []),
        ("find the eas", [63]),
        ("nothing to match zzz", [5, 30, 41, 52, 63]),
    ],
)
def test_phrases(patients, phrase, expected):
    assert ages(patients, phrase) == expected


def test_inside_match(patients):
    assert ages(patients, "male", contains=True) == [5, 30, 41, 52]


def test_rules_and_metrics(patients):
    found = filter_rows(patients, PATIENTS, "rating in city south above 2")
    assert [str(r) for r in found.rules] == ["`rating` > 2", "`city` = 'south'"]
    row = filter_rows(patients, PATIENTS, "rating above 3").metrics().first()
    assert (row["original_count"], row["filtered_count"], row["percentage"]) == (5, 2, 40.0)
    empty = filter_rows(patients.limit(0), PATIENTS, "age above 3").metrics().first()
    assert tuple(empty) == (0, 0, 0.0)


def test_nan_is_not_above_anything(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 9.0)], "age int, rating double")
    assert ages(df, "rating above 2", Roles(numeric=["rating"])) == [2]


def test_number_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, 2.0)], "age int, rating double").write.parquet(path)
    df = filter_rows(spark.read.parquet(path), PATIENTS, "age above 3 and rating below 4").data
    plan = df._jdf.queryExecution().toString()
    assert "GreaterThan(age,3)" in plan and "LessThan(rating,4.0)" in plan


def test_sales_rows_above_1000(spark):
    found = filter_rows(sales(spark), SALES_ROLES, "revenue over ₹1,000")
    assert found.data.count() == 8


@pytest.mark.parametrize(
    ("question", "intent"),
    [
        ("What are the top categories by revenue?", "top"),
        ("Plot distribution of numeric features", "chart"),
        ("Generate SQL query to group and aggregate top metrics", "code"),
        ("show transactions above 5000", None),
        ("what is the accuracy of the dataset", "hygiene"),
        ("average revenue", "stats"),
        ("barley summary", None),
        ("Explain the anomalies", None),
    ],
)
def test_intents(question, intent):
    assert intent_of(question) == intent


def test_answers(spark):
    df = sales(spark).dropDuplicates().na.fill({"Revenue": 610.0})
    top = ask(df, SALES_ROLES, "What are the top product categories by revenue?")
    assert top.intent == "top"
    rows = [(r[0], round(r["total"], 2), round(r["mean"], 4), r["n"]) for r in top.table.collect()]
    assert rows == [
        ("Electronics", 32460.50, 3606.7222, 9), ("Home & Kitchen", 2400.74, 480.148, 5),
        ("Clothing", 1360.20, 226.70, 6),
    ]
    code = ask(df, SALES_ROLES, "write SQL for product category and revenue")
    assert code.sql == top_sql("Product_Category", "Revenue")
    assert [r["n"] for r in code.table.collect()] == [9, 5, 6]
    kept = ask(df, SALES_ROLES, "show transactions with revenue above 2000", order_by=["Transaction_ID"])
    assert kept.intent == "filter" and kept.table.count() == 5 and kept.figures.first()["filtered_count"] == 5
    assert sum(r["n"] for r in kept.chart.collect()) == 5
    assert ask(df, SALES_ROLES, "quality?").table.count() == 5
    assert ask(df, SALES_ROLES, "hello there").intent == "retrieval"
    assert ask(df, SALES_ROLES, "plot a trend").chart_kind == "line"
    assert ask(df, SALES_ROLES, "scatter").chart_kind == "scatter"
    assert ask(df, SALES_ROLES, "describe revenue").table.first()["n"] == 20
