import pytest
from hypothesis import given, seed, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colsight.functions.dates import ISO_ONLY, day_first_columns, parse_timestamp
from colsight.functions.text import compact_key, keeps_case, null_tokens_to_null, strip, title_case, tokens


def values(spark, texts, expression):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, v string").select("i", expression.alias("x"))
    return [r["x"] for r in sorted(rows.collect(), key=lambda r: r["i"])]


def test_title_case_examples(spark):
    texts = ["o'neil co-op 3rd home&kitchen", "DaNnY sMitH", "x1y", "éCOLE été", "straße", None]
    assert values(spark, texts, title_case(F.col("v"))) == [
        "O'Neil Co-Op 3Rd Home&Kitchen", "Danny Smith", "X1Y", "École Été", "Straße", None,
    ]


@pytest.fixture(scope="module")
def same_case(spark):
    """Characters whose upper and lower forms are the same in Spark's and in Python's Unicode tables."""
    letters = [chr(c) for c in range(32, 0x250) if chr(c) != "İ"]
    df = spark.createDataFrame([(c,) for c in letters], "c string").select("c", F.upper("c").alias("u"), F.lower("c").alias("l"))
    return sorted(r["c"] for r in df.collect() if r["u"] == r["c"].upper() and r["l"] == r["c"].lower())


def test_title_case_and_strip_as_python(spark, same_case):
    assert len(same_case) > 500

    @seed(20)
    @settings(max_examples=12, deadline=None, database=None)
    @given(st.lists(st.text(st.sampled_from(same_case), max_size=20), min_size=30, max_size=60))
    def check(texts):
        assert values(spark, texts, title_case(F.col("v"))) == [t.title() for t in texts]
        padded = [f"\t {t} \n" for t in texts]
        assert values(spark, padded, strip(F.col("v"))) == [t.strip() for t in padded]

    check()


def test_null_tokens(spark):
    texts = ["", "nan", "NaN", "null", "NULL", "None", "<NA>", " null ", "Nan", "none", "nil"]
    assert values(spark, texts, null_tokens_to_null(F.col("v"))) == [None] * 8 + ["Nan", "none", "nil"]


def test_names_that_keep_case():
    assert [keeps_case(n) for n in ("id", "Order_ID", "zip_code", "hash", "api_key", "code_name", "name", "paid")] == [
        True, True, True, True, True, False, False, False,
    ]


def test_dates(spark):
    texts = [
        "2025-01-05", "01/07/2025", "2025-1-5", "2025-01-05 10:11:12", "2025-01-05T10:11", "2025/02/03", "3 Mar 2025",
        "Mar 3, 2025", "02-29-2024", "13/13/2025", "2025-02-30", "n/a", "", "2025", "words - and more", None,
    ]
    parsed = values(spark, texts, F.date_format(parse_timestamp(F.col("v")), "yyyy-MM-dd HH:mm:ss"))
    assert parsed == [
        "2025-01-05 00:00:00", "2025-01-07 00:00:00", "2025-01-05 00:00:00", "2025-01-05 10:11:12",
        "2025-01-05 10:11:00", "2025-02-03 00:00:00", "2025-03-03 00:00:00", "2025-03-03 00:00:00",
        "2024-02-29 00:00:00", None, None, None, None, None, None, None,
    ]
    strict = values(spark, texts[:2], parse_timestamp(F.col("v"), ISO_ONLY).isNull())
    assert strict == [False, True]


def test_more_date_shapes(spark):
    texts = [
        "05-Jan-2025", "January 5, 2025", "5 January 2025", "20250105", "2025.01.05", "01/05/25", "2025-01-05 3:04 PM",
        "2025-01-05\t", "\u20032025-01-05 ", "01/05/2025 12:00 am", "01.05.2025",
    ]
    month_first = values(spark, texts, F.date_format(parse_timestamp(F.col("v")), "yyyy-MM-dd HH:mm"))
    assert month_first == ["2025-01-05 00:00"] * 6 + ["2025-01-05 15:04"] + ["2025-01-05 00:00"] * 4
    day_first = values(spark, ["13/01/2025", "25-12-2024", "05/01/25", "31.01.2025", "2025-01-05", "Mar 3, 2025"],
                       F.date_format(parse_timestamp(F.col("v"), day_first=True), "yyyy-MM-dd"))
    assert day_first == ["2025-01-13", "2024-12-25", "2025-01-05", "2025-01-31", "2025-01-05", "2025-03-03"]


def test_order_of_day_and_month_is_found_by_column(spark):
    df = spark.createDataFrame(
        [("13/01/2025", "01/13/2025", "01/02/2025", "x"), ("02/03/2025", "02/03/2025", None, "14/15")],
        "d string, m string, open string, other string",
    )
    assert day_first_columns(df, df.columns) == {"d"}
    assert day_first_columns(df, []) == frozenset()


def test_tokens_and_digests(spark):
    assert values(spark, ["The Été, l'été_2 x 42!"], tokens(F.col("v"))) == [["the", "été", "été_2", "42"]]
    short, long = values(spark, ["a" * 64, "a" * 65], compact_key(F.col("v")))
    assert short == "a" * 64 and long.startswith("#") and len(long) == 65
