"""Registration, table access and the shared dirty table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsight.functions.numbers import col
from colsight.operators.profile import Roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its own name, with the SQL that must give the same rows."""
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql.strip()
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """All doubles rounded, as sums depend on the order of rows in their last digits."""
    return df.select(
        *(
            F.round(col(f.name), digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else
            col(f.name)
            for f in df.schema
        )
    )


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders with gaps, null tokens, padded and mixed-case text, mixed date formats and repeated rows."""
    key, when = F.col("o_orderkey"), F.col("o_orderdate")
    one = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.when(key % 13 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(key % 17 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        F.when(key % 29 == 0, "n/a")
        .when(key % 7 == 0, F.date_format(when, "MM/dd/yyyy"))
        .otherwise(F.date_format(when, "yyyy-MM-dd"))
        .alias("o_orderdate"),
        F.when(key % 19 == 0, "")
        .when(key % 23 == 0, "NULL")
        .when(key % 5 == 0, F.concat(F.lit("  "), F.lower("o_orderpriority"), F.lit(" ")))
        .otherwise(F.col("o_orderpriority"))
        .alias("o_orderpriority"),
    )
    return one.unionAll(one.where(key % 11 == 0))


DIRTY_ROLES = Roles(
    numeric=["o_custkey", "o_totalprice"],
    categorical=["o_orderstatus", "o_orderpriority"],
    date=["o_orderdate"],
    id_high_cardinality=["o_orderkey"],
)

DIRTY_SQL = """
one AS (
  SELECT o_orderkey, o_custkey,
         CASE WHEN o_orderkey % 13 <> 0 THEN o_orderstatus END AS o_orderstatus,
         CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS o_totalprice,
         CASE WHEN o_orderkey % 29 = 0 THEN 'n/a'
              WHEN o_orderkey % 7 = 0 THEN strftime(o_orderdate, '%m/%d/%Y')
              ELSE strftime(o_orderdate, '%Y-%m-%d') END AS o_orderdate,
         CASE WHEN o_orderkey % 19 = 0 THEN '' WHEN o_orderkey % 23 = 0 THEN 'NULL'
              WHEN o_orderkey % 5 = 0 THEN '  ' || lower(o_orderpriority) || ' '
              ELSE o_orderpriority END AS o_orderpriority
  FROM orders),
dirty AS (SELECT * FROM one UNION ALL SELECT * FROM one WHERE o_orderkey % 11 = 0)"""


def title_sql(value: str) -> str:
    pieces = rf"regexp_extract_all(lower({value}), '\p{{L}}+|\P{{L}}+')"
    return f"array_to_string(list_transform({pieces}, lambda x: upper(x[1]) || x[2:]), '')"


def hygiene_sql(value: str) -> str:
    tokens = "'', 'nan', 'NaN', 'null', 'NULL', 'None', '<NA>'"
    return f"CASE WHEN trim({value}) NOT IN ({tokens}) THEN {title_sql(f'trim({value})')} END"


def date_sql(value: str) -> str:
    return f"coalesce(try_strptime({value}, '%Y-%m-%d'), try_strptime({value}, '%m/%d/%Y'))"


def mode_sql(source: str, column: str) -> str:
    """Most frequent value, the smallest on ties."""
    return (
        f"(SELECT {column} FROM {source} WHERE {column} IS NOT NULL GROUP BY {column} "
        f"ORDER BY count(*) DESC, {column} LIMIT 1)"
    )


#: Deduplicated dirty rows, then the same with tidy strings.
TIDY_SQL = f"""{DIRTY_SQL},
base AS (SELECT DISTINCT * FROM dirty),
tidy AS (
  SELECT o_orderkey, o_custkey, {hygiene_sql('o_orderstatus')} AS o_orderstatus, o_totalprice,
         {hygiene_sql('o_orderdate')} AS o_orderdate, {hygiene_sql('o_orderpriority')} AS o_orderpriority
  FROM base)"""
