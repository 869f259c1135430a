"""Duplicates, imputation, string and date hygiene, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from colsight.functions.dates import ISO_ONLY, parse_timestamp
from colsight.functions.text import null_tokens_to_null, title_case
from colsight.operators.clean import (
    changed_cells,
    clean,
    coerce_dates,
    column_audit,
    drop_copies,
    fill_values,
    impute,
)
from colsight.operators.profile import Roles, profile
from colsight.plans.catalog.base import (
    DIRTY_ROLES,
    DIRTY_SQL,
    TIDY_SQL,
    date_sql,
    dirty_orders,
    hygiene_sql,
    mode_sql,
    query,
    rounded,
    table,
    title_sql,
)

NUMERIC_ONLY = Roles(numeric=["o_totalprice"])
CATEGORIES_ONLY = Roles(categorical=["o_orderstatus", "o_orderpriority"])
BASE = f"WITH {DIRTY_SQL}, base AS (SELECT DISTINCT * FROM dirty)"


@query(f"{BASE} SELECT * FROM base")
def dedup_orders(spark, sf_dir):
    return drop_copies(dirty_orders(spark, sf_dir))


def _imputed(spark, sf_dir, roles, policy):
    base = drop_copies(dirty_orders(spark, sf_dir))
    return impute(base, fill_values(base, roles, policy))


@query(f"""{BASE} SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT median(o_totalprice) FROM base)), 4)
AS o_totalprice FROM base""")
def impute_median(spark, sf_dir):
    return rounded(_imputed(spark, sf_dir, NUMERIC_ONLY, "median_mode").select("o_orderkey", "o_totalprice"))


@query(f"""{BASE} SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM base)), 4)
AS o_totalprice FROM base""")
def impute_mean(spark, sf_dir):
    return rounded(_imputed(spark, sf_dir, NUMERIC_ONLY, "mean").select("o_orderkey", "o_totalprice"))


@query(f"""{BASE} SELECT o_orderkey, coalesce(o_orderstatus, {mode_sql('base', 'o_orderstatus')}) AS o_orderstatus,
coalesce(o_orderpriority, {mode_sql('base', 'o_orderpriority')}) AS o_orderpriority FROM base""")
def impute_mode(spark, sf_dir):
    filled = _imputed(spark, sf_dir, CATEGORIES_ONLY, "median_mode")
    return filled.select("o_orderkey", "o_orderstatus", "o_orderpriority")


PARSED_SQL = f"WITH {TIDY_SQL}, parsed AS (SELECT * REPLACE ({date_sql('o_orderdate')} AS o_orderdate) FROM tidy)"


@query(f"""{PARSED_SQL} SELECT * REPLACE (CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate) FROM parsed
WHERE o_custkey IS NOT NULL AND o_orderstatus IS NOT NULL AND o_totalprice IS NOT NULL AND o_orderdate IS NOT NULL
AND o_orderpriority IS NOT NULL""")
def impute_drop(spark, sf_dir):
    done = clean(dirty_orders(spark, sf_dir), DIRTY_ROLES, policy="drop").data
    return done.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query(f"""WITH {DIRTY_SQL} SELECT o_orderkey, {hygiene_sql('o_orderstatus')} AS o_orderstatus,
{hygiene_sql('o_orderpriority')} AS o_orderpriority FROM dirty""")
def string_hygiene(spark, sf_dir):
    dirty = dirty_orders(spark, sf_dir)
    return dirty.select(
        "o_orderkey",
        *(title_case(null_tokens_to_null(F.col(c))).alias(c) for c in ("o_orderstatus", "o_orderpriority")),
    )


@query(f"SELECT p_partkey, {title_sql('p_name')} AS p_name, {title_sql('p_type')} AS p_type FROM part")
def title_case_part(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", title_case(F.col("p_name")).alias("p_name"), title_case(F.col("p_type")).alias("p_type")
    )


@query(f"""WITH {DIRTY_SQL} SELECT o_orderkey, CAST(CAST({date_sql('o_orderdate')} AS DATE) AS VARCHAR) AS day,
CAST(CAST(try_strptime(o_orderdate, '%Y-%m-%d') AS DATE) AS VARCHAR) AS strict_day FROM dirty""")
def date_coercion(spark, sf_dir):
    """All formats beside the strict single-format reading."""
    dirty = dirty_orders(spark, sf_dir).withColumn("strict", parse_timestamp(F.col("o_orderdate"), ISO_ONLY))
    return coerce_dates(dirty, ["o_orderdate"]).select(
        "o_orderkey",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.date_format("strict", "yyyy-MM-dd").alias("strict_day"),
    )


SHAPES = (
    ("dd/MM/yyyy", "%d/%m/%Y"), ("dd-MMM-yyyy", "%d-%b-%Y"), ("MMMM d, yyyy", "%B %-d, %Y"), ("yyyyMMdd", "%Y%m%d"),
    ("yyyy.MM.dd", "%Y.%m.%d"), ("dd/MM/yy", "%d/%m/%y"), ("yyyy-MM-dd", "%Y-%m-%d"),
)


def _many_shapes(spark, sf_dir):
    """Order dates in seven shapes, numeric ones day first, with white space around."""
    key = F.col("o_orderkey") % len(SHAPES)
    shape = F.coalesce(*(F.when(key == i, F.date_format("o_orderdate", s)) for i, (s, _) in enumerate(SHAPES)))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("\t "), shape, F.lit(" \t")).alias("o_orderdate"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders")
def date_formats_mixed(spark, sf_dir):
    """No date is lost, whatever its shape; the order of day and month is found for the column."""
    return coerce_dates(_many_shapes(spark, sf_dir), ["o_orderdate"]).select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")
    )


@query("SELECT 'o_orderdate' AS \"column\", 'date' AS role")
def roles_day_first(spark, sf_dir):
    """A column of day-first dates is a date column."""
    day_first = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("o_orderdate"))
    return profile(day_first).select("column", "role")


CLEAN_SQL = f"""WITH {TIDY_SQL},
cleaned AS (
  SELECT o_orderkey, o_custkey, coalesce(o_orderstatus, {mode_sql('tidy', 'o_orderstatus')}) AS o_orderstatus,
         coalesce(o_totalprice, (SELECT median(o_totalprice) FROM tidy)) AS o_totalprice,
         CAST(CAST({date_sql('o_orderdate')} AS DATE) AS VARCHAR) AS o_orderdate,
         coalesce(o_orderpriority, {mode_sql('tidy', 'o_orderpriority')}) AS o_orderpriority
  FROM tidy)"""


def _day_text(df):
    return df.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query(f"{CLEAN_SQL} SELECT * REPLACE (round(o_totalprice, 4) AS o_totalprice) FROM cleaned")
def clean_orders(spark, sf_dir):
    return rounded(_day_text(clean(dirty_orders(spark, sf_dir), DIRTY_ROLES).data))


@query(f"""{BASE},
filled AS (
  SELECT o_orderkey, o_custkey, coalesce(o_orderstatus, {mode_sql('base', 'o_orderstatus')}) AS o_orderstatus,
         coalesce(o_totalprice, (SELECT median(o_totalprice) FROM base)) AS o_totalprice, o_orderdate,
         coalesce(o_orderpriority, {mode_sql('base', 'o_orderpriority')}) AS o_orderpriority
  FROM base)
SELECT o_orderkey, o_custkey, {hygiene_sql('o_orderstatus')} AS o_orderstatus, round(o_totalprice, 4) AS o_totalprice,
       CAST(CAST({date_sql(hygiene_sql('o_orderdate'))} AS DATE) AS VARCHAR) AS o_orderdate,
       {hygiene_sql('o_orderpriority')} AS o_orderpriority
FROM filled""")
def clean_orders_impute_first(spark, sf_dir):
    """The older step order: null tokens found after filling stay null."""
    done = clean(dirty_orders(spark, sf_dir), DIRTY_ROLES, order="impute_first").data
    return rounded(_day_text(done))


NULLS_SQL = " - ".join(
    ["6 * count(*)"]
    + [f"count({c})" for c in
       ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")]
)
REPORT_SQL = f"""WITH {TIDY_SQL},
raw AS (SELECT count(*) AS initial_rows, {NULLS_SQL} AS initial_nulls FROM dirty),
filled AS (
  SELECT count(*) AS final_rows, count(*) - count(o_totalprice) AS numeric_imputed,
         2 * count(*) - count(o_orderstatus) - count(o_orderpriority) AS categorical_imputed FROM tidy),
report AS (
  SELECT initial_rows, CAST(6 AS BIGINT) AS n_columns, final_rows, initial_rows - final_rows AS duplicates_removed,
         initial_nulls, numeric_imputed, categorical_imputed,
         numeric_imputed + categorical_imputed AS total_imputed, 3 * final_rows AS string_cells,
         (SELECT count({date_sql('o_orderdate')}) FROM tidy) AS date_cells,
         (SELECT count(o_orderdate) - count({date_sql('o_orderdate')}) FROM tidy) AS unreadable_dates,
         100.0 - initial_nulls * 100.0 / (6 * initial_rows) - (initial_rows - final_rows) * 5.0 / initial_rows
           AS raw_score
  FROM raw, filled)"""


@query(f"""{REPORT_SQL} SELECT * REPLACE (round(raw_score, 6) AS raw_score),
round(least(100.0, greatest(85.0, raw_score)), 6) AS hygiene_score FROM report""")
def clean_report(spark, sf_dir):
    report = clean(dirty_orders(spark, sf_dir), DIRTY_ROLES).report
    return rounded(report.drop("dates_converted"), 6)


@query(f"""{REPORT_SQL}
SELECT 1 AS step_num, 'dedup' AS tag, duplicates_removed AS rows_or_cells FROM report
UNION ALL SELECT 2, 'impute_numeric', numeric_imputed FROM report
UNION ALL SELECT 3, 'impute_categorical', categorical_imputed FROM report
UNION ALL SELECT 4, 'string_hygiene', string_cells FROM report
UNION ALL SELECT 5, 'date_coercion', date_cells FROM report""")
def clean_steps(spark, sf_dir):
    return clean(dirty_orders(spark, sf_dir), DIRTY_ROLES).steps.drop("title")


AUDITED = (
    (0, "o_orderkey", "id_high_cardinality", "count(*) * 0", "'key kept, trimmed'"),
    (1, "o_custkey", "numeric", "count(*) * 0", "'validated'"),
    (2, "o_orderstatus", "categorical", "count(*) - count(o_orderstatus)", "'mode or sentinel fill'"),
    (3, "o_totalprice", "numeric", "count(*) - count(o_totalprice)", "'numeric fill'"),
    (4, "o_orderdate", "date", "count(*) * 0", "'parsed to timestamp'"),
    (5, "o_orderpriority", "categorical", "count(*) - count(o_orderpriority)", "'mode or sentinel fill'"),
)


@query(CLEAN_SQL + " " + " UNION ALL ".join(
    f"""SELECT {i} AS position, '{c}' AS "column", '{role}' AS role,
    (SELECT CAST({count} AS BIGINT) FROM tidy) AS imputed, {strategy} AS strategy,
    (SELECT count(*) - count({c}) FROM cleaned) AS nulls_after"""
    for i, c, role, count, strategy in AUDITED
))
def column_audit_orders(spark, sf_dir):
    return column_audit(clean(dirty_orders(spark, sf_dir), DIRTY_ROLES))


@query(CLEAN_SQL + " SELECT position, \"column\", changed FROM (" + " UNION ALL ".join(
    f"""SELECT {i} AS position, '{c}' AS "column", count(*) AS changed FROM base b JOIN cleaned c USING (o_orderkey)
    WHERE b.{c} IS DISTINCT FROM c.{c}"""
    for i, c, *_ in AUDITED if c != "o_orderkey"
) + " UNION ALL SELECT 0, 'o_orderkey', 0)")
def clean_diff(spark, sf_dir):
    return changed_cells(clean(dirty_orders(spark, sf_dir), DIRTY_ROLES))
