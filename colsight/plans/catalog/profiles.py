"""Roles, telemetry, table figures and column statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from colsight.operators.profile import (
    DATE_NAME_PARTS,
    KEY_NAME_WORDS,
    ROLES,
    categorical_stats,
    detect_roles,
    hygiene_score,
    profile,
    shape,
    telemetry,
)
from colsight.operators.report import numeric_stats
from colsight.plans.catalog.base import DIRTY_SQL, date_sql, dirty_orders, query, rounded, table

COLUMNS = {
    "lineitem": {
        "l_orderkey": "integral", "l_partkey": "integral", "l_suppkey": "integral", "l_linenumber": "integral",
        "l_quantity": "fractional", "l_extendedprice": "fractional", "l_discount": "fractional",
        "l_tax": "fractional", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "temporal",
    },
    "orders": {
        "o_orderkey": "integral", "o_custkey": "integral", "o_orderstatus": "string", "o_totalprice": "fractional",
        "o_orderdate": "temporal", "o_orderpriority": "string",
    },
    "dirty": {
        "o_orderkey": "integral", "o_custkey": "integral", "o_orderstatus": "string", "o_totalprice": "fractional",
        "o_orderdate": "string", "o_orderpriority": "string",
    },
    "events": {
        "event_id": "integral", "ts": "temporal", "user_id": "integral", "event_type": "string",
        "value": "fractional", "props": "string",
    },
    "documents": {
        "doc_id": "integral", "text": "string", "lang": "string", "source": "string", "n_chars": "integral",
    },
}


def stats_sql(source: str) -> str:
    """Counts per column and the role rules as one CASE; ``WITH`` clauses to be followed by a SELECT FROM roles."""
    separator = "regexp_matches(trim({c}), '[-/: ]') AND length(trim({c})) >= 6"
    keys = "|".join(KEY_NAME_WORDS)
    parts = []
    for i, (c, kind) in enumerate(COLUMNS[source].items()):
        string = kind == "string"
        named = any(p in c for p in DATE_NAME_PARTS)
        dated = f"{date_sql(f'trim({c})')} IS NOT NULL"
        if string and not named:
            dated = f"({dated} AND {separator.format(c=c)})"
        parts.append(
            f"SELECT {i} AS position, '{c}' AS \"column\", '{kind}' AS kind, count(*) AS n_rows, "
            f"count({c}) AS non_null, count(DISTINCT {c}) AS n_unique, "
            + (f"avg(length({c})) AS avg_len, avg(CASE WHEN {c} IS NULL THEN NULL WHEN {dated} THEN 1.0 ELSE 0.0 END)"
               if string else "CAST(NULL AS DOUBLE) AS avg_len, CAST(NULL AS DOUBLE)")
            + f" AS date_share FROM {source}"
        )
    union = "\n  UNION ALL ".join(parts)
    return f"""
stats AS ({union}),
facts AS (
  SELECT *, n_rows - non_null AS nulls, n_unique / CAST(n_rows AS DOUBLE) AS unique_ratio,
         regexp_matches("column", '{"|".join(DATE_NAME_PARTS)}') AS date_named,
         regexp_matches("column", '^({keys})$|_({keys})$|^({keys})_') AS key_named
  FROM stats),
roles AS (
  SELECT *, CASE
    WHEN kind = 'temporal' THEN 'date'
    WHEN kind = 'string' AND date_share > (CASE WHEN date_named THEN 0.6 ELSE 0.7 END) THEN 'date'
    WHEN key_named AND (unique_ratio > 0.3 OR n_unique > 20) THEN 'id_high_cardinality'
    WHEN kind = 'string' AND avg_len > 40 AND n_unique > 30 AND unique_ratio > 0.05 THEN 'text'
    WHEN unique_ratio >= 0.95 AND n_rows >= 10 AND kind <> 'fractional' AND NOT (kind = 'integral' AND nulls > 0)
      THEN 'id_high_cardinality'
    WHEN kind = 'integral' AND nulls = 0 AND n_unique <= 5 THEN 'categorical'
    WHEN kind IN ('integral', 'fractional') THEN 'numeric'
    WHEN n_unique <= 30 OR unique_ratio <= 0.05 THEN 'categorical'
    WHEN avg_len > 40 THEN 'text'
    ELSE 'categorical' END AS role
  FROM facts)"""


def _profile_sql(source: str, prefix: str = "") -> str:
    return f"""WITH {prefix + ',' if prefix else ''}{stats_sql(source)}
SELECT position, "column", role, non_null, nulls, n_unique, round(unique_ratio, 6) AS unique_ratio,
       round(avg_len, 4) AS avg_len, round(date_share, 6) AS date_share
FROM roles"""


def _profiled(df):
    return profile(df).select(
        "position", "column", "role", "non_null", "nulls", "n_unique", F.round("unique_ratio", 6).alias("unique_ratio"),
        F.round("avg_len", 4).alias("avg_len"), F.round("date_share", 6).alias("date_share"),
    )


@query(_profile_sql("lineitem"))
def profile_roles_lineitem(spark, sf_dir):
    return _profiled(table(spark, sf_dir, "lineitem"))


@query(_profile_sql("orders"))
def profile_roles_orders(spark, sf_dir):
    return _profiled(table(spark, sf_dir, "orders"))


@query(_profile_sql("dirty", DIRTY_SQL))
def profile_roles_dirty(spark, sf_dir):
    return _profiled(dirty_orders(spark, sf_dir))


@query(_profile_sql("events"))
def profile_roles_events(spark, sf_dir):
    return _profiled(table(spark, sf_dir, "events"))


@query(_profile_sql("documents"))
def profile_roles_documents(spark, sf_dir):
    return _profiled(table(spark, sf_dir, "documents"))


@query(f"""WITH {stats_sql('lineitem')} SELECT "column", role FROM roles""")
def detected_roles_lineitem(spark, sf_dir):
    """Roles by the sketch screen with exact counts where it is close."""
    df = table(spark, sf_dir, "lineitem")
    roles = detect_roles(df)
    rows = [(c, role) for role in ROLES for c in getattr(roles, role)]
    return spark.createDataFrame(rows, "column string, role string")


@query(f"""WITH {DIRTY_SQL}, {stats_sql('dirty')},
firsts AS (
  {" UNION ALL ".join(
      f'''SELECT '{c}' AS "column", string_agg(v, ', ' ORDER BY o_orderkey, v) AS everything FROM (
      SELECT o_orderkey, {f"printf('%.2f', {c})" if c == 'o_totalprice' else f"CAST({c} AS VARCHAR)"} AS v FROM dirty
      WHERE {c} IS NOT NULL ORDER BY o_orderkey, v LIMIT 3)'''
      for c in COLUMNS["dirty"])})
SELECT position, r."column", role, non_null, nulls, n_unique, round(unique_ratio * 100, 1) AS unique_pct,
       round(nulls * 100.0 / n_rows, 1) AS missing_pct,
       CASE WHEN length(everything) > 40 THEN substr(everything, 1, 37) || '...' ELSE everything END AS sample_values
FROM roles r JOIN firsts f ON r."column" = f."column" """)
def telemetry_orders(spark, sf_dir):
    dirty = dirty_orders(spark, sf_dir)
    priced = dirty.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(12,2)"))
    return telemetry(priced, ["o_orderkey"]).drop("dtype")


SHAPE_SQL = f"""WITH {DIRTY_SQL},
shape AS (
  SELECT count(*) AS n_rows, CAST(6 AS BIGINT) AS n_columns, count(*) * 6 AS cells,
         6 * count(*) - count(o_orderkey) - count(o_custkey) - count(o_orderstatus) - count(o_totalprice)
           - count(o_orderdate) - count(o_orderpriority) AS null_cells,
         count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS duplicate_rows
  FROM dirty),
score AS (
  SELECT *, greatest(0.0, 100.0 - null_cells * 100.0 / cells - duplicate_rows * 5.0 / n_rows) AS s FROM shape)"""


@query(f"{SHAPE_SQL} SELECT * FROM shape")
def shape_nulls_dups(spark, sf_dir):
    return shape(dirty_orders(spark, sf_dir))


@query(f"""{SHAPE_SQL}
SELECT n_rows, n_columns, cells, null_cells, duplicate_rows, round(s, 6) AS raw_score,
       round(least(100.0, greatest(85.0, s)), 6) AS hygiene_score FROM score""")
def hygiene_score_orders(spark, sf_dir):
    return rounded(hygiene_score(dirty_orders(spark, sf_dir)), 6)


NUMERIC = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]


@query(" UNION ALL ".join(
    f"""SELECT {i} AS position, '{c}' AS "column", round(avg({c}), 4) AS mean,
    round(CAST(median({c}) AS DOUBLE), 4) AS median, CAST(min({c}) AS DOUBLE) AS minimum,
    CAST(max({c}) AS DOUBLE) AS maximum FROM lineitem"""
    for i, c in enumerate(NUMERIC)
))
def num_stats_lineitem(spark, sf_dir):
    return rounded(numeric_stats(table(spark, sf_dir, "lineitem"), NUMERIC))


CATEGORIES = ["o_orderstatus", "o_orderpriority"]


@query(f"WITH {DIRTY_SQL} " + " UNION ALL ".join(
    f"""(SELECT '{c}' AS "column", (SELECT count(DISTINCT {c}) FROM dirty) AS n_unique, {c} AS top_value,
    count(*) AS top_count, round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM dirty), 6) AS top_share
    FROM dirty WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"""
    for c in CATEGORIES
))
def cat_stats_orders(spark, sf_dir):
    return rounded(categorical_stats(dirty_orders(spark, sf_dir), CATEGORIES), 6)
