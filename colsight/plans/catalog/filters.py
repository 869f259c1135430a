"""English filters and questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from colsight.operators.nlfilter import filter_rows
from colsight.operators.profile import Roles
from colsight.plans.ask import ask, filter_figures
from colsight.plans.catalog.base import DIRTY_SQL, dirty_orders, query, rounded, table
from colsight.plans.catalog.charts import hist_sql

ORDERS = Roles(
    numeric=["o_custkey", "o_totalprice"], categorical=["o_orderstatus", "o_orderpriority"], date=["o_orderdate"],
    id_high_cardinality=["o_orderkey"],
)
EVENTS = Roles(
    numeric=["value"], categorical=["event_type", "props"], date=["ts"], id_high_cardinality=["event_id", "user_id"]
)
PARTS = Roles(
    numeric=["p_size", "p_retailprice"], categorical=["p_name", "p_brand", "p_type"],
    id_high_cardinality=["p_partkey"],
)
LINES = Roles(
    numeric=["l_quantity", "l_extendedprice", "l_discount", "l_tax"], categorical=["l_returnflag", "l_linestatus"],
    date=["l_shipdate"],
)


def _plain(df):
    """Timestamps as text, the same in both engines."""
    return df.select(
        *(F.col(c).cast("string").alias(c) if t.startswith("timestamp") else F.col(c) for c, t in df.dtypes)
    )


ORDER_COLUMNS = "* REPLACE (strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate)"


@query(f"SELECT {ORDER_COLUMNS} FROM orders WHERE o_totalprice > 400000")
def nl_filter_num(spark, sf_dir):
    return _plain(filter_rows(table(spark, sf_dir, "orders"), ORDERS, "orders with total price above $400,000").data)


@query(f"SELECT {ORDER_COLUMNS} FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 150000")
def nl_filter_range(spark, sf_dir):
    phrase = "total price >= 100,000 and total price below 150000"
    return _plain(filter_rows(table(spark, sf_dir, "orders"), ORDERS, phrase).data)


@query("SELECT * REPLACE (CAST(ts AS VARCHAR) AS ts) FROM events WHERE event_type IN ('click', 'purchase')")
def nl_filter_cat(spark, sf_dir):
    return _plain(filter_rows(table(spark, sf_dir, "events"), EVENTS, "show me click or purchase rows").data)


@query(f"""SELECT {ORDER_COLUMNS} FROM orders
WHERE o_totalprice < 50000 AND lower(trim(o_orderpriority)) = '1-urgent'""")
def nl_filter_multi(spark, sf_dir):
    phrase = "find all 1-urgent orders with a total price under 50000"
    return _plain(filter_rows(table(spark, sf_dir, "orders"), ORDERS, phrase).data)


@query("SELECT * FROM part WHERE lower(p_name) LIKE '%gizmo%' OR lower(p_brand) LIKE '%gizmo%' OR lower(p_type) LIKE '%gizmo%'")
def nl_fulltext(spark, sf_dir):
    """No category equals a word of the phrase, so the text of all columns is searched."""
    return filter_rows(table(spark, sf_dir, "part"), PARTS, "display the gizmo").data


@query(f"SELECT {ORDER_COLUMNS} FROM orders")
def nl_filter_empty_phrase(spark, sf_dir):
    return _plain(filter_rows(table(spark, sf_dir, "orders"), ORDERS, "  ").data)


@query("""SELECT count(*) AS original_count, count(*) FILTER (WHERE o_totalprice > 250000) AS filtered_count,
round(count(*) FILTER (WHERE o_totalprice > 250000) * 100.0 / count(*), 1) AS percentage FROM orders""")
def nl_filter_metrics(spark, sf_dir):
    return filter_rows(table(spark, sf_dir, "orders"), ORDERS, "total price over 250,000").metrics()


TOP_SQL = """SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total, round(avg(l_extendedprice), 2) AS mean,
count({n}) AS n FROM lineitem GROUP BY 1 ORDER BY sum(l_extendedprice) DESC, l_returnflag LIMIT 10"""


@query(TOP_SQL.format(n="l_extendedprice"))
def ask_top(spark, sf_dir):
    answer = ask(table(spark, sf_dir, "lineitem"), LINES, "What are the top return flags by extended price?")
    return rounded(answer.table, 2)


@query("""SELECT o_custkey, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 2) AS mean,
count(o_totalprice) AS n FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 10""")
def ask_top_customers(spark, sf_dir):
    """Ranking over a key with many values."""
    roles = Roles(numeric=["o_totalprice"], categorical=["o_custkey"])
    return rounded(ask(table(spark, sf_dir, "orders"), roles, "highest total price per custkey").table, 2)


@query(TOP_SQL.format(n="*"))
def ask_sql(spark, sf_dir):
    answer = ask(table(spark, sf_dir, "lineitem"), LINES, "Generate SQL for the top return flags by extended price")
    return rounded(answer.table, 2)


@query("""SELECT 'l_extendedprice' AS "column", round(sum(l_extendedprice), 2) AS total,
round(avg(l_extendedprice), 2) AS mean, min(l_extendedprice) AS minimum, max(l_extendedprice) AS maximum,
round(stddev_samp(l_extendedprice), 2) AS std, count(l_extendedprice) AS n,
round(median(l_extendedprice), 2) AS median FROM lineitem""")
def ask_stats(spark, sf_dir):
    return rounded(ask(table(spark, sf_dir, "lineitem"), LINES, "average extended price").table, 2)


@query(f"""WITH {DIRTY_SQL},
shape AS (
  SELECT count(*) AS n_rows, 6 * count(*) - count(o_orderkey) - count(o_custkey) - count(o_orderstatus)
           - count(o_totalprice) - count(o_orderdate) - count(o_orderpriority) AS null_cells,
         count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS duplicate_rows
  FROM dirty)
SELECT 0 AS position, 'hygiene_score' AS figure, round(least(100.0, greatest(85.0,
  100.0 - null_cells * 100.0 / (6 * n_rows) - duplicate_rows * 5.0 / n_rows)), 4) AS value FROM shape
UNION ALL SELECT 1, 'n_rows', CAST(n_rows AS DOUBLE) FROM shape
UNION ALL SELECT 2, 'n_columns', 6.0 FROM shape
UNION ALL SELECT 3, 'duplicate_rows', CAST(duplicate_rows AS DOUBLE) FROM shape
UNION ALL SELECT 4, 'null_cells', CAST(null_cells AS DOUBLE) FROM shape""")
def ask_hygiene(spark, sf_dir):
    return rounded(ask(dirty_orders(spark, sf_dir), ORDERS, "How is the data quality?").table)


@query("""SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1
ORDER BY sum(l_extendedprice) DESC, l_returnflag LIMIT 10""")
def ask_chart(spark, sf_dir):
    answer = ask(table(spark, sf_dir, "lineitem"), LINES, "plot a bar of return flag and extended price")
    return rounded(answer.chart, 2)


@query(hist_sql("l_quantity", 30))
def ask_chart_histogram(spark, sf_dir):
    return rounded(ask(table(spark, sf_dir, "lineitem"), LINES, "plot the distribution of quantity").chart)


@query("""SELECT CAST(ts AS VARCHAR) AS ts, value FROM events""")
def ask_chart_line(spark, sf_dir):
    return _plain(ask(table(spark, sf_dir, "events"), EVENTS, "plot the trend of value over time").chart)


@query("""SELECT l_quantity, l_extendedprice, l_returnflag FROM lineitem""")
def ask_chart_scatter(spark, sf_dir):
    return ask(table(spark, sf_dir, "lineitem"), LINES, "scatter of quantity and price").chart


@query("""SELECT (SELECT count(*) FROM lineitem) AS original_count, count(*) AS filtered_count,
""" + ", ".join(
    f"round(avg({c}), 4) AS mean_{c}, min({c}) AS min_{c}, max({c}) AS max_{c}" for c in LINES.numeric
) + " FROM lineitem WHERE l_quantity > 45")
def ask_filter_stats(spark, sf_dir):
    return rounded(ask(table(spark, sf_dir, "lineitem"), LINES, "show lines with quantity above 45").figures)


@query("SELECT * REPLACE (CAST(ts AS VARCHAR) AS ts) FROM events WHERE value > 60")
def ask_filter_rows(spark, sf_dir):
    answer = ask(table(spark, sf_dir, "events"), EVENTS, "show events with value above 60", order_by=["event_id"])
    return _plain(answer.table)


@query(hist_sql("value", 20, source="(SELECT * FROM events WHERE value > 60)"))
def ask_filter_histogram(spark, sf_dir):
    return rounded(ask(table(spark, sf_dir, "events"), EVENTS, "show events with value above 60").chart)
