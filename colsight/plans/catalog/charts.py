"""Chart tables."""

from __future__ import annotations

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
    value_bar,
    violin_bins,
)
from colsight.operators.correlation import correlation_matrix
from colsight.plans.catalog.base import DIRTY_SQL, dirty_orders, query, rounded, table


def _lineitem(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


def hist_sql(value: str, bins: int, keys: str = "", total: str = "count(*) AS n", source: str = "lineitem") -> str:
    lead = f"{keys}, " if keys else ""
    return f"""WITH ends AS (SELECT min({value}) AS lo, max({value}) AS hi FROM {source}),
binned AS (
  SELECT *, CAST(least({bins}, floor(({bins} * ({value} - lo)) / (hi - lo) + 1)) AS INTEGER) AS bin
  FROM {source}, ends WHERE {value} IS NOT NULL)
SELECT {lead}bin, {total}, round(any_value(lo) + (bin - 1) * (any_value(hi) - any_value(lo)) / {bins}, 4) AS bin_low,
       round(any_value(lo) + bin * (any_value(hi) - any_value(lo)) / {bins}, 4) AS bin_high
FROM binned GROUP BY {lead}bin"""


@query(hist_sql("l_extendedprice", 30))
def hist30(spark, sf_dir):
    return rounded(histogram(_lineitem(spark, sf_dir), "l_extendedprice"))


@query(hist_sql("l_extendedprice", 30, "l_returnflag"))
def hist_grouped(spark, sf_dir):
    return rounded(histogram(_lineitem(spark, sf_dir), "l_extendedprice", color="l_returnflag"))


@query(hist_sql("l_extendedprice", 30, "l_linestatus", "round(sum(l_quantity), 2) AS total"))
def hist_sum(spark, sf_dir):
    return rounded(
        histogram(_lineitem(spark, sf_dir), "l_extendedprice", color="l_linestatus", weight="l_quantity")
    )


@query(hist_sql("l_quantity", 20, "l_linestatus"))
def violin_density(spark, sf_dir):
    return rounded(violin_bins(_lineitem(spark, sf_dir), "l_linestatus", "l_quantity", 20))


def _box_sql(value: str, key: str | None) -> str:
    lead = f"{key}, " if key else ""
    group = f"GROUP BY {key}" if key else ""
    return f"""WITH q AS (
  SELECT {lead}count({value}) AS n, avg({value}) AS mean, min({value}) AS minimum, max({value}) AS maximum,
         quantile_cont({value}, 0.25) AS q1, median({value}) AS median, quantile_cont({value}, 0.75) AS q3
  FROM lineitem {group})
SELECT {lead}n, round(mean, 4) AS mean, minimum, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
       maximum, round(greatest(minimum, q1 - 1.5 * (q3 - q1)), 4) AS lower_fence,
       round(least(maximum, q3 + 1.5 * (q3 - q1)), 4) AS upper_fence FROM q"""


@query(_box_sql("l_extendedprice", "l_returnflag"))
def box_by_group(spark, sf_dir):
    return rounded(box_summary(_lineitem(spark, sf_dir), "l_extendedprice", ["l_returnflag"]))


@query(_box_sql("l_extendedprice", None))
def box_overall(spark, sf_dir):
    return rounded(box_summary(_lineitem(spark, sf_dir), "l_extendedprice"))


@query(_box_sql("l_extendedprice", "l_returnflag"))
def box_by_group_spread(spark, sf_dir):
    """The same quartiles by the path for groups too large for one task."""
    return rounded(box_summary(_lineitem(spark, sf_dir), "l_extendedprice", ["l_returnflag"]))


@query(f"""WITH {DIRTY_SQL} SELECT o_orderpriority, count(*) AS n,
round(count(*) * 100.0 / (SELECT count(*) FROM dirty), 1) AS share_pct FROM dirty WHERE o_orderpriority IS NOT NULL
GROUP BY 1 ORDER BY n DESC, o_orderpriority LIMIT 7""")
def topn_share(spark, sf_dir):
    return top_values(dirty_orders(spark, sf_dir), "o_orderpriority")


@query(f"""WITH {DIRTY_SQL} SELECT o_orderstatus, count(*) AS n FROM dirty WHERE o_orderstatus IS NOT NULL
GROUP BY 1""")
def count_bar(spark, sf_dir):
    return value_bar(dirty_orders(spark, sf_dir), "o_orderstatus")


@query("""SELECT l_returnflag, count(*) AS amount,
round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM lineitem), 4) AS share FROM lineitem GROUP BY 1""")
def pie_count(spark, sf_dir):
    return rounded(pie_shares(_lineitem(spark, sf_dir), "l_returnflag"))


@query("""SELECT l_returnflag, round(sum(l_quantity), 2) AS amount,
round(sum(l_quantity) / (SELECT sum(l_quantity) FROM lineitem), 4) AS share FROM lineitem GROUP BY 1""")
def pie_sum(spark, sf_dir):
    return rounded(pie_shares(_lineitem(spark, sf_dir), "l_returnflag", "l_quantity"))


def _as_text(df):
    return df.withColumn("bucket", F.col("bucket").cast("string"))


@query("""WITH days AS (
  SELECT unnest(generate_series(CAST(min(ts) AS DATE), CAST(max(ts) AS DATE), INTERVAL 1 DAY)) AS d FROM events),
trend AS (SELECT CAST(ts AS DATE) AS d, avg(value) AS mean FROM events GROUP BY 1)
SELECT CAST(CAST(days.d AS DATE) AS VARCHAR) AS bucket, round(mean, 4) AS mean
FROM days LEFT JOIN trend ON CAST(days.d AS DATE) = trend.d""")
def trend_day(spark, sf_dir):
    """The range of events is short, so the unit comes out as days."""
    return rounded(_as_text(date_trend(table(spark, sf_dir, "events"), "ts", "value")))


@query("""WITH months AS (
  SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), max(o_orderdate), INTERVAL 1 MONTH)) AS m
  FROM orders),
trend AS (SELECT last_day(o_orderdate) AS d, count(*) AS n FROM orders GROUP BY 1)
SELECT CAST(last_day(m) AS VARCHAR) AS bucket, coalesce(n, 0) AS n FROM months LEFT JOIN trend ON last_day(m) = d""")
def trend_month(spark, sf_dir):
    return _as_text(date_trend(table(spark, sf_dir, "orders"), "o_orderdate", unit="month"))


@query("""WITH years AS (
  SELECT unnest(generate_series(CAST(year(min(o_orderdate)) AS BIGINT), CAST(year(max(o_orderdate)) AS BIGINT))) AS y
  FROM orders),
trend AS (SELECT year(o_orderdate) AS y, avg(o_totalprice) AS mean FROM orders GROUP BY 1)
SELECT CAST(make_date(CAST(years.y AS INTEGER), 12, 31) AS VARCHAR) AS bucket, round(mean, 4) AS mean
FROM years LEFT JOIN trend ON years.y = trend.y""")
def trend_year(spark, sf_dir):
    """The range of orders is long, so the unit comes out as years."""
    return rounded(_as_text(date_trend(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice")))


@query("""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS bucket, count(*) AS n FROM events GROUP BY 1""")
def trend_daily_nofill(spark, sf_dir):
    return _as_text(date_trend(table(spark, sf_dir, "events"), "ts", unit="day", fill_gaps=False))


def _bar_sql(figure: str, keys: str = "l_returnflag") -> str:
    return f"SELECT {keys}, {figure} AS value FROM lineitem GROUP BY {keys}"


@query(_bar_sql("round(sum(l_extendedprice), 2)"))
def bar_sum(spark, sf_dir):
    return rounded(bar(_lineitem(spark, sf_dir), "l_returnflag", "l_extendedprice", "sum"), 2)


@query(_bar_sql("count(l_extendedprice)"))
def bar_count(spark, sf_dir):
    return bar(_lineitem(spark, sf_dir), "l_returnflag", "l_extendedprice", "count")


@query(_bar_sql("round(median(l_extendedprice), 4)"))
def bar_median(spark, sf_dir):
    return rounded(bar(_lineitem(spark, sf_dir), "l_returnflag", "l_extendedprice", "median"))


@query(_bar_sql("round(avg(l_extendedprice), 4)"))
def bar_mean(spark, sf_dir):
    return rounded(bar(_lineitem(spark, sf_dir), "l_returnflag", "l_extendedprice"))


@query(_bar_sql("round(avg(l_extendedprice), 4)", "l_returnflag, l_linestatus"))
def bar_colour(spark, sf_dir):
    return rounded(bar(_lineitem(spark, sf_dir), "l_returnflag", "l_extendedprice", color="l_linestatus"))


@query("SELECT l_quantity, l_extendedprice, l_returnflag FROM lineitem")
def scatter_points(spark, sf_dir):
    return points(_lineitem(spark, sf_dir), ["l_quantity", "l_extendedprice", "l_returnflag"])


@query("SELECT l_quantity, l_extendedprice, l_discount, l_returnflag FROM lineitem")
def scatter3d_points(spark, sf_dir):
    return points(_lineitem(spark, sf_dir), ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag"])


@query("SELECT CAST(ts AS VARCHAR) AS ts, value FROM events ORDER BY events.ts")
def line_sorted(spark, sf_dir):
    line = points(table(spark, sf_dir, "events"), ["ts", "value"], order_by=["ts"])
    return line.withColumn("ts", F.col("ts").cast("string"))


@query("""
WITH p AS (SELECT CAST(epoch_us(ts) AS DOUBLE) AS x, CAST(value AS DOUBLE) AS y FROM events WHERE ts IS NOT NULL AND value IS NOT NULL),
e AS (SELECT min(x) AS low, max(x) AS high FROM p),
q AS (SELECT x, y, CAST(least(799, floor((x - low) * 800.0::DOUBLE / (high - low))) AS INTEGER) AS pixel FROM p, e)
SELECT pixel, count(*) AS n, min(struct_pack(x := x, y := y)).x AS first_x, min(struct_pack(x := x, y := y)).y AS first_y,
       max(struct_pack(x := x, y := y)).x AS last_x, max(struct_pack(x := x, y := y)).y AS last_y,
       min(y) AS low_y, max(y) AS high_y
FROM q GROUP BY pixel""")
def line_pixels_events(spark, sf_dir):
    return line_pixels(table(spark, sf_dir, "events"), "ts", "value", 800)


@query("""
WITH p AS (SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem
           WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL),
e AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM p)
SELECT CAST(least(399, floor((x - lx) * 400.0::DOUBLE / (hx - lx))) AS INTEGER) AS pixel_x,
       CAST(least(299, floor((y - ly) * 300.0::DOUBLE / (hy - ly))) AS INTEGER) AS pixel_y, count(*) AS n
FROM p, e GROUP BY ALL""")
def scatter_cells_lineitem(spark, sf_dir):
    return scatter_cells(_lineitem(spark, sf_dir), "l_quantity", "l_extendedprice")


CORRELATED = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(
    f"SELECT '{a}' AS row, '{b}' AS col, round({'max(1.0)' if a == b else f'corr({a}, {b})'}, 6) AS r FROM lineitem"
    for a in CORRELATED for b in CORRELATED
))
def corr_matrix(spark, sf_dir):
    return rounded(correlation_matrix(_lineitem(spark, sf_dir), CORRELATED), 6)
