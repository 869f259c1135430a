"""The tables behind charts: histograms, shares, trends, grouped figures, points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsight.functions.numbers import as_number, col
from colsight.operators.quantiles import grouped_quantiles

# Longest date range in days shown per day, and per month; longer ones are shown per year.
DAY_RANGE = 60
MONTH_RANGE = 730


_INFINITE = float("inf")


def _outside(bins: int) -> Column:
    """The end of the bins that hold infinite values."""
    return F.when(F.col("bin") == 0, F.lit(-_INFINITE)).when(F.col("bin") == bins + 1, F.lit(_INFINITE))


def _bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin 1..bins; the maximum belongs to the last one, and a single value makes one bin."""
    return F.when(low == high, F.lit(1)).otherwise(
        F.least(F.lit(bins), F.width_bucket(value, low, high, F.lit(bins)).cast("int"))
    )


def histogram(
    df: DataFrame, value: str, bins: int = 30, *, color: str | None = None, weight: str | None = None
) -> DataFrame:
    """Rows per equal-width bin (or the sum of ``weight``), optionally per ``color``; empty bins are left out.

    The range comes from a scalar subquery and bins fold before the shuffle, so at most ``bins`` rows per task and
    colour move. It spans the finite values; infinite ones are counted apart, as bin 0 and bin ``bins + 1``, with both
    ends infinite.
    """
    number = as_number(df, value)
    picked = [number.alias("_v")]
    keys = ["bin"]
    if color:
        picked.append(col(color).alias(color))
        keys.insert(0, color)
    if weight:
        picked.append(as_number(df, weight).alias("_w"))
    rows = df.select(*picked).where(F.col("_v").isNotNull())
    finite = F.when(F.abs(number) < F.lit(float("inf")), number)
    ends = df.agg(F.struct(F.min(finite).alias("low"), F.max(finite).alias("high")).alias("ends")).scalar()
    low, high = ends["low"], ends["high"]
    width = (high - low) / bins
    total = F.sum("_w").alias("total") if weight else F.count(F.lit(1)).alias("n")
    return (
        rows.withColumn("bin", _bin(F.col("_v"), low, high, bins))
        .withColumn("bin", F.when(F.col("_v") == F.lit(_INFINITE), bins + 1).when(F.col("_v") == F.lit(-_INFINITE), 0).otherwise(F.col("bin")))
        .groupBy(*(col(k) for k in keys))
        .agg(total)
        .withColumn("bin_low", _outside(bins).otherwise(low + (F.col("bin") - 1) * width))
        .withColumn("bin_high", _outside(bins).when(low == high, high).otherwise(low + F.col("bin") * width))
    )


def box_summary(
    df: DataFrame, value: str, by: list[str] | None = None
) -> DataFrame:
    """Count, mean, extremes, quartiles and 1.5 IQR fences, over the table or per group."""
    keys = by or []
    number = as_number(df, value)
    figures = df.where(number.isNotNull()).groupBy(*(col(k) for k in keys)).agg(
        F.count(number).alias("n"), F.avg(number).alias("mean"), F.min(number).alias("minimum"),
        F.max(number).alias("maximum"),
    )
    quartiles = grouped_quantiles(df, keys, value, [0.25, 0.5, 0.75])
    if keys:
        names = [f"_k{i}" for i in range(len(keys))]
        other = quartiles.toDF(*names, "quantiles")
        on = F.lit(True)
        for key, name in zip(keys, names):
            on = on & col(key).eqNullSafe(F.col(name))
        joined = figures.join(other, on).drop(*names)
    else:
        joined = figures.withColumn("quantiles", quartiles.scalar())
    q1, q3 = F.col("quantiles")[0], F.col("quantiles")[2]
    return joined.select(
        *(col(k) for k in keys), "n", "mean", "minimum", q1.alias("q1"), F.col("quantiles")[1].alias("median"),
        q3.alias("q3"), "maximum",
        F.greatest(F.col("minimum"), q1 - 1.5 * (q3 - q1)).alias("lower_fence"),
        F.least(F.col("maximum"), q3 + 1.5 * (q3 - q1)).alias("upper_fence"),
    )


def top_values(df: DataFrame, column: str, n: int = 7) -> DataFrame:
    """The ``n`` most frequent values with their share of all rows, missing ones included in the total."""
    rows = df.agg(F.count(F.lit(1))).scalar()
    return (
        df.where(col(column).isNotNull())
        .groupBy(col(column))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), col(column))
        .limit(n)
        .withColumn("share_pct", F.round(F.col("n") / rows * 100, 1))
    )


def value_bar(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, missing values left out."""
    return df.where(col(column).isNotNull()).groupBy(col(column)).agg(F.count(F.lit(1)).alias("n"))


def pie_shares(df: DataFrame, names: str, values: str | None = None) -> DataFrame:
    """Row count or sum per name with its share of the whole."""
    amount = F.sum(as_number(df, values)) if values else F.count(F.lit(1))
    named = df.where(col(names).isNotNull())
    total = named.agg(amount).scalar()
    return (
        named.groupBy(col(names))
        .agg(amount.alias("amount"))
        .withColumn("share", F.try_divide(F.col("amount").cast("double"), total.cast("double")))
    )


def _bucket_label(moment: Column, unit: str) -> Column:
    """A bucket is named by its last day: the day itself, month end, year end."""
    if unit == "day":
        return F.to_date(moment)
    if unit == "month":
        return F.last_day(moment)
    return F.make_date(F.year(moment), F.lit(12), F.lit(31))


def _granularity(days: int) -> str:
    if days <= DAY_RANGE:
        return "day"
    return "month" if days <= MONTH_RANGE else "year"


def date_trend(
    df: DataFrame, moment: str, value: str | None = None, *, unit: str | None = None, fill_gaps: bool = True
) -> DataFrame:
    """Row count, or mean of ``value``, per day, month or year; the unit follows the range unless given.

    Buckets without rows are kept (count 0, mean null) unless ``fill_gaps`` is off. Two passes: the range decides the
    unit, then one aggregate; the calendar has at most one row per bucket.
    """
    when = col(moment)
    if isinstance(df.schema[moment].dataType, T.StringType):
        when = when.try_cast("timestamp")
    ends = df.agg(F.min(when).alias("low"), F.max(when).alias("high")).first()
    low, high = ends["low"], ends["high"]
    if unit is None:
        unit = _granularity((high - low).days) if low is not None else "day"
    figure = F.avg(as_number(df, value)).alias("mean") if value else F.count(F.lit(1)).alias("n")
    trend = df.where(when.isNotNull()).groupBy(_bucket_label(when, unit).alias("bucket")).agg(figure)
    if not fill_gaps or low is None:
        return trend
    step = {"day": "interval 1 day", "month": "interval 1 month", "year": "interval 1 year"}[unit]
    first, last = (F.trunc(F.lit(end).cast("date"), unit if unit != "day" else "week") for end in (low, high))
    if unit == "day":
        first, last = F.lit(low).cast("date"), F.lit(high).cast("date")
    calendar = (
        df.sparkSession.range(1)
        .select(F.explode(F.sequence(first, last, F.expr(step))).alias("start"))
        .select(_bucket_label(F.col("start"), unit).alias("bucket"))
    )
    filled = calendar.join(trend, "bucket", "left")
    return filled if value else filled.withColumn("n", F.coalesce(F.col("n"), F.lit(0)))


def bar(
    df: DataFrame, x: str, y: str, how: str = "mean", *, color: str | None = None
) -> DataFrame:
    """``y`` per value of ``x`` (and colour): sum, count, median or mean; missing groups are left out."""
    keys = [x, *([color] if color and color not in (x, y) else [])]
    kept = df.dropna(subset=keys)
    number = as_number(df, y)
    grouped = kept.groupBy(*(col(k) for k in keys))
    if how == "sum":
        return grouped.agg(F.coalesce(F.sum(number), F.lit(0.0)).alias("value"))
    if how == "count":
        return grouped.agg(F.count(number).alias("value"))
    if how == "median":
        return grouped_quantiles(kept, keys, y, [0.5]).select(
            *(col(k) for k in keys), F.col("quantiles")[0].alias("value")
        )
    if how == "mean":
        return grouped.agg(F.avg(number).alias("value"))
    raise ValueError("how is one of sum, count, median, mean")


def points(df: DataFrame, columns: list[str], *, order_by: list[str] | None = None) -> DataFrame:
    """Row-level columns for scatter and line charts, all rows."""
    picked = df.select(*(col(c) for c in columns))
    return picked.orderBy(*(col(c) for c in order_by)) if order_by else picked


def _position(df: DataFrame, name: str) -> Column:
    """A number for every value of a numeric or date column; null where it is missing or infinite."""
    if isinstance(df.schema[name].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(col(name).cast("timestamp")).cast("double")
    number = as_number(df, name).cast("double")
    return F.when(F.abs(number) < F.lit(_INFINITE), number)


def _pixel(value: str, ends: Column, size: int) -> Column:
    """Pixel 0 to size - 1 along an axis from the least to the greatest value, which belongs to the last pixel."""
    low, high = ends[f"low{value}"], ends[f"high{value}"]
    share = (F.col(value) - low) * F.lit(float(size)) / F.nullif(high - low, F.lit(0.0))
    return F.least(F.lit(size - 1), F.coalesce(F.floor(share).cast("int"), F.lit(0)))


def _placed(df: DataFrame, x: str, y: str) -> tuple[DataFrame, Column]:
    rows = df.select(_position(df, x).alias("_x"), _position(df, y).alias("_y")).where("_x is not null and _y is not null")
    ends = [f(c).alias(f"{name}{c}") for c in ("_x", "_y") for name, f in (("low", F.min), ("high", F.max))]
    return rows, rows.agg(F.struct(*ends).alias("ends")).scalar()


def line_pixels(df: DataFrame, x: str, y: str, width: int = 1000) -> DataFrame:
    """What a line through all rows, in order of ``x`` (ties: of ``y``), needs to be drawn ``width`` pixels wide.

    One row per pixel column that has rows: their number, the first, last, lowest and highest ``y``, and the ``x`` of the
    first and last. Dates and times are microseconds since 1970. Rows with a missing or infinite value are left out; a
    single ``x`` is pixel 0. Columns fold before the shuffle, so at most ``width`` rows per task move.
    """
    rows, ends = _placed(df, x, y)
    point = F.struct("_x", "_y")
    return rows.groupBy(_pixel("_x", ends, width).alias("pixel")).agg(
        F.count(F.lit(1)).alias("n"), F.min(point).alias("first"), F.max(point).alias("last"),
        F.min("_y").alias("low_y"), F.max("_y").alias("high_y"),
    ).select(
        "pixel", "n", F.col("first._x").alias("first_x"), F.col("first._y").alias("first_y"),
        F.col("last._x").alias("last_x"), F.col("last._y").alias("last_y"), "low_y", "high_y",
    )


def scatter_cells(df: DataFrame, x: str, y: str, width: int = 400, height: int = 300) -> DataFrame:
    """Rows per pixel of a scatter chart, pixels without rows left out; ends and left-out rows as in :func:`line_pixels`."""
    rows, ends = _placed(df, x, y)
    return rows.groupBy(
        _pixel("_x", ends, width).alias("pixel_x"), _pixel("_y", ends, height).alias("pixel_y")
    ).agg(F.count(F.lit(1)).alias("n"))


def violin_bins(df: DataFrame, x: str, y: str, bins: int = 30) -> DataFrame:
    """The density behind violins: bins of ``y`` over its whole range, counted per ``x``."""
    return histogram(df, y, bins, color=x)
