"""Column roles, telemetry and table-level quality figures."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsight.functions.dates import DATE_FORMATS, has_date_separator, reads_as_date
from colsight.functions.numbers import (
    FRACTIONAL,
    INTEGRAL,
    TEMPORAL,
    as_number,
    col,
    is_number,
    nan_to_null,
    string_value,
    unpivot,
)
from colsight.functions.text import compact_key

ROLES = ("numeric", "categorical", "date", "id_high_cardinality", "text")

# Name parts of date columns, and name words of key columns.
DATE_NAME_PARTS = ("date", "time", "timestamp", "dt", "dob", "created", "updated")
KEY_NAME_WORDS = ("id", "uuid", "guid", "ssn", "tax_id", "account_num", "index", "key", "code", "hash")

# Thresholds of the role rules.
NAMED_DATE_SHARE = 0.6
UNNAMED_DATE_SHARE = 0.7
KEY_RATIO = 0.3
KEY_DISTINCT = 20
UNIQUE_RATIO = 0.95
UNIQUE_MIN_ROWS = 10
CODED_INT_DISTINCT = 5
CATEGORY_DISTINCT = 30
CATEGORY_RATIO = 0.05
TEXT_LENGTH = 40

#: Sketch size of the distinct-count screen, its relative standard deviation, and how many of those a threshold must
#: be away.
_SCREEN_LOG_SIZE = 12
_SCREEN_RSD = 1.04 / 2 ** (_SCREEN_LOG_SIZE / 2)
_SCREEN_MARGIN = 6


@dataclass(frozen=True)
class Roles:
    """Column names by role, in table order."""

    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    date: list[str] = field(default_factory=list)
    id_high_cardinality: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, pairs) -> Roles:
        roles = cls()
        for column, role in pairs:
            getattr(roles, role).append(column)
        return roles

    def role_of(self, column: str) -> str | None:
        return next((role for role in ROLES if column in getattr(self, role)), None)


def _date_named(column: str) -> bool:
    return any(part in column.lower() for part in DATE_NAME_PARTS)


def _key_named(column: str) -> bool:
    name = column.lower().strip()
    return any(
        name == word or name.endswith("_" + word) or name.startswith(word + "_") for word in KEY_NAME_WORDS
    )


def _kind(data_type: T.DataType) -> str:
    if isinstance(data_type, TEMPORAL):
        return "temporal"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, INTEGRAL):
        return "integral"
    if isinstance(data_type, FRACTIONAL):
        return "fractional"
    return "string"


def _date_like(df: DataFrame, name: str, formats) -> Column:
    """Whether a string cell reads as a date; without a date-like name it must also hold a separator."""
    if not isinstance(df.schema[name].dataType, T.StringType):
        return F.lit(None).cast("boolean")
    reads = reads_as_date(col(name), formats)
    return reads if _date_named(name) else has_date_separator(col(name)) & reads


def _facts(df: DataFrame, name: str) -> list[Column]:
    """What the schema alone says about a column, as literals."""
    data_type = df.schema[name].dataType
    return [
        F.lit(df.columns.index(name)).alias("position"),
        F.lit(name).alias("column"),
        F.lit(data_type.simpleString()).alias("dtype"),
        F.lit(_kind(data_type)).alias("kind"),
        F.lit(_date_named(name)).alias("date_named"),
        F.lit(_key_named(name)).alias("key_named"),
    ]


def _cell_key(df: DataFrame, name: str) -> list[Column]:
    """Two numbers that name a cell's value within its column; the first is null for a missing cell.

    XXH64 maps numbers of up to 64 bits one to one, so these have one hash and a zero; other values have two hashes of
    differing seeds, 128 bits in all.
    """
    data_type = df.schema[name].dataType
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        value = col(name) + F.lit(0.0)  # both zeros are one value
    elif isinstance(data_type, (*INTEGRAL, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        value = col(name)
    else:
        value = string_value(df, name)
        return [F.when(value.isNotNull(), F.xxhash64(value)), F.xxhash64(F.lit(1), value)]
    return [F.when(value.isNotNull(), F.xxhash64(value)), F.lit(0).cast("long")]


def _text_figures(df: DataFrame, names: list[str], formats) -> DataFrame:
    """Mean length and date share of the string columns among ``names``, by position: one row per task is shuffled."""
    strings = [(i, n) for i, n in enumerate(names) if _kind(df.schema[n].dataType) == "string"]
    aggregates = []
    for i, name in strings:
        text = string_value(df, name)
        aggregates.append(F.struct(
            F.lit(i).alias("c"), F.avg(F.length(text)).alias("avg_len"),
            F.try_divide(F.count_if(_date_like(df, name, formats)), F.count(text)).alias("date_share"),
        ))
    none = F.struct(F.lit(-1).alias("c"), *(F.lit(None).cast("double").alias(n) for n in ("avg_len", "date_share")))
    wide = df.agg(F.array(*aggregates, none).alias("figures")) if strings else df.sparkSession.range(1).select(
        F.array(none).alias("figures")
    )
    return wide.select(F.inline("figures"))


def _exact_stats(df: DataFrame, names: list[str], formats) -> DataFrame:
    """Exact figures per column: count equal cells of all columns, then fold the counts.

    Cells travel as fixed-width numbers, never as text. Equal ones combine before the shuffle, so a value that fills
    most rows costs one row per task; the second fold moves one row per column and task. The figures of texts come from
    a scan of the string columns alone: with their long date test in it, the code that hashes cells would be too large
    to be compiled.
    """
    cells = []
    for i, name in enumerate(names):
        high, low = _cell_key(df, name)
        cells.append(F.struct(F.lit(i).alias("c"), high.alias("high"), low.alias("low")))
    counted = df.select(F.inline(F.array(*cells))).groupBy("c", "high", "low").agg(F.count(F.lit(1)).alias("n"))
    facts = F.array(*(F.struct(*_facts(df, n)) for n in names))
    counts = counted.groupBy("c").agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(F.col("high").isNotNull(), F.col("n")).otherwise(0)).alias("non_null"),
        F.count("high").alias("n_unique"),
    )
    # At most one row per column of the table on either side.
    return counts.join(F.broadcast(_text_figures(df, names, formats)), "c", "left").select(
        F.inline(F.array(F.get(facts, F.col("c")))), "n_rows", "non_null", "n_unique", "avg_len", "date_share"
    )


def _screened_stats(df: DataFrame, names: list[str], formats) -> DataFrame:
    """The same figures with distinct-count sketches: no shuffle but one row per task."""
    aggregates = [F.count(F.lit(1)).alias("n_rows")]
    for i, name in enumerate(names):
        string = _kind(df.schema[name].dataType) == "string"
        value = string_value(df, name) if string else col(name)
        digest = F.when(value.isNotNull(), F.xxhash64(value))
        aggregates += [
            F.count(value).alias(f"non_null_{i}"),
            F.hll_sketch_estimate(F.hll_sketch_agg(digest, F.lit(_SCREEN_LOG_SIZE))).alias(f"n_unique_{i}"),
        ]
    cells = F.array(*(
        F.struct(
            *_facts(df, name), F.col("n_rows"), F.col(f"non_null_{i}").alias("non_null"),
            F.col(f"n_unique_{i}").alias("n_unique"),
        )
        for i, name in enumerate(names)
    ))
    screened = df.agg(*aggregates).select(F.inline(cells))
    figures = _text_figures(df, names, formats).withColumnRenamed("c", "position")
    return screened.join(F.broadcast(figures), "position", "left")


def _role(bool_as_numeric: bool, strict_order: bool) -> Column:
    """The role rules; the first that holds decides.

    Differences from the classic order, each with a switch: booleans are categories (``bool_as_numeric``), and strings
    longer than 40 characters on average are text before all-distinct columns are keys (``strict_order``).
    """
    kind, n_unique, ratio = F.col("kind"), F.col("n_unique"), F.col("unique_ratio")
    string = kind == "string"
    number = kind.isin("integral", "fractional", "boolean") if bool_as_numeric else kind.isin("integral", "fractional")
    # An integer column with missing cells counts as fractional: such columns hold floats once a table has gaps.
    whole = (kind == "integral") & (F.col("nulls") == 0)
    fractional = (kind == "fractional") | ((kind == "integral") & (F.col("nulls") > 0))
    date_share = F.when(F.col("date_named"), F.col("date_share") > NAMED_DATE_SHARE).otherwise(
        F.col("date_share") > UNNAMED_DATE_SHARE
    )
    long_text = string & (F.col("avg_len") > TEXT_LENGTH)
    few = (n_unique <= CATEGORY_DISTINCT) | (ratio <= CATEGORY_RATIO)
    role = F.when(kind == "temporal", "date").when(string & date_share, "date")
    role = role.when(F.col("key_named") & ((ratio > KEY_RATIO) | (n_unique > KEY_DISTINCT)), "id_high_cardinality")
    if not strict_order:
        role = role.when(long_text & ~few, "text")
    role = role.when(
        (ratio >= UNIQUE_RATIO) & (F.col("n_rows") >= UNIQUE_MIN_ROWS) & ~fractional, "id_high_cardinality"
    )
    role = role.when(number & whole & (n_unique <= CODED_INT_DISTINCT), "categorical").when(number, "numeric")
    return role.when(few, "categorical").when(long_text, "text").otherwise("categorical")


def profile(
    df: DataFrame,
    *,
    distinct: str = "exact",
    bool_as_numeric: bool = False,
    strict_order: bool = False,
    formats=DATE_FORMATS,
) -> DataFrame:
    """One row per column: role, type, counts, distinct values and share, mean length, date share.

    ``distinct="screened"`` estimates distinct counts in a single scan; see :func:`detect_roles`, which counts exactly
    wherever an estimate is close to a rule's threshold. Mean length and date share concern strings only. An empty
    table gives an empty profile.
    """
    df = nan_to_null(df)
    if not df.columns:
        raise ValueError("a table needs at least one column")
    stats = {"exact": _exact_stats, "screened": _screened_stats}[distinct](df, df.columns, formats)
    return (
        stats.where(F.col("n_rows") > 0)
        .withColumn("nulls", F.col("n_rows") - F.col("non_null"))
        .withColumn("unique_ratio", F.try_divide(F.col("n_unique"), F.col("n_rows")))
        .withColumn("role", _role(bool_as_numeric, strict_order))
        .select(
            "position", "column", "role", "dtype", "kind", "key_named", "n_rows", "non_null", "nulls", "n_unique",
            "unique_ratio", "avg_len", "date_share",
        )
    )


def _undecided(row) -> bool:
    """Whether a distinct estimate is too close to a threshold of a rule that concerns the column."""
    edges = []
    if row.key_named:
        edges += [KEY_DISTINCT + 0.5, KEY_RATIO * row.n_rows]
    if row.kind != "fractional":
        edges.append(UNIQUE_RATIO * row.n_rows)
    if row.kind == "integral":
        edges.append(CODED_INT_DISTINCT + 0.5)
    if row.kind in ("string", "boolean"):
        edges += [CATEGORY_DISTINCT + 0.5, CATEGORY_RATIO * row.n_rows]
    slack = max(2.0, _SCREEN_MARGIN * _SCREEN_RSD * row.n_unique)
    return row.role != "date" and any(abs(row.n_unique - edge) <= slack for edge in edges)


def detect_roles(df: DataFrame, **options) -> Roles:
    """Roles of all columns.

    One scan with distinct-count sketches decides most columns; only those whose estimate lies within six standard
    deviations of a threshold are counted exactly. Returns names only, bounded by the width of the table.
    """
    rows = {r.column: r for r in profile(df, distinct="screened", **options).collect()}
    close = [name for name in df.columns if name in rows and _undecided(rows[name])]
    if close:
        exact = profile(df.select(*(col(c) for c in close)), distinct="exact", **options)
        rows.update({r.column: r for r in exact.collect()})
    return Roles.of((name, rows[name].role) for name in df.columns if name in rows)


def telemetry(df: DataFrame, order_by: list[str], *, samples: int = 3, width: int = 40, **options) -> DataFrame:
    """Profile plus the first ``samples`` values per column in ``order_by`` order, cut to ``width`` characters.

    One scan serves all columns: each task keeps the first few rows of every column.
    """
    clean = nan_to_null(df)
    keys = [col(c).alias(f"_k{i}") for i, c in enumerate(order_by)]
    names = [f"_k{i}" for i in range(len(order_by))]
    cells = F.array(*(
        F.struct(F.lit(n).alias("column"), string_value(clean, n).alias("_shown")) for n in clean.columns
    ))
    long = clean.select(*keys, F.inline(cells)).where(F.col("_shown").isNotNull())
    place = Window.partitionBy("column").orderBy(*names, "_shown")
    sampled = (
        long.withColumn("_rank", F.row_number().over(place)).where(F.col("_rank") <= samples)
        .groupBy("column").agg(F.array_sort(F.collect_list(F.struct("_rank", "_shown"))).alias("_firsts"))
        .select("column", F.array_join(F.transform("_firsts", lambda p: p["_shown"]), ", ").alias("_all"))
    )
    cut = F.when(
        F.length("_all") > width, F.concat(F.substring("_all", 1, width - 3), F.lit("..."))
    ).otherwise(F.col("_all"))
    return (
        profile(df, **options)
        .join(F.broadcast(sampled), "column", "left")
        .select(
            "position", "column", "role", "dtype", "non_null", "nulls", "n_unique",
            F.round(F.col("unique_ratio") * 100, 1).alias("unique_pct"),
            F.round(F.try_divide(F.col("nulls"), F.col("n_rows")) * 100, 1).alias("missing_pct"),
            F.coalesce(cut, F.lit("")).alias("sample_values"),
        )
    )


def shape(df: DataFrame) -> DataFrame:
    """One row: rows, columns, cells, null cells and surplus copies of equal rows.

    Copies are found by grouping on all columns (long texts by digest): equal rows collapse before the shuffle, so even
    one row repeated all over the table moves once per task.
    """
    df = nan_to_null(df)
    keys = [
        compact_key(string_value(df, f.name)) if _kind(f.dataType) == "string" else col(f.name) for f in df.schema
    ]
    nulls = reduce(lambda a, b: a + b, (F.when(col(c).isNull(), 1).otherwise(0) for c in df.columns))
    grouped = (
        df.select(*(k.alias(f"k{i}") for i, k in enumerate(keys)), nulls.cast("long").alias("_nulls"))
        .groupBy(*(f"k{i}" for i in range(len(keys))), "_nulls")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return grouped.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        (F.coalesce(F.sum("_n"), F.lit(0)) * len(df.columns)).alias("cells"),
        F.coalesce(F.sum(F.col("_n") * F.col("_nulls")), F.lit(0)).alias("null_cells"),
        (F.coalesce(F.sum("_n"), F.lit(0)) - F.count(F.lit(1))).alias("duplicate_rows"),
    )


def raw_score(nulls: Column, cells: Column, duplicates: Column, rows: Column) -> Column:
    """100 less the share of null cells in percent and five points for a table of nothing but copies."""
    null_part = F.coalesce(F.try_divide(nulls, cells), F.lit(0.0)) * 100
    copy_part = F.coalesce(F.try_divide(duplicates, rows), F.lit(0.0)) * 5
    return F.greatest(F.lit(0.0), F.lit(100.0) - null_part - copy_part)


def clamp_score(score: Column) -> Column:
    """The published score never falls below 85; the raw one is always given beside it."""
    return F.least(F.lit(100.0), F.greatest(F.lit(85.0), score))


def hygiene_score(df: DataFrame) -> DataFrame:
    """Shape figures with the raw score and the one clamped to [85, 100]."""
    scored = shape(df).withColumn(
        "raw_score",
        raw_score(F.col("null_cells"), F.col("cells"), F.col("duplicate_rows"), F.col("n_rows")),
    )
    return scored.withColumn("hygiene_score", clamp_score(F.col("raw_score")))


def value_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows per (column, value); ``number`` holds the value of numeric columns, to order ties by size.

    One scan; equal cells of a column combine before the shuffle.
    """
    def number(name: str) -> Column:
        return as_number(df, name) if is_number(df.schema[name].dataType) else F.lit(None).cast("double")

    def text(name: str) -> Column:
        floating = isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))
        return F.when(col(name) == 0, F.lit("0.0")).otherwise(string_value(df, name)) if floating else string_value(df, name)

    cells = F.array(*(
        F.struct(F.lit(n).alias("column"), text(n).alias("value"), (number(n) + F.lit(0.0)).alias("number")) for n in names
    ))
    return df.select(F.inline(cells)).groupBy("column", "value", "number").agg(F.count(F.lit(1)).alias("n"))


def categorical_stats(df: DataFrame, names: list[str]) -> DataFrame:
    """Distinct values, the most frequent value (the smallest one on ties), its count and its share of all rows."""
    counts = value_counts(nan_to_null(df), names)
    present = F.col("value").isNotNull()
    best = F.min(F.when(present, F.struct(-F.col("n"), F.col("number"), F.col("value"))))
    return (
        counts.groupBy("column")
        .agg(F.count("value").alias("n_unique"), best.alias("_best"), F.sum("n").alias("_rows"))
        .select(
            "column",
            "n_unique",
            F.col("_best.value").alias("top_value"),
            F.coalesce(-F.col("_best.col1"), F.lit(0)).alias("top_count"),
            F.try_divide(-F.col("_best.col1"), F.col("_rows")).alias("top_share"),
        )
    )


def null_counts(df: DataFrame) -> DataFrame:
    """Missing cells per column, from one aggregate."""
    df = nan_to_null(df)
    wide = df.agg(*(F.count_if(col(c).isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)))
    return unpivot(wide, [f"c{i}" for i in range(len(df.columns))], lambda d, n: F.col(n), "nulls").select(
        "position", F.element_at(F.array(*(F.lit(c) for c in df.columns)), F.col("position") + 1).alias("column"),
        "nulls",
    )
