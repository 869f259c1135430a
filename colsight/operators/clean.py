"""Whole-table cleaning: duplicates, missing values, string and date hygiene, with a countable report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsight.functions.dates import DATE_FORMATS, day_first_columns, parse_timestamp
from colsight.functions.numbers import as_number, col, is_integral, is_number, nan_to_null
from colsight.functions.text import keeps_case, null_tokens_to_null, title_case
from colsight.operators.profile import Roles, categorical_stats, clamp_score, null_counts, raw_score
from colsight.operators.quantiles import exact_quantiles
from colsight.session import materialize

POLICIES = ("median_mode", "mean", "drop")
ORDERS = ("hygiene_first", "impute_first")

#: Fill for a categorical column without any value.
SENTINEL = "Unknown"


def drop_copies(df: DataFrame) -> DataFrame:
    """One of each set of equal rows, nulls being equal; copies collapse before the shuffle."""
    return nan_to_null(df).dropDuplicates()


def _is_string(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def _tidied(text: Column, name: str) -> Column:
    value = null_tokens_to_null(text)
    return value if keeps_case(name) else title_case(value)


def hygienic(name: str) -> Column:
    """Trimmed text with null tokens as null, in title case unless the column is a key by name."""
    return _tidied(col(name), name)


def string_hygiene(df: DataFrame) -> DataFrame:
    """:func:`hygienic` on every string column."""
    return df.select(*(hygienic(c).alias(c) if _is_string(df, c) else col(c) for c in df.columns))


def coerce_dates(
    df: DataFrame, names: list[str], formats=DATE_FORMATS, day_first: frozenset[str] | None = None
) -> DataFrame:
    """String columns among ``names`` as timestamps; unreadable text becomes null.

    Each column is read in one order of day and month. ``day_first`` names the columns that write the day first; without
    it one aggregate finds them.
    """
    texts = [c for c in df.columns if c in names and _is_string(df, c)]
    if day_first is None:
        day_first = day_first_columns(df, texts)
    return df.select(
        *(parse_timestamp(col(c), formats, c in day_first).alias(c) if c in texts else col(c) for c in df.columns)
    )


def fill_values(
    df: DataFrame,
    roles: Roles,
    policy: str = "median_mode",
    *,
    only: list[str] | None = None,
) -> dict[str, object]:
    """One fill value per numeric and categorical column: median or mean, and mode; at most one per column.

    A column without values is filled with 0 or ``Unknown``. Ties between modes go to the smallest value.
    """
    wanted = set(df.columns if only is None else only)
    numeric = [c for c in roles.numeric if c in wanted]
    categorical = [c for c in roles.categorical if c in wanted]
    fills: dict[str, object] = {}
    if numeric and policy == "mean":
        row = df.agg(*(F.avg(as_number(df, c)).alias(f"m{i}") for i, c in enumerate(numeric))).first()
        fills.update({c: row[i] if row[i] is not None else 0.0 for i, c in enumerate(numeric)})
    elif numeric:
        medians = exact_quantiles(df, numeric, [0.5])
        fills.update({c: m[0] if m[0] is not None else 0.0 for c, m in medians.items()})
    if categorical:
        modes = {r["column"]: r["top_value"] for r in categorical_stats(df, categorical).collect()}
        fills.update({c: modes.get(c) if modes.get(c) is not None else SENTINEL for c in categorical})
    return fills


def _filled(df: DataFrame, name: str, fill: object) -> Column:
    """A column with its nulls filled; whole numbers turn to doubles when the fill has a fraction."""
    data_type = df.schema[name].dataType
    if is_number(data_type):
        if is_integral(data_type) and not float(fill).is_integer():
            return F.coalesce(col(name).cast("double"), F.lit(float(fill)))
        return F.coalesce(col(name), F.lit(fill).cast(data_type))
    if isinstance(data_type, T.StringType):
        return F.coalesce(col(name), F.lit(str(fill)))
    return F.coalesce(col(name), F.lit(fill).try_cast(data_type))


def impute(df: DataFrame, fills: dict[str, object]) -> DataFrame:
    """``df`` with the given fill values in place of nulls."""
    return df.select(*(_filled(df, c, fills[c]).alias(c) if c in fills else col(c) for c in df.columns))


@dataclass(frozen=True)
class Cleaned:
    """A cleaned table with what was done to it; all tables are lazy."""

    data: DataFrame
    base: DataFrame
    tidy: DataFrame
    roles: Roles
    fills: dict[str, object]
    report: DataFrame
    steps: DataFrame
    imputed: DataFrame
    order: str
    formats: tuple
    day_first: frozenset


@dataclass(frozen=True)
class _Counts:
    """What was counted while the distinct rows were written."""

    rows: int
    null_cells: int
    distinct: int
    gaps: dict[str, int]


def _stored(raw: DataFrame, with_tidy: bool) -> tuple[DataFrame, DataFrame, _Counts]:
    """Writes the distinct rows, with a tidy copy of each string column beside it; returns raw and tidy views and counts.

    String hygiene is the costliest work per row; this way it runs once, and passes over one view do not read the
    columns of the other. All counts are taken by the tasks that write, behind the shuffle, where every task counts once
    however often executors are lost: rows and null cells of the whole table follow from the copies of each distinct row.
    """
    names = raw.columns
    strings = [c for c in names if _is_string(raw, c)] if with_tidy else []
    extra = {c: f"{c}\x1ftidy" for c in strings}
    copies = "\x1fcopies"
    distinct = raw.groupBy(*(col(c) for c in names)).agg(F.count(F.lit(1)).alias(copies))
    wide = distinct.select("*", *(hygienic(c).alias(extra[c]) for c in strings))
    empty = sum((F.when(col(c).isNull(), 1).otherwise(0) for c in names), F.lit(0))
    seen = Observation()
    counted = wide.observe(
        seen, F.count(F.lit(1)).alias("distinct"), F.sum(col(copies)).alias("rows"),
        F.sum(col(copies) * empty).alias("null_cells"),
        *(F.count_if(col(extra.get(c, c)).isNull()).alias(f"gaps{i}") for i, c in enumerate(names)),
    )
    stored = materialize(counted.drop(copies), "dedup")
    found = seen.get
    counts = _Counts(
        found.get("rows") or 0, found.get("null_cells") or 0, found.get("distinct") or 0,
        {c: found.get(f"gaps{i}") or 0 for i, c in enumerate(names)},
    )
    return (
        stored.select(*(col(c) for c in names)),
        stored.select(*(col(extra[c]).alias(c) if c in extra else col(c) for c in names)),
        counts,
    )


def clean(
    df: DataFrame,
    roles: Roles,
    *,
    policy: str = "median_mode",
    order: str = "hygiene_first",
    formats=DATE_FORMATS,
) -> Cleaned:
    """Drop copies, tidy strings, fill missing cells, parse dates.

    ``order="hygiene_first"`` recognises null tokens before filling, so that no token is left as a null and modes are
    taken on tidy text; ``"impute_first"`` fills first, as older tools do. ``policy`` is ``median_mode``, ``mean`` or
    ``drop`` (rows with any null go, after hygiene and date parsing).

    The deduplicated table is written once to the shared folder, tidy strings included: fill values, result, report
    and diff all read that, instead of shuffling all rows again for each.
    """
    if policy not in POLICIES or order not in ORDERS:
        raise ValueError(f"policy is one of {POLICIES}, order one of {ORDERS}")
    raw = nan_to_null(df)
    base, tidy, counts = _stored(raw, order == "hygiene_first")
    early = tidy if order == "hygiene_first" else base

    gaps = counts.gaps
    before = df.sparkSession.createDataFrame(
        [(i, c, n) for i, (c, n) in enumerate(gaps.items())], "position int, column string, nulls long"
    )
    fillable = [c for c in roles.numeric + roles.categorical if gaps.get(c)] if policy != "drop" else []
    fills = fill_values(early, roles, policy, only=fillable)

    filled = impute(early, fills)
    late = filled if order == "hygiene_first" else string_hygiene(filled)
    texts = [c for c in roles.date if c in late.columns and _is_string(late, c)]
    day_first = day_first_columns(base, texts)
    data = coerce_dates(late, roles.date, formats, day_first)
    written = read = F.lit(0).cast("long")
    if texts:
        filled_cells = sum((F.count_if(col(c).isNotNull()) for c in texts), F.lit(0).cast("long"))
        written, read = late.agg(filled_cells).scalar(), data.agg(filled_cells).scalar()
    if policy == "drop":
        data = data.na.drop("any")

    imputed = before.select(
        "position", "column", F.when(F.col("column").isin(*fills), F.col("nulls")).otherwise(0).alias("imputed")
    ) if fills else before.select("position", "column", F.lit(0).cast("long").alias("imputed"))
    dates = (read, written - read)
    report = _report(counts, base, data, roles, {c: gaps[c] for c in fills}, policy, dates)
    return Cleaned(
        data, base, tidy, roles, fills, report, _steps(report), imputed, order, tuple(formats), day_first
    )


def _report(
    counts: _Counts, base: DataFrame, data: DataFrame, roles: Roles, imputed: dict[str, int], policy: str,
    cells: tuple[Column, Column],
) -> DataFrame:
    """One row: shapes, duplicates, filled and rebuilt cells, date cells read and not, and the score of the raw table."""
    strings = [f.name for f in base.schema if isinstance(f.dataType, T.StringType)]
    dates = [c for c in roles.date if c in base.columns]
    distinct = F.lit(counts.distinct).cast("long")
    one = base.sparkSession.range(1).select(
        F.lit(counts.rows).cast("long").alias("initial_rows"),
        F.lit(counts.null_cells).cast("long").alias("initial_nulls"),
        distinct.alias("distinct_rows"),
        (data.agg(F.count(F.lit(1))).scalar() if policy == "drop" else distinct).alias("final_rows"),
    )
    columns = F.lit(len(base.columns)).cast("long")
    score = raw_score(
        F.col("initial_nulls"),
        F.col("initial_rows") * columns,
        F.col("initial_rows") - F.col("distinct_rows"),
        F.col("initial_rows"),
    )
    return one.select(
        "initial_rows",
        columns.alias("n_columns"),
        "final_rows",
        (F.col("initial_rows") - F.col("distinct_rows")).alias("duplicates_removed"),
        "initial_nulls",
        F.lit(sum(imputed.get(c, 0) for c in roles.numeric)).cast("long").alias("numeric_imputed"),
        F.lit(sum(imputed.get(c, 0) for c in roles.categorical)).cast("long").alias("categorical_imputed"),
        F.lit(sum(imputed.values())).cast("long").alias("total_imputed"),
        (F.col("distinct_rows") * len(strings)).alias("string_cells"),
        F.array(*(F.lit(c) for c in dates)).cast("array<string>").alias("dates_converted"),
        cells[0].alias("date_cells"), cells[1].alias("unreadable_dates"),
        score.alias("raw_score"),
        clamp_score(score).alias("hygiene_score"),
    )


def _steps(report: DataFrame) -> DataFrame:
    """The report as one row per cleaning step with the rows or cells it touched."""
    steps = (
        ("Duplicate rows removed", "dedup", "duplicates_removed"),
        ("Numeric gaps filled", "impute_numeric", "numeric_imputed"),
        ("Categorical gaps filled", "impute_categorical", "categorical_imputed"),
        ("String cells tidied", "string_hygiene", "string_cells"),
        ("Date cells parsed", "date_coercion", "date_cells"),
    )
    rows = F.array(
        *(
            F.struct(
                F.lit(i).alias("step_num"), F.lit(title).alias("title"), F.lit(tag).alias("tag"),
                F.col(count).alias("rows_or_cells"),
            )
            for i, (title, tag, count) in enumerate(steps, 1)
        )
    )
    return report.select(F.inline(rows))


def column_audit(cleaned: Cleaned) -> DataFrame:
    """Per column: role, filled cells, what was done, nulls left."""
    roles = cleaned.roles
    role = F.coalesce(
        *(F.when(F.col("column").isin(*names), F.lit(name)) for name, names in vars(roles).items() if names),
        F.lit("general"),
    )
    filled = F.col("imputed") > 0
    strategy = (
        F.when((F.col("role") == "numeric") & filled, "numeric fill")
        .when(F.col("role") == "numeric", "validated")
        .when((F.col("role") == "categorical") & filled, "mode or sentinel fill")
        .when(F.col("role") == "categorical", "grouped")
        .when(F.col("role") == "date", "parsed to timestamp")
        .when(F.col("role") == "id_high_cardinality", "key kept, trimmed")
        .otherwise("tidied, title case")
    )
    after = null_counts(cleaned.data).select("column", F.col("nulls").alias("nulls_after"))
    return (
        cleaned.imputed.join(after, "column")
        .withColumn("role", role)
        .select("position", "column", "role", "imputed", strategy.alias("strategy"), "nulls_after")
    )


def changed_cells(cleaned: Cleaned) -> DataFrame:
    """Cells per column whose value differs between the deduplicated and the cleaned table.

    Both sides are columns of one projection, so no join is needed. A date text counts as changed when it could not be
    read or is not already the ISO form of its date.
    """
    base, roles = cleaned.base, cleaned.roles

    def after(name: str) -> Column:
        fill = cleaned.fills.get(name)
        if not _is_string(base, name):
            return col(name) if fill is None else _filled(base, name, fill)

        def filled(value: Column) -> Column:
            return value if fill is None else F.coalesce(value, F.lit(str(fill)))

        if cleaned.order == "hygiene_first":
            value = filled(_tidied(col(name), name))
        else:
            value = _tidied(filled(col(name)), name)
        if name in roles.date:
            parsed = parse_timestamp(value, cleaned.formats, name in cleaned.day_first)
            midnight = parsed == F.date_trunc("day", parsed)
            return F.when(midnight, F.date_format(parsed, "yyyy-MM-dd")).otherwise(
                F.date_format(parsed, "yyyy-MM-dd HH:mm:ss")
            )
        return value

    wide = base.agg(
        *(F.count_if(~col(c).eqNullSafe(after(c))).alias(f"c{i}") for i, c in enumerate(base.columns))
    )
    rows = F.array(
        *(
            F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(f"c{i}").alias("changed"))
            for i, c in enumerate(base.columns)
        )
    )
    return wide.select(F.inline(rows))
