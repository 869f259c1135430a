"""Questions in English, answered with an operator's table."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsight.functions.numbers import as_number, col
from colsight.operators.charts import histogram, points
from colsight.operators.nlfilter import Filtered, Rule, best_column, filter_rows
from colsight.operators.profile import Roles, hygiene_score
from colsight.operators.quantiles import exact_quantiles
from colsight.operators.report import cited
from colsight.operators.retrieval import TextIndex, search_index

# Words that reveal what a question asks for, in order of precedence.
INTENTS = {
    "code": ("sql", "code", "python", "pandas", "query"),
    "hygiene": (
        "accuracy", "hygiene", "quality", "clean", "health", "valid", "score", "reliable", "trust", "precision",
        "integrity",
    ),
    "chart": ("plot", "chart", "graph", "visualize", "histogram", "scatter", "bar", "distribution"),
    "top": ("top", "highest", "max", "best", "leading", "rank"),
    "stats": ("average", "mean", "avg", "total", "sum", "stats", "metrics", "describe"),
}
TREND_WORDS = ("trend", "line", "time")
HISTOGRAM_WORDS = ("histogram", "distribution")

#: Rows in ranked tables; bins of a filter answer's histogram.
TOP_ROWS = 10
FILTER_BINS = 20


@dataclass(frozen=True)
class Answer:
    """What was understood and the tables that answer it; parts that do not apply are None."""

    intent: str
    table: DataFrame | None = None
    chart: DataFrame | None = None
    chart_kind: str | None = None
    figures: DataFrame | None = None
    citations: DataFrame | None = None
    sql: str | None = None
    rules: list[Rule] = field(default_factory=list)


def _mentions(question: str, words: tuple[str, ...]) -> bool:
    return re.search(r"\b(?:" + "|".join(words) + r")s?\b", question.lower()) is not None


def intent_of(question: str) -> str | None:
    """The first intent with a whole word in the question."""
    return next((name for name, words in INTENTS.items() if _mentions(question, words)), None)


def match_column(question: str, columns: list[str]) -> str | None:
    """The column a question names best, else the first of the list."""
    return best_column(columns, question) or (columns[0] if columns else None)


def top_ranking(df: DataFrame, category: str, number: str, n: int = TOP_ROWS) -> DataFrame:
    """Sum, mean and count of a number per category, largest sums first; rows without a category are left out."""
    value = as_number(df, number)
    return (
        df.where(col(category).isNotNull())
        .groupBy(col(category))
        .agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), F.count(value).alias("n"))
        .orderBy(F.desc("total"), col(category))
        .limit(n)
    )


def column_stats(df: DataFrame, name: str) -> DataFrame:
    """Sum, mean, median, extremes, sample deviation and count of one column."""
    value = as_number(df, name)
    median = exact_quantiles(df, [name], [0.5])[name][0]
    return df.agg(
        F.sum(value).alias("total"), F.avg(value).alias("mean"), F.min(value).alias("minimum"),
        F.max(value).alias("maximum"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"),
    ).select(F.lit(name).alias("column"), "*", F.lit(median).cast("double").alias("median"))


def hygiene_audit(df: DataFrame) -> DataFrame:
    """Score, rows, columns, duplicate rows and null cells, one row each."""
    figures = ("hygiene_score", "n_rows", "n_columns", "duplicate_rows", "null_cells")
    rows = F.array(
        *(
            F.struct(F.lit(i).alias("position"), F.lit(name).alias("figure"), F.col(name).cast("double").alias("value"))
            for i, name in enumerate(figures)
        )
    )
    return hygiene_score(df).select(F.inline(rows))


def top_sql(category: str, number: str, view: str = "data", n: int = TOP_ROWS) -> str:
    """SQL text of the ranking; it counts rows where :func:`top_ranking` counts numbers."""
    c, v = (f"`{name.replace('`', '``')}`" for name in (category, number))
    return (
        f"SELECT {c}, SUM({v}) AS total, AVG({v}) AS mean, COUNT(*) AS n\n"
        f"FROM {view}\n"
        f"GROUP BY {c}\n"
        f"ORDER BY total DESC, {c}\n"
        f"LIMIT {n}"
    )


def run_sql(df: DataFrame, text: str, view: str = "data") -> DataFrame:
    """Runs SQL text with ``df`` as the table it names."""
    df.createOrReplaceTempView(view)
    return df.sparkSession.sql(text)


def filter_figures(found: Filtered, numeric: list[str]) -> DataFrame:
    """Counts of a filter with mean, minimum and maximum of the numeric columns of its rows, in one scan."""
    kept = F.lit(True) if found.condition is None else F.coalesce(found.condition, F.lit(False))
    aggregates = [F.count(F.lit(1)).alias("original_count"), F.count_if(kept).alias("filtered_count")]
    for name in numeric:
        value = F.when(kept, as_number(found.source, name))
        aggregates += [
            F.avg(value).alias(f"mean_{name}"), F.min(value).alias(f"min_{name}"), F.max(value).alias(f"max_{name}")
        ]
    return found.source.agg(*aggregates)


def _chart(df: DataFrame, roles: Roles, question: str, category: str | None, number: str | None) -> Answer | None:
    if _mentions(question, ("scatter",)) and len(roles.numeric) >= 2:
        x, y = roles.numeric[:2]
        columns = [x, y, *([category] if category else [])]
        return Answer("chart", chart=points(df, columns), chart_kind="scatter")
    if _mentions(question, TREND_WORDS) and roles.date and number:
        line = points(df, [roles.date[0], number], order_by=[roles.date[0]])
        return Answer("chart", chart=line, chart_kind="line")
    if number and (_mentions(question, HISTOGRAM_WORDS) or not category):
        return Answer("chart", chart=histogram(df, number), chart_kind="histogram")
    if number and category:
        ranked = top_ranking(df, category, number).select(col(category), "total")
        return Answer("chart", chart=ranked, chart_kind="bar")
    return None


def ask(
    df: DataFrame, roles: Roles, question: str, *, index: TextIndex | None = None, chunks: DataFrame | None = None,
    order_by: list[str] | None = None,
) -> Answer:
    """Route a question to an operator.

    Words count only whole (``transactions`` is no ``action``), SQL requests come first, and asking for a distribution
    gives a histogram even if there are categories. ``index`` holds the chunks to cite, see
    :func:`colsight.operators.report.index_chunks`, and ``chunks`` their titles and texts. A filter's answer lists all its rows, lazily, in the order of
    ``order_by`` if given; the caller limits them.
    """
    category = match_column(question, roles.categorical)
    number = match_column(question, roles.numeric)
    citations = None
    if index is not None:
        citations = search_index(index, question) if chunks is None else cited(index, chunks, question)
    intent = intent_of(question)
    if intent == "code" and category and number:
        text = top_sql(category, number)
        return Answer("code", table=run_sql(df, text), sql=text, citations=citations)
    if intent == "hygiene":
        return Answer("hygiene", table=hygiene_audit(df), citations=citations)
    if intent == "chart":
        answer = _chart(df, roles, question, category, number)
        if answer:
            return Answer("chart", chart=answer.chart, chart_kind=answer.chart_kind, citations=citations)
    if intent in ("top", "chart") and category and number:
        return Answer("top", table=top_ranking(df, category, number), citations=citations)
    if intent == "stats" and number:
        return Answer("stats", table=column_stats(df, number), citations=citations)
    found = filter_rows(df, roles, question)
    if found.rules:
        listed = found.data.orderBy(*(col(c) for c in order_by)) if order_by else found.data
        chart = histogram(found.data, roles.numeric[0], FILTER_BINS) if roles.numeric else None
        return Answer(
            "filter", table=listed, chart=chart, chart_kind="histogram" if chart is not None else None,
            figures=filter_figures(found, roles.numeric), citations=citations, rules=found.rules,
        )
    return Answer("retrieval", citations=citations)
