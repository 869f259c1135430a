"""English phrases to row filters."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsight.functions.numbers import as_number, col, string_value
from colsight.functions.text import strip
from colsight.operators.profile import Roles

# Comparison phrases and what they mean.
COMPARISONS = {
    "greater than or equal to": ">=",
    "less than or equal to": "<=",
    "at least": ">=",
    "at most": "<=",
    "greater than": ">",
    "more than": ">",
    "higher than": ">",
    "exceeding": ">",
    "above": ">",
    "over": ">",
    "less than": "<",
    "lower than": "<",
    "smaller than": "<",
    "below": "<",
    "under": "<",
    "equal to": "=",
    "equals": "=",
    ">=": ">=",
    "<=": "<=",
    "==": "=",
    ">": ">",
    "<": "<",
    "=": "=",
    "is": "=",
}

# Words that ask for rows but say nothing about them.
FILLER = (
    "show me", "filter", "find", "get", "rows", "where", "display", "the", "dataset", "records", "with", "that have",
    "which have", "list", "all",
)

_WORDY = "|".join(rf"\b{re.escape(p)}\b" for p in COMPARISONS if p[0].isalpha())
_SIGNS = "|".join(re.escape(p) for p in COMPARISONS if not p[0].isalpha())
_COMPARISON = re.compile(
    rf"(?P<op>{_WORDY}|{_SIGNS})\s*[₹$€£]?\s*(?P<number>-?\d+(?:,\d{{3}})*(?:\.\d+)?)", re.IGNORECASE
)
_FILLER = re.compile(r"\b(?:" + "|".join(FILLER) + r")\b")


@dataclass(frozen=True)
class Rule:
    """One condition read from a phrase."""

    column: str
    op: str
    value: float | str

    def __str__(self) -> str:
        shown = f"{self.value:g}" if isinstance(self.value, float) else f"'{self.value}'"
        return f"`{self.column}` {self.op} {shown}"


@dataclass(frozen=True)
class Filtered:
    """Rows a phrase selects, the rules read from it and the condition they form (None selects everything)."""

    source: DataFrame
    rules: list[Rule]
    condition: Column | None

    @property
    def data(self) -> DataFrame:
        return self.source if self.condition is None else self.source.where(self.condition)

    def metrics(self) -> DataFrame:
        """Rows before and after, and the share kept in percent, from one scan."""
        kept = F.lit(True) if self.condition is None else F.coalesce(self.condition, F.lit(False))
        counted = self.source.agg(F.count(F.lit(1)).alias("original_count"), F.count_if(kept).alias("filtered_count"))
        share = F.try_divide(F.col("filtered_count"), F.col("original_count")) * 100
        return counted.withColumn("percentage", F.round(F.coalesce(share, F.lit(0.0)), 1))


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def name_score(column: str, text: str) -> int:
    """How well a text names a column: its whole name counts most, then each whole word of the name.

    A run-together name such as ``totalprice`` is also found when the text spells it in two words.
    """
    words = _words(text)
    parts = [w for w in _words(column) if len(w) > 1]
    squashed = "".join(words)
    hits = sum(1 for p in parts if p in words or (len(p) > 4 and p in squashed))
    whole = bool(parts) and f" {' '.join(_words(column))} " in f" {' '.join(words)} "
    return hits + (10 if whole else 0)


def best_column(columns: list[str], text: str) -> str | None:
    """The column a text names best; the first one wins ties, no match gives None."""
    scored = [(name_score(c, text), -i, c) for i, c in enumerate(columns)]
    score, _, column = max(scored, default=(0, 0, None))
    return column if score > 0 else None


def numeric_rules(phrase: str, numeric: list[str]) -> tuple[list[Rule], str]:
    """Comparisons in a phrase and what is left of it.

    Each comparison is read with the words between it and the one before; a comparison naming no column falls back to
    a column named anywhere in the phrase, then to the first numeric one.
    """
    rules, start = [], 0
    if not numeric:
        return [], phrase
    for match in _COMPARISON.finditer(phrase):
        before = phrase[start : match.start()]
        column = best_column(numeric, before) or best_column(numeric, phrase) or numeric[0]
        number = float(match["number"].replace(",", ""))
        rules.append(Rule(column, COMPARISONS[match["op"].lower()], number))
        start = match.end()
    return rules, _COMPARISON.sub(" ", phrase)


def value_rules(df: DataFrame, columns: list[str], text: str) -> list[Rule]:
    """Category values that occur in the text as whole words.

    Runs on Spark: cells longer than the text are dropped before anything else, the rest must be contained in it, so
    no more distinct values than the text has substrings can come back.
    """
    if not columns or not text.strip():
        return []
    cells = F.array(
        *(F.struct(F.lit(c).alias("column"), strip(string_value(df, c)).alias("value")) for c in columns)
    )
    lowered = F.lower("value")
    inside = F.lit(text).contains(lowered)
    found = (
        df.select(F.inline(cells))
        .where(F.length("value").between(2, len(text)) & inside)
        .select("column", lowered.alias("value"))
        .distinct()
        .collect()
    )
    hits = [
        (r["column"], r["value"])
        for r in found
        if re.search(rf"(?<!\w){re.escape(r['value'])}(?!\w)", text)
    ]
    # A value inside a longer matching value of the same column says nothing of its own.
    kept = [
        (c, v) for c, v in hits if not any(c == c2 and v != v2 and v in v2 for c2, v2 in hits)
    ]
    return [Rule(c, "=", v) for c, v in sorted(kept, key=lambda x: (columns.index(x[0]), x[1]))]


def _condition(df: DataFrame, rule: Rule, contains: bool) -> Column:
    if isinstance(rule.value, str):
        cell = F.lower(strip(string_value(df, rule.column)))
        return cell.contains(rule.value) if contains else cell == rule.value
    number, bound = as_number(df, rule.column), F.lit(rule.value)
    if isinstance(df.schema[rule.column].dataType, (T.NumericType,)) and not isinstance(
        df.schema[rule.column].dataType, (T.FloatType, T.DoubleType)
    ):
        # Whole numbers are compared in their own type where the bound allows it, so the scan can use the filter.
        number = col(rule.column)
        bound = F.lit(int(rule.value)) if rule.value.is_integer() else bound
    elif isinstance(df.schema[rule.column].dataType, (T.FloatType, T.DoubleType)):
        # NaN is greater than any number in Spark; the plain column keeps the filter in the scan.
        number = col(rule.column)
        if rule.op in (">", ">="):
            return {">": number > bound, ">=": number >= bound}[rule.op] & ~F.isnan(number)
    return {
        ">": number > bound, ">=": number >= bound, "<": number < bound, "<=": number <= bound, "=": number == bound,
    }[rule.op]


def combine(df: DataFrame, rules: list[Rule], contains: bool = False) -> Column | None:
    """OR between values of one column, AND between columns and comparisons."""
    if not rules:
        return None
    parts = [_condition(df, r, contains) for r in rules if not isinstance(r.value, str)]
    by_column: dict[str, list[Column]] = {}
    for rule in rules:
        if isinstance(rule.value, str):
            by_column.setdefault(rule.column, []).append(_condition(df, rule, contains))
    parts += [reduce(lambda a, b: a | b, options) for options in by_column.values()]
    return reduce(lambda a, b: a & b, parts)


def full_text(df: DataFrame, text: str) -> tuple[list[Rule], Column | None]:
    """Rows where any string column contains any word of three letters or more; nothing found means no filter."""
    words = [w for w in text.split() if len(w) > 2]
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not words or not strings:
        return [], None
    found = reduce(lambda a, b: a | b, (F.lower(col(c)).contains(w) for c in strings for w in words))
    if df.where(found).limit(1).count() == 0:
        return [], None
    return [Rule("*", "contains", " ".join(words))], found


def filter_rows(df: DataFrame, roles: Roles, phrase: str, *, contains: bool = False) -> Filtered:
    """Rows a phrase such as ``west region with revenue above 5,000`` asks for.

    Comparisons are inclusive where they say so. Values must match whole cells (``contains=True`` looks inside them).
    Full-text search is used only if no rule is found. An empty phrase selects everything.
    """
    text = (phrase or "").strip()
    if not text:
        return Filtered(df, [], None)
    rules, rest = numeric_rules(text, [c for c in roles.numeric if c in df.columns])
    rest = " ".join(_FILLER.sub(" ", rest.lower()).split())
    rules += value_rules(df, [c for c in roles.categorical + roles.text if c in df.columns], rest)
    if rules:
        return Filtered(df, rules, combine(df, rules, contains))
    rules, condition = full_text(df, rest)
    return Filtered(df, rules, condition)
