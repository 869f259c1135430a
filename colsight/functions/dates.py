"""Date texts to timestamps."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsight.functions.numbers import col
from colsight.functions.text import strip

# Accepted shapes in order of preference, each with its parse pattern. A shape is tested first, so that
# a pattern only meets texts it can read and failing parses stay rare. None means Spark's own ISO reader. A pattern that
# begins with a numeric month has its day-first twin from :func:`_day_first`.
DATE_FORMATS: tuple[tuple[str, str | None], ...] = (
    (r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?(Z|[+-]\d{2}:\d{2})?$", None),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "M/d/yyyy H:mm"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "M/d/yyyy H:mm:ss"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^[A-Za-z]{4,9} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", "d MMMM yyyy"),
    (r"^\d{4}\.\d{1,2}\.\d{1,2}$", "yyyy.M.d"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "M.d.yyyy"),
    (r"^(19|20)\d{6}$", "yyyyMMdd"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "M/d/yy"),
    (r"^\d{1,2}-\d{1,2}-\d{2}$", "M-d-yy"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2} [AaPp][Mm]$", "yyyy-M-d h:mm a"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2} [AaPp][Mm]$", "M/d/yyyy h:mm a"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2} [AaPp][Mm]$", "M/d/yyyy h:mm:ss a"),
)

#: The one ISO shape, for callers who want a single strict format.
ISO_ONLY = DATE_FORMATS[:1]

#: Texts of two numbers before a year, which order of day and month alone can tell apart.
_TWO_NUMBERS = r"^(\d{1,2})([/.-])(\d{1,2})\2(\d{4}|\d{2})( .*)?$"


def _day_first(pattern: str | None) -> str | None:
    """``M/d/yyyy`` to ``d/M/yyyy``; patterns that don't begin with a numeric month stay."""
    if pattern is None or not pattern.startswith("M") or pattern.startswith("MM"):
        return pattern
    return "d" + pattern[1] + "M" + pattern[3:]


def parse_timestamp(text: Column, formats=DATE_FORMATS, day_first: bool = False) -> Column:
    """First format that reads the trimmed text, else null. ``day_first`` says how a column writes its numeric dates."""
    text = strip(text)

    def attempt(shape: str, pattern: str | None) -> Column:
        if pattern is None:
            return F.when(text.rlike(shape), text.try_cast("timestamp"))
        parsed = F.try_to_timestamp(text, F.lit(_day_first(pattern) if day_first else pattern))
        if pattern.endswith("-yy") or pattern.endswith("/yy"):
            # Two digits from 69 on are years of the last century.
            parsed = F.when(F.year(parsed) > 2068, parsed - F.expr("INTERVAL 100 YEARS")).otherwise(parsed)
        return F.when(text.rlike(shape), parsed)

    return F.coalesce(*(attempt(shape, pattern) for shape, pattern in formats))


def reads_as_date(text: Column, formats=DATE_FORMATS) -> Column:
    """Whether a text is a date in either order of day and month."""
    return F.coalesce(parse_timestamp(text, formats), parse_timestamp(text, formats, day_first=True)).isNotNull()


def day_first_columns(df: DataFrame, names: Sequence[str]) -> frozenset[str]:
    """The string columns among ``names`` that write the day first: more first numbers above 12 than second ones.

    One aggregate over all of them; a column that leaves it open is taken as month-first.
    """
    if not names:
        return frozenset()
    counts = []
    for name in names:
        text = strip(col(name))
        for group in (1, 3):
            counts.append(F.count_if(F.regexp_extract(text, _TWO_NUMBERS, group).try_cast("int") > 12))
    row = df.agg(*counts).first()
    return frozenset(n for i, n in enumerate(names) if row[2 * i] > row[2 * i + 1])


def has_date_separator(text: Column) -> Column:
    """True for texts of at least six characters with a date or time separator."""
    bare = strip(text)
    marks = reduce(lambda a, b: a | b, (bare.contains(mark) for mark in "-/.: "))
    # Stripping never lengthens: short texts are ruled out before it.
    return (F.length(text) >= 6) & (F.length(bare) >= 6) & marks
