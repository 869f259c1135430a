"""String hygiene and tokens as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts that stand for a missing value after trimming.
NULL_TOKENS = ("", "nan", "NaN", "null", "NULL", "None", "<NA>")

# All characters that count as white space around a value.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Name endings of key columns, which keep their letter case.
CASE_KEEPING_NAMES = ("id", "uuid", "code", "hash", "key")

#: A token is a run of at least two letters, digits or underscores.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

_WORD_START = (
    r"(?<=[^\p{IsUppercase}\p{IsLowercase}\p{Lt}])(?=[\p{IsUppercase}\p{IsLowercase}\p{Lt}])"
)

#: Strings longer than this are compared and counted by digest, so that shuffles carry no long texts.
DIGEST_ABOVE = 64


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITE_SPACE))


def null_tokens_to_null(value: Column) -> Column:
    """Trimmed value, or null where it spells a missing value."""
    trimmed = strip(value)
    return F.when(~trimmed.isin(*NULL_TOKENS), trimmed)


def title_case(value: Column) -> Column:
    """Capital after every character that has no case, lower case elsewhere (``o'neil co-op`` -> ``O'Neil Co-Op``)."""
    pieces = F.split(F.lower(value), _WORD_START)
    return F.array_join(F.transform(pieces, F.initcap), "")


def keeps_case(column: str) -> bool:
    """True for key columns by name; a name containing ``name`` is always cased."""
    name = column.lower()
    is_key = any(name == word or name.endswith("_" + word) for word in CASE_KEEPING_NAMES)
    return is_key and "name" not in name


def compact_key(value: Column) -> Column:
    """The value itself when short, else a SHA-256 digest one character longer than any short value."""
    digest = F.concat(F.lit("#"), F.sha2(value, 256))
    return F.when(F.length(value) > DIGEST_ABOVE, digest).otherwise(value)


def tokens(value: Column) -> Column:
    """All tokens of a text, lower case, in order."""
    return F.regexp_extract_all(F.lower(value), F.lit(TOKEN_PATTERN), F.lit(0))
