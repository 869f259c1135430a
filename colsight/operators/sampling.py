"""Repeatable row samples for models and plots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsight.functions.numbers import col, string_value


def hashed_sample(
    df: DataFrame, n: int, keys: list[str] | None = None, seed: int = 42, digest: Column | None = None
) -> DataFrame:
    """``n`` rows with the lowest hash of their key; the same rows whatever the partitioning.

    ``digest`` takes the place of the seeded hash, for instance one that other systems have too.
    """
    keys = keys or df.columns
    if digest is None:
        digest = F.xxhash64(F.lit(seed), *(F.coalesce(string_value(df, c), F.lit("\x00")) for c in keys))
    return df.orderBy(digest, *(col(c) for c in keys)).limit(n)


def fraction_sample(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Roughly ``fraction`` of all rows."""
    return df.sample(fraction=fraction, seed=seed)
