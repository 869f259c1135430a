"""Exact quantiles that never need all values of a column or group in one task; one method for every size."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colsight.functions.numbers import as_number, col
from colsight.session import materialize

#: Rounds end once this many values or fewer lie between the bounds of a wanted rank; those are put in order.
PICK_ROWS = 10_000

_ACCURACY = 10_000


@dataclass
class _Search:
    """The value of one rank (counted from 0) of one column: it lies strictly between ``low`` and ``high``."""

    column: str
    rank: int
    below: int  # values up to and including ``low``
    inside: int
    low: float | None = None
    high: float | None = None

    def between(self):
        value, test = F.col(self.column), F.col(self.column).isNotNull()
        if self.low is not None:
            test = test & (value > self.low)
        if self.high is not None:
            test = test & (value < self.high)
        return test


def _searched(numbers: DataFrame, searches: list[_Search]) -> dict[tuple[str, int], float]:
    """The wanted order statistics, by rounds of two scans and one that picks.

    A round sketches the values between the bounds of each rank, and counts what lies below, at and between two sketched
    values close to it. Either the rank falls on one of them, or they are its new bounds, which hold about a thousandth of
    the values before; a value that many rows share is never between bounds again. Nothing is shuffled but sums.
    """
    found: dict[tuple[str, int], float] = {}
    slack = 4.0 / _ACCURACY
    while wide := [s for s in searches if (s.column, s.rank) not in found and s.inside > PICK_ROWS]:
        ends = [
            [min(1.0, max(0.0, (s.rank - s.below) / s.inside + d)) for d in (-slack, slack)] for s in wide
        ]
        near = numbers.agg(*(
            F.percentile_approx(F.when(s.between(), F.col(s.column)), e, _ACCURACY) for s, e in zip(wide, ends)
        )).first()
        sums = []
        for s, (a, b) in zip(wide, near):
            value, inside = F.col(s.column), s.between()
            tests = [value < a, value == a, (value > a) & (value < b), (value == b) & (value != a)]
            sums += [F.count_if(inside & t) for t in tests]
        counts = numbers.agg(*sums).first()
        for k, (s, (a, b)) in enumerate(zip(wide, near)):
            less, at_a, middle, at_b = counts[4 * k : 4 * k + 4]
            place = s.rank - s.below
            if place < less:
                s.high, s.inside = a, less
            elif place < less + at_a:
                found[s.column, s.rank] = a
            elif place < less + at_a + middle:
                s.low, s.high, s.below, s.inside = a, b, s.below + less + at_a, middle
            elif place < less + at_a + middle + at_b:
                found[s.column, s.rank] = b
            else:
                s.low, s.below = b, s.below + less + at_a + middle + at_b
                s.inside -= less + at_a + middle + at_b
    left = [s for s in searches if (s.column, s.rank) not in found]
    if left:
        row = numbers.agg(*(
            F.get(F.sort_array(F.collect_list(F.when(s.between(), F.col(s.column)))), F.lit(s.rank - s.below))
            for s in left
        )).first()
        found.update({(s.column, s.rank): value for s, value in zip(left, row)})
    return found


def exact_quantiles(
    df: DataFrame, names: list[str], probs: list[float]
) -> dict[str, list[float | None]]:
    """Interpolated quantiles of numeric columns as plain numbers, nulls ignored; an all-null column gives None.

    Sketches narrow down the values around each wanted rank until at most ``PICK_ROWS`` are left to be put in order.
    """
    if not names:
        return {}
    numbers = df.select(*(as_number(df, n).alias(f"v{i}") for i, n in enumerate(names)))
    totals = numbers.agg(*(F.count(v) for v in numbers.columns)).first()
    wanted = {}
    for v, total in zip(numbers.columns, totals):
        for p in probs if total else ():
            exact = p * (total - 1)
            for rank in {math.floor(exact), math.ceil(exact)}:
                wanted[v, rank] = _Search(v, rank, 0, total)
    found = _searched(numbers, list(wanted.values())) if wanted else {}

    def quantile(v: str, total: int, p: float) -> float | None:
        if not total:
            return None
        exact = p * (total - 1)
        low, share = math.floor(exact), exact - math.floor(exact)
        return (1 - share) * found[v, low] + share * found[v, math.ceil(exact)] if share else found[v, low]

    return {n: [quantile(v, t, p) for p in probs] for n, v, t in zip(names, numbers.columns, totals)}


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """``keys..., quantiles array<double>`` per group, in the order of ``probs``; null keys form a group.

    Equal values are counted first. The counts are then dealt by ranges of key and value, whatever the sizes of groups,
    so a large group, or one whose values lie close together, fills as many tasks as it needs. Totals per task tell which
    of them hold a wanted rank, and only those are put in order.
    """
    groups = [f"g{i}" for i in range(len(keys))]
    plain = df.select(*(col(k).alias(g) for k, g in zip(keys, groups)), as_number(df, value).alias("value"))
    counted = plain.where(F.col("value").isNotNull()).groupBy(*groups, "value").agg(F.count(F.lit(1)).alias("n"))
    dealt = counted.repartitionByRange(*groups, "value").withColumn("part", F.spark_partition_id())
    placed = materialize(dealt, "quantiles")

    group = Window.partitionBy(*groups)
    totals = placed.groupBy(*groups, "part").agg(F.sum("n").alias("part_n"))
    rank = F.col("p") * (F.col("group_n") - 1)
    places = (
        totals.withColumn("before", F.sum("part_n").over(group.orderBy("part")) - F.col("part_n"))
        .withColumn("group_n", F.sum("part_n").over(group))
        .withColumn("p", F.explode(F.array(*(F.lit(float(p)) for p in probs))))
        .withColumn("low", F.floor(rank))
        .withColumn("high", F.ceil(rank))
        .where((F.col("before") <= F.col("high")) & (F.col("before") + F.col("part_n") > F.col("low")))
        .select(*groups, "part", "p", "before", "low", "high", (rank - F.floor(rank)).alias("fraction"))
    )
    same = reduce(lambda a, b: a & b, (F.col(f"c.{k}").eqNullSafe(F.col(f"t.{k}")) for k in [*groups, "part"]))
    hit = placed.alias("c").join(places.alias("t"), same).select("c.*", "p", "before", "low", "high", "fraction")
    order = Window.partitionBy(*groups, "part", "p").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    seen = hit.withColumn("seen", F.col("before") + F.sum("n").over(order))
    found = seen.groupBy(*groups, "p", "fraction").agg(
        F.min(F.when(F.col("seen") > F.col("low"), F.col("value"))).alias("a"),
        F.min(F.when(F.col("seen") > F.col("high"), F.col("value"))).alias("b"),
    )
    between = F.when(F.col("fraction") == 0, F.col("a")).otherwise(
        (1 - F.col("fraction")) * F.col("a") + F.col("fraction") * F.col("b")
    )
    by_prob = F.map_from_entries(F.collect_list(F.struct("p", between)))
    picked = found.groupBy(*groups).agg(by_prob.alias("q"))
    quantiles = F.array(*(F.try_element_at("q", F.lit(float(p))) for p in probs))
    return picked.select(*(F.col(g).alias(k) for g, k in zip(groups, keys)), quantiles.alias("quantiles"))
