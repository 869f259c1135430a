"""Mixing sources to target weights by pivotal dependent rounding over a distributed reduction tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsight.session import materialize

#: Expected items in one node of the reduction tree: what a task holds of a source at a time.
FAN_IN = 64

BLANKS = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs without white space; a null text has none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """``target`` of every source, from rows (source, size) of documents: (source, source_size, target).

    Sources in code point order, null last, get the weights in turn. The total is shared by weight; where a share is
    above ``most`` times its source's size it stops there, and the rest is shared again until none is above. Each round
    takes two sums to the driver, whatever the number of sources. Numbering the sources sorts one row of each.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.array(*(F.lit(float(w)) for w in weights))
    ranked = sums.withColumn("rank", F.expr("row_number() over (order by source is null, source) - 1"))
    weighed = materialize(
        ranked.select(
            "source", "source_size", F.get(turn, (F.col("rank") % len(weights)).cast("int")).alias("weight"),
            (F.lit(float(most)) * F.col("source_size")).alias("cap"),
        ),
        "sources",
    )
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, open_weight = 0.0, None
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        weight, used = weighed.agg(
            F.sum(F.when(~full, F.col("weight"))), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0))
        ).first()
        if not weight or weight == open_weight:
            break
        level, open_weight = (total - used) / weight, weight
    return weighed.select("source", "source_size", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


#: One step of the pivotal method. The carried item c (mass a, fraction x) meets the next one e. Mass moves up to c or
#: down to e, as far as it goes; the odds keep the expectation of both fractions, and the sum of a * x stays the same.
#: One of the two becomes integral and is decided, the other is carried on.
PIVOTAL_STEP = """
(acc, e) -> transform(
  transform(
    array(named_struct(
      'c', acc.carry,
      'up', least(acc.carry.a * (1 - acc.carry.x), e.a * e.x),
      'down', least(acc.carry.a * acc.carry.x, e.a * (1 - e.x)))),
    m -> named_struct(
      'c', m.c, 'up', m.up, 'down', m.down, 'rise', e.u * (m.up + m.down) < m.down,
      'settled', if(e.u * (m.up + m.down) < m.down, m.c.a * (1 - m.c.x) <= e.a * e.x, m.c.a * m.c.x <= e.a * (1 - e.x)))),
  m -> named_struct(
    'carry', transform(array(if(m.settled, e, m.c)), k -> named_struct(
      'u', k.u, 'key', k.key, 'a', k.a, 'base', k.base,
      'x', least(1D, greatest(0D, k.x + if(m.rise = m.settled, -1, 1) * if(m.rise, m.up, m.down) / k.a))))[0],
    'done', concat(acc.done, array(named_struct(
      'key', if(m.settled, m.c.key, e.key),
      'copies', if(m.settled, m.c.base, e.base) + if(m.rise = m.settled, 1L, 0L))))))[0]
"""


def _reduced(items: DataFrame, buckets: int, level: int) -> DataFrame:
    """One level of the tree: of each node the decided items, and the one item left with the residual."""
    node = F.pmod(F.xxhash64("item.key", F.lit(level)), F.lit(buckets)).alias("node")
    kind = items.schema["item"].dataType["key"].dataType.simpleString()
    walk = f"""aggregate(
        slice(items, 2, size(items)),
        named_struct('carry', items[0], 'done', cast(array() as array<struct<key: {kind}, copies: bigint>>)),
        {PIVOTAL_STEP})"""
    return (
        items.groupBy("source", node).agg(F.array_sort(F.collect_list("item")).alias("items"))
        .select("source", F.expr(walk).alias("walked")).select("source", "walked.carry", "walked.done")
    )


def mix_sources(
    documents: DataFrame,
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    most: float = 3.0,
    seed: int = 11,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row (id, source, size, replica, source_size, target, copies, taken) per row of ``documents``.

    ``size`` counts words. Every document of a source expects target / source_size copies: it surely gets the whole
    part, and the fractional part is rounded by the pivotal method, weighed by size, so each source's taken words differ
    from its target by less than its largest document. A node of the tree rounds about ``FAN_IN`` items of a source and
    hands on the one that is left; nodes are dealt by a hash of the item, so a source of any size spreads out.
    Odds are hashes of the items, so reruns agree.

    Documents without words, null or empty, take nothing and have no copies. Rows equal in id, source and size are told
    apart by ``replica``, counted from 1; each is rounded on its own. Null sources are one source, the last. An empty
    table gives an empty result.
    """
    slim = materialize(
        documents.select(
            F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"),
            word_count(F.col(f"`{text_col}`")).alias("size"),
        ),
        "sizes",
    )
    targets = materialize(source_targets(slim, weights, most), "targets")
    units = slim.groupBy("id", "source", "size").agg(F.count("*").alias("n")).select(
        "id", "source", "size", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("replica")
    )
    ratio = F.when(F.col("size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    odds = (F.shiftrightunsigned(F.xxhash64("id", "source", "size", "replica", F.lit(seed)), 11) / float(1 << 53))
    rows = units.withColumnRenamed("source", "s").join(targets, F.col("s").eqNullSafe(F.col("source"))).select(
        "source", "target", "source_size",
        F.struct(
            odds.alias("u"), F.struct("id", "size", "replica").alias("key"), F.col("size").cast("double").alias("a"),
            F.floor(ratio).cast("long").alias("base"), (ratio - F.floor(ratio)).alias("x"),
        ).alias("item"),
    )
    rows = materialize(rows, "units")
    whole = rows.where("item.x = 0").select("source", "item.key", F.col("item.base").alias("copies"))
    items = rows.where("item.x > 0").select("source", "item")
    largest = items.groupBy("source").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    decided, buckets, level = [whole], -(-largest // FAN_IN), 0
    while largest:
        step = materialize(_reduced(items, buckets, level), "level")
        decided.append(step.select("source", F.explode("done").alias("d")).select("source", "d.key", "d.copies"))
        items = step.select("source", F.col("carry").alias("item"))
        if buckets == 1:
            last = F.when(F.col("item.u") < F.col("item.x"), 1).otherwise(0)
            decided.append(items.select("source", "item.key", (F.col("item.base") + last).alias("copies")))
            break
        buckets, level = -(-buckets // FAN_IN), level + 1
    result = decided[0]
    for part in decided[1:]:
        result = result.unionByName(part)
    return result.withColumnRenamed("source", "s").join(targets, F.col("s").eqNullSafe(F.col("source"))).select(
        F.col("key.id").alias(id_col), F.col("s").alias(source_col), F.col("key.size").alias("size"),
        F.col("key.replica").alias("replica"), "source_size", "target", "copies",
        (F.col("copies") * F.col("key.size")).alias("taken"),
    )
