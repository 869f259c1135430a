"""Mergeable tables of a stream, kept in tiers: what n batches left is read from O(log n) tables.

Each batch adds one table of level 0. As soon as ``FAN`` tables of a level stand last they are merged into one of the next
level, so a row is rewritten once per level. One manifest per batch, put in place by a rename, names the tables that count:
a batch that is repeated after its commit changes nothing, and what a crash left before the commit is never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from colsight.sources.snapshots import KEPT, VersionFolder

#: Tables of one level that are merged into one of the next.
FAN = 4


def add_batch(table: DataFrame, folder: str, batch_id: int, merge: Callable[[DataFrame], DataFrame]) -> None:
    """Adds the table of a batch and merges full levels; ``merge`` folds the union of tables into one of the same schema."""
    spark = table.sparkSession
    place = VersionFolder(spark, folder)
    known = place.versions()
    if batch_id + 1 in known:
        return
    tables = place.read(known[-1])["tables"] if known else []
    tables.append({"level": 0, "data": _written(table, place, 0)})
    while len(tables) >= FAN and len({t["level"] for t in tables[-FAN:]}) == 1:
        level = tables[-1]["level"] + 1
        union = spark.read.schema(table.schema).parquet(*(f"{place.name}/{t['data']}" for t in tables[-FAN:]))
        tables[-FAN:] = [{"level": level, "data": _written(merge(union), place, level)}]
    if place.commit(batch_id + 1, {"tables": tables}):
        _clear(place)


def _written(table: DataFrame, place: VersionFolder, level: int) -> str:
    name = f"level{level}-{uuid.uuid4().hex}"
    table.write.parquet(f"{place.name}/{name}")
    return name


def _clear(place: VersionFolder) -> None:
    """Removes old manifests, and tables that none of the last ones names; a stream has one writer."""
    versions = place.versions()
    for old in versions[:-KEPT]:
        place.remove(f"manifest-{old}.json")
    used = {t["data"] for v in versions[-KEPT:] for t in place.read(v)["tables"]}
    for name in place.names():
        if name.startswith("level") and name not in used:
            place.remove(name)


def open_tiers(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """The union of the tables of all batches so far, none if no batch came; still to be merged by the reader."""
    place = VersionFolder(spark, folder)
    known = place.versions()
    paths = [f"{place.name}/{t['data']}" for t in place.read(known[-1])["tables"]] if known else []
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
