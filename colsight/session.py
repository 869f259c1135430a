"""Session builder and shared scratch space."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths handed out inside each open :func:`owned_scratch`, the innermost last.
_OWNED: list[list[str]] = []


def build_session(app_name: str = "colsight", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; ``conf`` adds or overrides settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _local_root() -> str:
    """A folder for sessions of one machine without a shared one, removed when Python ends."""
    root = tempfile.mkdtemp(prefix="colsight-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the folder the cluster shares (``spark.checkpoint.dir``).

    Only a session within one process may run without that setting; it then gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = _local_root()
    path = f"{root.rstrip('/')}/colsight/{label}-{uuid.uuid4().hex}"
    if _OWNED:
        _OWNED[-1].append(path)
    return path


@contextmanager
def owned_scratch() -> Iterator[list[str]]:
    """Collects the scratch paths handed out meanwhile, so that their owner can remove them once nothing reads them."""
    paths: list[str] = []
    _OWNED.append(paths)
    try:
        yield paths
    finally:
        _OWNED.remove(paths)


def remove_scratch(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables below the shared folder; those already gone are passed over."""
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def materialize(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; ``compression`` takes the place of the session's codec.

    A written table cuts the lineage, survives lost executors and, unlike a cached one, lets later passes read single
    columns.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)



def dealt(df: DataFrame, partitions: int) -> DataFrame:
    """The rows dealt evenly over ``partitions`` by their number, which, unlike a plain ``repartition``, sorts no rows."""
    number = f"row_{uuid.uuid4().hex}"
    return df.withColumn(number, F.monotonically_increasing_id()).repartition(partitions, number).drop(number)
