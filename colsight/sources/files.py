"""CSV and Parquet scans and sinks, merged files, saved datasets, previews."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsight.functions.numbers import col, string_value
from colsight.sources.snapshots import load_version, save_version

#: Column that names the file a merged row came from.
SOURCE_COLUMN = "_source_file"


def csv_encoding(spark: SparkSession, path: str | list[str]) -> str:
    """``UTF-8``, or ``ISO-8859-1`` where the bytes are not UTF-8.

    The lines of a text scan keep their bytes, so each is tested as it is, in splits on all executors, and the scan
    stops at the first line that fails.
    """
    broken = spark.read.text(path).where(~F.is_valid_utf8("value"))
    return "UTF-8" if broken.limit(1).count() == 0 else "ISO-8859-1"


def read_csv(
    spark: SparkSession, path: str | list[str], *, schema: T.StructType | str | None = None, encoding: str | None = None,
    multiline: bool = False, **options,
) -> DataFrame:
    """A CSV file, folder or list of them, each with a header. Types are inferred unless a schema is given, the encoding likewise.

    Give both for large inputs: each inference is a pass over the data. Without ``multiline`` files are split.
    """
    reader = (
        spark.read.option("header", True)
        .option("encoding", encoding or csv_encoding(spark, path))
        .option("multiLine", multiline)
        .option("escape", '"')
        .options(**options)
    )
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_csv_stream(
    spark: SparkSession, folder: str, schema: T.StructType | str, *, files_per_batch: int = 1,
    encoding: str = "UTF-8", **options,
) -> DataFrame:
    """A folder of CSV files as a stream of micro-batches."""
    return (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("encoding", encoding)
        .option("escape", '"')
        .option("maxFilesPerTrigger", files_per_batch)
        .options(**options)
        .csv(folder)
    )


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def _is_parquet(path: str) -> bool:
    return path.rstrip("/").lower().endswith(".parquet")


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """One table by file ending: Parquet, otherwise CSV."""
    if _is_parquet(path):
        return read_parquet(spark, path)
    return read_csv(spark, path, **options)


def select_table(spark: SparkSession, paths: Sequence[str], index: int, **options) -> DataFrame:
    """One of several files."""
    return read_table(spark, paths[index], **options)


def _aligned(tables: Sequence[DataFrame]) -> list[DataFrame]:
    """Columns whose type differs between tables as text in all of them; whole and fractional numbers as doubles."""
    types: dict[str, set] = {}
    for table in tables:
        for f in table.schema:
            if f.name != SOURCE_COLUMN:
                types.setdefault(f.name, set()).add(f.dataType)
    target = {}
    for name, found in types.items():
        if len(found) > 1:
            if all(isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) for t in found):
                target[name] = "long"
            elif all(isinstance(t, T.NumericType) for t in found):
                target[name] = "double"
            else:
                target[name] = "string"

    def cast(table: DataFrame, name: str):
        if name not in target:
            return col(name)
        if target[name] == "string":
            return string_value(table, name).alias(name)
        return col(name).cast(target[name]).alias(name)

    return [t.select(*(cast(t, c) for c in t.columns)) for t in tables]


def merge_files(
    spark: SparkSession, paths: Sequence[str], *, skip_unreadable: bool = True, **options
) -> tuple[DataFrame, list[str]]:
    """All files as one table by column name plus ``_source_file``; returns it with the paths that were skipped.

    Columns a file lacks are null. Files of one format, encoding and schema become a single scan, so the plan grows
    with the number of different schemas, not of files. Types are aligned before the union, as a union would otherwise
    pick a type that fails on the first value of the other. ``options`` are those of :func:`read_csv`.
    """
    groups: dict[tuple, list[str]] = {}
    skipped = []
    for path in paths:
        try:
            if _is_parquet(path):
                kind, encoding, schema = "parquet", None, read_parquet(spark, path).schema
            else:
                kind, encoding = "csv", options.get("encoding") or csv_encoding(spark, path)
                schema = read_csv(spark, path, **{**options, "encoding": encoding}).schema
            groups.setdefault((kind, encoding, schema.json()), []).append(path)
        except (PySparkException, Py4JJavaError):
            if not skip_unreadable:
                raise
            skipped.append(path)
    if not groups:
        raise ValueError("none of the files could be read")
    tables = []
    for (kind, encoding, schema), members in groups.items():
        if kind == "parquet":
            table = read_parquet(spark, *members)
        else:
            known = T.StructType.fromJson(json.loads(schema))
            table = read_csv(spark, members, **{**options, "encoding": encoding, "schema": known})
        tables.append(table.select("*", F.col("_metadata.file_name").alias(SOURCE_COLUMN)))
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), _aligned(tables))
    others = [c for c in merged.columns if c != SOURCE_COLUMN]
    return merged.select(*(col(c) for c in others), SOURCE_COLUMN), skipped


def write_csv(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """A folder of CSV files with a header each; quotes are doubled, as :func:`read_csv` expects."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def save_dataset(df: DataFrame, folder: str, name: str) -> None:
    """Keep a table and its display name for a later session, as the next version of ``folder``.

    The table may be read from the same folder; see :func:`save_version`.
    """
    save_version(df, folder, name)


def restore_dataset(spark: SparkSession, folder: str) -> tuple[DataFrame, str] | None:
    """The table and name kept by :func:`save_dataset`, or None."""
    return load_version(spark, folder)


def preview(df: DataFrame, order_by: Sequence[str], n: int = 25) -> DataFrame:
    """The first ``n`` rows in the order of the given key; a top-k, not a sort of the table."""
    if not order_by:
        raise ValueError("a preview needs an order key")
    return df.orderBy(*(col(c) for c in order_by)).limit(n)
