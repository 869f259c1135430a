"""Running statistics and per-batch cleaning over a stream of rows.

Results live in tables below a folder. A micro-batch writes its own ``batch_id=N`` directory, overwritten when the batch is
repeated, or a table that a manifest commits once; so a restart after a lost executor or driver counts no batch twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsight.functions.dates import DATE_FORMATS
from colsight.functions.numbers import as_number, col, nan_to_null, string_value, unpivot
from colsight.operators.clean import coerce_dates, fill_values, impute, string_hygiene
from colsight.operators.profile import Roles, clamp_score, null_counts, raw_score
from colsight.operators.sampling import hashed_sample
from colsight.session import materialize, owned_scratch, remove_scratch, scratch_path
from colsight.streaming.tiers import add_batch, open_tiers

#: Values reported per column by :func:`running_top_values`.
TOP_VALUES = 10


def read_parquet_stream(
    spark: SparkSession, folder: str, schema: T.StructType, *, glob: str | None = None, files_per_batch: int = 1
) -> DataFrame:
    """Parquet files of a folder as a stream of micro-batches."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(folder)


def _run(stream: DataFrame, write, folder: str, mode: str) -> None:
    """Process what is available now; progress is kept in the folder's checkpoint."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()


def _folder(df: DataFrame, label: str, folder: str | None) -> str:
    return folder or scratch_path(df.sparkSession, label)


def running_numeric_stats(stream: DataFrame, names: list[str], folder: str | None = None) -> DataFrame:
    """Minimum, maximum, count, mean and population deviation per column; unreadable cells are ignored.

    State is one row per column. Each trigger writes the complete result, which is as small.
    """
    folder = _folder(stream, "running-stats", folder)
    value = F.col("value")
    stats = (
        unpivot(stream, names, as_number)
        .groupBy("position", "column")
        .agg(
            F.min(value).alias("minimum"), F.max(value).alias("maximum"), F.count(value).alias("n"),
            F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        )
    )
    return _latest(stats, folder)


def running_null_counts(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Missing cells per column so far."""
    folder = _folder(stream, "running-nulls", folder)
    rows = unpivot(
        nan_to_null(stream), stream.columns, lambda d, n: col(n).isNull().cast("long"), "missing"
    )
    counts = rows.groupBy("position", "column").agg(F.sum("missing").alias("nulls"))
    return _latest(counts, folder)


def _latest(stats: DataFrame, folder: str) -> DataFrame:
    """Runs a complete-mode aggregate and reads back the result of the last batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result/batch_id={batch_id}")

    _run(stats, write, folder, "complete")
    saved = stats.sparkSession.read.parquet(f"{folder}/result")
    last = saved.agg(F.max("batch_id")).scalar()
    return saved.where(F.col("batch_id") == last).drop("batch_id")


def running_top_values(
    stream: DataFrame, names: list[str], folder: str | None = None, *, n: int = TOP_VALUES
) -> DataFrame:
    """The ``n`` most frequent values per column over all batches, exact.

    A batch writes its value counts, already folded, and tables of counts are merged in tiers, so what is read and summed
    at the end are few tables however many batches came. No state grows with the number of distinct values, and a value
    that fills a third of the stream is one row per table.
    """
    folder = _folder(stream, "running-top", folder)
    cells = unpivot(nan_to_null(stream), names, string_value)

    def folded(counts: DataFrame) -> DataFrame:
        return counts.groupBy("column", "value").agg(F.sum("n").alias("n"))

    def write(batch: DataFrame, batch_id: int) -> None:
        counts = folded(batch.select("column", "value", F.lit(1).cast("long").alias("n")))
        add_batch(counts, f"{folder}/counts", batch_id, folded)

    _run(cells, write, folder, "append")
    counts = folded(open_tiers(stream.sparkSession, f"{folder}/counts", "column string, value string, n long"))
    # One top-k per column: each is a small heap per task, where a window would sort every value of a column.
    tops = [
        counts.where(F.col("column") == name).orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(n)
        for name in names
    ]
    out = tops[0]
    for top in tops[1:]:
        out = out.unionByName(top)
    return out


def running_sample(
    stream: DataFrame, n: int, keys: list[str] | None = None, folder: str | None = None, *, seed: int = 42,
    digest: Column | None = None,
) -> DataFrame:
    """The sample that :func:`colsight.operators.sampling.hashed_sample` would take of all batches together.

    The ``n`` rows of lowest hash are among those of their batch, so a batch writes at most ``n`` rows, and so does every
    merge of tables.
    """
    folder = _folder(stream, "running-sample", folder)

    def lowest(rows: DataFrame) -> DataFrame:
        return hashed_sample(rows, n, keys, seed, digest)

    def write(batch: DataFrame, batch_id: int) -> None:
        add_batch(lowest(batch), f"{folder}/sample", batch_id, lowest)

    _run(stream, write, folder, "append")
    return lowest(open_tiers(stream.sparkSession, f"{folder}/sample", stream.schema))


def stream_deduplicated(stream: DataFrame, keys: list[str], event_time: str, delay: str = "1 hour") -> DataFrame:
    """Rows without copies across batches, as long as a copy arrives within ``delay`` of the first in event time.

    State holds the keys of that span only, spread by key hash.
    """
    timed = stream.withColumn(event_time, col(event_time).cast("timestamp"))
    return timed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def write_stream_table(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Runs an append stream into a Parquet table and reads it back."""
    folder = _folder(stream, "stream-table", folder)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/data/batch_id={batch_id}")

    _run(stream, write, folder, "append")
    return stream.sparkSession.read.parquet(f"{folder}/data").drop("batch_id")


def clean_batches(
    stream: DataFrame, roles: Roles, folder: str | None = None, *, policy: str = "median_mode", formats=DATE_FORMATS
) -> tuple[DataFrame, DataFrame]:
    """Each micro-batch cleaned by itself; returns the cleaned table and one log row per batch.

    Duplicates, medians and modes are those of the batch, which is what a stream can know; for the whole-table meaning
    run :func:`colsight.operators.clean.clean` on the finished table. The log holds rows in and out, duplicates, and
    cells that were missing and filled; durations are in the query's own progress reports.
    """
    folder = _folder(stream, "clean-batches", folder)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows_in = nan_to_null(batch)
        with owned_scratch() as written:
            rows = materialize(rows_in.dropDuplicates(), "batch-rows")
            tidy = string_hygiene(rows)
            gaps = {r["column"]: r["nulls"] for r in null_counts(tidy).collect()}
            fillable = [c for c in roles.numeric + roles.categorical if gaps.get(c)]
            fills = fill_values(tidy, roles, policy, only=fillable) if policy != "drop" else {}
            done = coerce_dates(impute(tidy, fills), roles.date, formats)
            if policy == "drop":
                done = done.na.drop("any")
            done.write.mode("overwrite").parquet(f"{folder}/data/batch_id={batch_id}")
            log = rows.sparkSession.range(1).select(
                rows_in.agg(F.count(F.lit(1))).scalar().alias("rows_in"),
                rows.agg(F.count(F.lit(1))).scalar().alias("distinct_rows"),
                F.lit(sum(gaps.values())).cast("long").alias("missing_cells"),
                F.lit(sum(gaps[c] for c in fills)).cast("long").alias("imputed_cells"),
            )
            log.write.mode("overwrite").parquet(f"{folder}/log/batch_id={batch_id}")
        remove_scratch(rows.sparkSession, written)

    _run(stream, write, folder, "append")
    spark = stream.sparkSession
    data = spark.read.parquet(f"{folder}/data").drop("batch_id")
    log = spark.read.parquet(f"{folder}/log").select(
        "batch_id", "rows_in", "distinct_rows", (F.col("rows_in") - F.col("distinct_rows")).alias("duplicates"),
        "missing_cells", "imputed_cells",
    )
    return data, log


def batch_summary(log: DataFrame, n_columns: int) -> DataFrame:
    """Totals of a batch log with the hygiene score; duplicates across batches are not in it."""
    cells = F.sum("rows_in") * n_columns
    totals = log.agg(
        F.count(F.lit(1)).alias("batches"), F.sum("rows_in").alias("rows_in"),
        F.sum("distinct_rows").alias("rows_out"), F.sum("duplicates").alias("duplicates"),
        F.sum("imputed_cells").alias("imputed_cells"),
        raw_score(F.sum("missing_cells"), cells, F.sum("duplicates"), F.sum("rows_in")).alias("raw_score"),
    )
    return totals.withColumn("hygiene_score", clamp_score(F.col("raw_score")))


def folder_bytes(spark: SparkSession, folder: str) -> int:
    """Bytes of all files below a folder of any file system Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def throughput(progress: list, n_bytes: int | None = None) -> dict[str, float]:
    """Batches with rows and their mean rows per second, from a query's reports (``StreamingQuery.recentProgress``).

    With ``n_bytes``, the size of what was read (see :func:`folder_bytes`), also rows, the seconds the batches took,
    megabytes, and megabytes per second.
    """
    done = [p for p in progress if p["numInputRows"]]
    rates = [p["processedRowsPerSecond"] for p in done]
    figures = {"batches": len(done), "rows_per_second": sum(rates) / len(rates) if rates else 0.0}
    if n_bytes is None:
        return figures
    seconds = sum(p["durationMs"]["triggerExecution"] for p in done) / 1000
    return {
        **figures, "rows": sum(p["numInputRows"] for p in done), "seconds": seconds, "megabytes": n_bytes / 1e6,
        "megabytes_per_second": n_bytes / 1e6 / seconds if seconds else 0.0,
    }
