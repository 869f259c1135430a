"""Streams over the event files."""

from __future__ import annotations

from pyspark.sql import functions as F

from colsight.operators.profile import Roles
from colsight.operators.sampling import hashed_sample
from colsight.plans.catalog.base import hygiene_sql, mode_sql, query, rounded, table
from colsight.session import scratch_path
from colsight.streaming.batches import (
    batch_summary,
    clean_batches,
    read_parquet_stream,
    running_null_counts,
    running_numeric_stats,
    running_sample,
    running_top_values,
    stream_deduplicated,
    write_stream_table,
)

ROLES = Roles(
    numeric=["value"], categorical=["event_type", "props"], date=["ts"], id_high_cardinality=["event_id", "user_id"]
)
GAPS = "event_id % 9 = 0"


def _events(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return read_parquet_stream(spark, sf_dir, schema, glob="events.parquet")


def _gapped(spark, sf_dir):
    """All events with some values and types missing."""
    gap = F.expr(GAPS)
    return _events(spark, sf_dir).withColumns(
        {"value": F.when(~gap, F.col("value")), "event_type": F.when(~gap, F.col("event_type"))}
    )


@query(" UNION ALL ".join(
    f"""SELECT {i} AS position, '{c}' AS "column", CAST(min({c}) AS DOUBLE) AS minimum,
    CAST(max({c}) AS DOUBLE) AS maximum, count({c}) AS n, round(avg({c}), 4) AS mean,
    round(stddev_pop({c}), 4) AS std FROM events"""
    for i, c in enumerate(("value", "user_id"))
))
def running_num_stats(spark, sf_dir):
    return rounded(running_numeric_stats(_events(spark, sf_dir), ["value", "user_id"]))


@query(" UNION ALL ".join(
    f"""SELECT * FROM (SELECT '{c}' AS "column", {c} AS value, count(*) AS n FROM events GROUP BY {c}
    ORDER BY count(*) DESC, {c} LIMIT 10)"""
    for c in ("event_type", "props")
))
def running_top(spark, sf_dir):
    return running_top_values(_events(spark, sf_dir), ["event_type", "props"])


@query(" UNION ALL ".join(
    f"""SELECT {i} AS position, '{c}' AS "column",
    {f"CAST(count(*) FILTER (WHERE {GAPS}) AS BIGINT)" if c in ("value", "event_type") else "count(*) * 0"}
    AS nulls FROM events"""
    for i, c in enumerate(("event_id", "ts", "user_id", "event_type", "value", "props"))
))
def running_nulls(spark, sf_dir):
    return running_null_counts(_gapped(spark, sf_dir))


@query("SELECT event_id, user_id, event_type, value FROM events")
def stream_dedup(spark, sf_dir):
    """Each event delivered twice comes out once."""
    events = _events(spark, sf_dir)
    twice = events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    once = stream_deduplicated(twice, ["event_id"], "ts")
    return write_stream_table(once.select("event_id", "user_id", "event_type", "value"))


@query(f"""WITH gapped AS (
  SELECT * REPLACE (CASE WHEN NOT {GAPS} THEN value END AS value,
                    CASE WHEN NOT {GAPS} THEN event_type END AS event_type) FROM events),
tidy AS (
  SELECT event_id, CAST(ts AS VARCHAR) AS ts, user_id, {hygiene_sql('event_type')} AS event_type, value,
         {hygiene_sql('props')} AS props FROM gapped)
SELECT * REPLACE (round(coalesce(value, (SELECT median(value) FROM tidy)), 4) AS value,
                  coalesce(event_type, {mode_sql('tidy', 'event_type')}) AS event_type) FROM tidy""")
def stream_clean_batches(spark, sf_dir):
    """The events are one file and so one batch, whose median and mode are those of the table."""
    done = clean_batches(_gapped(spark, sf_dir), ROLES)[0]
    return rounded(done.withColumn("ts", F.col("ts").cast("string")))


@query(f"""SELECT CAST(0 AS INTEGER) AS batch_id, count(*) AS rows_in, count(*) AS distinct_rows,
CAST(0 AS BIGINT) AS duplicates, 2 * count(*) FILTER (WHERE {GAPS}) AS missing_cells,
2 * count(*) FILTER (WHERE {GAPS}) AS imputed_cells FROM events""")
def stream_batch_log(spark, sf_dir):
    return clean_batches(_gapped(spark, sf_dir), ROLES)[1]


@query(f"""SELECT count(*) AS rows_in, count(*) AS rows_out, CAST(0 AS BIGINT) AS duplicates,
2 * count(*) FILTER (WHERE {GAPS}) AS imputed_cells,
round(100.0 - 2 * count(*) FILTER (WHERE {GAPS}) * 100.0 / (6 * count(*)), 6) AS raw_score,
round(least(100.0, greatest(85.0, 100.0 - 2 * count(*) FILTER (WHERE {GAPS}) * 100.0 / (6 * count(*)))), 6)
  AS hygiene_score FROM events""")
def stream_batch_summary(spark, sf_dir):
    log = clean_batches(_gapped(spark, sf_dir), ROLES)[1]
    return rounded(batch_summary(log, 6).drop("batches"), 6)


def _in_batches(spark, folder, parts):
    """A stream whose micro-batches are the given tables in turn, each written as one file for every core."""
    files = spark.sparkContext.defaultParallelism
    for part in parts:
        part.repartition(files).write.mode("append").parquet(folder)
    return read_parquet_stream(spark, folder, parts[0].schema, files_per_batch=files)


def _delivered(spark, sf_dir):
    """The events in four micro-batches by event number; some come twice in a batch."""
    folder = scratch_path(spark, "event-files")
    events = table(spark, sf_dir, "events")
    parts = [events.where(F.col("event_id") % 4 == k) for k in range(4)]
    return _in_batches(spark, folder, [p.unionAll(p.where("event_id % 13 = 0")) for p in parts])


@query(" UNION ALL ".join(
    f"""SELECT {i} AS position, '{c}' AS "column", CAST(min({c}) AS DOUBLE) AS minimum,
    CAST(max({c}) AS DOUBLE) AS maximum, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std
    FROM (FROM events UNION ALL FROM events WHERE event_id % 13 = 0)"""
    for i, c in enumerate(("value", "user_id"))
))
def running_num_stats_batches(spark, sf_dir):
    """Figures merged over four micro-batches."""
    return rounded(running_numeric_stats(_delivered(spark, sf_dir), ["value", "user_id"]))


@query(" UNION ALL ".join(
    f"""SELECT * FROM (SELECT '{c}' AS "column", {c} AS value, count(*) AS n
    FROM (FROM events UNION ALL FROM events WHERE event_id % 13 = 0) GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 10)"""
    for c in ("event_type", "props")
))
def running_top_batches(spark, sf_dir):
    """Counts merged over four micro-batches."""
    return running_top_values(_delivered(spark, sf_dir), ["event_type", "props"])


@query("SELECT event_id, user_id, event_type, value FROM events")
def stream_dedup_batches(spark, sf_dir):
    """Every event comes in two of four micro-batches, and once out."""
    folder = scratch_path(spark, "event-copies")
    events = table(spark, sf_dir, "events")
    stream = _in_batches(spark, folder, [events.where(F.col("event_id") % 4 % 2 == k % 2) for k in range(4)])
    once = stream_deduplicated(stream, ["event_id"], "ts")
    return write_stream_table(once.select("event_id", "user_id", "event_type", "value"))


@query("""SELECT CAST(event_id % 4 AS INTEGER) AS batch_id, count(*) + count(*) FILTER (WHERE event_id % 13 = 0) AS rows_in,
count(*) AS distinct_rows, count(*) FILTER (WHERE event_id % 13 = 0) AS duplicates FROM events GROUP BY 1""")
def stream_batch_log_batches(spark, sf_dir):
    """One row for each of four micro-batches."""
    log = clean_batches(_delivered(spark, sf_dir), ROLES)[1]
    return log.select("batch_id", "rows_in", "distinct_rows", "duplicates")


@query()
def row_sample(spark, sf_dir):
    """A repeatable sample of rows for models and plots."""
    return hashed_sample(table(spark, sf_dir, "events"), 1000, ["event_id"])


@query("SELECT * REPLACE (CAST(ts AS VARCHAR) AS ts) FROM events ORDER BY md5('42:' || event_id), event_id LIMIT 1000")
def row_sample_batches(spark, sf_dir):
    """The same 1000 rows as of the whole table, kept while twelve micro-batches arrive."""
    folder = scratch_path(spark, "event-parts")
    events = table(spark, sf_dir, "events")
    stream = _in_batches(spark, folder, [events.where(F.col("event_id") % 12 == k) for k in range(12)])
    digest = F.md5(F.concat(F.lit("42:"), F.col("event_id").cast("string")))
    return running_sample(stream, 1000, ["event_id"], digest=digest).withColumn("ts", F.col("ts").cast("string"))


@query(" UNION ALL ".join(
    f"""SELECT * FROM (SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM events GROUP BY {c}
    ORDER BY count(*) DESC, CAST({c} AS VARCHAR) LIMIT 10)"""
    for c in ("event_type", "user_id")
))
def running_top_tiers(spark, sf_dir):
    """Counts of seventeen micro-batches, merged in tiers while they arrive."""
    folder = scratch_path(spark, "event-parts")
    events = table(spark, sf_dir, "events")
    stream = _in_batches(spark, folder, [events.where(F.col("event_id") % 17 == k) for k in range(17)])
    return running_top_values(stream, ["event_type", "user_id"])
