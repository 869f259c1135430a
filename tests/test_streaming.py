import datetime as dt

import pytest
from pyspark.sql import functions as F

from colsight.operators.profile import Roles
from colsight.operators.sampling import hashed_sample
from colsight.sources.files import read_csv_stream
from colsight.streaming.batches import (
    batch_summary,
    clean_batches,
    folder_bytes,
    read_parquet_stream,
    running_null_counts,
    running_numeric_stats,
    running_sample,
    running_top_values,
    stream_deduplicated,
    throughput,
    write_stream_table,
)
from colsight.streaming.tiers import FAN, add_batch, open_tiers

ROLES = Roles(numeric=["x"], categorical=["s"], id_high_cardinality=["id"])


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stream") / "t")
    df = spark.range(400).select(
        "id",
        F.when(F.col("id") % 10 != 0, (F.col("id") % 50).cast("double")).alias("x"),
        F.when(F.col("id") % 7 != 0, F.concat(F.lit(" v"), (F.col("id") % 3).cast("string"))).alias("s"),
        (F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id"))).alias("t"),
    )
    df.unionByName(df.where("id < 20")).repartitionByRange(4, "id").write.parquet(folder)
    return folder


def stream(spark, folder):
    return read_parquet_stream(spark, folder, spark.read.parquet(folder).schema)


def test_running_statistics_equal_batch_ones(spark, table):
    batch = spark.read.parquet(table)
    want = batch.agg(
        F.min("x"), F.max("x"), F.count("x"), F.avg("x"), F.stddev_pop("x")
    ).first()
    got = running_numeric_stats(stream(spark, table), ["x"]).collect()
    assert len(got) == 1
    assert tuple(got[0])[2:] == pytest.approx(tuple(want))
    nulls = {r["column"]: r["nulls"] for r in running_null_counts(stream(spark, table)).collect()}
    assert nulls == {"id": 0, "x": batch.where("x is null").count(), "s": batch.where("s is null").count(), "t": 0}


def test_running_top_values_are_exact(spark, table):
    top = running_top_values(stream(spark, table), ["s", "x"], n=2).collect()
    for name in ("s", "x"):
        want = (
            spark.read.parquet(table).groupBy(F.col(name).cast("string").alias("v")).count()
            .orderBy(F.desc("count"), F.asc_nulls_last("v")).limit(2).collect()
        )
        assert [(r["value"], r["n"]) for r in top if r["column"] == name] == [(r["v"], r["count"]) for r in want]


def test_a_repeated_run_counts_nothing_twice(spark, table, tmp_path):
    folder = str(tmp_path / "again")
    first = running_top_values(stream(spark, table), ["s"], folder).collect()
    assert running_top_values(stream(spark, table), ["s"], folder).collect() == first


def test_batches_are_cleaned_one_by_one(spark, table):
    data, log = clean_batches(stream(spark, table), ROLES)
    rows = log.orderBy("batch_id").collect()
    assert len(rows) == 4
    assert sum(r["rows_in"] for r in rows) == 420 and sum(r["duplicates"] for r in rows) == 20
    assert data.count() == 400 and data.where("x is null or s is null").count() == 0
    assert {r["s"] for r in data.select("s").distinct().collect()} == {"V0", "V1", "V2"}
    total = batch_summary(log, 4).first()
    assert (total["batches"], total["rows_in"], total["rows_out"]) == (4, 420, 400)
    assert total["raw_score"] < 100 and total["hygiene_score"] >= 85
    kept, _ = clean_batches(stream(spark, table), ROLES, policy="drop")
    assert kept.count() == spark.read.parquet(table).distinct().where("x is not null and s is not null").count()


def test_copies_across_batches_are_dropped(spark, table):
    out = write_stream_table(stream_deduplicated(stream(spark, table), ["id"], "t", "1 hour"))
    assert out.count() == 400


def test_csv_stream(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"f{i}.csv").write_text(f"a,b\n{i},x\n{i + 10},y\n")
    rows = write_stream_table(read_csv_stream(spark, str(tmp_path), "a int, b string"), str(tmp_path / "out"))
    assert sorted(r["a"] for r in rows.collect()) == [0, 1, 2, 10, 11, 12]


def test_sample_does_not_depend_on_partitions(spark):
    df = spark.range(1000).select("id", F.lit(dt.date(2025, 1, 1)).alias("d"))
    first = {r["id"] for r in hashed_sample(df, 100).collect()}
    assert len(first) == 100 and first == {r["id"] for r in hashed_sample(df.repartition(9), 100).collect()}


def test_throughput():
    reports = [
        {"processedRowsPerSecond": 10.0, "numInputRows": 5}, {"processedRowsPerSecond": 30.0, "numInputRows": 5},
        {"processedRowsPerSecond": 0.0, "numInputRows": 0},
    ]
    assert throughput(reports) == {"batches": 2, "rows_per_second": 20.0}


def test_throughput_of_a_folder_in_megabytes(spark, tmp_path):
    for i in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"f{i}.csv").write_text(f"a,b\n{i},x\n{i + 10},y\n")
    stream = read_csv_stream(spark, str(tmp_path / "in"), "a int, b string")
    query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(
        availableNow=True
    ).start()
    query.awaitTermination(60)
    size = folder_bytes(spark, str(tmp_path / "in"))
    got = throughput(query.recentProgress, size)
    assert size == sum(f.stat().st_size for f in (tmp_path / "in").glob("*.csv"))
    assert (got["batches"], got["rows"], got["megabytes"]) == (3, 6, size / 1e6)
    assert got["megabytes_per_second"] == pytest.approx(size / 1e6 / got["seconds"]) and got["seconds"] > 0


def summed(df):
    return df.groupBy("k").agg(F.sum("n").alias("n"))


def test_tiers_stay_few_and_count_each_batch_once(spark, tmp_path):
    folder = str(tmp_path / "tiers")
    for i in range(FAN * FAN + FAN + 1):
        batch = spark.createDataFrame([(f"k{i % 3}", 1), ("all", 1)], "k string, n long")
        add_batch(batch, folder, i, summed)
        add_batch(batch, folder, i, summed)
        rows = {r["k"]: r["n"] for r in summed(open_tiers(spark, folder, "k string, n long")).collect()}
        assert rows["all"] == i + 1 and sum(rows.values()) == 2 * (i + 1)
    assert len(open_tiers(spark, folder, "k string, n long").inputFiles()) <= 3 * spark.sparkContext.defaultParallelism
    tables = [p.name for p in (tmp_path / "tiers").iterdir() if p.name.startswith("level")]
    last = sorted(t.split("-")[0] for t in tables)
    assert last.count("level2") == 1 and last.count("level1") == 1 and last.count("level0") <= FAN


def test_a_crash_before_the_commit_leaves_nothing_that_counts(spark, tmp_path):
    folder = str(tmp_path / "tiers")
    batch = spark.createDataFrame([("a", 1)], "k string, n long")
    for i in range(FAN - 1):
        add_batch(batch, folder, i, summed)

    def fails(_):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        add_batch(batch, folder, FAN - 1, fails)
    read = lambda: summed(open_tiers(spark, folder, "k string, n long")).first()["n"]
    assert read() == FAN - 1
    add_batch(batch, folder, FAN - 1, summed)
    assert read() == FAN


def test_no_batch_gives_no_rows(spark, tmp_path):
    assert open_tiers(spark, str(tmp_path / "none"), "k string, n long").count() == 0


def test_sample_of_a_stream_is_that_of_the_table(spark, table):
    rows = spark.read.parquet(table)
    for n in (7, 90, 1000):
        got = running_sample(stream(spark, table), n, ["id"]).select("id").collect()
        want = hashed_sample(rows, n, ["id"]).select("id").collect()
        assert sorted(got) == sorted(want) and len(got) == min(n, 420)
