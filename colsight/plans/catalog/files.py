"""Scans, merged files, sinks and saved tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from colsight.operators.clean import clean
from colsight.plans.catalog.base import DIRTY_ROLES, dirty_orders, query, rounded, table
from colsight.plans.catalog.cleaning import CLEAN_SQL
from colsight.session import scratch_path
from colsight.sources.files import (
    merge_files,
    preview,
    read_csv,
    restore_dataset,
    save_dataset,
    select_table,
    write_csv,
)


@query("""SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, NULL::BIGINT AS s_suppkey,
NULL::VARCHAR AS s_name, NULL::INTEGER AS s_nationkey, NULL::DOUBLE AS s_acctbal, 'customer.parquet' AS _source_file
FROM customer UNION ALL
SELECT NULL, NULL, NULL, NULL, NULL, s_suppkey, s_name, s_nationkey, s_acctbal, 'supplier.parquet' FROM supplier""")
def union_files(spark, sf_dir):
    return merge_files(spark, [f"{sf_dir}/customer.parquet", f"{sf_dir}/supplier.parquet"])[0]


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def select_one_file(spark, sf_dir):
    return select_table(spark, [f"{sf_dir}/customer.parquet", f"{sf_dir}/supplier.parquet"], 1)


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_roundtrip(spark, sf_dir):
    """Written as CSV and read back with encoding and types inferred."""
    path = scratch_path(spark, "customer-csv")
    write_csv(table(spark, sf_dir, "customer"), path)
    return read_csv(spark, path).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query(f"{CLEAN_SQL} SELECT * REPLACE (round(o_totalprice, 4) AS o_totalprice) FROM cleaned")
def snapshot_roundtrip(spark, sf_dir):
    """The clean table saved for a later session and restored."""
    folder = scratch_path(spark, "saved")
    cleaned = clean(dirty_orders(spark, sf_dir), DIRTY_ROLES).data
    save_dataset(cleaned, folder, "orders")
    restored, _ = restore_dataset(spark, folder)
    return rounded(restored.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")))


@query("SELECT c_custkey, round(c_acctbal * 2, 2) AS c_acctbal, 'second' AS title FROM customer WHERE c_acctbal > 0")
def snapshot_saved_again(spark, sf_dir):
    """A restored table changed and saved to the folder it is read from."""
    folder = scratch_path(spark, "saved")
    save_dataset(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), folder, "first")
    restored, _ = restore_dataset(spark, folder)
    changed = restored.where("c_acctbal > 0").withColumn("c_acctbal", F.col("c_acctbal") * 2)
    save_dataset(changed, folder, "second")
    again, name = restore_dataset(spark, folder)
    return rounded(again, 2).withColumn("title", F.lit(name))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem "
       "ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice LIMIT 25")
def preview_lineitem(spark, sf_dir):
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    return preview(table(spark, sf_dir, "lineitem").select(*columns), columns)
