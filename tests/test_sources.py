import pytest
from pyspark.sql import functions as F

from colsight.sources.files import (
    csv_encoding,
    merge_files,
    preview,
    read_csv,
    read_table,
    restore_dataset,
    save_dataset,
    select_table,
    write_csv,
    write_parquet,
)


def put(path, data):
    path.write_bytes(data)
    return str(path)


def test_encodings(spark, tmp_path):
    latin = put(tmp_path / "latin.csv", "id,name\n1,José\n".encode("latin-1"))
    marked = put(tmp_path / "bom.csv", "id,name\n1,José\n".encode("utf-8-sig"))
    plain = put(tmp_path / "plain.csv", "id,name\n1,José\n".encode())
    odd = put(tmp_path / "odd.csv", "id,name\n1,what�\n".encode())
    assert [csv_encoding(spark, p) for p in (latin, marked, plain, odd)] == ["ISO-8859-1", "UTF-8", "UTF-8", "UTF-8"]
    for path in (latin, marked, plain):
        df = read_csv(spark, path)
        assert df.columns == ["id", "name"] and df.first()["name"] == "José"
        assert df.schema["id"].dataType.simpleString() == "int"


def test_csv_quotes_and_gaps_survive(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", you'), (2, None)], "id int, t string")
    write_csv(df, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in read_csv(spark, str(tmp_path / "out")).collect()) == [
        (1, 'say "hi", you'), (2, None),
    ]


def test_merge_aligns_columns_and_types(spark, tmp_path):
    a = put(tmp_path / "a.csv", b"id,v,w\n1,10,x\n2,20,y\n")
    b = put(tmp_path / "b.csv", b"id,v,z\n3,abc,1.5\n4,def,2.5\n")
    merged, skipped = merge_files(spark, [a, b, str(tmp_path / "none.csv")])
    assert merged.columns == ["id", "v", "w", "z", "_source_file"] and len(skipped) == 1
    assert sorted(tuple(r) for r in merged.collect()) == [
        (1, "10", "x", None, "a.csv"), (2, "20", "y", None, "a.csv"),
        (3, "abc", None, 1.5, "b.csv"), (4, "def", None, 2.5, "b.csv"),
    ]
    a2 = put(tmp_path / "a2.csv", b"id,v,w\n9,90,z\n")
    bad = put(tmp_path / "bad.parquet", b"this is no parquet file")
    more, skipped = merge_files(spark, [a, b, a2, bad])
    assert skipped == [bad] and more.count() == 5
    assert {r["_source_file"] for r in more.where("id in (1, 9)").collect()} == {"a.csv", "a2.csv"}
    c = put(tmp_path / "c.csv", b"id,v\n5,2.5\n")
    numbers, _ = merge_files(spark, [a, c])
    assert numbers.schema["v"].dataType.simpleString() == "double"
    with pytest.raises(ValueError):
        merge_files(spark, [str(tmp_path / "none.csv")])


def test_parquet_merge_and_choice(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    write_parquet(spark.range(3).select(F.col("id").cast("int").alias("id")), path)
    a = put(tmp_path / "a.csv", b"id\n7\n")
    merged, _ = merge_files(spark, [path, a])
    assert sorted(r["id"] for r in merged.collect()) == [0, 1, 2, 7]
    assert select_table(spark, [path, a], 1).first()["id"] == 7 and read_table(spark, path).count() == 3


def test_saved_dataset(spark, tmp_path):
    folder = str(tmp_path / "saved")
    assert restore_dataset(spark, folder) is None
    save_dataset(spark.range(4), folder, "numbers.csv")
    save_dataset(spark.range(5), folder, "more numbers.csv")
    df, name = restore_dataset(spark, folder)
    assert df.count() == 5 and name == "more numbers.csv"


def test_preview_needs_an_order(spark):
    assert [r["id"] for r in preview(spark.range(100).repartition(7), ["id"], 3).collect()] == [0, 1, 2]
    with pytest.raises(ValueError):
        preview(spark.range(3), [])


def test_a_table_saved_from_itself(spark, tmp_path):
    folder = str(tmp_path / "saved")
    save_dataset(spark.range(10), folder, "first")
    restored, _ = restore_dataset(spark, folder)
    save_dataset(restored.where("id < 4"), folder, "second")
    again, name = restore_dataset(spark, folder)
    assert name == "second" and sorted(r.id for r in again.collect()) == [0, 1, 2, 3]
    # The version it was made from is still whole.
    assert restored.count() == 10


def test_a_save_that_fails_leaves_the_old_table(spark, tmp_path):
    from pyspark.sql import functions as F

    folder = str(tmp_path / "saved")
    save_dataset(spark.range(5), folder, "kept")
    with pytest.raises(Exception, match="broken"):
        save_dataset(spark.range(5).select(F.raise_error(F.lit("broken")).cast("long").alias("id")), folder, "lost")
    table, name = restore_dataset(spark, folder)
    assert name == "kept" and table.count() == 5
    # A version that was written but not committed is no version.
    spark.range(3).write.parquet(f"{folder}/data-none")
    assert restore_dataset(spark, folder)[0].count() == 5


def test_old_versions_go_and_missing_ones_are_none(spark, tmp_path):
    from colsight.sources.snapshots import KEPT, load_version, save_version

    folder = str(tmp_path / "saved")
    assert load_version(spark, folder) is None
    assert [save_version(spark.range(k), folder, f"v{k}") for k in range(1, 5)] == [1, 2, 3, 4]
    assert load_version(spark, folder, 1) is None and load_version(spark, folder, 3)[0].count() == 3
    assert len([p for p in (tmp_path / "saved").iterdir() if p.name.startswith("data-")]) == KEPT


def test_two_saves_get_two_numbers(spark, tmp_path):
    from colsight.sources.snapshots import VersionFolder, save_version

    folder = str(tmp_path / "saved")
    save_version(spark.range(1), folder, "a")
    assert not VersionFolder(spark, folder).commit(1, {"data": "x", "name": "late"})
    assert VersionFolder(spark, folder).read(1)["name"] == "a"
