import hashlib

import pyarrow.fs
import pytest
import zstandard
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsight.llm import catalog, warc
from colsight.llm.warc import DICTIONARY_MAGIC, archive, frames, parsed, read_archives, record, unpacker, write_archives

SF = "/root/testdata/sf0.001"
PAGES = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
])
LONG, OTHER = "<p>é" + "long payload " * 100, "<p>" + "another one " * 100


@pytest.fixture
def pages(spark):
    return lambda rows: spark.createDataFrame(rows, PAGES).repartition(3)


def expected(rows):
    """By the definition, pair by pair."""
    out = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "").encode() == payload and r[0] is not None]
        winner = max(same, default=None)
        revisit = len(payload) >= 1000 and page_id is not None and page_id < winner
        out.append((
            page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response",
            winner if revisit else None,
        ))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


ODD = [
    (1, "http://a/x", LONG), (5, "http://b/ü\r\nInjected: yes", LONG), (3, None, LONG), (2, "http://c", OTHER),
    (4, "http://d", "small"), (6, "http://e", "small"), (7, "http://f", None), (8, "", ""), (None, "http://g", LONG),
    (None, None, None), (9, "http://h", OTHER), (9, "http://h", OTHER), (10, "u", "x" * 999), (11, "u", "x" * 999),
    (12, "u", "é" * 500), (13, "u", "é" * 500), (14, "u", "\r\n\r\nWARC/1.1\r\n" * 200_000), (15, "u", "\x00" * 1000),
]


def test_odd_rows(pages, tmp_path):
    manifest = write_archives(pages(ODD), str(tmp_path / "w"))
    assert got(read_archives(manifest)) == expected(ODD)


def test_frequent_payloads_are_looked_up(pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "heavy_keys", lambda counted, held: counted.where(F.col(held) > 2))
    assert got(read_archives(write_archives(pages(ODD), str(tmp_path / "w")))) == expected(ODD)


def test_empty_table_and_clashing_columns(pages, tmp_path):
    assert write_archives(pages([]), str(tmp_path / "a")).count() == 0
    assert read_archives(write_archives(pages([]), str(tmp_path / "a"))).count() == 0
    names = ("id", "payload", "sha", "size", "part", "held", "largest", "frequent", "refers_to")
    more = pages(ODD).select("*", *(F.lit(f"own {n}").alias(n) for n in names))
    assert got(read_archives(write_archives(more, str(tmp_path / "b")))) == expected(ODD)


def test_payloads_come_back(pages, tmp_path):
    manifest = write_archives(pages(ODD), str(tmp_path / "w"))
    back = {r.page_id: r for r in read_archives(manifest, payload=True).collect()}
    for page_id, _, html in ODD:
        if page_id is not None:
            kept = back[page_id]
            kept = kept if kept.record_type == "response" else back[kept.refers_to]
            assert bytes(kept.payload).decode() == (html or "")
    assert "\n" not in back[5].url and back[3].url is None


def test_every_record_is_a_frame_and_the_dictionary_leads(spark, tmp_path):
    manifest = write_archives(spark.read.parquet(f"{SF}/pages.parquet"), str(tmp_path / "w")).collect()
    for row in manifest:
        data = memoryview(pyarrow.fs.LocalFileSystem().open_input_stream(row.archive).read())
        assert int.from_bytes(data[:4], "little") == DICTIONARY_MAGIC and row.dictionary_bytes > 0
        spots = list(frames(data))
        assert len(spots) == row.records and sum(n for _, n in spots) + 8 + row.dictionary_bytes == len(data)
        one = unpacker(data)
        assert parsed(one.decompress(data[slice(spots[-1][0], sum(spots[-1]))]))["record_type"] in ("response", "revisit")
        # Any reader of such frames sees one WARC file.
        known = zstandard.ZstdCompressionDict(bytes(data[8:8 + row.dictionary_bytes]))
        whole = zstandard.ZstdDecompressor(dict_data=known).stream_reader(bytes(data), read_across_frames=True).read()
        assert len(whole) == row.raw_bytes and whole.startswith(b"WARC/1.1\r\n")


def test_a_dictionary_saves_space(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").limit(200).collect()
    records = [record(r.page_id, r.url, r.html.encode(), None, "2024-01-01T00:00:00Z") for r in rows]
    alone = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)
    data, known = archive(records)
    assert known and len(data) < alone


def test_damage_is_found():
    raw = record(1, "u", b"payload", None, "2024-01-01T00:00:00Z")
    for bad in (raw.replace(b"payload", b"paylord"), raw[:-6]):
        with pytest.raises(ValueError):
            parsed(bad)
    with pytest.raises(ValueError):
        list(frames(memoryview(b"no frame at all")))


def test_a_second_attempt_adds_no_rows(pages, tmp_path):
    folder = str(tmp_path / "w")
    first, second = write_archives(pages(ODD), folder), write_archives(pages(ODD), folder)
    assert got(read_archives(first)) == got(read_archives(second)) == expected(ODD)


def test_query_by_definition(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert got(catalog.op13_warc(spark, SF)) == expected(rows)
