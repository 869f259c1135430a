"""WARC archives of pages: records compressed one by one with a Zstandard dictionary that leads each archive.

An archive starts with a skippable frame that holds its dictionary; every record behind it is a Zstandard frame of its
own, so one record can be read from its offset with nothing but the dictionary. Equal payloads are stored once, the other
records revisit them.

Tasks write archives straight to a folder that all executors reach. Each attempt of a task names its files anew, and only
the files in the manifest that Spark commits count, so a repeated or lost attempt leaves nothing but files nobody reads.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsight.llm.common import heavy_keys, whole_texts
from colsight.session import materialize

#: Payloads below this size are stored anew each time.
LEAST_REVISITED = 1000

#: Bytes of records an archive gathers before it is written; one record beyond that is an archive of its own.
ARCHIVE_BYTES = 16 << 20

#: Size of a dictionary, and the records it is trained on: evenly spread over those of its archive, this many times its size.
DICTIONARY_BYTES, TRAINED_ON = 64 << 10, 48

LEVEL = 3

#: Fixed by the format: the magic numbers of a frame and of the skippable frame that holds the dictionary.
FRAME_MAGIC, DICTIONARY_MAGIC = 0xFD2FB528, 0x184D2A5D

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Parts of a dealt hash for rows that are not joined.
PARTS = 1024

MANIFEST = T.StructType([
    T.StructField("archive", T.StringType()), T.StructField("records", T.LongType()),
    T.StructField("raw_bytes", T.LongType()), T.StructField("archive_bytes", T.LongType()),
    T.StructField("dictionary_bytes", T.LongType()),
])


# Records


def _uri(text: str) -> str:
    """A header value on one line: blanks, control characters and everything beyond ASCII are percent-encoded."""
    return re.sub(rb"[^\x21-\x7e]", lambda m: b"%%%02X" % m[0][0], text.encode()).decode()


def record_id(page_id, digest: bytes, revisit: bool) -> str:
    """The same for rows of equal id and payload, so a revisit can name the response without having seen it."""
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest.hex()}/{revisit}').urn}>"


def record(page_id, url: str | None, payload: bytes, refers_to, date: str) -> bytes:
    """A response record; with ``refers_to`` a revisit, which keeps the HTTP headers and drops the payload."""
    digest = hashlib.sha1(payload).digest()
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    named = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest, revisit)),
        ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{base64.b32encode(digest).decode()}"),
        ("WARC-Block-Digest", f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"),
    ]
    if url is not None:
        named.append(("WARC-Target-URI", _uri(url)))
    if page_id is not None:
        named.append(("X-Page-ID", _uri(str(page_id))))
    if revisit:
        named += [
            ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest, False)),
            ("X-Refers-To-Page", _uri(str(refers_to))),
        ]
    head = "".join(f"{k}: {v}\r\n" for k, v in [*named, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode().split("\r\n")[1:]
    return dict(line.split(": ", 1) for line in lines if line)


def parsed(raw: bytes) -> dict:
    """The parts of a record; a digest that doesn't fit its bytes is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    named = _headers(head)
    length = int(named["Content-Length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"record {named.get('WARC-Record-ID')} is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(named["WARC-Payload-Digest"].removeprefix("sha1:"))
    kept = named["WARC-Type"] == "response"
    if kept and hashlib.sha1(payload).digest() != digest:
        raise ValueError(f"record {named['WARC-Record-ID']} does not fit its digest")
    return {
        "page_id": named.get("X-Page-ID"), "url": named.get("WARC-Target-URI"), "record_type": named["WARC-Type"],
        "record_id": named["WARC-Record-ID"], "refers_to": named.get("X-Refers-To-Page"),
        "payload_bytes": int(_headers(http)["Content-Length"]), "payload_digest": digest.hex(),
        "payload": payload if kept else None,
    }


# Archives


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """Trained on records spread evenly over all; none where they are too few or too much alike to train one."""
    total = sum(map(len, records))
    step = max(1, -(-total // (DICTIONARY_BYTES * TRAINED_ON)))
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, total // 8), records[::step], k=256, d=8)
    except zstandard.ZstdError:
        return None


def archive(records: list[bytes]) -> tuple[bytes, int]:
    """The bytes of an archive, and the size of its dictionary."""
    shared = dictionary(records)
    known = shared.as_bytes() if shared else b""
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True, write_checksum=True)
    out = [DICTIONARY_MAGIC.to_bytes(4, "little") + len(known).to_bytes(4, "little") + known] if known else []
    return b"".join(out + [packer.compress(r) for r in records]), len(known)


def frames(data: memoryview) -> Iterator[tuple[int, int]]:
    """Offset and length of each frame that holds a record, found by its block headers without decompressing it."""
    at = 0
    while at < len(data):
        magic = int.from_bytes(data[at:at + 4], "little")
        if magic & 0xFFFFFFF0 == DICTIONARY_MAGIC & 0xFFFFFFF0:
            at += 8 + int.from_bytes(data[at + 4:at + 8], "little")
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no frame at byte {at}")
        end = at + zstandard.frame_header_size(data[at:at + 18])
        last = False
        while not last:
            block = int.from_bytes(data[end:end + 3], "little")
            last, kind, size = bool(block & 1), block >> 1 & 3, block >> 3
            end += 3 + (1 if kind == 1 else size)
        end += 4 * zstandard.get_frame_parameters(data[at:at + 18]).has_checksum
        yield at, end - at
        at = end


def unpacker(data: memoryview) -> zstandard.ZstdDecompressor:
    """A decompressor with the dictionary that leads the archive, if there is one."""
    known = None
    if int.from_bytes(data[:4], "little") == DICTIONARY_MAGIC:
        known = zstandard.ZstdCompressionDict(bytes(data[8:8 + int.from_bytes(data[4:8], "little")]))
    return zstandard.ZstdDecompressor(dict_data=known)


def _store(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path in it."""
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if ":" in path else f"file://{path}")


# Tables


def _revisits(pages: DataFrame) -> DataFrame:
    """``pages`` with ``refers_to``: the largest id among the rows of an equal payload, where a row's own is smaller.

    Payloads are named by SHA-256 and size. The few that are very frequent are looked up in a broadcast of bounded size;
    their rows and those of small payloads are dealt by id, all others by payload.
    """
    named = pages.withColumn("sha", F.sha2(F.col("payload"), 256)).withColumn("size", F.octet_length("payload").cast("long"))
    groups = materialize(
        named.where(F.col("size") >= LEAST_REVISITED).groupBy("sha").agg(
            F.max("id").alias("largest"), F.count("*").alias("held")
        ).where("held > 1 and largest is not null"), "payloads",
    )
    frequent = heavy_keys(groups, "held").select("sha", F.col("largest").alias("frequent"))
    rest = groups.select("sha", F.lit(0).alias("part"), "largest")
    part = F.when(
        F.col("frequent").isNotNull() | (F.col("size") < LEAST_REVISITED), F.pmod(F.xxhash64("id", "url"), F.lit(PARTS)) + 1
    ).otherwise(0).cast("int")
    found = named.join(F.broadcast(frequent), "sha", "left").withColumn("part", part).join(rest, ["sha", "part"], "left")
    target = F.coalesce("frequent", "largest")
    return found.select("id", "url", "payload", F.when(F.col("id") < target, target).alias("refers_to"))


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    date: str | None = None,
) -> DataFrame:
    """Writes every row of ``pages`` as a record and returns the manifest: a row for each archive.

    Of rows with equal payloads of 1000 bytes or more, the ones with the largest id are responses and the others revisit
    them; smaller payloads are always responses. A null html is an empty payload, a null url is left out of the headers, a
    row with a null id is a response without an id. Rows that repeat with one id and payload each get a record. Without
    rows there is no archive. Other columns are not looked at, whatever their names.
    """
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"),
        F.encode(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), "UTF-8").alias("payload"),
    )

    def save(records: list[bytes]) -> dict:
        data, known = archive(records)
        path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.warc.zst"
        store, name = _store(path)
        store.create_dir(name.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(name) as out:
            out.write(data)
        return {
            "archive": path, "records": len(records), "raw_bytes": sum(map(len, records)), "archive_bytes": len(data),
            "dictionary_bytes": known,
        }

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, made = [], 0, []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("id", "url", "payload", "refers_to"))
            for page_id, url, payload, refers_to in zip(*columns, strict=True):
                raw = record(page_id, url, payload, refers_to, date)
                if held and size + len(raw) > ARCHIVE_BYTES:
                    made.append(save(held))
                    held, size = [], 0
                held.append(raw)
                size += len(raw)
        if held:
            made.append(save(held))
        if made:
            yield pa.RecordBatch.from_pylist(made)

    return materialize(whole_texts(_revisits(rows)).mapInArrow(write, MANIFEST), "archives")


def read_archives(manifest: DataFrame, id_type: T.DataType | str = "long", payload: bool = False) -> DataFrame:
    """One row per record of the archives in ``manifest``, digests checked; ``payload`` adds the bytes of responses.

    Offset and length name the frame of a record in its archive. Payload size and digest of a revisit come from its
    headers. A damaged archive is an error.
    """
    names = ["page_id", "url", "record_type", "record_id", "refers_to", "payload_bytes", "payload_digest"]
    names += ["payload"] if payload else []
    kinds = {"payload_bytes": T.LongType(), "payload": T.BinaryType()}
    schema = T.StructType([
        *(T.StructField(n, kinds.get(n, T.StringType())) for n in names), T.StructField("archive", T.StringType()),
        T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()),
    ])
    arrow = pa.schema([
        *((n, {"payload_bytes": pa.int64(), "payload": pa.binary()}.get(n, pa.string())) for n in names),
        ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
    ])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                store, name = _store(path)
                with store.open_input_stream(name) as source:
                    data = memoryview(source.read())
                opened, rows, size = unpacker(data), [], 0
                for offset, length in frames(data):
                    found = parsed(opened.decompress(data[offset:offset + length]))
                    rows.append({**{n: found[n] for n in names}, "archive": path, "offset": offset, "length": length})
                    size += found["payload_bytes"]
                    if len(rows) == 4096 or (payload and size > 1 << 22):
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    # An archive is a row of the manifest: deal rows evenly, as they are few and each is megabytes of work.
    tasks = max(1, min(manifest.count(), 4 * manifest.sparkSession.sparkContext.defaultParallelism))
    found = manifest.select("archive").repartition(tasks).mapInArrow(read, schema)
    return found.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))
