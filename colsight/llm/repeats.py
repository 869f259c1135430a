"""Windows of a fixed length that occur more than once, found exactly with few rows per text.

A window is anchored at the least of the hashes of its first short grams, so equal windows have their anchor at the same
offset. Windows in sequence that share an anchor are a unit. Three facts spare rows for single windows:

- All windows of a unit contain the ``core``, the symbols from the anchor on that every such window reaches. If no other
  unit has the same core, no window of the unit is repeated.
- Units with equal core and equal symbols from the first window's begin to the last one's end are one class; what holds
  for a window of one holds for all.
- Windows of units with different cores differ. So only where several classes share a core are windows compared, and
  there a window is given by its symbols outside the core.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsight.llm import sketch
from colsight.llm.common import FIRST, SECOND, mix, pieces, utf8, whole_texts
from colsight.session import materialize

#: Windows that one step over NumPy arrays takes; a longer text is cut, and units with it.
STEP = 1 << 20

#: Classes that share a core are compared within a task up to this number; those of a more frequent core by a shuffle.
TOGETHER = 4096

_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
_GRAM = np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Windows:
    """What windows are made of: ``symbols`` turns (bytes, limits of rows) into symbols and their limits."""

    symbols: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    length: int
    reach: int  # the anchor lies within so many first positions of a window
    gram: int
    code: np.ndarray | None = None  # the 64-bit word of each 8-bit symbol; else symbols are such words

    @property
    def kind(self) -> type:
        return np.uint64 if self.code is None else np.uint8

    def words(self, symbols: np.ndarray) -> np.ndarray:
        return symbols if self.code is None else self.code[symbols]

    @property
    def core(self) -> int:
        return self.length - self.reach + 1


@dataclass
class Units:
    row: np.ndarray
    anchor: np.ndarray
    first: np.ndarray  # begin of the first window
    last: np.ndarray  # begin of the last window
    core: np.ndarray
    span: np.ndarray


def anchors(symbols: np.ndarray, prefix: np.ndarray, windows: Windows) -> np.ndarray:
    """The anchor of each window: the last of the least gram hashes among its first ``reach`` positions."""
    reach, gram = windows.reach, windows.gram
    count = len(symbols) - gram + 1
    hashes = (prefix[gram:] - prefix[:count]) * FIRST._down[:count] * _GRAM
    ranks = (hashes & _HIGH) | (_LOW - np.arange(count, dtype=np.uint64))
    padded = np.full(-(-count // reach) * reach, _HIGH | _LOW, np.uint64)
    padded[:count] = ranks
    blocks = padded.reshape(-1, reach)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    total = len(symbols) - windows.length + 1
    least = np.minimum(behind[:total], ahead[reach - 1:reach - 1 + total])
    return (_LOW - (least & _LOW)).astype(np.int64)


def units_of(symbols: np.ndarray, limits: np.ndarray, windows: Windows) -> Iterator[tuple[int, np.ndarray, Units]]:
    """(offset, symbols, units) by step; places in units count from the offset."""
    length = windows.length
    for at in range(0, len(symbols) - length + 1, STEP):
        part = symbols[at:at + STEP + length - 1]
        words = windows.words(part)
        prefix = FIRST.prefix(words)
        where = anchors(words, prefix, windows)
        cut = np.ones(len(where), bool)
        cut[1:] = where[1:] != where[:-1]
        for edge in (limits, limits[1:] - length + 1):
            edge = edge - at
            cut[edge[(edge >= 0) & (edge < len(cut))]] = True
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(cut)) - 1
        row = np.searchsorted(limits, first + at, side="right") - 1
        fits = first + at + length <= limits[row + 1]
        first, last, row = first[fits], last[fits], row[fits]
        anchor = where[first]
        yield at, part, Units(
            row, anchor, first, last, FIRST.spans(prefix, anchor, anchor + windows.core),
            SECOND.spans(SECOND.prefix(words), first, last + length),
        )


def outside_core(part: np.ndarray, units: Units, windows: Windows) -> list[bytes]:
    """The symbols of each unit before and behind its core; windows are its runs of ``reach - 1`` symbols."""
    ends = units.last + windows.length
    return [
        part[f:a].tobytes() + part[a + windows.core:e].tobytes()
        for f, a, e in zip(units.first.tolist(), units.anchor.tolist(), ends.tolist(), strict=True)
    ]


def spread_out(around: list[bytes], windows: Windows) -> tuple[np.ndarray, ...]:
    """All symbols of some classes, the limits of classes in them, and the class and number of every window."""
    symbols = np.frombuffer(b"".join(around), windows.kind)
    limits = np.concatenate([[0], np.cumsum([len(x) // symbols.itemsize for x in around])]).astype(np.int64)
    counts = np.diff(limits) - windows.reach + 2
    owner = np.repeat(np.arange(len(around)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return symbols, limits, owner, number


def window_hashes(core: np.ndarray, lead: np.ndarray, around: list[bytes], windows: Windows) -> tuple[np.ndarray, ...]:
    """A hash of every window of every class, the class it belongs to, and its number there."""
    size = windows.reach - 1
    symbols, limits, owner, number = spread_out(around, windows)
    begin = limits[owner] + number
    hashes = np.empty(len(owner), np.uint64)
    for at in range(0, len(owner), STEP):
        some = slice(at, at + STEP)
        low, high = begin[some][0], begin[some][-1] + size
        prefix = SECOND.prefix(windows.words(symbols[low:high]))
        hashes[some] = SECOND.spans(prefix, begin[some] - low, begin[some] - low + size)
    left = (lead[owner] - number).astype(np.uint64)
    return mix(hashes ^ mix(core[owner] + left * _GRAM)), owner, number


def _batches(rows: DataFrame, work: Callable, schema: T.StructType, windows: Windows) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                symbols, limits = windows.symbols(*utf8(piece.column("text")))
                for at, part, units in units_of(symbols, limits, windows):
                    yield from work(piece, limits, at, part, units)

    return whole_texts(rows).mapInArrow(scan, schema)


def repeated_starts(
    rows: DataFrame, windows: Windows, earlier_only: bool, name: Callable = window_hashes
) -> DataFrame:
    """Runs of begins of repeated windows: (id, digest, runs), where ``rows`` has (id, digest, text).

    Without ``earlier_only`` a window counts if it begins anywhere else too, in the same row or another; with it, if it
    begins in a row of smaller id (a null id is larger than all). ``runs`` is an array of (first, last) begins. Rows of
    equal id and digest must be equal; they get the same runs, once. Rows without a run are left out. ``name`` gives the
    windows of some classes names that are equal for equal windows.
    """
    context = rows.sparkSession.sparkContext
    kind = rows.schema["id"].dataType

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (
            units.core for batch in batches for piece in pieces(batch)
            for _, _, units in units_of(*windows.symbols(*utf8(piece.column("text"))), windows)
        )
        yield from sketch.partial_sketches(found)

    twice = context.broadcast(sketch.merged(whole_texts(rows).mapInArrow(keys, sketch.SCHEMA)))

    unit_schema = T.StructType([
        T.StructField("id", kind), T.StructField("digest", T.LongType()),
        *(T.StructField(n, T.LongType()) for n in ("first", "last", "core", "span")),
    ])

    def candidates(piece, limits, at, part, units):
        kept = np.flatnonzero(sketch.passed(twice.value, units.core))
        row = pa.array(units.row[kept])
        shift = at - limits[units.row[kept]]
        yield pa.RecordBatch.from_arrays([
            piece.column("id").take(row), piece.column("digest").take(row),
            pa.array(units.first[kept] + shift), pa.array(units.last[kept] + shift),
            pa.array(units.core[kept].view(np.int64)), pa.array(units.span[kept].view(np.int64)),
        ], names=unit_schema.names)

    units = materialize(_batches(rows, candidates, unit_schema, windows), "units")
    classes = materialize(
        units.groupBy("core", "span").agg(F.count("*").alias("n"), F.min("id").alias("least")), "classes"
    )
    shared = classes.groupBy("core").agg(F.count("*").alias("classes")).where("classes > 1")
    shared = materialize(classes.join(shared, "core"), "shared")

    def open_cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from sketch.partial_sketches((b.column(0).to_numpy().view(np.uint64) for b in batches), least=1)

    opened = context.broadcast(sketch.merged(shared.select("core").mapInArrow(open_cores, sketch.SCHEMA), least=1))

    around_schema = T.StructType([
        T.StructField("core", T.LongType()), T.StructField("span", T.LongType()),
        T.StructField("lead", T.LongType()), T.StructField("around", T.BinaryType()),
    ])

    def contents(piece, limits, at, part, units):
        kept = np.flatnonzero(sketch.passed(opened.value, units.core))
        _, once = np.unique(units.span[kept], return_index=True)
        kept = kept[once]
        some = Units(*(getattr(units, n)[kept] for n in Units.__dataclass_fields__))
        yield pa.RecordBatch.from_arrays([
            pa.array(some.core.view(np.int64)), pa.array(some.span.view(np.int64)),
            pa.array(some.anchor - some.first), pa.array(outside_core(part, some, windows), pa.binary()),
        ], names=around_schema.names)

    spelled = _batches(rows, contents, around_schema, windows).dropDuplicates(["core", "span"])
    answers = _compared(materialize(spelled.join(shared, ["core", "span"]), "spelled"), windows, earlier_only, name)
    # Written, so that the join with units, many of which may be of one class, is one whose partitions Spark can split.
    known = materialize(
        classes.join(answers, ["core", "span"], "left").select("core", "span", "n", "least", "inner"), "known"
    )
    if earlier_only:
        whole = F.coalesce(F.col("least") < F.col("id"), F.col("least").isNotNull() & F.col("id").isNull())
    else:
        whole = F.col("n") > 1
    some = F.when(whole, F.array(F.struct(F.col("first").alias("first"), F.col("last").alias("last")))).otherwise(
        F.transform("inner", lambda r: F.struct(
            (F.col("first") + r["first"]).alias("first"), (F.col("first") + r["last"]).alias("last")
        ))
    )
    begins = units.join(known, ["core", "span"]).where(whole | F.col("inner").isNotNull()).select(
        "id", "digest", F.inline(some)
    )
    return _merged(begins.distinct())


def _merged(runs: DataFrame) -> DataFrame:
    """(id, digest, runs) with runs that meet joined; only those are gathered for a row."""
    text = "partition by id, digest order by first"
    before = F.expr(f"max(last) over ({text} rows between unbounded preceding and 1 preceding)")
    island = F.expr(f"sum(fresh) over ({text} rows unbounded preceding)")
    return (
        runs.withColumn("before", before)
        .withColumn("fresh", F.when(F.col("first") <= F.col("before") + 1, 0).otherwise(1)).withColumn("island", island)
        .groupBy("id", "digest", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"))
        .groupBy("id", "digest").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))
    )


RUNS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))


def _compared(classes: DataFrame, windows: Windows, earlier_only: bool, named: Callable) -> DataFrame:
    """``inner``, the runs of windows of a class (core, span) that other classes repeat; classes without are left out."""
    schema = T.StructType([
        T.StructField("core", T.LongType()), T.StructField("span", T.LongType()), T.StructField("inner", RUNS)
    ])

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cores(batches):
            core = table.column("core").to_numpy().view(np.uint64)
            names, owner, number = named(
                core, table.column("lead").to_numpy(), table.column("around").to_pylist(), windows
            )
            _, name = np.unique(names, return_inverse=True)
            if earlier_only:
                rank = _ranks(table.column("least"))
                least = np.full(name.max(initial=-1) + 1, np.iinfo(np.int64).max)
                np.minimum.at(least, name, rank[owner])
                hit = least[name] < rank[owner]
            else:
                times = table.column("n").to_numpy()
                hit = np.bincount(name, weights=times[owner])[name] > 1 if len(name) else np.zeros(0, bool)
            yield from _answers(table, owner[hit], number[hit], schema)

    few = classes.where(F.col("classes") <= TOGETHER).select("core", "span", "lead", "around", "n", "least")
    inside = few.repartition("core").sortWithinPartitions("core").mapInArrow(held, schema)

    window_schema = T.StructType([
        T.StructField("core", T.LongType()), T.StructField("span", T.LongType()), T.StructField("n", T.LongType()),
        T.StructField("least", classes.schema["least"].dataType), T.StructField("number", T.LongType()),
        T.StructField("window", T.LongType()),
    ])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            core = batch.column("core").to_numpy().view(np.uint64)
            hashes, owner, number = window_hashes(
                core, batch.column("lead").to_numpy(), batch.column("around").to_pylist(), windows
            )
            rows = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [batch.column(n).take(rows) for n in ("core", "span", "n", "least")]
                + [pa.array(number), pa.array(hashes.view(np.int64))], names=window_schema.names,
            )

    many = classes.where(F.col("classes") > TOGETHER).mapInArrow(spread, window_schema)
    totals = many.groupBy("window").agg(F.sum("n").alias("times"), F.min("least").alias("earliest"))
    again = _earlier(F.col("earliest"), F.col("least")) if earlier_only else F.col("times") > 1
    numbers = many.join(totals, "window").where(again).groupBy("core", "span").agg(
        F.transform(F.array_sort(F.collect_set("number")), lambda k: F.struct(
            k.alias("first"), k.alias("last"))).alias("inner")
    )
    return inside.unionByName(numbers)


def _earlier(one: Column, other: Column) -> Column:
    return F.coalesce(one < other, one.isNotNull() & other.isNull())


def _ranks(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers in the order of the values, null last."""
    known = column.drop_null()
    values = np.unique(known.to_numpy())
    out = np.full(len(column), len(values), np.int64)
    out[column.is_valid().to_numpy()] = np.searchsorted(values, known.to_numpy())
    return out


def _whole_cores(batches: Iterator[pa.RecordBatch], most: int = 1 << 14) -> Iterator[pa.Table]:
    """Rows sorted by core, cut between cores into tables of about ``most`` rows."""
    kept: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        kept = table if kept is None else pa.concat_tables([kept, table])
        if kept.num_rows >= most:
            core = kept.column("core").to_numpy()
            cut = int(np.searchsorted(core, core[-1]))
            if cut:
                yield kept.slice(0, cut)
                kept = kept.slice(cut)
    if kept is not None and kept.num_rows:
        yield kept


def _answers(table: pa.Table, owner: np.ndarray, number: np.ndarray, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    if not len(owner):
        return
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (number[1:] != number[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(owner)) - 1
    rows, begin = np.unique(owner[first], return_index=True)
    runs = pa.StructArray.from_arrays([pa.array(number[first]), pa.array(number[last])], names=["first", "last"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(first)).astype(np.int32)), runs)
    pick = pa.array(rows)
    columns = [table.column(n).take(pick).combine_chunks() for n in ("core", "span")]
    yield pa.RecordBatch.from_arrays([*columns, lists], names=schema.names)
