"""URL filters: all glob rules packed into one multiword Shift-And automaton that runs over canonical URLs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsight.llm.common import utf8

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class HostRule:
    """Holds for a host and its subdomains where the path starts with ``path``; the longest fitting rule decides."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class GlobRule:
    """``*`` stands for any characters but ``/``, ``**`` for any, ``?`` for one but ``/``; decides where no host rule fits."""

    verdict: str
    glob: str


def _quoted(text: str) -> list[tuple[str, int]]:
    return [("literal", byte) for byte in text.encode()]


def _parsed(glob: str) -> list[tuple[str, int]]:
    parts, i = [], 0
    while i < len(glob):
        if glob.startswith("**", i):
            parts.append(("any", 0))
            i += 2
            continue
        if glob[i] == "*":
            parts.append(("segment", 0))
        elif glob[i] == "?":
            parts.append(("one", 0))
        else:
            parts += _quoted(glob[i])
        i += 1
    return parts


class Automaton:
    """Bit-parallel simulation of many globs at once.

    Every pattern owns a start bit and one bit per consumed character, side by side in a row of 64-bit words. Reading
    byte c turns the active bits D into ``((D << 1) & step[c]) | (D & stay[c])``: ``step`` has the bits that c may enter,
    ``stay`` those on which a star lets c pass. Start bits are in no step mask, so patterns don't leak into each other.
    """

    def __init__(self, patterns: Sequence[list[tuple[str, int]]]):
        bits = sum(1 + sum(kind in ("literal", "one") for kind, _ in p) for p in patterns)
        self.words = max(1, -(-bits // 64))
        self.step = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.final: list[tuple[int, np.uint64]] = []
        every = np.ones(256, bool)
        segment = every.copy()
        segment[ord("/")] = False
        at = 0
        for pattern in patterns:
            self._set(self.start[None, :], at)
            for kind, byte in pattern:
                if kind in ("any", "segment"):
                    self._set(self.stay, at, every if kind == "any" else segment)
                else:
                    at += 1
                    self._set(self.step, at, np.arange(256) == byte if kind == "literal" else segment)
            self.final.append((at // 64, np.uint64(1) << np.uint64(at % 64)))
            at += 1

    @staticmethod
    def _set(masks: np.ndarray, bit: int, rows: np.ndarray | slice = slice(None)) -> None:
        masks[rows, bit // 64] |= np.uint64(1) << np.uint64(bit % 64)

    def run(self, raw: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """Which patterns match which whole rows: a matrix of rows by patterns."""
        sizes = np.diff(limits)
        order = np.argsort(-sizes, kind="stable")
        begins, left = limits[:-1][order], sizes[order]
        active = np.tile(self.start, (len(sizes), 1))
        one, top = np.uint64(1), np.uint64(63)
        live = len(order)
        for k in range(int(left[0]) if len(left) else 0):
            while live and left[live - 1] <= k:
                live -= 1
            byte, now = raw[begins[:live] + k], active[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            active[:live] = (moved & self.step[byte]) | (now & self.stay[byte])
        out = np.empty((len(sizes), len(self.final)), bool)
        for j, (word, bit) in enumerate(self.final):
            out[order, j] = active[:, word] & bit != 0
        return out


def filter_urls(
    pages: DataFrame,
    host_rules: Sequence[HostRule],
    glob_rules: Sequence[GlobRule] = (),
    default: str = ALLOW,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row (id, host, path, rule, verdict) per row of ``pages``, without a shuffle.

    Host: behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case. Path: from there up to
    ``?``, ``#`` or the end. A null url, or one without ``://``, has both empty. Of the fitting host rules the longest
    decides (at equal length the one listed first) and is named in ``rule``; else ``rule`` is null and the first fitting
    glob rule decides, else ``default``. Repeated rows, null ids and other columns do no harm: rows are judged one by
    one, and only the two columns are read. An empty table gives an empty result.
    """
    rules = sorted(host_rules, key=lambda r: -len(r.name))
    patterns = []
    for r in rules:
        tail = [*_quoted(r.name), ("any", 0)]
        patterns += [tail, [("segment", 0), *_quoted("."), *tail]]
    patterns += [_parsed(g.glob) for g in glob_rules]
    automaton = Automaton(patterns)
    names = np.array([*(r.name for r in rules), None], object)
    verdicts = np.array([*(r.verdict for r in rules), *(g.verdict for g in glob_rules), default], object)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = automaton.run(*utf8(batch.column("canonical")))
            by_rule = hits[:, 0:2 * len(rules):2] | hits[:, 1:2 * len(rules):2]
            fits = np.hstack([by_rule, hits[:, 2 * len(rules):], np.ones((len(hits), 1), bool)])
            first = fits.argmax(axis=1)
            out = [
                batch.column(0), batch.column(1), batch.column(2),
                pa.array(names[np.minimum(first, len(rules))], pa.string()), pa.array(verdicts[first], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(out, names=[id_col, "host", "path", "rule", "verdict"])

    rest = F.when(F.col("url").contains("://"), F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    parts = pages.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{url_col}`").alias("url")).select(
        F.col(id_col), F.coalesce(rest, F.lit("")).alias("rest")
    ).select(
        F.col(id_col),
        F.translate(F.regexp_extract("rest", "^[^/?#]*", 0), upper, lower).alias("host"),
        F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1).alias("path"),
    ).withColumn("canonical", F.concat("host", "path"))
    schema = T.StructType([
        T.StructField(id_col, pages.schema[id_col].dataType),
        *(T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")),
    ])
    return parts.mapInArrow(judge, schema)
