"""Language-model scores: a Katz bigram model with Good-Turing discounts and exactly normalised backoff weights.

A token given its predecessor has the discounted share of the bigram if that was seen in training, or else the
predecessor's backoff weight times the token's own probability. All bigrams are counted and stored. Frequent words have
small numbers as names and other words 63 bits of their hash, so a bigram is a pair of names.

Most tokens are scored in the scan over the texts, from the most frequent words and bigrams, which are broadcast up to a
fixed number. In a training text every bigram was seen, so one that a sketch tells was not seen twice was seen once. Only
the other bigrams and the rare words are shuffled to their counts, which also takes hot keys out of the shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsight.llm import sketch
from colsight.llm.common import LOWER, mix, pieces, utf8, whole_texts, word_hashes, word_spans
from colsight.session import materialize, owned_scratch, remove_scratch

#: Most words and bigrams that are broadcast (40 and 24 bytes each).
HEAD_TOKENS, HEAD_BIGRAMS = 1 << 19, 1 << 20

#: Entries that a task counts before it hands them on.
FLUSH = 1 << 22

#: Counts up to which a bigram's count is discounted.
DISCOUNTED = 7

#: Occurrences of a first word for each group that its bigrams are dealt into.
DEALT = 1 << 16

#: Names of the end token and of what stands before the first word. Frequent words have the names from ``WORDS`` on, by
#: descending count; the names of others are negative.
END, BEGIN, WORDS = 0, 1, 2

_TOP = np.uint64(1 << 63)
_ODD = np.uint64(0xD6E8FEB86659FD93)

COUNTS = T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType())])


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts, A-Z in lower case, and the limits of rows in them."""
    raw, limits = utf8(column)
    raw = LOWER[raw]
    begin, end, row = word_spans(raw, limits)
    return word_hashes(raw, begin, end), np.searchsorted(row, np.arange(len(limits)))


class Places:
    """Looks keys up among ``keys``, sorted and spread evenly as hashes are: the leading bits lead to the first that has
    them, and from there it is a step or two.
    """

    def __init__(self, keys: np.ndarray):
        bits = max(1, len(keys).bit_length())
        self.keys, self.shift = keys, np.uint64(64 - bits)
        self.starts = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each, -1 where missing."""
        out = np.full(len(wanted), -1, np.int64)
        if not len(self.keys):
            return out
        at, open_ = self.starts[wanted >> self.shift], np.arange(len(wanted))
        while len(open_):
            there = self.keys[np.minimum(at, len(self.keys) - 1)]
            hit = there == wanted
            out[open_[hit]] = at[hit]
            on = (there < wanted) & (at < len(self.keys) - 1)
            at, wanted, open_ = at[on] + 1, wanted[on], open_[on]
        return out


@dataclass
class Words:
    """The frequent words: the ``places`` of their hashes and the ``names`` at them; by name the training count ``n``, the log
    probability ``logp``, the log of what a history's counts are divided by, ``history``, and the log backoff weight
    ``loga``.
    """

    places: Places
    names: np.ndarray
    n: np.ndarray
    scale: float
    loga: np.ndarray

    @property
    def logp(self) -> np.ndarray:
        return np.log10(self.n + 0.5) - np.log10(self.scale)

    @property
    def history(self) -> np.ndarray:
        return np.log10(self.n + 0.5)

    def named(self, hashes: np.ndarray) -> np.ndarray:
        at = self.places.find(hashes)
        return np.where(at >= 0, self.names[at] if len(self.names) else np.uint64(0), hashes | _TOP)


def name_column(key: str) -> Column:
    """The name of a word that is not frequent, of a column with its hash."""
    return F.col(key).bitwiseOR(F.lit(-(1 << 63)))


def lines_of(names: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All names from the begin to the end token of every row, whether each is a word, and the row of each."""
    rows = len(limits) - 1
    sizes = np.diff(limits) + 2
    starts = np.cumsum(sizes) - sizes
    inner = np.ones(len(names) + 2 * rows, bool)
    inner[starts] = inner[starts + sizes - 1] = False
    line = np.empty(len(inner), np.uint64)
    line[starts] = BEGIN
    line[starts + sizes - 1] = END
    line[inner] = names
    return line, inner, np.repeat(np.arange(rows), sizes)


def _frequent(names: np.ndarray) -> np.ndarray:
    return names < _TOP


def _packed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A pair of frequent names as one number."""
    return first << np.uint64(32) | second


def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * _ODD + mix(second))


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


class _Counter:
    """Counts of the keys of a task; equal keys meet before the shuffle as far as memory is bounded."""

    def __init__(self) -> None:
        self.held, self.total = [], 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, part: np.ndarray) -> bool:
        """Whether there are so many distinct keys that they should be taken."""
        self.held.append(part)
        self.total += len(part)
        if self.total < 1 << 20:
            return False
        self._fold()
        return len(self.keys) >= FLUSH

    def _fold(self) -> None:
        new, times = np.unique(np.concatenate(self.held), return_counts=True)
        both, place = np.unique(np.concatenate([self.keys, new]), return_inverse=True)
        sums = np.bincount(place, weights=np.concatenate([self.counts, times]), minlength=len(both))
        self.keys, self.counts, self.held, self.total = both, sums.astype(np.int64), [], 0

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if self.held:
            self._fold()
        out = self.keys, self.counts
        self.keys, self.counts = self.keys[:0], self.counts[:0]
        return out


def _joined(rows: DataFrame) -> DataFrame:
    """Tasks joined by fours, so that more equal keys meet in one."""
    slots = rows.sparkSession.sparkContext.defaultParallelism
    return whole_texts(rows.coalesce(max(slots, rows.rdd.getNumPartitions() // 4)))


def _count_words(texts: DataFrame) -> DataFrame:
    """(key, n): occurrences of each word by its hash, and of the end token by zero."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter()

        def batch() -> pa.RecordBatch:
            keys, counts = counter.take()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=COUNTS.names)

        for b in batches:
            for piece in pieces(b):
                hashes, limits = tokens_of(piece.column("text"))
                if counter.add(np.concatenate([hashes, np.zeros(len(limits) - 1, np.uint64)])):
                    yield batch()
        yield batch()

    return _joined(texts).mapInArrow(scan, COUNTS).groupBy("key").agg(F.sum("n").alias("n"))


def _count_bigrams(texts: DataFrame, words: Words) -> DataFrame:
    """(first, second, n): occurrences of each bigram, the bigrams of a first word side by side.

    They are dealt by first word, those of a frequent one into as many groups as its count, known by then, asks for.
    Bigrams of rare words, which seldom repeat, go to the shuffle as they are.
    """
    sent = texts.sparkSession.sparkContext.broadcast(words)
    schema = "first long, part int, second long, n long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counter = sent.value, _Counter()
        parts = (1 + words.n // DEALT).astype(np.uint64)

        def batch(first: np.ndarray, second: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            part = np.zeros(len(first), np.int32)
            known = _frequent(first)
            part[known] = mix(second[known]) % parts[first[known]]
            return pa.RecordBatch.from_arrays([
                pa.array(first.view(np.int64)), pa.array(part), pa.array(second.view(np.int64)), pa.array(n),
            ], names=["first", "part", "second", "n"])

        def counted() -> pa.RecordBatch:
            keys, n = counter.take()
            return batch(keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF), n)

        for b in batches:
            for piece in pieces(b):
                hashes, limits = tokens_of(piece.column("text"))
                line, _, owner = lines_of(words.named(hashes), limits)
                within = owner[1:] == owner[:-1]
                first, second = line[:-1][within], line[1:][within]
                both = _frequent(first | second)
                full = counter.add(_packed(first[both], second[both]))
                yield batch(first[~both], second[~both], np.ones(np.count_nonzero(~both), np.int64))
                if full:
                    yield counted()
        yield counted()

    pairs = _joined(texts).mapInArrow(scan, schema).repartition("first", "part")
    sums = pairs.groupBy("first", "part", "second").agg(F.sum("n").alias("n"))
    return sums.select("first", "second", "n").sortWithinPartitions("first")


@dataclass
class Model:
    """``tokens`` (key, n): training counts by word hash. ``rare`` (name, n, loga): of the words not in ``words``.
    ``bigrams`` (first, second, n): all of them. ``twice``: a sketch of those seen more than once.
    """

    tokens: DataFrame
    rare: DataFrame
    bigrams: DataFrame
    words: Words
    twice: np.ndarray
    total: int
    distinct: int
    discounts: dict[int, float]
    spent: list[str] = field(default_factory=list)

    @property
    def scale(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    @property
    def unknown(self) -> float:
        """Log probability of an unknown word, whose backoff weight is one."""
        return float(np.log10(0.5) - np.log10(self.scale))


def good_turing(counts: dict[int, int], least: int, most: int) -> dict[int, float]:
    """Discount factors of the counts from ``least`` to ``most``; others, and those without a next one, stay whole."""
    return {
        r: min(1.0, (r + 1) * counts[r + 1] / (r * counts[r]))
        for r in range(least, most + 1) if counts.get(r) and counts.get(r + 1)
    }


def katz_discounts(counts: dict[int, int], most: int) -> dict[int, float]:
    """Good-Turing factors of the counts 1 to ``most`` with Katz's normalisation: (r*/r - a) / (1 - a).

    With a = (most + 1) * N(most + 1) / N(1) higher counts stay whole and the mass set free is that of Good-Turing, N(1).
    Counts whose factor would not lie between 0 and 1, which small or odd tables have, take the plain factor; without
    a next count, or where that one is not below 1 either, (r - 0.5) / r.
    """
    a = (most + 1) * counts.get(most + 1, 0) / counts[1] if counts.get(1) else 1.0
    plain, out = good_turing(counts, 1, most), {}
    for r in range(1, most + 1):
        if counts.get(r):
            share = plain.get(r, 1.0)
            katz = (share - a) / (1 - a) if a < 1 else 0.0
            out[r] = katz if 0 < katz < 1 else share if share < 1 else (r - 0.5) / r
    return out


def _factors(discounts: dict[int, float]) -> np.ndarray:
    """The discount of each count up to the first that stays whole."""
    return np.array([1.0, *(discounts.get(r, 1.0) for r in range(1, DISCOUNTED + 1)), 1.0])


def _mass(n: np.ndarray, factors: np.ndarray) -> np.ndarray:
    return n * factors[np.minimum(n, len(factors) - 1)]


def _sums_by_first(bigrams: DataFrame, rare: DataFrame, words: Words, factors: np.ndarray) -> DataFrame:
    """(first, mass, p): the discounted counts of a word's successors and the sum of their own probabilities."""
    sent = bigrams.sparkSession.sparkContext.broadcast((words, factors))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, factors = sent.value
        chance = (words.n + 0.5) / words.scale
        for batch in batches:
            if not batch.num_rows:
                continue
            first, second = _unsigned(batch.column("first")), _unsigned(batch.column("second"))
            n = batch.column("n").to_numpy(zero_copy_only=False)
            p = np.zeros(len(n))
            known = _frequent(second)
            p[known] = chance[second[known]]
            starts = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
            yield pa.RecordBatch.from_arrays([
                pa.array(first[starts].view(np.int64)), pa.array(np.add.reduceat(_mass(n, factors), starts)),
                pa.array(np.add.reduceat(p, starts)),
            ], names=["first", "mass", "p"])

    frequent = bigrams.mapInArrow(scan, "first long, mass double, p double")
    chance = ((F.col("n") + 0.5) / words.scale).alias("p")
    others = bigrams.where("second < 0").select("first", F.col("second").alias("name")).join(
        rare.select("name", chance), "name"
    ).select("first", F.lit(0.0).alias("mass"), "p")
    return frequent.unionByName(others).groupBy("first").agg(F.sum("mass").alias("mass"), F.sum("p").alias("p"))


def train(rows: DataFrame) -> Model:
    """The model of all ``rows`` (text), each table written in the shared folder.

    All tokens and all bigrams are counted; discounts are Katz's. With c for the count of a bigram, d for its discount
    and n for the count of its first word, the bigram's share is d * c / (n + 0.5), so something is always left for unseen
    successors, and the backoff weight spreads exactly that over them.
    """
    texts = rows.select("text")
    with owned_scratch() as spent:
        tokens = materialize(_count_words(texts), "tokens")
        total, distinct = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        ends = tokens.where("key = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        least = _least(tokens.where("key <> 0"), HEAD_TOKENS)
        found = tokens.where((F.col("key") != 0) & (F.col("n") >= least)).toArrow()
        keys, n = _unsigned(found.column("key")), found.column("n").to_numpy()
        order = np.lexsort((keys, -n))
        names = np.empty(len(keys), np.uint64)
        names[order] = np.arange(WORDS, WORDS + len(keys), dtype=np.uint64)
        by_key = np.argsort(keys, kind="stable")
        counts = np.concatenate([[ends, ends], n[order]]).astype(np.int64)
        scale = total + 0.5 * (distinct + 1)
        words = Words(Places(keys[by_key]), names[by_key], counts, scale, np.zeros(len(counts)))
        bigrams = materialize(_count_bigrams(texts, words), "bigrams")
        least_often = bigrams.where(F.col("n") <= DISCOUNTED + 1).groupBy("n").count().collect()
        discounts = katz_discounts({r["n"]: r["count"] for r in least_often}, DISCOUNTED)
        others = tokens.where((F.col("key") != 0) & (F.col("n") < least)).select(name_column("key").alias("name"), "n")
        seen = materialize(_sums_by_first(bigrams, others, words, _factors(discounts)), "successors")
    left = (1 - F.col("mass") / (F.col("n") + 0.5)) / (1 - F.col("p"))
    rare = materialize(
        others.join(seen.where("first < 0").withColumnRenamed("first", "name"), "name", "left").select(
            "name", "n", F.coalesce(F.log10(left), F.lit(0.0)).alias("loga")
        ), "rare-words",
    )
    known = seen.where("first >= 0").toArrow()
    at = known.column("first").to_numpy()
    mass, p = known.column("mass").to_numpy(), known.column("p").to_numpy()
    words.loga[at] = np.log10((1 - mass / (counts[at] + 0.5)) / (1 - p))

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from sketch.partial_sketches(_hashes(batches), least=1)

    twice = sketch.merged(bigrams.where("n > 1").select("first", "second").mapInArrow(repeated, sketch.SCHEMA), least=1)
    return Model(tokens, rare, bigrams, words, twice, total, distinct, discounts, spent)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        yield _pair_hash(_unsigned(batch.column("first")), _unsigned(batch.column("second")))


def _least(table: DataFrame, most: int) -> int:
    """The least count ``n`` such that at most ``most`` rows have it or more."""
    so_far = F.sum("count").over(Window.orderBy(F.desc("n")))
    held = table.groupBy("n").count().select("n", so_far.alias("so_far"))
    cut = held.where(F.col("so_far") <= most).agg(F.min("n")).first()[0]
    return cut if cut is not None else (1 << 62)


def _lists(values: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    limits = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(limits), pa.array(values))


def _gains(scored: DataFrame, model: Model) -> DataFrame:
    """(first, second, gain) of at least the stored bigrams asked for: what one adds to its backed-off log probability."""
    context = scored.sparkSession.sparkContext

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = ([b.column(c).flatten() for c in ("firsts", "seconds")] for b in batches)
        yield from sketch.partial_sketches((_pair_hash(*map(_unsigned, pair)) for pair in lists), least=1)

    bits = sketch.merged(scored.select("firsts", "seconds").mapInArrow(asked, sketch.SCHEMA), least=1)
    sent = context.broadcast((bits, model.words, _factors(model.discounts)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, words, factors = sent.value
        before, after = words.history + words.loga, words.logp
        for batch in batches:
            hashes = next(_hashes(iter([batch])))
            batch = batch.filter(pa.array(sketch.passed(bits, hashes)))
            first, second = _unsigned(batch.column("first")), _unsigned(batch.column("second"))
            gain = np.log10(_mass(batch.column("n").to_numpy(zero_copy_only=False), factors))
            one, two = _frequent(first), _frequent(second)
            gain[one] -= before[first[one]]
            gain[two] -= after[second[two]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("first"), batch.column("second"), pa.array(gain)], names=["first", "second", "gain"]
            )

    found = materialize(model.bigrams.mapInArrow(scan, "first long, second long, gain double"), "asked")
    chance = F.log10(F.col("n") + 0.5) - float(np.log10(model.scale))
    for side, value in (("first", F.log10(F.col("n") + 0.5) + F.col("loga")), ("second", chance)):
        values = model.rare.select(F.col("name").alias(side), value.alias("less"))
        rest = found.where(F.col(side) < 0).join(values, side).withColumn("gain", F.col("gain") - F.col("less"))
        found = found.where(F.col(side) >= 0).unionByName(rest.drop("less"))
    return found


def score(rows: DataFrame, model: Model) -> DataFrame:
    """Every row (id, held_out, text) as (id, held_out, n_tokens, n_known, base, score).

    The rows not held out must be those of the training: their bigrams count as seen.
    """
    context = rows.sparkSession.sparkContext
    often = _least(model.bigrams, HEAD_BIGRAMS)
    found = model.bigrams.where((F.col("first") >= 0) & (F.col("second") >= 0) & (F.col("n") >= often)).toArrow()
    pairs = _packed(_unsigned(found.column("first")), _unsigned(found.column("second")))
    pairs = mix(pairs)
    order = np.argsort(pairs)
    factors = _factors(model.discounts)
    shares = np.log10(_mass(found.column("n").to_numpy(), factors))[order]
    once = float(np.log10(factors[1]))
    sent = context.broadcast((model.words, Places(pairs[order]), shares, model.twice))
    known_end = int(model.words.n[END] > 0)
    schema = T.StructType([
        T.StructField("row", T.LongType()), T.StructField("id", rows.schema["id"].dataType),
        T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("part", T.DoubleType()),
        T.StructField("words", T.ArrayType(T.LongType())), T.StructField("sides", T.ArrayType(T.ByteType())),
        T.StructField("firsts", T.ArrayType(T.LongType())), T.StructField("seconds", T.ArrayType(T.LongType())),
    ])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, shares, twice = sent.value
        logp, history, loga = words.logp, words.history, words.loga
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for piece in pieces(batch):
                count = piece.num_rows
                hashes, limits = tokens_of(piece.column("text"))
                line, inner, owner = lines_of(words.named(hashes), limits)
                first, second, of = line[:-1], line[1:], owner[:-1]
                within = owner[1:] == of
                one, two = _frequent(first), _frequent(second)
                both = np.flatnonzero(within & one & two)
                place = pairs.find(mix(_packed(first[both], second[both])))
                # A transition is settled where its bigram is known to be seen, with this log of its discounted count.
                share, settled = np.zeros(len(first)), np.zeros(len(first), bool)
                hit = both[place >= 0]
                share[hit], settled[hit] = shares[place[place >= 0]], True
                held = piece.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
                trained = np.flatnonzero(within & ~settled & ~held[of])
                single = trained[~sketch.passed(twice, _pair_hash(first[trained], second[trained]))]
                share[single], settled[single] = once, True
                asked = within & ~settled
                part = np.where(settled, share, 0.0)
                at = within & one
                part[at] += np.where(settled[at], -history[first[at]], loga[first[at]])
                at = asked & two
                part[at] += logp[second[at]]
                token = line[(line != BEGIN)]
                row = owner[(line != BEGIN)]
                known = _frequent(token)
                base = np.bincount(row[known], weights=history[token[known]], minlength=count)
                hits = np.bincount(row[known & (token != END)], minlength=count)
                rare = np.flatnonzero(inner & ~_frequent(line))
                sides = settled[rare - 1].astype(np.int8) + 2 * settled[rare].astype(np.int8)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(number, number + count)), piece.column("id"), piece.column("held_out"),
                    pa.array(np.diff(limits) + 1), pa.array(hits + known_end), pa.array(base),
                    pa.array(np.bincount(of[within], weights=part[within], minlength=count)),
                    _lists(line[rare].view(np.int64), owner[rare], count), _lists(sides.astype(np.int8), owner[rare], count),
                    _lists(first[asked].view(np.int64), of[asked], count),
                    _lists(second[asked].view(np.int64), of[asked], count),
                ], names=schema.names)
                number += count

    scored = materialize(whole_texts(rows).mapInArrow(scan, schema), "scored")
    gains = _gains(scored, model)
    scale = float(np.log10(model.scale))
    log_n = F.log10(F.coalesce("n", F.lit(0)) + 0.5)
    before, after = F.col("side").bitwiseAND(F.lit(1)) > 0, F.col("side").bitwiseAND(F.lit(2)) > 0
    rare = scored.select("row", F.explode(F.arrays_zip("words", "sides")).alias("w")).select(
        "row", F.col("w.words").alias("name"), F.col("w.sides").alias("side")
    ).join(model.rare, "name", "left").groupBy("row").agg(
        F.count("n").alias("more_known"), F.sum(log_n).alias("more_base"),
        F.sum(
            F.when(before, 0.0).otherwise(log_n - scale) + F.when(after, -log_n).otherwise(F.coalesce("loga", F.lit(0.0)))
        ).alias("more"),
    )
    other = scored.select("row", F.explode(F.arrays_zip("firsts", "seconds")).alias("b")).select(
        "row", F.col("b.firsts").alias("first"), F.col("b.seconds").alias("second")
    ).join(gains, ["first", "second"]).groupBy("row").agg(F.sum("gain").alias("gains"))
    nothing = F.lit(0)
    return scored.drop("words", "sides", "firsts", "seconds").join(rare, "row", "left").join(other, "row", "left").select(
        "id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", nothing)).alias("n_known"),
        (F.col("base") + F.coalesce("more_base", nothing) - F.col("n_tokens") * scale).alias("base"),
        (F.col("part") + F.coalesce("more", nothing) + F.coalesce("gains", nothing)).alias("score"),
    )


def split(documents: DataFrame, folds: int, held: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, held_out): a row is held out if the CRC-32 of its id as text leaves ``held`` modulo ``folds``."""
    fold = F.crc32(F.col(f"`{id_col}`").cast("string")) % folds
    return documents.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        F.coalesce(fold == held, F.lit(False)).alias("held_out"),
    )


def score_texts(
    documents: DataFrame, folds: int = 5, held: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row (id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``documents``.

    Trained on the rows that are not held out, over whole texts. Tokens are words, A-Z in lower case, then one end. A
    null or empty text is an end alone. ``base_score`` adds log10((c + 0.5) / (N + 0.5 * (V + 1))) over tokens; ``score``
    is the model's log10 probability of the text. Rows of null id belong to the training; repeated rows count and are
    scored each. Without training rows every token has base probability one and the score of an unknown word; an empty
    table gives an empty result.
    """
    rows = split(documents, folds, held, id_col, text_col)
    model = train(rows.where("not held_out"))
    scored = score(rows, model)
    remove_scratch(documents.sparkSession, model.spent)
    return scored.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), "score",
    )
