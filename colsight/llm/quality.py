"""Quality rules: a decision list learned by sequential covering and applied as one ordered conditional expression."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsight.llm.common import drawn
from colsight.session import materialize

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Shares and means the rules may test, each from the statistics of one document.
FEATURES = {
    "word_length": "word_chars / n_words",
    "symbol_share": "n_symbols / word_chars",
    "repeat_share": "n_repeat_words / n_words",
    "dup_line_share": "n_dup_lines / n_lines",
    "upper_share": "n_upper / word_chars",
    "digit_share": "n_digits / word_chars",
    "mark_share": "n_marks / word_chars",
    "line_words": "n_words / n_lines",
}


def _removed(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def statistics(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """Counts of every text: id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_digits,
    n_marks, and the columns ``keep`` as a struct ``doc``.

    Words are runs without white space. Repeated words lie in a window of eight that begins twice or more in the text;
    windows are compared by 64-bit hashes, sorted with their places, so equal ones are neighbours. A null text counts as
    an empty one. Everything is a column expression over its own row: there is no shuffle.
    """
    cells = documents.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        *([F.struct(*(F.col(f"`{c}`") for c in keep)).alias("doc")] if keep else []),
    )
    words = cells.withColumn("words", F.array_remove(F.split("text", BLANKS), "")).withColumn(
        "lines", F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    )
    hashed = words.withColumn("hashes", F.expr("transform(words, w -> xxhash64(w))"))
    starts = hashed.withColumn("starts", F.expr(f"""
        if(size(words) < {WINDOW}, cast(array() as array<bigint>),
           transform(sequence(0, size(words) - {WINDOW}),
             i -> xxhash64({', '.join(f'hashes[i + {k}]' for k in range(WINDOW))})))"""))
    # Most texts repeat no window; only those of the others are put in order.
    windows = starts.withColumn("windows", F.expr("""
        if(size(array_distinct(starts)) = size(starts), cast(array() as array<struct<h: bigint, i: int>>),
           sort_array(transform(starts, (h, i) -> named_struct('h', h, 'i', i))))"""))
    places = windows.withColumn("places", F.expr("""
        sort_array(transform(
          filter(windows, (w, j) -> (j > 0 and w.h = windows[j - 1].h)
                                 or (j < size(windows) - 1 and w.h = windows[j + 1].h)), w -> w.i))"""))
    covered = F.expr(f"""
        aggregate(transform(places, (p, j) -> if(j < size(places) - 1, least({WINDOW}, places[j + 1] - p), {WINDOW})),
                  0L, (n, x) -> n + x)""")
    return places.select(
        "id", F.size("words").cast("long").alias("n_words"),
        (F.length("text") - _removed(F.col("text"), " \t\n\x0b\x0c\r")).cast("long").alias("word_chars"),
        _removed(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        _removed(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"),
        _removed(F.col("text"), "0123456789").cast("long").alias("n_digits"),
        _removed(F.col("text"), ".,;:!?'\"()-").cast("long").alias("n_marks"),
        *(["doc"] if keep else []),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def features(stats: DataFrame, *others: str) -> DataFrame:
    """The features of each row; a share of nothing is zero."""
    return stats.select(
        *others, *(F.coalesce(F.expr(f"try_divide({e.split(' / ')[0]}, {e.split(' / ')[1]})"), F.lit(0.0)).alias(n)
                   for n, e in FEATURES.items())
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        test = F.lit(True)
        for c in self.conditions:
            test = test & c.column()
        return test

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _gain(before: tuple[float, float], after: tuple[float, float]) -> float:
    """How much a condition tells about the covered bad rows, counted for each of them that stays covered."""
    (bad0, good0), (bad, good) = before, after
    if not bad:
        return 0.0
    return bad * (math.log2((bad + 1e-9) / (bad + good + 1e-9)) - math.log2((bad0 + 1e-9) / (bad0 + good0 + 1e-9)))


def _grown(rows: DataFrame, cuts: dict[str, list[float]], most: int) -> Rule:
    """Adds the condition of largest gain until no good row is covered; a table of counts per bin comes to the driver.

    Of lower limits that gain alike the largest is taken, which leaves most room for good rows not seen here.
    """
    conditions: list[Condition] = []
    while len(conditions) < most:
        covered = rows.where(Rule(tuple(conditions)).column()) if conditions else rows
        bins = F.explode(F.array(*(
            F.struct(F.lit(n).alias("feature"), F.expr(
                f"size(filter(array({', '.join(f'{c!r}D' for c in values)}), c -> `{n}` > c))" if values else "0"
            ).alias("bin"))
            for n, values in cuts.items()
        ))).alias("b")
        counts: dict[str, list[list[float]]] = {n: [[0, 0] for _ in range(len(v) + 1)] for n, v in cuts.items()}
        for r in covered.select("bad", bins).groupBy("b.feature", "b.bin", "bad").count().collect():
            counts[r.feature][r.bin][0 if r.bad else 1] += r["count"]
        some = next(iter(counts.values()))
        total = (sum(b for b, _ in some), sum(g for _, g in some))
        if not total[0] or not total[1]:
            break
        best, choice = 0.0, None
        for name, values in cuts.items():
            bad = good = 0.0
            for cut, (b, g) in zip(values, counts[name], strict=False):
                bad, good = bad + b, good + g
                for above, after in ((False, (bad, good)), (True, (total[0] - bad, total[1] - good))):
                    gain = _gain(total, after)
                    if gain > best + 1e-9 or above and choice and (name, True) == (choice.feature, choice.above) and (
                        gain > best - 1e-9
                    ):
                        best, choice = gain, Condition(name, above, cut)
        if choice is None:
            break
        conditions.append(choice)
    return Rule(tuple(conditions))


def _pruned(rows: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    """The rule without its last conditions, as many as make (bad - good) / (bad + good) largest on rows set apart."""
    heads = [Rule(rule.conditions[:k]) for k in range(1, len(rule.conditions) + 1)]
    sums = rows.agg(*(
        F.count(F.when(h.column() & (F.col("bad") == side), 1)).alias(f"s{k}_{int(side)}")
        for k, h in enumerate(heads) for side in (True, False)
    )).first()
    scored = [(h, sums[f"s{k}_1"], sums[f"s{k}_0"]) for k, h in enumerate(heads)]
    return max(scored, key=lambda s: ((s[1] - s[2]) / (s[1] + s[2]) if s[1] + s[2] else -1.0, -len(s[0].conditions)))


def learn_rules(
    labelled: DataFrame, precision: float = 0.97, most_rules: int = 8, most_conditions: int = 3, bins: int = 24,
    sample: int = 100_000,
) -> list[Rule]:
    """An ordered list of rules for bad documents, from rows (id, bad, features).

    Two thirds of the rows, by hash of the id, grow a rule; the rest prune it. A rule is kept if its precision there is
    at least ``precision`` and it covers three bad rows or more; what it covers is then taken out, and the next is
    learned, until one fails. ``sample`` bounds the labelled rows, those with the least hash of the id. Thresholds are
    values of rows near evenly spaced ranks of either label, and the middles between them. Rows of null id or label are left out.
    """
    known = labelled.where("id is not null and bad is not null").withColumn("draw", F.xxhash64("id"))
    rows = materialize(drawn(materialize(known, "known"), "draw", sample), "labelled")
    ranks = [k / bins for k in range(1, bins)]
    found = rows.where("bad").agg(*(F.percentile_approx(n, ranks, 10_000).alias(n) for n in FEATURES)).first()
    other = rows.where("not bad").agg(*(F.percentile_approx(n, [0.0, *ranks, 1.0], 10_000).alias(n) for n in FEATURES)).first()
    values = {n: sorted({*(found[n] or ()), *(other[n] or ())}) for n in FEATURES}
    cuts = {n: sorted({*v, *((a + b) / 2 for a, b in zip(v[:-1], v[1:], strict=True))}) for n, v in values.items()}
    if not any(found) or not any(other):
        return []
    third = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(3)) == 0
    rules: list[Rule] = []
    while len(rules) < most_rules:
        left = rows.where(~_any(rules))
        rule = _grown(left.where(~third), cuts, most_conditions)
        if not rule.conditions:
            break
        rule, bad, good = _pruned(left.where(third), rule)
        if bad < 3 or bad < precision * (bad + good):
            break
        rules.append(rule)
    return rules


def _any(rules: list[Rule]) -> Column:
    test = F.lit(False)
    for r in rules:
        test = test | r.column()
    return test


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, counted from 1, else 0: one ordered conditional expression."""
    if not rules:
        return F.lit(0)
    chain = F.when(rules[0].column(), 1)
    for k, rule in enumerate(rules[1:], 2):
        chain = chain.when(rule.column(), k)
    return chain.otherwise(0)


def judge_quality(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    keep: tuple[str, ...] = (), precision: float = 0.97,
) -> DataFrame:
    """One row per row of ``documents``: id, the statistics, base_failed, rule and kept, and the columns ``keep``
    as a struct ``doc``.

    Fixed tests come first: fewer than 20 words, or more than 30 % of them repeated. Of the others, documents labelled
    1 or 0 teach a decision list, and ``rule`` names the first of its rules that holds (0: none). A document is kept if
    neither rejects it. Labels may repeat or disagree (a document counts as bad if any says so), be null or belong to no
    document; without bad and good ones no rule is learned. Null and empty texts have no words and fail the fixed tests.
    Repeated rows and null ids are judged one by one; an empty table gives an empty result. The statistics are written
    once, so texts are read once.
    """
    stats = materialize(statistics(documents, id_col, text_col, keep), "statistics")
    marks = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label")).where(
        "id is not null and label is not null"
    ).groupBy("id").agg((F.min("label") <= 0).alias("bad"))
    taught = features(stats.where(~base_failed()).join(marks, "id"), "id", "bad")
    rules = learn_rules(taught, precision)
    kept = ["doc"] if keep else []
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = features(stats.withColumn("base_failed", base_failed()), "id", *counts, "base_failed", *kept)
    return judged.withColumn("rule", verdict(rules)).select(
        F.col("id").alias(id_col), *counts, "base_failed", "rule", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"),
        *kept,
    )
