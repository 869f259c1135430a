"""Variants of spelling: words of a corpus one edit apart, each led to the far more frequent one beside it."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsight.llm.common import whole_texts
from colsight.llm.trie import near_words
from colsight.session import materialize

#: Letters A to Z and the range U+00C0 to U+00FF.
LETTERS = "a-zÀ-ÿ"

#: Code points and occurrences a word has at least; how many times as frequent a form is.
LEAST_LETTERS, LEAST_COUNT, FORM_RATIO = 7, 2, 10

#: Distinct words a task gathers before it hands their counts on.
FLUSH = 1 << 18


def vocabulary(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    change: Callable[[object, str], str] | None = None,
) -> DataFrame:
    """(word, n): the words of at least seven letters in all texts and how often they occur, at least twice.

    Words are runs of letters, A-Z in lower case. ``change`` gets the id of a row and a run and returns the run to count
    in its place. Null and empty texts have no words; ids only go to ``change``.
    """
    rows = documents.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    runs = re.compile(f"[{LETTERS}]{{{LEAST_LETTERS},}}")
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def told(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                # Bytes have lower case for ASCII letters alone.
                found = Counter(runs.findall(text.encode().lower().decode())) if text else {}
                if change is None:
                    held.update(found)
                    continue
                for run, n in found.items():
                    word = change(key, run)
                    if len(word) >= LEAST_LETTERS:
                        held[word] += n
            if len(held) >= FLUSH:
                yield told(held)
                held = Counter()
        if held:
            yield told(held)

    counts = whole_texts(rows).mapInArrow(scan, schema).groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= LEAST_COUNT)


def _roots(links: DataFrame) -> DataFrame:
    """(word, root): the last form reached from each word that has one.

    Roots jump twice as far each round; a form is ten times as frequent as its word, so chains are short and end.
    """
    roots = materialize(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        moved = roots.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), "onward")
        moved = materialize(moved, "roots")
        if moved.where("onward is not null").isEmpty():
            return moved.select("word", "root")
        roots = moved.select("word", "root")


def spelling_variants(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    change: Callable[[object, str], str] | None = None,
) -> DataFrame:
    """One row (word, form, root, n, n_near, form_n) per word of ``vocabulary``.

    ``n_near`` counts the words one inserted, deleted or replaced code point away. ``form`` is the most frequent of them,
    the smallest by code points among equals, if it occurs at least ten times as often as the word; else null. ``root`` is
    where forms of forms lead, the word itself without one. Repeated rows count again. A table without words gives none.
    """
    words = materialize(vocabulary(documents, id_col, text_col, change), "vocabulary")
    near = near_words(words)
    others = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    # Strings are ordered by their UTF-8 bytes, which is the order of code points.
    best = near.join(others, "near").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    often = -F.col("best.less") >= FORM_RATIO * F.col("n")
    formed = materialize(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(often, F.col("best.near")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n"),
        ), "forms",
    )
    roots = _roots(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
