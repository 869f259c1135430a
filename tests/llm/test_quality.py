import collections
import random
import re

from colsight.llm.quality import FEATURES, base_failed, judge_quality, learn_rules, statistics, verdict
from tests.llm.conftest import ODD, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    times = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    gone = [False] * len(words)
    for i in range(len(words) - 7):
        if times[tuple(words[i:i + 8])] > 1:
            gone[i:i + 8] = [True] * 8
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), sum(gone)


def labelled(seed=1, count=300):
    """Clean texts, and bad ones that shout or are full of marks."""
    rnd = random.Random(seed)
    rows, labels = [], []
    for k in range(count):
        words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(25, 60))]
        kind = k % 6
        if kind == 0:
            words = [w.upper() for w in words]
        elif kind == 1:
            words = [w + "***" for w in words]
        rows.append((k, " ".join(words)))
        labels.append((k, int(kind > 1)))
    return rows, labels


def test_counts_as_brute_force(documents):
    rnd = random.Random(2)
    rows = [(k, "".join(rnd.choice(["a ", "b ", "\n", "a\n", "#", "é ", "\t", "\x0b"]) for _ in range(rnd.randint(0, 120))))
            for k in range(80)]
    got = rows_of(statistics(documents(rows)), "id", *COUNTS)
    assert got == sorted(((k, *brute(t)) for k, t in rows), key=repr)


def test_learns_both_kinds_and_keeps_clean_ones(spark, documents):
    rows, labels = labelled()
    marks = spark.createDataFrame(labels[:240], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in judge_quality(documents(rows), marks).collect()}
    assert all(got[k] == bool(q) for k, q in labels)


def test_rules_are_readable_and_ordered(spark, documents):
    rows, labels = labelled()
    marks = spark.createDataFrame(labels, "id long, quality int").selectExpr("id", "quality = 0 AS bad")
    from colsight.llm.quality import features

    taught = features(statistics(documents(rows)).join(marks, "id"), "id", "bad")
    rules = learn_rules(taught)
    assert 2 <= len(rules) <= 8 and all(c.feature in FEATURES for r in rules for c in r.conditions)
    caught = taught.withColumn("rule", verdict(rules)).where("bad and rule = 0").count()
    assert caught == 0


def test_base_rule(documents):
    rows = [(1, "w " * 19), (2, " ".join(f"w{i}" for i in range(20))), (3, "a b c d e f g h " * 4), (4, None)]
    got = {r.id: r.failed for r in statistics(documents(rows)).withColumn("failed", base_failed()).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True}


def test_odd_tables(spark, odd, clashing, documents):
    marks = spark.createDataFrame(
        [(1, 1), (1, 0), (None, 0), (2, None), (77, 0), (7, 1), (7, 1)], "doc_id long, quality int"
    )
    want = sorted(((d, *brute(t)) for d, t, *_ in ODD), key=repr)
    got = judge_quality(odd, marks)
    assert rows_of(got, "doc_id", *COUNTS) == want
    assert rows_of(got) == rows_of(judge_quality(clashing, marks))
    assert judge_quality(documents([]), marks).count() == 0
    none = judge_quality(odd, marks.limit(0)).collect()
    assert all(r.rule == 0 and r.kept == (not r.base_failed) for r in none)
    kept = judge_quality(clashing, marks, keep=("doc_id", "id", "kept")).first()
    assert kept.doc.id == "own id" and kept.doc.kept == "own kept"


def test_no_python_in_the_plan(spark, documents):
    rows, labels = labelled(count=60)
    df = judge_quality(documents(rows), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert "Python" not in (plan := df._jdf.queryExecution().toString()) and "Arrow" not in plan
