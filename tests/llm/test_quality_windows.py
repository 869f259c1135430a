import random

from colsight.llm.quality import statistics


def repeated(text):
    words = text.split()
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i:i + 8]), []).append(i)
    return len({j for starts in seen.values() if len(starts) > 1 for i in starts for j in range(i, i + 8)})


def test_only_texts_that_repeat_a_window_are_put_in_order(spark):
    rnd = random.Random(3)
    texts = [" ".join(f"w{rnd.randrange(4)}" for _ in range(n)) for n in range(0, 400, 7)]
    texts += [" ".join(f"u{i}" for i in range(n)) for n in (7, 8, 9, 300)] + ["a " * 50, "a b c d e f g h x a b c d e f g h"]
    stats = statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    assert {r.id: r.n_repeat_words for r in stats.collect()} == {k: repeated(t) for k, t in enumerate(texts)}
    plan = stats._jdf.queryExecution().optimizedPlan().toString()
    # No sort by a comparator, and none without a look whether any window repeats.
    assert "array_sort(" not in plan and "array_distinct(starts" in plan
