import public_tokenizers
import pytest
from tokenizers import Tokenizer

from colsight.llm.token_counts import count_tokens, read_cache, tokenizer_version
from tests.llm.conftest import ODD, rows_of

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture
def cache(tmp_path):
    return str(tmp_path / "cache")


def expected(rows, limit=1024):
    tokenizer = Tokenizer.from_file(PATH)
    counts = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in rows]
    return sorted(((d, len((t or "").encode()), n, n > limit) for (d, t, *_), n in zip(rows, counts)), key=repr)


def test_counts_as_the_library_does(documents, cache):
    rows = [*ODD, (20, "a<|endoftext|>b"), (21, "tab\tand  blanks")]
    assert rows_of(count_tokens(documents(rows), PATH, cache)) == expected(rows)


def test_second_run_encodes_only_what_is_new(spark, odd, documents, cache):
    count_tokens(odd, PATH, cache).collect()
    before = spark.read.parquet(cache).count()
    assert before == len({t or "" for _, t, _ in ODD})
    more = [*ODD, (30, "brand new text"), (31, "brand new text")]
    assert rows_of(count_tokens(documents(more), PATH, cache)) == expected(more)
    assert spark.read.parquet(cache).count() == before + 1


def test_stored_counts_are_used_and_versions_kept_apart(spark, documents, cache):
    rows = [(1, "one two three")]
    count_tokens(documents(rows), PATH, cache).collect()
    stored = spark.read.parquet(cache)
    fake = str(cache) + "-fake"
    stored.selectExpr("tokenizer", "digest", "777L AS n_tokens").write.parquet(fake)
    assert count_tokens(documents(rows), PATH, fake).first().n_tokens == 777
    other = str(cache) + "-other"
    stored.selectExpr("'another file' AS tokenizer", "digest", "777L AS n_tokens").write.parquet(other)
    assert rows_of(count_tokens(documents(rows), PATH, other)) == expected(rows)


def test_concurrent_appends_count_once(spark, documents, cache):
    rows = [(1, "one two three"), (2, "one two three")]
    count_tokens(documents(rows), PATH, cache).collect()
    spark.read.parquet(cache).write.mode("append").parquet(cache + "-twice")
    spark.read.parquet(cache).write.mode("append").parquet(cache + "-twice")
    assert read_cache(spark, cache + "-twice", tokenizer_version(PATH)).count() == 1
    assert rows_of(count_tokens(documents(rows), PATH, cache + "-twice")) == expected(rows)


def test_sentencepiece_file(documents, cache):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(1, "Some words here"), (2, None)]
    got = {r.doc_id: r.n_tokens for r in count_tokens(documents(rows), path, cache).collect()}
    assert got == {1: len(model.encode("Some words here")), 2: 0}


def test_empty_table_and_clashing_columns(documents, clashing, cache):
    assert count_tokens(documents([]), PATH, cache).count() == 0
    assert rows_of(count_tokens(clashing, PATH, cache)) == expected(ODD)
