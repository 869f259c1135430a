import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
])

#: Ids and texts of every odd kind: nulls, no words, repeated rows and ids, a very long text, copies.
ODD = [
    (1, "alpha beta gamma delta", "a"), (1, "alpha beta gamma delta", "a"), (1, "other text under the same id", "b"),
    (2, None, "a"), (3, "", None), (4, " \t\n ", "b"), (None, "alpha beta gamma delta", None), (None, None, None),
    (5, "Alpha BETA gamma delta", "c"), (6, "ß é ñ 漢字 naïve \u2028 x", "c"), (7, "word " * 20_000, "a"),
    (8, "x" * 50_000, "b"), (9, "alpha beta gamma epsilon", "a"),
]


@pytest.fixture
def documents(spark):
    """Builds a table of documents, spread over partitions."""
    def build(rows):
        return spark.createDataFrame([(*r, *[None] * (3 - len(r))) for r in rows], DOCUMENTS).repartition(3)

    return build


@pytest.fixture
def odd(documents):
    return documents(ODD)


@pytest.fixture
def clashing(odd):
    """The odd table with more columns, named like the operators' own."""
    names = ("id", "digest", "n_words", "fp", "key", "row", "kept", "n", "spans", "label", "size", "target", "host", "path")
    from pyspark.sql import functions as F

    return odd.select("*", *(F.lit(f"own {n}").alias(n) for n in names))


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)
