"""Token counts with a digest cache: stored counts are joined by digest, only distinct misses are encoded."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsight.llm.common import pieces, whole_texts
from colsight.session import materialize

CACHE = T.StructType([
    T.StructField("tokenizer", T.StringType()),
    T.StructField("digest", T.BinaryType()),
    T.StructField("n_tokens", T.LongType()),
])

#: Bytes of text that are encoded at a time; the library keeps about a hundred bytes for every token of a call.
CALL_BYTES = 1 << 18


def tokenizer_version(path: str) -> str:
    """The digest of a tokenizer file: counts of another file never meet."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


@lru_cache(maxsize=4)
def _loaded(path: str, version: str):
    """The counting function of a tokenizer file, once per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if tokenizer_version(path) != version:
        raise ValueError(f"{path} is another file on this executor")
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(e) for e in model.encode(texts, num_threads=1)]


def read_cache(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version (digest, n_tokens), a digest once, whoever else appended it meanwhile."""
    try:
        stored = spark.read.schema(CACHE).parquet(cache_path)
    except AnalysisException:  # nothing has been stored yet
        stored = spark.createDataFrame([], CACHE)
    return stored.where(F.col("tokenizer") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(
    documents: DataFrame,
    tokenizer_path: str,
    cache_path: str,
    limit: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row (id, n_bytes, n_tokens, over_limit) per row of ``documents``.

    Counts are those of the library for the whole text, without added tokens; strings of special tokens inside a text
    are handled as its default does. The digest is taken of the text as it is (null as empty): any folding of blanks or
    case would change counts. Misses are distinct digests without a stored count; each is encoded once, from the row
    with the smallest id, and appended below ``cache_path`` by Spark's committer, so a lost executor repeats its task
    and leaves no half-written file. Repeated rows and null ids keep their rows; an empty table gives an empty result.
    Ids, digests and lengths are written first, so only digests, not texts, meet the cache.
    """
    spark = documents.sparkSession
    version = tokenizer_version(tokenizer_path)
    rows = documents.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))

    keys = materialize(
        rows.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "text-digests"
    )
    first = keys.groupBy("digest").agg(F.min("id").alias("id"))
    misses = first.join(read_cache(spark, cache_path, version), "digest", "left_anti")
    chosen = misses.select(F.col("digest").alias("miss"), F.col("id").alias("miss_id"))
    same = F.col("id").eqNullSafe(F.col("miss_id")) & (F.col("digest") == F.col("miss"))
    texts = whole_texts(rows).join(chosen.hint("shuffle_hash"), same).select("digest", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _loaded(tokenizer_path, version)
        seen: set[bytes] = set()  # rows equal in id and text meet in one task
        for batch in batches:
            for piece in pieces(batch, most=CALL_BYTES):
                digests = piece.column("digest").to_pylist()
                fresh = [i for i, d in enumerate(digests) if not (d in seen or seen.add(d))]
                if len(fresh) < len(digests):
                    piece = piece.take(pa.array(fresh, pa.int64()))
                counts = count(piece.column("text").to_pylist())
                tag = pa.array([version] * piece.num_rows, pa.string())
                digests = piece.column("digest").cast(pa.binary())
                yield pa.RecordBatch.from_arrays([tag, digests, pa.array(counts, pa.int64())], names=CACHE.names)

    encoded = texts.mapInArrow(encode, CACHE)
    encoded.write.mode("append").parquet(cache_path)

    # Written, so that the last join reads one row per digest from a table, and Spark can split a frequent digest's rows.
    counts = materialize(
        first.select("digest").join(read_cache(spark, cache_path, version), "digest"), "token-counts"
    )
    return keys.join(counts, "digest").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
