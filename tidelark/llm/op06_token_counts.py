"""Token counts with a digest cache.

The cache is a table (tokenizer, digest, n_tokens) in a store that Spark writes to, in one partition for each tokenizer: the
tokenizer's digest is that of its file, so another version never meets old counts (nor reads them), and the content's digest is the SHA-256 of the text as it is encoded, with a
null text normalised to the empty one.  Documents are joined to it by both digests; texts of distinct misses alone are
encoded, and their counts are appended.  A lost executor repeats a task; the append is one committed write.

Copies collapse before the texts are shuffled (a digest's first text is a partial aggregate), and counts are joined back to
(doc_id, digest) rows, whose hot keys Spark may split.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows give repeated results and one cache entry; entries
that runs at the same time have appended twice are read as one; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelark.llm.chunks import SplitEncoder, byte_bpe
from tidelark.llm.shared import cut, documents, new_path, small_batches, text_or_empty, tidy

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"
LIMIT = 512


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache's counts; none if nothing has been written yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def _counter(path: str, make: Callable[[str], SplitEncoder]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make(path)
        for batch in batches:
            counts = np.array([len(x) for x in encoder.encode_all(batch.column(1))], dtype=np.int64)
            yield pa.record_batch([batch.column(0), pa.array(counts)], names=["digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, cache_path: str, tokenizer_path: str, make: Callable[[str], SplitEncoder] = byte_bpe, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of documents (doc_id, text); new counts are appended to the cache."""
    spark = docs.sparkSession
    small_batches(spark)
    version = tokenizer_digest(tokenizer_path)
    texts = docs.select("doc_id", text_or_empty().alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    rows = cut(texts.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    known = read_cache(spark, cache_path).where(F.col("tokenizer") == version).select("digest", "n_tokens")
    distinct = texts.groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(known.select("digest"), "digest", "left_anti")
    counted = misses.mapInArrow(tidy(_counter(tokenizer_path, make)), "digest binary, n_tokens long")
    counted.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").partitionBy("tokenizer").parquet(cache_path)
    counts = read_cache(spark, cache_path).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of its own, empty at first, so that every run counts every distinct text."""
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), new_path(spark, "token-cache"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op6_token_counts": op6_token_counts}
SQL: dict[str, str] = {}
