"""Token counts with a digest cache.

The cache is a table of (content digest, tokenizer digest, number of tokens). Documents are
joined to it by the digest of their content; each distinct text that it misses is encoded
once and appended. The tokenizer digest covers the vocabulary file, the library's version
and how it is called, so counts of another tokenizer never match.

Content is normalised only where that cannot change the count: null becomes empty. Repeated
rows share one digest and are encoded once. An empty table adds nothing and gives an empty
table. Input columns named like an added one are replaced.

Texts that are missing travel once, by their digest, after every task has dropped the
copies it sees itself; so the copies of one text, however many, do not meet in one task.
The final join carries digests and ids only; its large keys are split by adaptive skew
joins. Appends are single Spark writes: a failed run adds nothing, and a text that two runs
add at the same time is there twice with the same count, which reading folds.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
import tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import slices, without

LIMIT = 512
CACHE = "digest binary, tokenizer binary, n_tokens long"
ENCODE_CHARS = 2_000_000   # characters that are encoded together


def tokenizer_digest(vocabulary: bytes) -> bytes:
    said = f"tokenizers {tokenizers.__version__} add_special_tokens=False".encode()
    return hashlib.sha256(said + b"\0" + hashlib.sha256(vocabulary).digest()).digest()


def load(vocabulary: bytes) -> tokenizers.Tokenizer:
    tokenizer = tokenizers.Tokenizer.from_buffer(vocabulary)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def read_cache(spark: SparkSession, path: str, tokenizer: bytes) -> DataFrame:
    """(digest, n_tokens) that the cache holds for a tokenizer; empty if there is no cache."""
    try:
        stored = spark.read.schema(CACHE).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], CACHE)
    return (stored.where(F.col("tokenizer") == F.lit(tokenizer))
            .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))


def first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose digest (column 0) this task has not passed on before."""
    seen: set[bytes] = set()
    for part in slices(batches):
        fresh = []
        for i, digest in enumerate(part.column(0).to_pylist()):
            if digest not in seen:
                seen.add(digest)
                fresh.append(i)
        if fresh:
            yield part.take(pa.array(fresh, pa.int64()))


def count_misses(missing: DataFrame, vocabulary: bytes) -> DataFrame:
    """(digest, tokenizer, n_tokens) of the distinct texts of ``missing`` (digest, text)."""
    version = tokenizer_digest(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # one core a task
        tokenizer = load(vocabulary)

        def counted(digests: list[bytes], texts: list[str]) -> pa.RecordBatch:
            found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            return pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.binary()), pa.array([version] * len(texts), pa.binary()),
                 pa.array([len(x.ids) for x in found], pa.int64())],
                names=["digest", "tokenizer", "n_tokens"])

        digests, texts, size = [], [], 0
        for part in first_seen(batches):
            for digest, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                digests.append(digest)
                texts.append(text)
                size += len(text)
                if size >= ENCODE_CHARS:
                    yield counted(digests, texts)
                    digests, texts, size = [], [], 0
        if texts:
            yield counted(digests, texts)

    alike = missing.mapInArrow(first_seen, "digest binary, text string")
    return alike.repartition("digest").mapInArrow(encode, CACHE)


def count_tokens(df: DataFrame, vocabulary: bytes, cache: str, text: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """``df`` without its text, with n_bytes, n_tokens and over_limit.

    ``vocabulary``: content of the tokenizer's file, so executors need no file. ``cache``:
    folder of the cache, which all executors must reach; this call appends to it.
    """
    spark, version = df.sparkSession, tokenizer_digest(vocabulary)
    content = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(content, 256))
    stored = read_cache(spark, cache, version)
    missing = df.select(digest.alias("digest"), content.alias("text"))
    if not stored.isEmpty():
        missing = missing.join(stored.hint("shuffle_hash"), "digest", "left_anti")
    count_misses(missing, vocabulary).write.mode("append").parquet(cache)

    # the row travels as one column, so no name of the input can clash with the cache's
    rest = without(df, ["n_bytes", "n_tokens", "over_limit"])
    kept = [c for c in rest.columns if c != text]
    keyed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), digest.alias("digest"),
        F.octet_length(content).cast("long").alias("n_bytes"))
    joined = keyed.join(read_cache(spark, cache, version), "digest")
    return joined.select(*[F.col("row")[c].alias(c) for c in kept], "n_bytes", "n_tokens",
                         (F.col("n_tokens") > limit).alias("over_limit"))
