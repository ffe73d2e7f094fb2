"""Quality classifier by importance resampling.

Two generative models over hashed word 1-grams and 2-grams: one of the target (a bounded
sample of documents labelled good), one of the raw text (every document). A document's log
importance weight is the sum of the log ratios of its n-grams. Documents are sampled
without replacement in proportion to their weights by the Gumbel top-k rule: the k largest
sums of log weight and Gumbel noise stay.

k is the number of documents that the weights call good: those at or above the cut that
best separates the labelled good from the labelled poor ones (the mean of both classes'
error rates is least; of equal cuts the lowest). Noise moves documents near the cut only,
as it is small beside weights of dozens of n-grams. Without poor or without good labels
nothing can be told apart and every document stays.

The noise is a hash of id, text length and seed, so a repeated run or task gives the same
sample. Documents tied at the k-th place all stay. Null and empty texts have no n-grams,
weight 0 and noise like any other; repeated rows have equal weights and noise. Labels of
one id that contradict each other count as poor; labels without id or value, and toxic
documents of good quality, are left out of target and cut. An empty
table gives an empty table. Input columns named like an added one are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import annotate, slices, without
from ledgerlens.session import cut_lineage

BUCKETS = 1 << 16      # hashed n-grams of each order share this many counters
LABELLED = 20_000      # labelled documents used at most, half to fit and half to set k
SMOOTHING = 0.5        # added to every target count, scaled to the raw model's shape
SEED = 17
CACHE_WORDS = 100_000  # distinct words a task remembers the hash of


class WordHashes(dict):
    """Hash of a word, remembered up to a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = zlib.crc32(word) * 0x9E3779B1 & 0xFFFFFFFF
        return value


def ngrams(text: str, hashes: WordHashes) -> np.ndarray:
    """Buckets of the words (case kept) and of the pairs of neighbouring words."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.int64)
    one = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    two = (one[:-1] * np.uint64(0x85EBCA6B) + one[1:] * np.uint64(0xC2B2AE35)) >> np.uint64(7)
    both = np.concatenate((one >> np.uint64(5), two | np.uint64(1 << 40)))
    return ((both ^ (both >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int64)


def labelled(labels: DataFrame, id_column: str = "doc_id", rows: int = LABELLED) -> dict:
    """Bounded sample of labelled ids: id -> good, chosen by a hash of the id.

    Good: quality 1 and not toxic. Poor: quality 0. Others say nothing about quality.
    """
    found = (labels.where(F.col(id_column).isNotNull())
             .groupBy(F.col(id_column).alias("id"))
             .agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0)))
                  .alias("toxic"))
             .select("id", F.when(F.col("quality") == 0, False).when(
                 (F.col("quality") == 1) & (F.col("toxic") == 0), True).alias("good"))
             .where(F.col("good").isNotNull())
             .orderBy(F.xxhash64("id"), "id").limit(rows))
    return {r["id"]: r["good"] for r in found.collect()}


def to_fit(ids: dict) -> tuple[set, set]:
    """Good ids for the target model, and all ids that set k, as halves of the sample."""
    first = {i for i in ids if zlib.crc32(str(i).encode()) & 1}
    return {i for i in first if ids[i]}, set(ids) - first


def count_ngrams(df: DataFrame, target: set, text: str, id_column: str) -> np.ndarray:
    """Counts of target and raw model (2 x BUCKETS), over every document.

    Tasks add up their own documents; what leaves them is a row a bucket.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, hashes = np.zeros((2, BUCKETS), np.int64), WordHashes()
        for part in slices(batches):
            raw = [np.empty(0, np.int64)]
            for key, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                grams = ngrams(value or "", hashes)
                raw.append(grams)
                if key in target:
                    counts[0] += np.bincount(grams, minlength=BUCKETS)
            counts[1] += np.bincount(np.concatenate(raw), minlength=BUCKETS)
        at = np.nonzero(counts[1])[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(counts[0, at]), pa.array(counts[1, at])],
            names=["bucket", "target", "raw"])

    rows = (df.select(id_column, text)
            .mapInArrow(run, "bucket long, target long, raw long")
            .groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))
            .toPandas())     # BUCKETS rows at most
    counts = np.zeros((2, BUCKETS))
    at = rows["bucket"].to_numpy(np.int64)
    counts[0, at], counts[1, at] = rows["target"], rows["raw"]
    return counts


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """Log ratio of each bucket; both models are smoothed by the raw model's shape."""
    raw = (counts[1] + SMOOTHING) / (counts[1].sum() + SMOOTHING * BUCKETS)
    target = (counts[0] + SMOOTHING * BUCKETS * raw) / (counts[0].sum() + SMOOTHING * BUCKETS)
    return np.log(target) - np.log(raw)


def add_weights(df: DataFrame, ratios: np.ndarray, text: str, id_column: str) -> DataFrame:
    """``df`` with n_ngrams, log_weight and the noisy key of Gumbel top-k."""
    def make():
        hashes = WordHashes()

        def work(texts: list[str]) -> list[tuple]:
            grams = [ngrams(t, hashes) for t in texts]
            return [(len(g), float(ratios[g].sum()), len(t)) for g, t in zip(grams, texts)]
        return work

    found = annotate(df, text, "n_ngrams long, log_weight double, __length long", make)
    # uniform in (0, 1) from 52 bits of a hash
    drawn = (F.shiftrightunsigned(F.xxhash64(F.col(id_column), F.col("__length"), F.lit(SEED)),
                                  12) + F.lit(0.5)) / F.lit(float(1 << 52))
    key = F.col("log_weight") - F.log(-F.log(drawn))
    return without(found.withColumn("gumbel_key", key), ["__length"])


def best_cut(weights: list[float], good: list[bool]) -> float:
    """Lowest cut with the least mean error rate of both classes; -inf without both classes."""
    w, g = np.array(weights, float), np.array(good, bool)
    if not g.any() or g.all():
        return float("-inf")
    order = np.argsort(w, kind="stable")
    w, g = w[order], g[order]
    lost = np.concatenate(([0], np.cumsum(g))) / g.sum()
    kept = 1 - np.concatenate(([0], np.cumsum(~g))) / (~g).sum()
    begins = np.concatenate(([True], w[1:] != w[:-1], [True]))   # a cut stands before a value
    error = np.where(begins, lost + kept, np.inf)
    at = int(np.argmin(error))
    return float(w[at]) if at < len(w) else float("inf")


def kth_largest(keys: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, by counting ever narrower ranges of values.

    Each round counts 4,096 ranges over all rows, so nothing is sorted as a whole and what
    reaches the driver is bounded. Ranges too narrow for that hold few distinct numbers.
    """
    row = keys.agg(F.min(column).alias("low"), F.max(column).alias("high")).first()
    low, high, wanted = row["low"], row["high"], k
    while low < high:
        width = (high - low) / 4096
        slot = F.floor((F.col(column) - F.lit(low)) / F.lit(width)) if low + width > low \
            else F.col(column)
        rows = (keys.where(F.col(column).between(low, high)).groupBy(slot.alias("slot"))
                .agg(F.count("*").alias("n"), F.min(column).alias("low"),
                     F.max(column).alias("high")).collect())
        for r in sorted(rows, key=lambda r: -r["slot"]):
            if r["n"] >= wanted:
                low, high = r["low"], r["high"]
                break
            wanted -= r["n"]
    return low


def fit(df: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id",
        rows: int = LABELLED) -> tuple[np.ndarray, DataFrame, float]:
    """(log ratios, checkpointed weights of all documents, key of the k-th document)."""
    ids = labelled(labels, id_column, rows)
    target, others = to_fit(ids)
    ratios = log_ratios(count_ngrams(df, target, text, id_column))
    weights = cut_lineage(without(add_weights(df.select(id_column, text), ratios, text,
                                              id_column), [text]))
    cut = float("-inf")
    if others:
        chosen = df.sparkSession.createDataFrame(    # rows / 2 at most, so it may be broadcast
            pd.DataFrame({"__id": sorted(others), "__good": [ids[i] for i in sorted(others)]}))
        judged = weights.join(F.broadcast(chosen), F.col(id_column) == F.col("__id")).select(
            "log_weight", "__good").collect()
        cut = best_cut([r["log_weight"] for r in judged], [r["__good"] for r in judged])
    k = weights.where(F.col("log_weight") >= cut).count()
    least = kth_largest(weights, "gumbel_key", k) if k else float("inf")
    return ratios, weights, least


def score_quality(df: DataFrame, labels: DataFrame, text: str = "text",
                  id_column: str = "doc_id", rows: int = LABELLED) -> DataFrame:
    """(id, n_ngrams, log_weight, gumbel_key, kept) of every document."""
    _, weights, least = fit(df, labels, text, id_column, rows)
    return weights.withColumn("kept", F.col("gumbel_key") >= F.lit(least))


def keep_good(df: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id",
              rows: int = LABELLED) -> DataFrame:
    """The sampled documents, columns as they were.

    Weights are computed again where the text is, which costs a pass but no shuffle of text.
    """
    names = df.columns
    ratios, _, least = fit(df, labels, text, id_column, rows)
    inner = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    scored = add_weights(inner, ratios, f"c{names.index(text)}", f"c{names.index(id_column)}")
    return scored.where(F.col("gumbel_key") >= F.lit(least)).select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
