"""Exact line dedup that answers with bitmaps, written with Spark's own functions only.

A line's key is the line without white space at both ends, A-Z lower-cased. Keys of
``MIN_CHARS`` code points or more that at least two documents hold lose their lines
everywhere but in the document with the smallest id; that document keeps all of its own.

Only (two 64-bit hashes of the key, document, position) travel. They are range-partitioned
by hash and sorted by document and position inside it; a streaming window hands every
occurrence the first document of its key. What is not in that document is a dropped line.
Dropped positions meet again by document, 64 of them to a word, and words whose lines all
stay are left out, so a bitmap is as long as what was dropped. ``apply_bitmaps`` brings
bitmaps and texts together, which is the only time that text is shuffled.

Range partitioning cannot cut a key, so keys that would fill a good part of a partition
(found in a sample, which decides where they are handled and nothing else) do not enter it:
their smallest document comes from an aggregate that is combined in the tasks, at most
``4 * partitions`` rows, and goes to the occurrences as a broadcast. The list is bounded by
arithmetic, since each of its keys holds a quarter of a mean partition.

Two different keys are taken for one if all 128 hash bits agree, which 10^13 keys do with a
chance of about 10^-13. Defined cases: null or empty text is one empty line; rows without a
document id keep their lines and count for no one; rows with one id are one document; equal
rows get equal bitmaps; an empty table gives an empty table. Input columns with the names
of added ones are replaced, all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import without
from ledgerlens.session import scratch_path

MIN_CHARS = 10
SPACE = "\t\n\v\f\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOT_PART = 0.25     # share of a mean partition from which a key is handled apart
HOT_HITS = 100      # sampled rows that a key of that size is expected to have
ADDED = ["n_lines", "n_dropped", "keep", "kept_text"]


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased (``lower`` where it does the same)."""
    bare = F.btrim(line, F.lit(SPACE))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def occurrences(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """(h1, h2, doc, version, pos) of every line that is long enough to count."""
    lines = docs.where(F.col(f"`{doc_id}`").isNotNull()).select(
        F.col(f"`{doc_id}`").alias("doc"), F.xxhash64(text).alias("version"),
        F.posexplode(lines_of(F.col(f"`{text}`"))).alias("pos", "line"))
    keyed = lines.select("doc", "version", "pos", line_key(F.col("line")).alias("key"))
    return keyed.where(F.length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"),
        "doc", "version", "pos")


def hot_firsts(found: DataFrame, rows: int, partitions: int) -> DataFrame:
    """(h1, h2, least) of the keys that are too frequent for one partition."""
    wanted = HOT_HITS * partitions / HOT_PART
    share = min(1.0, wanted / max(rows, 1))
    floor = rows * share * HOT_PART / partitions / 2
    hot = (found.sample(share, seed=11).groupBy("h1", "h2").agg(F.count("*").alias("n"))
           .where(F.col("n") > max(floor, 1.0)).orderBy(F.desc("n"), "h1", "h2")
           .limit(int(2 * partitions / HOT_PART)).select("h1", "h2"))
    return (found.join(F.broadcast(hot), ["h1", "h2"], "left_semi")
            .groupBy("h1", "h2").agg(F.min("doc").alias("least")))


def line_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, version, n_dropped, keep) of every document that loses lines.

    ``version`` is the hash of the document's text. ``keep`` is an array of (word, bits):
    bit b of word w tells whether line ``64 * w + b`` stays; words that are all ones are
    left out.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "line-keys")
    occurrences(docs, doc_id, text, min_chars).write.parquet(path)
    found = spark.read.parquet(path)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot_path = scratch_path(spark, "line-hot")
    hot_firsts(found, found.count(), partitions).write.parquet(hot_path)
    hot = F.broadcast(spark.read.parquet(hot_path))

    first = Window.partitionBy("h1", "h2").orderBy("doc", "pos").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    spread = (found.join(hot, ["h1", "h2"], "left_anti")
              .repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", "doc", "pos")
              .withColumn("least", F.first("doc").over(first)))
    apart = found.join(hot, ["h1", "h2"])
    dropped = spread.select("doc", "version", "pos", "least").unionByName(
        apart.select("doc", "version", "pos", "least")).where(F.col("doc") != F.col("least"))

    # equal rows bring every position twice, which an or does not mind
    words = dropped.repartition("doc", "version").groupBy(
        "doc", "version", F.shiftright("pos", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("gone"))
    return words.groupBy("doc", "version").agg(
        F.sum(F.bit_count("gone")).cast("long").alias("n_dropped"),
        F.array_sort(F.collect_list(F.struct(
            "word", F.bitwise_not("gone").alias("bits")))).alias("keep"))


def dense(keep: Column) -> Column:
    """Words of a bitmap up to its last one, the left-out ones as all ones."""
    def filled(word: Column, i: Column) -> Column:
        before = F.coalesce(F.get(keep, i - 1)["word"], F.lit(-1))
        return F.concat(F.array_repeat(F.lit(-1).cast("long"), word["word"] - before - 1),
                        F.array(word["bits"]))
    return F.flatten(F.transform(keep, filled))


def kept_lines(lines: Column, keep: Column) -> Column:
    """Lines whose bit is set; all where there is no bitmap."""
    def chosen(words: Column) -> Column:
        return F.filter(lines, lambda _, i: F.coalesce(F.getbit(
            F.get(words, F.shiftright(i, 6)), i % 64), F.lit(1)) == 1)
    return F.when(keep.isNull(), lines).otherwise(let(keep, lambda k: let(dense(k), chosen)))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """``docs`` with n_lines, n_dropped, keep and kept_text."""
    base = without(docs, ADDED)
    packed = base.select(F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("row"),
                         F.col(f"`{doc_id}`").alias("doc"), F.xxhash64(text).alias("version"),
                         F.col(f"`{text}`").alias("text"))
    lines = lines_of(F.col("text"))
    return packed.join(bitmaps, ["doc", "version"], "left").select(
        *[F.col("row")[c].alias(c) for c in base.columns],
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), "keep",
        F.array_join(kept_lines(lines, F.col("keep")), "\n").alias("kept_text"))
