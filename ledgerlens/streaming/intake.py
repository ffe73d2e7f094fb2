"""Incremental intake: documents once, status logs, redelivered messages."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import cut_lineage
from ledgerlens.sources.files import BINARY_FILE_SCHEMA

BUCKET_ROWS = 1_000_000   # rows of a bucket, on average, beyond which a table gets more buckets
FIRST_BUCKETS = 8
GROWTH = 4
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_files(spark: SparkSession, path: str, glob: str = "*",
                 per_batch: int | None = None) -> DataFrame:
    """New files as rows, ``per_batch`` of them at most together; the checkpoint remembers
    which were taken. Content is read only if it is selected."""
    reader = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
              .option("pathGlobFilter", glob).option("recursiveFileLookup", True))
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.load(path)


def stream_table(spark: SparkSession, path: str, glob: str, per_batch: int | None = None) -> DataFrame:
    """Parquet files as they arrive; ``per_batch`` bounds the files of one batch.

    What ``glob`` names may be files, or folders that hold the parts of a table.
    """
    # in braces, a plain name is a pattern too: as a path, the stream takes only folders
    named = f"{path.rstrip('/')}/{{{glob}}}"
    reader = spark.readStream.schema(spark.read.parquet(named).schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(named)


def run_available(stream: DataFrame, each_batch: Callable[[DataFrame, int], None],
                  checkpoint: str) -> None:
    """Process what is there, then stop. A repeated batch must write the same rows."""
    (stream.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def overwrite_batch(path: str, transform: Callable[[DataFrame], DataFrame]) -> Callable:
    """Sink whose rows live in a folder per batch, so redelivery replaces them."""
    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
    return write


def current_status(log: DataFrame) -> DataFrame:
    """Newest log entry per document by attempt, time and id."""
    return (log.groupBy("document_id")
            .agg(F.max(F.struct("attempt_number", "created_at", "id", "status")).alias("top"))
            .select("document_id", "top.*"))


def buckets_of(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """Buckets of a table of so many rows: the first count, times ``GROWTH`` as often as needed."""
    buckets = FIRST_BUCKETS
    while rows > buckets * bucket_rows:
        buckets *= GROWTH
    return buckets


def stored_buckets(spark: SparkSession, path: str) -> int | None:
    """Bucket count of the layout in force; its row is written after all of its buckets."""
    try:
        return spark.read.schema("buckets int").parquet(f"{path}/layout").agg(
            F.max("buckets")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """The rows that ``merge_buckets`` keeps under ``path``."""
    return spark.read.parquet(f"{path}/of-{stored_buckets(spark, path)}").drop("bucket")


def merge_buckets(path: str, key: str, merge: Callable[[DataFrame], DataFrame],
                  bucket_rows: int = BUCKET_ROWS) -> Callable:
    """Batch sink that merges rows into a table of hash buckets of ``key``.

    ``merge`` gets the stored and the new rows of the touched buckets and must give the
    same rows when the new ones are there twice. Only touched buckets are read and
    written. When the table outgrows its buckets it is written once into ``GROWTH`` times
    as many, in a folder of their own, which readers see when its layout row is written.
    A batch that broke off is delivered again and merged again, so nothing has to be
    remembered between batches and runs.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = cut_lineage(batch)
        added = fresh.count()
        if not added:
            return
        bucket = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
        now = stored_buckets(spark, path)
        rows, size = fresh, added
        if now:
            stored = spark.read.parquet(f"{path}/of-{now}")
            size += stored.count()      # from the files' footers
        wanted = max(now or 0, buckets_of(size, bucket_rows))
        if now == wanted:
            touched = [r[0] for r in fresh.select(bucket(now)).distinct().collect()]
            stored = stored.where(F.col("bucket").isin(touched))
        if now:
            rows = stored.drop("bucket").unionByName(fresh)
        merged = merge(rows).withColumn("bucket", bucket(wanted))
        if now == wanted:
            # what is read must be kept before its folders are replaced
            merged = cut_lineage(merged)
        (merged.repartition(wanted, "bucket").write.mode("overwrite").partitionBy("bucket")
         .option("partitionOverwriteMode", "dynamic" if now == wanted else "static")
         .parquet(f"{path}/of-{wanted}"))
        if now != wanted:
            layout = spark.createDataFrame([(wanted,)], "buckets int")
            layout.coalesce(1).write.mode("append").parquet(f"{path}/layout")
    return write


def run_status(log: DataFrame, path: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Drains a status log stream and returns the current status per document."""
    run_available(log, merge_buckets(path, "document_id", current_status, bucket_rows),
                  f"{path}-progress")
    return read_merged(log.sparkSession, path)


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that start here keep their state in RocksDB, checkpointed with the stream."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def run_messages(messages: DataFrame, path: str, message_id: str) -> DataFrame:
    """Drains a message stream and returns each message once, however late it comes.

    The ids seen so far are the stream's keyed state, so a batch costs what it brings and
    nothing stored is written again. There is no watermark: no delay after which a message
    would be lost or taken twice. A batch that is delivered again replaces its folder.
    """
    spark = messages.sparkSession
    once = messages.dropDuplicates([message_id])
    with state_on_disk(spark):
        run_available(once, overwrite_batch(path, lambda rows: rows), f"{path}-progress")
    return spark.read.parquet(path).drop("batch")
