"""Filtered listings, paging, tenant look-ups and counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PAGE = 100


def filtered(df: DataFrame, **wanted) -> DataFrame:
    """Rows equal to every given value; a value of None does not restrict."""
    tests = [F.col(name) == value for name, value in wanted.items() if value is not None]
    return df.where(reduce(Column.__and__, tests)) if tests else df


def page_of(df: DataFrame, offset: int, limit: int, created: str = "created_at",
            id_column: str = "id") -> DataFrame:
    """One page of a listing, newest first."""
    if offset < 0 or not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"offset must not be negative, limit 1 to {MAX_PAGE}")
    return df.orderBy(F.desc(created), F.desc(id_column)).offset(offset).limit(limit)


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def found(df: DataFrame, wanted: DataFrame, workspace: str, id_column: str = "id") -> DataFrame:
    """Rows of the tenant among the wanted ids."""
    return df.where(F.col("workspace_id") == workspace).join(
        wanted.select(id_column).distinct(), id_column, "left_semi")


def not_found(df: DataFrame, wanted: DataFrame, workspace: str, id_column: str = "id") -> DataFrame:
    """Wanted ids the tenant does not have."""
    mine = df.where(F.col("workspace_id") == workspace).select(id_column)
    return wanted.select(id_column).distinct().join(mine, id_column, "left_anti")


def next_attempt(runs: DataFrame, documents: DataFrame) -> DataFrame:
    """Attempt number the next processing of each document gets."""
    last = runs.groupBy("document_id").agg(F.max("attempt_number").alias("last"))
    return documents.select("document_id").join(last, "document_id", "left").select(
        "document_id", (F.coalesce("last", F.lit(0)) + 1).alias("next_attempt"))


def selected_pages(pages: DataFrame, latest: DataFrame,
                   given: DataFrame | None = None) -> DataFrame:
    """Pages of the given run of a document, else of its latest completed run."""
    chosen = latest.select("document_id", F.col("processing_run_id").alias("run"))
    if given is not None:
        asked = given.select("document_id", F.col("processing_run_id").alias("asked"))
        chosen = chosen.join(asked, "document_id", "full").select(
            "document_id", F.coalesce("asked", "run").alias("run"))
    return pages.join(chosen.select(F.col("run").alias("processing_run_id")),
                      "processing_run_id", "left_semi")


def record_counts(tables: dict[str, DataFrame], workspace: str | None = None) -> DataFrame:
    """Rows per table; each count is its own aggregate."""
    counts = []
    for name, df in tables.items():
        rows = df if workspace is None else df.where(F.col("workspace_id") == workspace)
        counts.append(rows.agg(F.count("*").alias("records"))
                      .select(F.lit(name).alias("table_name"), "records"))
    return reduce(DataFrame.unionAll, counts)


def processing_outcome(documents: DataFrame, totals: DataFrame, errors: DataFrame) -> DataFrame:
    """Status after processing: an error fails run and document, else both complete."""
    rows = (documents.select("document_id").join(totals, "document_id", "left")
            .join(errors, "document_id", "left"))
    failed = F.col("error").isNotNull() | F.col("total_pages").isNull()
    message = F.coalesce("error", F.lit("DocumentTextUnavailable"))
    return rows.select(
        "document_id",
        F.when(failed, "failed").otherwise("completed").alias("run_status"),
        F.when(failed, "failed").otherwise("processed").alias("document_status"),
        F.when(~failed, F.col("total_pages")).alias("page_count"),
        F.when(failed, F.substring(message, 1, 4000)).alias("error_message"),
        F.when(~failed, F.to_json(F.struct("total_pages", "total_characters", "total_words")))
        .alias("latest_extraction"))


def screen_counters(documents: DataFrame, tasks: DataFrame) -> DataFrame:
    """Counters of the overview screens, one row."""
    docs = documents.agg(
        F.count("*").alias("documents"), F.count_if(F.col("status") == "processed").alias("processed"),
        F.count_if(F.col("status").isin("queued", "running")).alias("busy"),
        F.count_if(F.col("status") == "failed").alias("failed"))
    work = tasks.agg(F.count_if(F.col("status").isin("open", "in_progress")).alias("open_tasks"))
    key = F.lit(1)
    return docs.withColumn("k", key).join(work.withColumn("k", key), "k").drop("k")


def duration_seconds(started: Column, completed: Column) -> Column:
    return (F.unix_micros(completed) - F.unix_micros(started)) / 1_000_000
