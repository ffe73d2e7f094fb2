"""Joins and running totals that stay balanced when one key holds most rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOT_SHARE = 0.001
SALTS = 64


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """Keys that hold more than ``share`` of the rows.

    At most ``1/share`` keys can qualify, so the collected list is bounded by
    arithmetic. The count is combined map-side before its shuffle.
    """
    counts = df.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"))
    heavy = (counts.where(F.col("k").isNotNull()).orderBy(F.desc("n")).limit(int(1 / share))
             .collect())
    floor = df.count() * share
    return [row["k"] for row in heavy if row["n"] > floor]


def lookup_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                spread_by: list[str], how: str = "left", hot: list = (),
                salts: int = SALTS) -> DataFrame:
    """Join ``left`` to a ``right`` with one row per key.

    Rows without a key match nothing, so each goes where a hash of ``spread_by`` sends it
    (repeatable, so a retried task sends each row to the same place). Large keys are split
    at run time by adaptive skew joins, whatever the size of the input. Keys that the
    caller knows to be ``hot`` are spread over ``salts`` sub-keys, and only the matching
    right rows are repeated for them; so that also works without adaptive execution.
    Broadcasting is left to the size checks of the optimiser and of AQE.
    """
    key, spread = F.col(left_key), F.xxhash64(*spread_by)
    salt = F.when(key.isNull(), spread)
    if hot:
        salt = salt.when(key.isin(list(hot)), F.pmod(spread, F.lit(salts)))
        copies = F.when(F.col("__rk").isin(list(hot)), F.sequence(
            F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    salted = left.withColumn("__salt", salt.otherwise(0))
    right = right.withColumnRenamed(right_key, "__rk")
    if hot:
        right = right.withColumn("__rsalt", F.explode(F.coalesce(
            copies, F.array(F.lit(0).cast("long")))))
    else:
        # zero, but not a literal: as a literal it would stop being a join key
        right = right.withColumn("__rsalt", F.pmod(F.xxhash64("__rk"), F.lit(1)))
    joined = salted.join(right, (salted[left_key] == right["__rk"])
                         & (salted["__salt"] == right["__rsalt"]), how)
    return joined.drop("__salt", "__rk", "__rsalt")


def running_start(df: DataFrame, group: list[str], order: list[str], bucket: str,
                  value: str, out: str, width: int = 1024) -> DataFrame:
    """Sum of ``value`` over the rows of a group before this one.

    A group may be huge, so the total is built in two steps: inside slices of
    ``width`` consecutive ``bucket`` numbers, and over the slice totals, which
    are ``width`` times fewer.
    """
    sliced = df.withColumn("__slice", F.floor(F.col(bucket) / width))
    totals = sliced.groupBy(*group, "__slice").agg(F.sum(value).alias("__total"))
    over_slices = Window.partitionBy(*group).orderBy("__slice")
    bases = totals.select(
        *group, "__slice",
        F.coalesce(F.sum("__total").over(over_slices.rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*group, "__slice").orderBy(*order)
    local = sliced.withColumn("__local", F.coalesce(F.sum(value).over(
        inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (local.join(bases, [*group, "__slice"])
            .withColumn(out, (F.col("__base") + F.col("__local")).cast("long"))
            .drop("__slice", "__base", "__local"))


def largest_group(df: DataFrame, key: str) -> int:
    """Rows of the largest group: one light aggregate over a single column."""
    row = df.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()
    return row["n"] or 0


def blocks_for(rows: int, per_block: int) -> int:
    return max(1, math.ceil(rows / per_block))
