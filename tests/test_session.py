"""Cuts of wide rows."""

import os

from pyspark.sql import functions as F

from ledgerlens.session import stored


def test_stored_rows_are_the_same_and_smaller_than_in_memory_form(spark):
    df = spark.range(5000).select(
        "id", F.struct(F.lit("labeled_line").alias("m"), F.lit(None).cast("int").alias("n")).alias("s"),
        F.create_map(F.lit("k"), F.lit("Policy number matches the database.")).alias("e"))
    kept = stored(df, "wide")
    assert kept.count() == 5000 and kept.columns == df.columns
    plain = lambda d: sorted(map(str, d.collect()))
    assert plain(kept) == plain(df)
    folder = os.path.dirname(kept.inputFiles()[0].removeprefix("file:").lstrip("/"))
    size = sum(os.path.getsize(f"/{folder}/{f}") for f in os.listdir(f"/{folder}"))
    assert size < 5000 * 35     # the text alone, uncompressed
