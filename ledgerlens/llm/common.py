"""Helpers that the operators of this folder share."""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Rows of an Arrow batch that are turned into Python objects together.
SLICE_ROWS = 256

# one byte table: A-Z become lower case, ASCII letters, digits and all bytes from 128 stay,
# every other byte becomes a space
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256))
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


# Characters that may belong to a run of white space, under any reading of it.
BLANK = frozenset(chr(c) for c in range(0x10000) if chr(c).isspace()) | set(
    "\u180e\u200b\u2060\ufeff\u2581")


def lower_ascii(text: str) -> str:
    """Lower case of A-Z only; lengths and positions stay."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).decode(
        "utf-8", "surrogatepass")


def words_of(text: str) -> list[bytes]:
    """Runs of ASCII letters, digits and characters from U+0080, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without the columns that an operator is about to add (names in any case)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def give_back() -> None:
    """Hands freed memory back to the system at a task's end, as workers live on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def annotate(df: DataFrame, text: str, added: str,
             make: Callable[[], Callable[[list[str]], list[tuple]]],
             keep: Callable[[tuple], bool] | None = None) -> DataFrame:
    """``df`` with the columns ``added`` (DDL), computed from each row's text in Arrow batches.

    ``make`` runs once in every task and returns the function from texts to one tuple a
    text; null text counts as empty. Input columns whose names are added again are
    replaced. ``keep`` drops rows by their tuple. Rows stay where they are: no shuffle.
    """
    fields = T.StructType.fromDDL(added)
    base = without(df, fields.names)
    schema = T.StructType(base.schema.fields + fields.fields)
    arrow = to_arrow_schema(fields)
    at = base.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for part in slices(batches):
            found = work([x or "" for x in part.column(at).to_pylist()])
            if keep is not None:
                chosen = [i for i, row in enumerate(found) if keep(row)]
                part = part.take(pa.array(chosen, pa.int64()))
                found = [found[i] for i in chosen]
            columns = list(zip(*found)) if found else [()] * len(arrow)
            new = [pa.array(c, f.type) for c, f in zip(columns, arrow)]
            yield pa.RecordBatch.from_arrays(part.columns + new, names=schema.names)
        del work
        give_back()

    return base.mapInArrow(run, schema)
