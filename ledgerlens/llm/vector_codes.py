"""Product codes of vectors: integer k-means per part, with a trie over the distinct parts.

Components become integers, floor(scale * x); a vector is cut into equal consecutive parts,
each of which gets the index of the nearest entry of its position's codebook. Training
works on the distinct parts of every position with the number of vectors that hold them:
tasks combine the copies they see, parts are then range-partitioned by (position, part) and
sorted, so that each task holds a stretch of the trie of parts in depth-first order.

The trie is walked by ``nearest``: a node's distances to all entries are its parent's plus
one squared difference, so parts with a common prefix share them; nodes over many leaves
are descended one by one, depth first, and a run of small subtrees is finished together
with arrays. Leaves take the first smallest distance and add their components, times their
weight, to that entry's sums. Only these sums (parts x entries x width numbers a task) are
shuffled in a round, so rounds cost one scan each, and the driver holds codebooks only.

Defined cases: vectors that are null, empty or hold null or non-finite components are left
out, and so are vectors of another width than the one with the smallest id; a width that
parts do not divide is filled up with zeros. Integers beyond +-2^27 count as that, so that
distances fit 64 bits. The first codebook takes the smallest ids, nulls last, equal ids by
their components; with fewer vectors than entries there are fewer entries. Ties go to the
lower index; repeated rows get equal codes and count as often as they occur; an empty table
gives an empty table. Input columns with the names of added ones are replaced, the vector
is left out, all others stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import without
from ledgerlens.session import scratch_path

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LIMIT = 1 << 27
BLOCK = 4096        # leaves whose subtrees are finished together
ADDED = ["code", "error", "label_error", "codebooks_sha256"]
SUMS = "position int, entry int, dim int, total long, n long"


def nearest(values: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of every row, by a walk of the trie.

    Rows in lexicographic order share the most; any order gives the same result.
    """
    rows, width = values.shape
    code, least = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    shared = np.zeros(rows, np.int64)    # components that a row has in common with the last
    if rows > 1:
        shared[1:] = np.cumprod(values[1:] == values[:-1], axis=1).sum(axis=1)

    def children(lo: int, hi: int, level: int) -> np.ndarray:
        return np.append(lo, lo + 1 + np.flatnonzero(shared[lo + 1:hi] <= level))

    def step(parent: np.ndarray, heads: np.ndarray, level: int) -> np.ndarray:
        apart = values[heads, level][:, None] - entries[:, level]
        return parent + apart * apart

    def finish(lo: int, hi: int, level: int, reached: np.ndarray) -> None:
        heads, reached = np.array([lo]), reached[None]
        for at in range(level, width):
            below = children(lo, hi, at)
            owner = np.searchsorted(heads, below, "right") - 1
            heads, reached = below, step(reached[owner], below, at)
        best = reached.argmin(axis=1)
        sizes = np.diff(np.append(heads, hi))
        code[lo:hi] = np.repeat(best, sizes)
        least[lo:hi] = np.repeat(reached[np.arange(len(best)), best], sizes)

    # nodes still to visit: leaves lo..hi, components on the path, distances so far
    open_nodes = [(0, rows, 0, np.zeros(len(entries), np.int64))] if rows else []
    while open_nodes:
        lo, hi, level, reached = open_nodes.pop()
        if hi - lo <= BLOCK or level == width:
            finish(lo, hi, level, reached)
            continue
        edges = np.append(children(lo, hi, level), hi)
        below = step(reached, edges[:-1], level)
        large = np.flatnonzero(np.diff(edges) > BLOCK)
        for i in large[::-1]:
            open_nodes.append((edges[i], edges[i + 1], level + 1, below[i]))
        # the children between large ones, as many together as a block takes
        for i, j in zip([0, *(large + 1)], [*large, len(edges) - 1]):
            while i < j:
                k = max(int(np.searchsorted(edges, edges[i] + BLOCK, "right")) - 1, i + 1)
                finish(edges[i], edges[min(k, j)], level, reached)
                i = min(k, j)
    return code, least


def pack(part: np.ndarray) -> np.ndarray:
    """Rows of integers as byte strings that sort as the rows do."""
    raw = np.ascontiguousarray((part + (1 << 31)).astype(">u4"))
    return raw.view(f"V{4 * part.shape[1]}").ravel()


def unpack(packed: np.ndarray | bytes, width: int) -> np.ndarray:
    return np.frombuffer(packed, ">u4").reshape(-1, width).astype(np.int64) - (1 << 31)


def matrix(column: pa.ListArray, width: int, parts: int) -> np.ndarray:
    """Integer vectors as rows, cut to (rows, parts, width of a part)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    rows = flat.reshape(-1, width)
    missing = -width % parts
    if missing:
        rows = np.hstack([rows, np.zeros((len(rows), missing), np.int64)])
    return rows.reshape(len(rows), parts, -1)


def distinct_parts(vectors: DataFrame, width: int, parts: int) -> DataFrame:
    """(position, part, weight), copies within an Arrow batch combined."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cut = matrix(batch.column(0), width, parts)
            for position in range(parts):
                found, weight = np.unique(pack(cut[:, position]), return_counts=True)
                size = found.dtype.itemsize
                column = pa.Array.from_buffers(
                    pa.binary(size), len(found), [None, pa.py_buffer(found.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), position, np.int32)),
                     column.cast(pa.binary()), pa.array(weight.astype(np.int64))],
                    names=["position", "part", "weight"])

    return vectors.select("ints").mapInArrow(run, "position int, part binary, weight long")


def entry_sums(table: DataFrame, books: np.ndarray) -> DataFrame:
    """Sums and numbers of the parts that are nearest to every entry."""
    parts, k, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, k, width), np.int64)
        number = np.zeros((parts, k), np.int64)
        for batch in batches:
            where = batch.column(0).to_numpy()
            values = unpack(b"".join(batch.column(1).to_pylist()), width)
            weight = batch.column(2).to_numpy()
            for position in np.unique(where):
                mine = where == position
                code, _ = nearest(values[mine], books[position])
                np.add.at(total[position], code, values[mine] * weight[mine][:, None])
                np.add.at(number[position], code, weight[mine])
        position, entry, dim = np.nonzero(np.broadcast_to(number[:, :, None] > 0, total.shape))
        yield pa.RecordBatch.from_arrays(
            [pa.array(position.astype(np.int32)), pa.array(entry.astype(np.int32)),
             pa.array(dim.astype(np.int32)), pa.array(total[position, entry, dim]),
             pa.array(number[position, entry])], names=["position", "entry", "dim", "total", "n"])

    return table.mapInArrow(run, SUMS).groupBy("position", "entry", "dim").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n"))


def train_books(vectors: DataFrame, first: np.ndarray, width: int, rounds: int) -> np.ndarray:
    """Codebooks (parts, entries, width) after ``rounds`` rounds over all distinct parts."""
    spark = vectors.sparkSession
    path = scratch_path(spark, "vector-parts")
    (distinct_parts(vectors, width, first.shape[0]).repartitionByRange("position", "part")
     .sortWithinPartitions("position", "part").write.parquet(path))
    table, books = spark.read.parquet(path), first.copy()
    for _ in range(rounds):
        for r in entry_sums(table, books).collect():     # one row a codebook number
            books[r["position"], r["entry"], r["dim"]] = r["total"] // r["n"]
    return books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """``row``, code and error of every vector; each batch walks the trie of its own parts."""
    parts = books.shape[0]
    schema = T.StructType([vectors.schema["row"], *T.StructType.fromDDL(
        "code string, error long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = matrix(batch.column(1), width, parts)
            codes, error = np.zeros((len(cut), parts), np.uint8), np.zeros(len(cut), np.int64)
            for position in range(parts):
                found, back = np.unique(pack(cut[:, position]), return_inverse=True)
                code, least = nearest(unpack(found.tobytes(), cut.shape[2]), books[position])
                codes[:, position] = code[back]
                error += least[back]
            text = codes.tobytes().hex()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0),
                 pa.array([text[i:i + 2 * parts] for i in range(0, len(text), 2 * parts)],
                          pa.string()), pa.array(error)], names=["row", "code", "error"])

    return vectors.select("row", "ints").mapInArrow(run, schema)


def compress_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
                     label: str = "label", parts: int = PARTS, entries: int = ENTRIES,
                     rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """``df`` without its vectors, with code, error, label_error and codebooks_sha256."""
    spark = df.sparkSession
    rest = [c for c in without(df, ADDED).columns if c != embedding]
    vector = F.col(f"`{embedding}`").cast("array<double>")
    usable = F.coalesce(F.size(vector) > 0, F.lit(False)) & F.coalesce(F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    ints = F.transform(vector, lambda x: F.greatest(F.lit(-LIMIT), F.least(
        F.lit(LIMIT), F.floor(x * scale))).cast("int"))
    kept = df.where(usable).select(
        F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), ints.alias("ints"),
        F.col(f"`{vec_id}`").alias("id"), F.size(vector).alias("width"))
    order = [F.col("id").asc_nulls_last(), "ints"]
    smallest = kept.orderBy(*order).first()
    if smallest is None:
        books, width = np.zeros((parts, 0, 0), np.int64), 0
        coded = kept.select("row", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        width = smallest["width"]
        kept = kept.where(F.col("width") == width)
        start = kept.orderBy(*order).limit(entries).select("ints").collect()
        first = matrix(pa.array([r["ints"] for r in start], pa.list_(pa.int32())), width, parts)
        books = train_books(kept, first.transpose(1, 0, 2), width, rounds)
        path = scratch_path(spark, "vector-codes")
        encode(kept, books, width).write.parquet(path)
        coded = spark.read.parquet(path)
    # one row a label; Spark broadcasts it if it is small and splits large labels if not
    mine = F.col("row")[label]
    totals = coded.groupBy(mine.alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(totals, mine.eqNullSafe(F.col("of")), "left").select(
        *[F.col("row")[c].alias(c) for c in rest], "code", "error", "label_error",
        F.lit(books_digest(books)).alias("codebooks_sha256"))
