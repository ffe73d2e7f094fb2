"""Exact cosine search for many questions at once.

Every partition of chunks is scored against a block of questions with one
matrix product and keeps only its best ``k`` rows per question, so pairs are
never materialised. A question block that fits its bound travels with the task;
a larger question table is cut into blocks that meet slices of the chunk table
on a grid, each cell of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.text import collapse
from ledgerlens.functions.vectors import similarity, vector_error
from ledgerlens.operators.skew import blocks_for, lookup_join

DEFAULT_K = 8
MAX_K = 25
MAX_DOCUMENT_IDS = 100
QUESTION_BLOCK = 8192
CHUNK_SLICE = 200_000
SCORE_ROWS = 1024
SCORE_PAIRS = 65_536      # pairs that are scored again together
# question blocks of one cell of the grid: every one more spares a copy of the chunks
CELL_BLOCKS = 8

HIT_FIELDS = "question_id long, chunk_id string, document_id long, chunk_index long, " \
             "cosine_distance double"


def query_error(c: Column) -> Column:
    """Null for a question of 2 to 4000 characters after normalisation."""
    size = F.length(collapse(F.coalesce(c, F.lit(""))))
    return F.when(size < 2, F.lit("too_short")).when(size > 4000, F.lit("too_long"))


def check_search(k: int | None, minimum_similarity: float) -> int:
    k = DEFAULT_K if k is None else k
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be between 1 and {MAX_K}")
    if not -1 <= minimum_similarity <= 1:
        raise ValueError("minimum_similarity must be between -1 and 1")
    return k


def distinct_ids(ids: list | None) -> list:
    """Document ids in first-seen order, at most a hundred."""
    unique = list(dict.fromkeys(ids or []))
    if len(unique) > MAX_DOCUMENT_IDS:
        raise ValueError(f"at most {MAX_DOCUMENT_IDS} document ids may be searched at once")
    return unique


def latest_completed(runs: DataFrame) -> DataFrame:
    """Newest completed attempt per document: attempt, creation time and id descending.

    An aggregate, so a document with very many attempts is reduced map-side.
    """
    return (runs.where(F.col("status") == "completed").groupBy("document_id")
            .agg(F.max(F.struct("attempt_number", "created_at", "id")).alias("top"))
            .select("document_id", F.col("top.id").alias("processing_run_id"),
                    F.col("top.attempt_number").alias("attempt_number"),
                    F.col("top.created_at").alias("created_at")))


def active_runs(runs: DataFrame) -> DataFrame:
    """Newest queued or running attempt per document."""
    return (runs.where(F.col("status").isin("queued", "running")).groupBy("document_id")
            .agg(F.max(F.struct("created_at", "id", "status")).alias("top"))
            .select("document_id", F.col("top.id").alias("processing_run_id"),
                    F.col("top.status").alias("status"),
                    F.col("top.created_at").alias("created_at")))


def searchable(chunks: DataFrame, runs: DataFrame, documents: DataFrame | None = None,
               workspace: str | None = None, document_ids: list | None = None) -> DataFrame:
    """Ready chunks of each document's latest completed run, one tenant throughout."""
    wanted = distinct_ids(document_ids)
    if workspace is not None:
        chunks = chunks.where(F.col("workspace_id") == workspace)
        runs = runs.where(F.col("workspace_id") == workspace)
    chunks = chunks.where((F.col("status") == "ready") & F.col("embedding").isNotNull())
    if wanted:
        chunks = chunks.where(F.col("document_id").isin(wanted))
    newest = latest_completed(runs).select(F.col("processing_run_id").alias("newest_run"))
    kept = lookup_join(chunks, newest, "processing_run_id", "newest_run", ["chunk_id"],
                       "left_semi")
    if documents is not None:
        if workspace is not None:
            documents = documents.where(F.col("workspace_id") == workspace)
        kept = kept.join(documents.select("document_id"), "document_id", "left_semi")
    return kept


def _unit(matrix: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(matrix, axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(size > 0, matrix / size, np.nan)


class _Best:
    """The best ``k`` rows per question seen so far, ties by document and index.

    All pairs are scored in single precision; those that may be among the best, by the
    bound of its rounding error, are scored again in double precision, which decides.
    """

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int, limit: float):
        self.ids, self.questions, self.k, self.limit = ids, _unit(matrix), k, limit
        self.rows: list[list[tuple]] = [[] for _ in ids]
        self.worst = np.full(len(ids), np.inf)
        self.single = self.questions.astype(np.float32)
        self.slack = (matrix.shape[1] + 8) * 2.0 ** -23

    def add(self, matrix: np.ndarray, chunk_ids, documents, indexes) -> None:
        unit = _unit(matrix)
        directed = np.flatnonzero(~np.isnan(unit).any(axis=1))
        single = unit[directed].astype(np.float32)
        for begin in range(0, len(self.ids), QUESTION_BLOCK):
            part = slice(begin, begin + QUESTION_BLOCK)
            asking, at = self.candidates(part, single)
            if len(asking):
                self.merge(asking + begin, directed[at], unit, chunk_ids, documents, indexes)

    def candidates(self, part: slice, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of question and row that may be among the best, by question."""
        near = self.single[part] @ single.T
        floor = 1.0 - np.minimum(self.worst[part], self.limit) - self.slack
        without = np.flatnonzero(np.isinf(self.worst[part]))
        last = len(single) - self.k
        if last > 0 and len(without):
            edge = np.partition(near[without], last, axis=1)[:, last]
            floor[without] = np.fmax(floor[without], edge - 2 * self.slack)
        return np.nonzero(near >= floor.astype(np.float32)[:, None])

    def merge(self, asking: np.ndarray, at: np.ndarray, unit: np.ndarray, chunk_ids, documents,
              indexes) -> None:
        distance = np.empty(len(asking))
        for i in range(0, len(asking), SCORE_PAIRS):
            own = slice(i, i + SCORE_PAIRS)
            distance[own] = 1.0 - np.einsum("ij,ij->i", self.questions[asking[own]],
                                            unit[at[own]])
        starts = np.flatnonzero(np.diff(asking, prepend=-1))
        for begin, end in zip(starts, [*starts[1:], len(asking)]):
            q, far, rows = asking[begin], distance[begin:end], at[begin:end]
            limit = min(self.worst[q], self.limit)
            if len(far) > self.k:
                limit = min(limit, np.partition(far, self.k - 1)[self.k - 1])
            fresh = [(float(x), documents[i], indexes[i], chunk_ids[i])
                     for x, i in zip(far, rows) if x <= limit]
            if not fresh:
                continue
            best = sorted(self.rows[q] + fresh)[:self.k]
            self.rows[q] = best
            if len(best) == self.k:
                self.worst[q] = best[-1][0]

    def table(self) -> pd.DataFrame:
        flat = [(int(self.ids[q]), c, d, i, x) for q, rows in enumerate(self.rows)
                for x, d, i, c in rows]
        return pd.DataFrame(flat, columns=["question_id", "chunk_id", "document_id",
                                           "chunk_index", "cosine_distance"])


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _with_bounded_questions(chunks: DataFrame, ids: np.ndarray, matrix: np.ndarray, width: int,
                            k: int, limit: float) -> DataFrame:
    shared = chunks.sparkSession.sparkContext.broadcast((ids, matrix))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(*shared.value, k, limit)
        for rows in batches:
            for begin in range(0, rows.num_rows, SCORE_ROWS):
                part = rows.slice(begin, SCORE_ROWS)
                best.add(_matrix(part.column(3), width), part.column(0).to_pylist(),
                         part.column(1).to_pylist(), part.column(2).to_pylist())
        yield pa.RecordBatch.from_pandas(best.table(), preserve_index=False, schema=HIT_ARROW)

    return chunks.mapInArrow(score, HIT_FIELDS)


HIT_ARROW = pa.schema([("question_id", pa.int64()), ("chunk_id", pa.string()),
                       ("document_id", pa.int64()), ("chunk_index", pa.int64()),
                       ("cosine_distance", pa.float64())])


def _on_grid(questions: DataFrame, chunks: DataFrame, width: int, k: int, limit: float,
             question_rows: int, block: int, slice_rows: int) -> DataFrame:
    """Question blocks against chunk slices; no cell exceeds ``CELL_BLOCKS`` blocks and a slice."""
    rows = blocks_for(question_rows, block * CELL_BLOCKS)
    # two cells a core at least; a slice more only copies questions once more
    columns = max(blocks_for(chunks.count(), slice_rows), blocks_for(
        2 * chunks.sparkSession.sparkContext.defaultParallelism, rows))
    spread = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = (questions.withColumn("r", spread("question_id", rows))
            .withColumn("c", every(columns)).groupBy("r", "c"))
    right = (chunks.withColumn("c", spread("chunk_id", columns))
             .withColumn("r", every(rows)).groupBy("r", "c"))

    def score(q: pa.Table, c: pa.Table) -> pa.Table:
        best = _Best(q["question_id"].to_numpy(), _matrix(q["vector"].combine_chunks(), width),
                     k, limit)
        for begin in range(0, len(c) if len(q) else 0, SCORE_ROWS):
            part = c.slice(begin, SCORE_ROWS)
            best.add(_matrix(part["embedding"].combine_chunks(), width),
                     part["chunk_id"].to_pylist(), part["document_id"].to_pylist(),
                     part["chunk_index"].to_pylist())
        return pa.Table.from_pandas(best.table(), preserve_index=False, schema=HIT_ARROW)

    return left.cogroup(right).applyInArrow(score, HIT_FIELDS)


def nearest(questions: DataFrame, chunks: DataFrame, width: int, k: int | None = None,
            minimum_similarity: float = 0.0, block: int = QUESTION_BLOCK,
            slice_rows: int = CHUNK_SLICE) -> DataFrame:
    """Top ``k`` chunks per question: distance, then document, then chunk index.

    ``questions`` has ``question_id`` and ``vector``; ``chunks`` has ``chunk_id``,
    ``document_id``, ``chunk_index`` and ``embedding``. Vectors of the wrong width,
    with a non-finite part or without direction take no part.
    """
    k = check_search(k, minimum_similarity)
    limit = 1.0 - minimum_similarity
    good = lambda c: vector_error(F.col(c), width).isNull()
    asked = questions.where(good("vector")).select(
        F.col("question_id").cast("long").alias("question_id"), "vector")
    scored = chunks.where(good("embedding")).select(
        F.col("chunk_id").cast("string").alias("chunk_id"),
        F.col("document_id").cast("long").alias("document_id"),
        F.col("chunk_index").cast("long").alias("chunk_index"), "embedding")
    sample = asked.limit(block + 1).toPandas()
    if len(sample) <= block:
        matrix = (np.stack(sample["vector"]).astype(np.float64) if len(sample)
                  else np.zeros((0, width)))
        partial = _with_bounded_questions(scored, sample["question_id"].to_numpy(), matrix,
                                          width, k, limit)
    else:
        partial = _on_grid(asked, scored, width, k, limit, asked.count(), block, slice_rows)
    best_first = Window.partitionBy("question_id").orderBy(
        "cosine_distance", "document_id", "chunk_index")
    return (partial.withColumn("rank", F.row_number().over(best_first))
            .where(F.col("rank") <= k)
            .withColumn("similarity_score", similarity(F.col("cosine_distance"))))


def hit_rows(hits: DataFrame, chunks: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Hits with text and provenance; the wide columns are read after the top k."""
    wide = [c for c in chunks.columns if c not in
            ("embedding", "document_id", "chunk_index", "status")]
    full = hits.join(chunks.select(*wide), "chunk_id")
    if documents is not None:
        full = full.join(documents.select("document_id", "document_name"), "document_id", "left")
    return full.withColumn("cosine_distance", F.round("cosine_distance", 6))
