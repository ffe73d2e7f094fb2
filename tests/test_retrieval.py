import random
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.functions import answers as a
from ledgerlens.operators import chunk, search
from ledgerlens.operators.embed import EmbeddingSpec, embed_column
from ledgerlens.plans.retrieval import answer_questions, index_pages, index_summary

# the test module is not on the workers' path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARKS = ["\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " "]


def slow_spans(text, size, overlap):
    """Every mark tried on its own, as the rule is written."""
    out, start = [], 0
    while start < len(text):
        hard = min(len(text), start + size)
        end = hard
        if hard < len(text):
            low = min(hard, start + max(1, int(size * 0.6)))
            ends = [text[low:hard].rfind(m) + low + len(m) for m in MARKS if m in text[low:hard]]
            end = max(ends) if ends else hard
        if text[start:end].strip():
            body = text[start:end]
            out.append((start + len(body) - len(body.lstrip()),
                        end - (len(body) - len(body.rstrip()))))
        if end >= len(text):
            break
        nxt = max(start + 1, end - overlap)
        if text[nxt - 1].isalnum() and text[nxt].isalnum():
            blanks = [i for i in range(start + 1, nxt + 1) if text[i] == " "]
            nxt = blanks[-1] + 1 if blanks else nxt
        while nxt < len(text) and text[nxt].isspace():
            nxt += 1
        start = nxt
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1é.,;?! \n", max_size=200), st.integers(2, 40), st.integers(0, 20))
def test_spans_follow_the_rule(raw, size, overlap):
    text = "\n".join(" ".join(line.split()) for line in raw.split("\n") if line.strip())
    overlap = min(overlap, size - 1)
    assert chunk.spans(text, size, overlap) == slow_spans(text, size, overlap)


def some_pages(spark, runs=3, count=7):
    rnd = random.Random(5)
    rows = []
    for run in range(runs):
        for n in range(1, count + 1):
            text = " ".join(rnd.choice(["alpha", "beta.", "gamma", "delta,"]) for _ in range(60 * (n % 4)))
            rows.append(("w", run, run, run * 100 + n, n, text, "completed", "native_text", "en", 1.0,
                         len(text)))
    return spark.createDataFrame(
        rows, "workspace_id string, document_id long, processing_run_id long, page_id long, "
              "page_number int, text_content string, status string, extraction_method string, "
              "language_code string, confidence_score double, character_count long")


def test_numbering_paths_agree(spark):
    pages = some_pages(spark)
    window = chunk.chunk_pages(pages, 100, 20)
    sliced = chunk.chunk_pages(pages, 100, 20, pages_per_run=10**9)
    keys = ["processing_run_id", "page_id", "chunk_index", "content_sha256"]
    assert window.select(keys).exceptAll(sliced.select(keys)).count() == 0
    spread = window.groupBy("processing_run_id").agg(
        F.count("*").alias("n"), F.max("chunk_index").alias("m"), F.countDistinct("chunk_index").alias("d"))
    assert all(r["n"] == r["m"] + 1 == r["d"] for r in spread.collect())


@pytest.mark.parametrize("size, overlap", [(0, 0), (10, 10), (10, -1)])
def test_bad_sizes(size, overlap):
    with pytest.raises(ValueError):
        chunk.check_sizes(size, overlap)


class Odd:
    """A model that misbehaves on request."""

    def __init__(self, width):
        self.width = width

    def embed(self, texts):
        for t in texts:
            yield ([1.0] * (self.width - 1) if "short" in t else
                   [float("nan")] * self.width if "nan" in t else [1.0] * self.width)


def test_embedding_errors(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "short"), (3, "nan"), (4, "  "), (5, None)],
                               "i int, t string")
    got = {r["i"]: r["embedding_error"]
           for r in embed_column(df, "t", EmbeddingSpec(Odd, width=4)).collect()}
    assert got == {1: None, 2: "dimension", 3: "non_finite", 4: "empty_text", 5: "empty_text"}


def brute(questions, chunks, k, floor):
    out = set()
    for qid, q in questions:
        scored = sorted((1 - float(q @ c / np.linalg.norm(q) / np.linalg.norm(c)), doc, idx)
                        for _, doc, idx, c in chunks if np.linalg.norm(c) > 0)
        out |= {(qid, r + 1, idx) for r, (d, _, idx) in enumerate(
            [s for s in scored if s[0] <= 1 - floor][:k])}
    return out


@pytest.mark.parametrize("block", [1000, 3])
def test_search_equals_brute_force(spark, block):
    rnd = np.random.default_rng(3)
    questions = [(i, rnd.normal(size=8)) for i in range(10)]
    chunks = [(str(i), i % 5, i, rnd.normal(size=8) if i % 50 else np.zeros(8)) for i in range(300)]
    q = spark.createDataFrame([(i, v.tolist()) for i, v in questions], "question_id long, vector array<double>")
    c = spark.createDataFrame([(a_, d, i, v.tolist()) for a_, d, i, v in chunks],
                              "chunk_id string, document_id long, chunk_index long, embedding array<double>")
    hits = search.nearest(q, c.repartition(5), 8, 6, 0.1, block=block, slice_rows=40)
    got = {(r["question_id"], r["rank"], r["chunk_index"]) for r in hits.collect()}
    assert got == brute(questions, chunks, 6, 0.1)


def test_best_pairs_are_decided_in_double_precision():
    """Near ties that single precision cannot tell apart, copies, and rows without direction."""
    rnd = np.random.default_rng(11)
    asked = rnd.normal(size=(search.QUESTION_BLOCK + 40, 6))
    asked[7] = 0
    rows = np.vstack([asked[3] + rnd.normal(size=(300, 6)) * 1e-7, rnd.normal(size=(500, 6)),
                      np.zeros((2, 6))])
    rows[400:420] = rows[399]
    best = search._Best(np.arange(len(asked)), asked, 5, 1.0)
    for at in range(0, len(rows), 130):
        n = len(rows[at:at + 130])
        best.add(rows[at:at + 130], [str(i) for i in range(at, at + n)],
                 [i % 3 for i in range(at, at + n)], list(range(at, at + n)))
    assert best.rows[7] == []
    unit = rows[:-2] / np.linalg.norm(rows[:-2], axis=1, keepdims=True)
    for q in (0, 3, 50, search.QUESTION_BLOCK + 39):
        own = asked[q] / np.linalg.norm(asked[q])
        far = 1.0 - np.einsum("ij,ij->i", np.tile(own, (len(unit), 1)), unit)
        want = sorted((x, i % 3, i, str(i)) for i, x in enumerate(far.tolist()) if x <= 1)[:5]
        assert best.rows[q] == want


def test_a_grid_of_several_question_blocks_and_slices(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    questions = [(i, rnd.normal(size=4)) for i in range(60)]
    chunks = [(str(i), i % 5, i, rnd.normal(size=4)) for i in range(200)]
    q = spark.createDataFrame([(i, v.tolist()) for i, v in questions], "question_id long, vector array<float>")
    c = spark.createDataFrame([(a_, d, i, v.tolist()) for a_, d, i, v in chunks],
                              "chunk_id string, document_id long, chunk_index long, embedding array<float>")
    cells = []
    monkeypatch.setattr(search, "blocks_for", lambda n, size: cells.append(-(-n // size)) or cells[-1])
    hits = search.nearest(q, c, 4, 6, 0.1, block=3, slice_rows=60)
    got = {(r["question_id"], r["rank"], r["chunk_index"]) for r in hits.collect()}
    single = lambda v: v.astype(np.float32).astype(np.float64)
    assert got == brute([(i, single(v)) for i, v in questions],
                        [(a_, d, i, single(v)) for a_, d, i, v in chunks], 6, 0.1)
    # 60 questions are three cells high, not twenty: chunks are copied three times
    assert cells[:2] == [3, 4] and cells[2] == -(-2 * spark.sparkContext.defaultParallelism // 3)


def test_search_limits():
    for k, s in ((0, 0), (26, 0), (5, 1.5)):
        with pytest.raises(ValueError):
            search.check_search(k, s)
    assert search.distinct_ids([3, 1, 3]) == [3, 1]
    with pytest.raises(ValueError):
        search.distinct_ids(list(range(101)))


def test_only_latest_run_is_searchable(spark):
    chunks = spark.createDataFrame(
        [("a", "w", 1, 10, "ready"), ("b", "w", 1, 11, "ready"), ("c", "x", 2, 12, "ready"),
         ("d", "w", 3, 13, "failed")],
        "chunk_id string, workspace_id string, document_id long, processing_run_id long, status string"
    ).withColumn("embedding", F.array(F.lit(1.0)))
    runs = spark.createDataFrame(
        [(10, "w", 1, 1, "completed"), (11, "w", 1, 2, "completed"), (14, "w", 1, 3, "failed"),
         (12, "x", 2, 1, "completed"), (13, "w", 3, 1, "completed")],
        "id long, workspace_id string, document_id long, attempt_number int, status string"
    ).withColumn("created_at", F.current_timestamp())
    got = search.searchable(chunks, runs, workspace="w").select("chunk_id").collect()
    assert [r["chunk_id"] for r in got] == ["b"]


def test_answers(spark):
    spec = EmbeddingSpec(width=4096)
    pages = some_pages(spark, 1, 1).withColumn("text_content", F.lit(
        "The harbour opens at nine. Boats leave daily!\nCustomer: Ann Lee Policy Number: PN-77"))
    chunks = index_pages(pages, spec)
    questions = spark.createDataFrame([(1, "When does the  harbour open?"), (2, "policy number"), (3, "x"),
                                       (4, "zzz qqq")], "question_id long, question string")
    got = {r["question_id"]: r for r in answer_questions(
        questions, chunks, spec, minimum_similarity=0.05).collect()}
    assert set(got) == {1, 2, 4}
    run = chunks.select(F.col("processing_run_id").alias("id"), "document_id", "workspace_id").distinct() \
        .withColumns({"attempt_number": F.lit(1), "created_at": F.current_timestamp()})
    for status, grounded in (("completed", {1: True, 2: True, 4: False}), ("failed", dict.fromkeys((1, 2, 4), False))):
        scoped = answer_questions(questions, chunks, spec, minimum_similarity=0.05,
                                  runs=run.withColumn("status", F.lit(status))).collect()
        assert {r["question_id"]: r["is_grounded"] for r in scoped} == grounded
    assert got[1]["answer"] == "The harbour opens at nine. [1]"
    assert got[2]["answer"] == "The policy number is PN-77. [1]"
    assert got[2]["citations"][0]["excerpt"] == "Customer: Ann Lee; Policy Number: PN-77"
    assert got[4]["answer"] == a.NO_ANSWER and not got[4]["is_grounded"]
    summary = index_summary(pages, chunks).first()
    assert (summary["source_page_count"], summary["chunk_count"], summary["embedded_chunk_count"]) == (1, 1, 1)


def test_excerpt_and_sentences(one):
    long = "word " * 200
    cut = one([long], a.excerpt)[0]
    assert len(cut) <= 601 and cut.endswith("word…")
    assert one(["One. Two?\nThree  x"], a.sentences) == [["One.", "Two?", "Three x"]]
    assert sorted(one(["The Cat-1 is a cat_2 z"], a.tokens)[0]) == ["cat-1", "cat_2"]


def test_citation_limits():
    for n in (0, 11):
        with pytest.raises(ValueError):
            a.check_citations(n)


class Held:
    """Tells how many texts were Python objects when it was called."""

    def __init__(self, width):
        self.width = width

    def embed(self, texts):
        return [[len(sys._getframe(1).f_locals["texts"])] * self.width for _ in texts]


def test_a_batch_is_embedded_in_pieces(spark):
    df = spark.range(0, 600, 1, 1).select("id", F.when(F.col("id") % 7 > 0, "a b").alias("t"))
    rows = embed_column(df, "t", EmbeddingSpec(Held, width=2)).collect()
    assert sorted(r["id"] for r in rows) == list(range(600))
    assert max(r["embedding"][0] for r in rows if r["embedding"]) <= 256
    assert all((r["embedding"] is None) == (r["id"] % 7 == 0) for r in rows)
