import hashlib
import random
import re

import public_tokenizers
import tiktoken

import corpus_pipeline
from ledgerlens.llm.byte_bpe import read_ranks
from tests.llm.test_decontaminate import brute

GOOD = ["the", "of", "river", "house", "and", "walks", "green", "tree", "by", "stone", "old"]


def words(rng, n, source=GOOD):
    return " ".join(rng.choice(source) for _ in range(n))


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(6)
    passage = words(rng, 14)
    rows, labels = [], []
    for i in range(240):
        poor = i % 6 == 0
        rows.append((i, words(rng, 70, ["###", "zzq", "buy"] if poor else GOOD), "en", "s"))
        labels.append((i, int(not poor), 0))
    rows += [(300, rows[1][1], "en", "s"), (301, rows[1][1] + " tree", "en", "s"),
             (302, words(rng, 50) + " " + passage + " " + words(rng, 30), "en", "s"),
             (303, words(rng, 50) + " password = abcd1234efgh " + words(rng, 30), "en", "s"),
             (304, None, "en", "s"), (305, "", None, None), (None, words(rng, 40), "en", "s")]
    docs = spark.createDataFrame(
        [(*r, len(r[1]) if r[1] is not None else None) for r in rows],
        "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(
        f"{folder}/benchmark.parquet")

    now, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, folder)
        assert k == 4 or out.schema.names == docs.schema.names
        out.write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        kept[name] = {r["doc_id"]: r for r in now.collect()}
    first, second, third, fourth, last = kept.values()
    assert not any(i in first for i in range(0, 240, 6))
    assert sum(i in first for i in range(240) if i % 6) >= 190
    assert 1 in second and 300 not in second
    assert 302 in third and brute(third[302]["text"], [(1, passage)])[1] == 0
    assert re.search("password", third[303]["text"]) and "abcd1234" not in fourth[303]["text"]
    assert fourth[303]["n_chars"] == len(fourth[303]["text"])
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, special_tokens={},
        mergeable_ranks=read_ranks(public_tokenizers.path(corpus_pipeline.VOCABULARY)))
    assert set(last) == set(fourth)
    for i, r in last.items():
        text = fourth[i]["text"] or ""
        ids = library.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    whole = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert whole == last


def test_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    for name, schema in (("documents", "doc_id long, text string, n_chars long"),
                         ("labels", "doc_id long, quality int, toxic int"),
                         ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_stages_bound_the_rows_of_a_batch(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    try:
        for given, want in (("10000", corpus_pipeline.BATCH_ROWS), ("0", corpus_pipeline.BATCH_ROWS),
                            ("7", 7)):
            spark.conf.set(key, given)
            dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "")
            assert int(spark.conf.get(key)) == want
    finally:
        spark.conf.set(key, before)
