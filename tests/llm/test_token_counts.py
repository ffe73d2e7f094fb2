import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlens.llm.token_counts import count_tokens, read_cache, tokenizer_digest

PATH = public_tokenizers.path("byte_bpe_50k.json")
VOCABULARY = open(PATH, "rb").read()
TEXTS = [None, "", "Hello world", "a <|endoftext|> b", "naïve ciónes 你好 😀", "x" * 3000,
         "word " * 20000, "Hello world", "Hello world", " \n\t "]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)],
                                 "doc_id long, text string, N_TOKENS string")


def test_counts_like_the_library_and_reuses_the_cache(spark, tmp_path):
    library, cache = Tokenizer.from_file(PATH), str(tmp_path / "cache")
    got = count_tokens(frame(spark, TEXTS), VOCABULARY, cache)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    rows = {r["doc_id"]: r for r in got.collect()}
    for i, t in enumerate(TEXTS):
        want = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (rows[i]["n_bytes"], rows[i]["n_tokens"]) == (len((t or "").encode()), want)
        assert rows[i]["over_limit"] == (want > 512)
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for t in TEXTS})
    # a second call adds the one new text only, and believes what is stored
    more = count_tokens(frame(spark, [*TEXTS, "new text"]), VOCABULARY, cache)
    assert more.count() == len(TEXTS) + 1
    assert spark.read.parquet(cache).count() == stored.count() + 1
    digest = F.unhex(F.sha2(F.lit("planted"), 256))
    spark.range(1).select(digest.alias("digest"), F.lit(tokenizer_digest(VOCABULARY)).alias(
        "tokenizer"), F.lit(77).cast("long").alias("n_tokens")).write.mode("append").parquet(cache)
    assert count_tokens(frame(spark, ["planted"]), VOCABULARY, cache).first()["n_tokens"] == 77


def test_other_tokenizer_and_empty_table(spark, tmp_path):
    cache = str(tmp_path / "cache")
    assert count_tokens(frame(spark, TEXTS).limit(0), VOCABULARY, cache).count() == 0
    count_tokens(frame(spark, ["a b c"]), VOCABULARY, cache)
    assert read_cache(spark, cache, tokenizer_digest(VOCABULARY)).count() == 1
    assert read_cache(spark, cache, tokenizer_digest(VOCABULARY + b" ")).count() == 0


def test_columns_named_like_the_caches(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b", "mine", b"x", 5), (1, "a b", "mine", b"x", 5)],
                               "doc_id long, text string, digest string, tokenizer binary, __digest int")
    got = count_tokens(df, VOCABULARY, str(tmp_path / "cache"))
    assert got.columns == ["doc_id", "digest", "tokenizer", "__digest", "n_bytes", "n_tokens",
                           "over_limit"]
    assert [(r["digest"], r["__digest"], r["n_tokens"]) for r in got.collect()] == [("mine", 5, 2)] * 2
