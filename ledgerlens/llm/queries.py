"""The registered queries of this folder: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.byte_bpe import encode_documents, read_ranks
from ledgerlens.llm.common import table
from ledgerlens.llm.decontaminate import find_benchmark
from ledgerlens.llm.embedding_dedup import near_vectors
from ledgerlens.llm.language import held_out, predict_language, train_language_model
from ledgerlens.llm.licenses import scan_licenses
from ledgerlens.llm.line_dedup import apply_bitmaps, line_bitmaps
from ledgerlens.llm.pii import scan_pii
from ledgerlens.llm.quality import score_quality
from ledgerlens.llm.secrets import corpus_samples, scan_secrets, train
from ledgerlens.llm.simhash import near_duplicates
from ledgerlens.llm.token_alignment import align_tokens
from ledgerlens.llm.token_counts import count_tokens
from ledgerlens.llm.vector_codes import compress_vectors
from ledgerlens.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return scan_licenses(docs).drop("text", "detections")


@query
def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    ratio = train(corpus_samples(docs))
    return scan_secrets(docs, ratio).drop("text", "found")


@query
def op10_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = find_benchmark(docs, table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


_LOWER = ("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          "'abcdefghijklmnopqrstuvwxyz')")
TWINS["op10_benchmark_decontamination"] = rf"""
WITH d AS (SELECT doc_id,
        regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT item_id,
        regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    placed AS (SELECT item_id, w, least(10, len(w)) AS n,
        unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
    windows AS (SELECT DISTINCT item_id, n, list_slice(w, i, i + n - 1) AS g FROM placed),
    sizes AS (SELECT DISTINCT n FROM windows),
    spots AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes
        WHERE len(w) >= n),
    found AS (SELECT a.doc_id, a.p, a.n, x.item_id FROM spots a
        JOIN windows x ON x.n = a.n AND x.g = list_slice(a.w, a.p, a.p + a.n - 1)),
    hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM
        (SELECT doc_id, unnest(range(p, p + n)) AS q FROM found) GROUP BY doc_id),
    named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM
        (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit,
    coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""


@query
def op8_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op1_quality_resampling(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return score_quality(docs, table(spark, folder, "labels"))


@query
def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return encode_documents(docs, ranks, public_tokenizers.PATTERN).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


@query
def op4_pii_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return scan_pii(docs).drop("text", "found")


@query
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The cache is a new one each time, so that every text is counted here."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as file:
        vocabulary = file.read()
    return count_tokens(docs, vocabulary, scratch_path(spark, "token-cache"))


@query
def op2_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))


TWINS["op2_embedding_near_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0
        AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0
        AND len([x FOR x IN e IF x <> 0]) > 0),
    pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
        ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
        AND list_cosine_similarity(a.e, b.e) >= 0.95),
    reach AS (SELECT vec_id AS a, vec_id AS b FROM v
        UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
    links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a),
    least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, m AS component_id, vec_id = m AS kept
FROM v JOIN least ON least.a = vec_id LEFT JOIN links ON links.a = vec_id"""


@query
def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    found = predict_language(docs.select("doc_id", "text"), train_language_model(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query
def op11_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return apply_bitmaps(docs, line_bitmaps(docs)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


TWINS["op11_line_dedup"] = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
        string_split(coalesce(text, ''), chr(10)) AS w FROM documents),
    l AS (SELECT r, doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS line FROM d),
    k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    twice AS (SELECT key, min(doc_id) AS least FROM k WHERE length(key) >= 10
        GROUP BY key HAVING count(DISTINCT doc_id) > 1),
    told AS (SELECT r, doc_id, i, line, coalesce(doc_id <> least, FALSE) AS gone
        FROM k LEFT JOIN twice USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM told GROUP BY r"""


@query
def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return compress_vectors(table(spark, folder, "embeddings").select(
        "vec_id", "embedding", "label")).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256")


def _codes_twin(rounds: int = 6) -> str:
    """The rounds one after the other, each a CTE for the nearest entries and one for the means."""
    apart = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(p.s, b.c)])"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT p.r, p.j, any_value(p.s) AS s, "
                     f"min(struct_pack(d := {apart}, k := b.k)) AS t "
                     f"FROM p JOIN b{i} b ON b.j = p.j GROUP BY p.r, p.j)")
        if i < rounds:
            steps.append(
                f"m{i} AS (SELECT j, k, list(CAST((n - ((n % q) + q) % q) // q AS BIGINT) "
                f"ORDER BY i) AS c FROM (SELECT j, t.k AS k, i, sum(x) AS n, count(*) AS q FROM "
                f"(SELECT j, t, unnest(s) AS x, unnest(range(len(s))) AS i FROM a{i}) "
                f"GROUP BY ALL) GROUP BY j, k)")
            steps.append(f"b{i + 1} AS MATERIALIZED (SELECT b.j, b.k, coalesce(m.c, b.c) AS c "
                         f"FROM b{i} b LEFT JOIN m{i} m ON m.j = b.j AND m.k = b.k)")
    return f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label,
        [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
        FROM embeddings WHERE embedding IS NOT NULL
        AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    p AS MATERIALIZED (SELECT r, j, e[j * (len(e) // 8) + 1:(j + 1) * (len(e) // 8)] AS s
        FROM v, (SELECT unnest(range(8)) AS j)),
    b0 AS MATERIALIZED (SELECT j, r AS k, s AS c FROM p WHERE r < 16),
    {", ".join(steps)},
    coded AS (SELECT r, string_agg(printf('%02x', t.k), '' ORDER BY j) AS code,
        CAST(sum(t.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
    whole AS (SELECT vec_id, label, code, error FROM v JOIN coded USING (r)),
    labels AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM whole GROUP BY label)
SELECT vec_id, code, error, label_error,
    (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY j, k)) FROM b{rounds})
        AS codebooks_sha256
FROM whole JOIN labels ON whole.label IS NOT DISTINCT FROM labels.label"""


TWINS["op12_vector_codes"] = _codes_twin()


@query
def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as file:
        vocabulary = file.read()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    return align_tokens(docs, vocabulary, model)
