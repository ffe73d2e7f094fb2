import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm.quality import best_cut, keep_good, kth_largest, score_quality


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    good = ["the", "of", "river", "house", "and", "walks", "green", "tree", "by", "stone"]
    rows, labels = [], []
    for i in range(400):
        if i % 8 == 0:
            text = " ".join(rng.choice(["###", "zzq", "click", "$$$", "buy"]) for _ in range(60))
        else:
            text = " ".join(rng.choice(good) for _ in range(rng.randrange(5, 90)))
        rows.append((i, text, "x"))
        if i % 2 == 0:
            labels.append((i, int(i % 8 != 0), 0))
    return rows, labels


def frames(spark, corpus):
    return (spark.createDataFrame(corpus[0], "doc_id long, text string, lang string"),
            spark.createDataFrame(corpus[1], "doc_id long, quality int, toxic int"))


def test_poor_documents_go_and_good_ones_stay(spark, corpus):
    docs, labels = frames(spark, corpus)
    got = {r["doc_id"]: r for r in score_quality(docs, labels).collect()}
    assert len(got) == 400
    assert not any(got[i]["kept"] for i in range(0, 400, 8))
    assert sum(got[i]["kept"] for i in range(400) if i % 8) >= 346
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}


def test_kept_are_the_k_largest_noisy_weights(spark, corpus):
    docs, labels = frames(spark, corpus)
    rows = score_quality(docs, labels).collect()
    order = sorted((r["gumbel_key"] for r in rows), reverse=True)
    kept = [r["gumbel_key"] for r in rows if r["kept"]]
    assert sorted(kept, reverse=True) == order[:len(kept)]
    noise = np.array([r["gumbel_key"] - r["log_weight"] for r in rows])
    assert abs(noise.mean() - 0.5772) < 0.25 and abs(noise.std() - 1.2825) < 0.25


def test_weights_against_plain_counts(spark):
    from ledgerlens.llm import quality as q
    texts = {1: "a b a", 2: "b c", 3: "a b", 4: None, 5: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    counts = q.count_ngrams(df, {1, 3}, "text", "doc_id")
    hashes = q.WordHashes()
    raw, target = {}, {}
    for i, t in texts.items():
        for g in q.ngrams(t or "", hashes).tolist():
            raw[g] = raw.get(g, 0) + 1
            if i in (1, 3):
                target[g] = target.get(g, 0) + 1
    assert {i: int(n) for i, n in enumerate(counts[1]) if n} == raw
    assert {i: int(n) for i, n in enumerate(counts[0]) if n} == target
    ratios = q.log_ratios(counts)
    g = q.ngrams("a", hashes)[0]
    share = (raw[g] + 0.5) / (sum(raw.values()) + 0.5 * q.BUCKETS)
    want = math.log((target[g] + 0.5 * q.BUCKETS * share)
                    / (sum(target.values()) + 0.5 * q.BUCKETS)) - math.log(share)
    assert abs(ratios[g] - want) < 1e-12


def test_kth_largest_with_ties_and_close_values(spark):
    rng = random.Random(1)
    values = [rng.gauss(0, 50) for _ in range(500)] + [3.0] * 40 + [1.0, np.nextafter(1.0, 2)]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    order = sorted(values, reverse=True)
    for k in (1, 7, 100, 260, 270, 280, len(values)):
        assert kth_largest(df, "v", k) == order[k - 1]


def test_cut_and_edges(spark, corpus):
    assert best_cut([1, 2, 3, 4], [False, False, True, True]) == 3
    assert best_cut([1, 2], [True, True]) == float("-inf")
    docs, labels = frames(spark, corpus)
    rows = [(1, None, "a"), (None, "x y", "b"), (2, "", "c"), (2, "", "c"), (3, "w " * 40000, "d")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, Kept string")
    bad = spark.createDataFrame([(None, 1, 0), (1, None, None), (2, 1, None), (2, 0, 0)],
                                "doc_id long, quality int, toxic int")
    assert score_quality(odd, bad).where("kept").count() == 5     # nothing to tell apart
    assert score_quality(odd, labels.limit(0)).count() == 5
    assert score_quality(docs.limit(0), labels).count() == 0
    assert keep_good(odd, labels).columns == odd.columns
    assert keep_good(docs, labels.limit(0)).agg(F.count("*")).first()[0] == 400
