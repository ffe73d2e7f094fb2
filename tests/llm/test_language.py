import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.llm.language import (Network, held_out, padded, predict_language, segments,
                                     train_language_model)

WORDS = {"aa": ["ciónes", "queado", "el", "los", "ñaro", "mente"],
         "bb": ["the", "thing", "where", "ously", "and", "of"],
         "cc": ["schicht", "über", "der", "ung", "keit", "ßen"]}


def rows(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        out.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(3, 40))), lang))
    return out


def test_gradients_against_differences():
    network = Network(["a", "b", "c"], hidden=3, kind=np.float64)
    words, labels = [b"abc", b"\xc3\xa9x", b"q", b"longer"], np.array([0, 2, 1, 1])
    _, grads = network.gradients(words, labels)
    rng = np.random.default_rng(0)
    for name, weights in network.weights.items():
        used = np.argwhere(grads[name] != 0)
        for at in used[rng.choice(len(used), min(12, len(used)), replace=False)]:
            at, keep = tuple(at), weights[tuple(at)]
            losses = []
            for step in (1e-5, -1e-5):
                weights[at] = keep + step
                losses.append(network.gradients(words, labels)[0])
            weights[at] = keep
            assert abs((losses[0] - losses[1]) / 2e-5 - grads[name][at]) < 1e-6, (name, at)


def test_width_of_the_network():
    assert Network(["a", "b"]).weights["re_f"].shape == (16, 48)


def test_words_do_not_depend_on_their_batch():
    network = Network(["a", "b"])
    words = [b"one", b"three", b"x", b"seventeen-long"]
    together = network.pooled(words)
    for w, row in zip(words, together):
        assert np.allclose(network.pooled([w])[0], row, atol=1e-5)
        assert abs(row.sum() - len(w)) < 1e-4
        # what training differentiates gives the same labels
        assert np.allclose(network.label(*padded([w]))[0].sum(axis=(0, 1)), row, atol=1e-5)
    assert padded([b"ab", b"c"])[0].tolist() == [[97, 99], [98, 256]]


def test_segments_cover_the_whole_text():
    text = "short " + "x" * 100 + "\t\n é"
    assert b"".join(segments(text)) == "".join(text.split()).encode()
    assert max(map(len, segments(text))) <= 24


def test_held_out_accuracy(spark):
    data = rows(900)
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    network = train_language_model(df)
    got = predict_language(df.drop("lang"), network).withColumn(
        "held_out", held_out("doc_id")).collect()
    truth = {i: lang for i, _, lang in data}
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    out = [r for r in got if r["held_out"]]
    assert len(out) > 100
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in out]) >= 0.97


def test_edges(spark):
    df = spark.createDataFrame(rows(200), "doc_id long, text string, lang string")
    network = train_language_model(df)
    odd = [(1, None, "a"), (2, "", "a"), (3, "123 ... ²", "a"), (4, "the " * 60000, "a"),
           (5, "z" * 200000, "a"), (None, "the thing", "a"), (6, "same of", "a"), (6, "same of", "a"),
           (7, "漢字", "a")]
    frame = spark.createDataFrame(odd, "doc_id long, text string, LANG_PRED string")
    got = predict_language(frame, network).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(odd)
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (1, 2, 3))
    assert by_id[4]["lang_pred"] == "bb" and by_id[7]["lang_pred"] in WORDS
    assert predict_language(frame.limit(0), network).count() == 0
    nothing = df.withColumn("lang", F.lit(None).cast("string"))
    assert train_language_model(nothing) is None and train_language_model(df.limit(0)) is None
    assert predict_language(frame, None).where("lang_pred <> 'und'").count() == 0
