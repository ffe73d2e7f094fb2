import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm.decontaminate import (FMIndex, cut_words, find_benchmark, remove_benchmark,
                                          suffix_order)

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    got, hit, found = words(text), set(), set()
    for item, passage in items:
        want = words(passage)
        size = min(window, len(want))
        grams = {tuple(want[i:i + size]) for i in range(len(want) - size + 1)} if want else set()
        for i in range(len(got) - size + 1 if grams else 0):
            if tuple(got[i:i + size]) in grams:
                hit.update(range(i, i + size))
                found.add(str(item))
    return len(got), len(hit), sorted(found)


@pytest.mark.parametrize("seed", range(6))
def test_index_against_scan(seed):
    rng = np.random.default_rng(seed)
    symbols = rng.integers(0, 2 + seed, 400)
    symbols[-1] = 0
    text = [int(x) if x else -i for i, x in enumerate(symbols, 1)]
    order = suffix_order(symbols, 3)
    # a separator ends the comparison; ties go by position
    key = lambda i: (tuple(text[i:next(j for j in range(i, 400) if text[j] < 0)]), i)
    assert order.tolist() == sorted(range(400), key=key)
    index = FMIndex(symbols, 2 + seed)
    for size in (1, 2, 5):
        patterns = rng.integers(1, max(2, 2 + seed), (20, size))
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high):
            want = [i for i in range(400 - size) if list(symbols[i:i + size]) == list(p)]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["alpha", "beta", "Gamma", "délta", "x9"]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, line(n)) for i, n in enumerate((30, 12, 10, 4, 9, 1))]
    items[5] = (5, "unique!")
    items += [(6, ""), (7, None), (8, items[0][1]), (None, line(10))]
    texts = [None, "", "...", items[0][1], line(40) + " " + items[1][1].upper() + "," + line(5),
             items[2][1] + " " + items[2][1], "Unique", line(3000), items[0][1], items[0][1]]
    texts += [line(60) + " foreign " + items[0][1][:60] for _ in range(20)]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in enumerate(texts)],
                               "doc_id long, text string, N_HIT int, spans string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (10**6, 100):   # one block, many blocks
        got = {r["doc_id"]: r for r in find_benchmark(df, bench, block_bytes=block).collect()}
        for i, t in enumerate(texts):
            n, hit, found = brute(t, [x for x in items if x[0] is not None])
            r = got[i]
            assert (r["n_words"], r["items"]) == (n, found), i
            assert r["n_hit"] == brute(t, items)[1], i
            assert r["n_hit"] == sum(s["end"] - s["start"] for s in r["spans"])
    assert find_benchmark(df.limit(0), bench).count() == 0
    assert find_benchmark(df, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_removal(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    df = spark.createDataFrame(
        [(1, f"Before, {passage.title()}! After it."), (2, passage), (3, "clean text"), (4, None)],
        "doc_id long, text string")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    out = remove_benchmark(df, bench)
    assert out.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {
        1: "Before, ! After it.", 3: "clean text", 4: None}
    assert cut_words("a b c d", [(0, 1), (2, 3)]) == " b  d"
