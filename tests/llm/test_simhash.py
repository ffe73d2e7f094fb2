import random
import re

import numpy as np
import pytest
import xxhash

from ledgerlens.llm.components import components
from ledgerlens.llm.simhash import classes, fingerprint, keep_one, near_duplicates, stars


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if linked(a, b) and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_fingerprint_matches_definition_and_spark(spark):
    rng = random.Random(1)
    texts = [None, "", " \t\n", "one", "One two three", "a b c d", "a b c d e é\x1cx\x85y"]
    texts += [" ".join(rng.choice("abcdefghij") for _ in range(n)) for n in (50, 400, 70000)]
    for t in texts:
        assert fingerprint(t or "") & (2**64 - 1) == brute_print(t), t and t[:30]


@pytest.mark.parametrize("cell", [3, 4096])
def test_classes_against_all_pairs(spark, cell):
    rng = random.Random(4)
    prints = [rng.getrandbits(64) for _ in range(120)]
    for p in prints[:60]:
        for bits in (1, 3, 4, 5, 8):
            q = p
            for b in rng.sample(range(64), bits):
                q ^= 1 << b
            prints.append(q)
    # a crowd that agrees on most bits, so that keys are crowded too
    crowd = rng.getrandbits(64)
    prints += [crowd ^ rng.getrandbits(7) for _ in range(60)]
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    want = brute_components(list(range(len(prints))),
                            lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    got = classes(spark.createDataFrame(rows, "doc_id long, fp long"), "doc_id", cell=cell)
    by_print = {r["fp"]: r["component_id"] for r in got.collect()}
    assert {i: by_print[p] for i, p in rows} == want


def test_other_block_counts_agree(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(62) for _ in range(40)]
    rows = [(i, p ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60)))
            for i, p in enumerate(base * 3)]
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    six, seven = (sorted(map(tuple, classes(df, "doc_id", blocks=b).collect())) for b in (6, 7))
    assert six == seven


def test_edges_of_input(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(3, text, "c"), (1, text, "x"), (1, text, "x"), (None, text, "n"), (7, None, "e"),
            (8, "", "e"), (9, "other words stand here and go on for a while", "o"),
            (10, text + " tail", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, FP string")
    got = near_duplicates(df).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r["component_id"] for r in got}
    assert (by_id[1], by_id[3], by_id[None], by_id[7], by_id[8], by_id[9]) == (1, 1, 1, 7, 7, 9)
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect() if r["doc_id"] != 10) == [0, 1, 7, 9]
    assert near_duplicates(df.limit(0)).count() == 0 and keep_one(df.limit(0)).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000 + i, 999) for i in range(1, 300)] + [(5, 5)]
    random.Random(2).shuffle(edges)
    got = {r["node"]: r["component"] for r in components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 999 for i in range(1, 300))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stars_hold_the_largest_group_once():
    fps = np.unique(np.random.default_rng(0).integers(0, 32, 60).astype(np.uint64))
    assert len(stars(fps, 5)) == len(fps) - 1
