import math
import random

import numpy as np

from ledgerlens.llm.vector_codes import BLOCK, books_digest, compress_vectors, nearest

SCHEMA = "vec_id long, embedding array<double>, label int, CODE string, row int, ints string"


def plain(rows, parts=8, k=16, rounds=6):
    """Every part against every entry, one vector after the other."""
    good = sorted((v, [math.floor(4096 * x) for x in e], n) for v, e, n in rows)
    w = len(good[0][1]) // parts
    cut = [[e[j * w:(j + 1) * w] for j in range(parts)] for _, e, _ in good]
    books = [[list(c[j]) for c in cut[:k]] for j in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[j], entry)), i)
                     for i, entry in enumerate(books[j])) for j in range(parts)] for c in cut]

    for _ in range(rounds):
        got = assign()
        for j in range(parts):
            for i in range(len(books[j])):
                mine = [c[j] for c, g in zip(cut, got) if g[j][1] == i]
                if mine:
                    books[j][i] = [sum(x) // len(mine) for x in zip(*mine)]
    out = [(v, "".join(f"{i:02x}" for _, i in g), sum(d for d, _ in g), n)
           for (v, _, n), g in zip(good, assign())]
    total = {}
    for _, _, d, n in out:
        total[n] = total.get(n, 0) + d
    return sorted((v, c, d, total[n]) for v, c, d, n in out), books_digest(np.array(books))


def run(spark, rows):
    df = spark.createDataFrame([(v, e, n, "c", 1, "i") for v, e, n in rows], SCHEMA)
    got = compress_vectors(df)
    assert got.columns == ["vec_id", "label", "row", "ints", "code", "error", "label_error",
                           "codebooks_sha256"]
    found = got.collect()
    digests = {r["codebooks_sha256"] for r in found}
    assert len(digests) <= 1
    return sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in found), \
        digests.pop() if digests else None


def vectors(rng, n, width=16, spread=None):
    def one():
        if spread:    # few values, so that prefixes, ties and whole parts repeat
            return [rng.randrange(-spread, spread) / 4096 + 0.0001 for _ in range(width)]
        return [rng.gauss(0, 1) for _ in range(width)]
    return [(i * 3, one(), rng.choice([None, 1, 2])) for i in range(n)]


def test_equals_plain_rounds(spark):
    rng = random.Random(1)
    assert run(spark, vectors(rng, 120)) == plain(vectors(random.Random(1), 120))
    rows = vectors(rng, 200, spread=3)
    rng.shuffle(rows)
    assert run(spark, rows) == plain(rows)
    few = vectors(rng, 5)
    assert run(spark, few) == plain(few)


def test_left_out_and_repeated_rows(spark):
    rng = random.Random(2)
    good = vectors(rng, 40, width=8)
    bad = [(-1, None, 1), (-2, [], 1), (-3, [None] + [0.5] * 7, 1), (-4, [math.nan] * 8, 2),
           (-5, [math.inf] + [0.0] * 7, 1), (1000, [0.5] * 16, 1)]
    assert run(spark, good + bad) == plain(good)
    assert run(spark, good * 3) == plain(good * 3)
    assert run(spark, []) == ([], None)
    assert run(spark, bad[:5]) == ([], None)


def test_odd_width_and_huge_components(spark):
    rows = vectors(random.Random(3), 30, width=5)
    padded = [(v, e + [0.0] * 3, n) for v, e, n in rows]
    assert run(spark, rows) == plain(padded)
    huge = [(i, [1e30 if i % 2 else -1e30] * 8, 1) for i in range(20)]
    assert len(run(spark, huge)[0]) == 20


def test_trie_walk_equals_all_distances():
    rng = np.random.default_rng(4)
    for high, rows, width in ((2, 3 * BLOCK, 6), (3, 2 * BLOCK + 7, 3), (1000, 5000, 4), (1, 9000, 2)):
        values = rng.integers(0, high, (rows, width))
        values[: rows // 2] = values[0]      # a node with more leaves than a block
        entries = rng.integers(0, high + 2, (16, width))
        every = ((values[:, None, :] - entries) ** 2).sum(axis=2)
        for order in (np.lexsort(values.T[::-1]), rng.permutation(rows)):
            code, least = nearest(values[order], entries)
            assert (code == every[order].argmin(axis=1)).all()
            assert (least == every[order].min(axis=1)).all()
