import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import embedding_dedup
from ledgerlens.llm.embedding_dedup import (audited, near_vectors, neighbour_lists, recall_of,
                                            unit_vectors)

SCHEMA = "vec_id long, embedding array<float>, n_links string"


def brute(rows, threshold=0.95):
    units = []
    for _, v, *_ in rows:
        ok = v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) \
            and any(v)
        v = np.array(v, np.float32).astype(float) if ok else None
        units.append(v / np.sqrt(v @ v) if ok else None)
    n = len(rows)
    link = [[i != j and units[i] is not None and units[j] is not None
             and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold
             for j in range(n)] for i in range(n)]
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if link[i][j] and label[j] < label[i]:
                    label[i], changed = label[j], True
    least = {}
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if label[j] == label[i] and rows[j][0] is not None]
        least[i] = min(ids, default=None)
    return [(rows[i][0], sum(link[i]), least[i]) for i in range(n)]


def test_against_all_pairs_with_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(16).tolist(), "x") for i in range(150)]
    for c in range(12):
        centre = rng.standard_normal(16)
        for k in range(2 + 3 * c):
            rows.append((200 + 50 * c + k, (centre + rng.standard_normal(16) * 0.12).tolist(), "x"))
    rows += [(2000, None, "x"), (2001, [], "x"), (2002, [0.0] * 16, "x"),
             (2003, [float("nan")] * 16, "x"), (2004, [None] + [1.0] * 15, "x"),
             (2005, [float("inf")] + [1.0] * 15, "x"), (2006, [1.0, 2.0], "x"),
             (2007, [2.0, 4.0], "x"), (2008, rows[0][1], "x"), (2009, rows[0][1], "x"),
             (2009, rows[0][1], "x"), (None, rows[1][1], "x"), (2010, [-0.0, 1.0], "x")]
    got = near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda r: (str(r[0]), r[1], str(r[2]))
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=key) == \
        sorted(brute(rows), key=key)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"])
               for r in got)


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(24)
    rows = [(i, (centre + rng.standard_normal(24) * 0.02).tolist(), "x") for i in range(1500)]
    rows += [(2000 + i, rng.standard_normal(24).tolist(), "x") for i in range(400)]
    got = {r["vec_id"]: r for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i]["n_links"] == 1499 and got[i]["component_id"] == 0 for i in range(1500))
    assert all(got[2000 + i]["n_links"] == 0 for i in range(400))


def test_groups_of_near_copies_without_outsiders(spark):
    rng = np.random.default_rng(11)
    rows, sizes = [], (600, 800, 1000)
    for c, size in enumerate(sizes):
        centre = rng.standard_normal(24)
        rows += [(10000 * c + i, (centre + rng.standard_normal(24) * 0.002).tolist(), "x")
                 for i in range(size)]
    got = near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == sum(sizes)
    for r in got:
        c = r["vec_id"] // 10000
        assert (r["n_links"], r["component_id"]) == (sizes[c] - 1, 10000 * c)


def pairs_and_a_group(pairs, group, seed=13):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal(24)
    rows = [(i, (centre + rng.standard_normal(24) * 0.02).tolist(), "x") for i in range(group)]
    for i in range(pairs):
        v = rng.standard_normal(24)
        rows += [(10000 + 2 * i + k, (v + rng.standard_normal(24) * 0.01 * k).tolist(), "x")
                 for k in range(2)]
    return rows


def test_audit_sees_lost_pairs_beside_a_large_group(spark):
    df = spark.createDataFrame(pairs_and_a_group(60, 300), SCHEMA)
    nodes = unit_vectors(df, "vec_id", "embedding")
    links, whole = audited(nodes, 0.95)
    assert whole and links.where("not many").count() == 120
    group = [r["node"] for r in nodes.where("least_id < 10000").collect()]
    spine = [(v, group[0], 1.0) for v in group[1:]]
    lists = spark.createDataFrame(spine, "u long, v long, sim float")
    assert recall_of(links.where("many"), lists, 0.95) == 1.0
    assert recall_of(links, lists, 0.95) == 0.0
    none, whole = audited(nodes.where("least_id in (0, 10000)"), 0.95)
    assert none is None and whole
    none, whole = audited(nodes.where("least_id in (0, 10000)"), 0.95, drawn=1)
    assert none is None and not whole


def test_trees_grow_until_recall_is_reached(spark, monkeypatch):
    df = spark.createDataFrame(pairs_and_a_group(20, 0), SCHEMA)
    nodes = unit_vectors(df, "vec_id", "embedding")
    made = []
    plant = embedding_dedup.planted
    monkeypatch.setattr(embedding_dedup, "planted",
                        lambda n, rows, first, room: made.append(first) or plant(
                            n, rows, first, room))
    monkeypatch.setattr(embedding_dedup, "recall_of",
                        lambda *a: 1.0 if len(made) == 3 else 0.5)
    _, recall = neighbour_lists(nodes)
    assert recall == 1.0 and made == [0, 4, 8]
    with pytest.raises(RuntimeError, match="0.5000 after 1 rounds"):
        near_vectors(df, rounds=1)


def test_recall_of_the_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    nodes = unit_vectors(df, "vec_id", "embedding")
    low = 0.30          # far below the threshold, so that lists are put to the test
    lists, _ = neighbour_lists(nodes, low)
    rows = nodes.select("node", "unit").collect()
    unit = np.array([np.frombuffer(r["unit"]) for r in rows])
    ids = np.array([r["node"] for r in rows])
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    best = {int(ids[i]): {int(ids[j]) for j in np.argsort(-sims[i])[:5]} for i in range(len(ids))}
    held = {}
    for r in lists.collect():
        held.setdefault(r["u"], set()).add(r["v"])
    recall = np.mean([len(best[i] & held.get(i, set())) / 5 for i in best])
    assert recall >= 0.9


@pytest.mark.parametrize("size", [0, 1])
def test_tiny_tables(spark, size):
    df = spark.createDataFrame([(7, [1.0, 2.0], "x")][:size], SCHEMA)
    got = near_vectors(df)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert got.agg(F.count("*")).first()[0] == size
