import random

from pyspark.sql import functions as F

from ledgerlens.llm.line_dedup import apply_bitmaps, line_bitmaps

SCHEMA = "doc_id long, text string, KEEP string, h1 int, row string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip("\t\n\v\f\r ").translate(UPPER)


def plain(docs):
    holders = {}
    for d, text in docs:
        for line in (text or "").split("\n"):
            if d is not None and len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(d)
    out = []
    for d, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if d is None or len(holders.get(key(x), ())) < 2
                or min(holders[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def run(spark, docs):
    df = spark.createDataFrame([(d, t, "k", 1, "r") for d, t in docs], SCHEMA)
    got = apply_bitmaps(df, line_bitmaps(df))
    assert got.columns == ["doc_id", "text", "h1", "row", "n_lines", "n_dropped", "keep",
                           "kept_text"]
    rows = got.collect()
    for r in rows:
        # a bitmap holds the words that lose lines, in order, and nothing else
        words = [w["word"] for w in r["keep"] or []]
        assert words == sorted(set(words)) and all(w["bits"] != -1 for w in r["keep"] or [])
        assert sum(64 - bin(w["bits"] & (2**64 - 1)).count("1") for w in r["keep"] or []) \
            == r["n_dropped"]
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in rows),
                  key=repr)


def test_cases(spark):
    docs = [(1, None), (2, ""), (3, "\n\n"), (4, "Shared line here\nown line of four"),
            (5, "  shared LINE here\t\nshared line here\nshort\nshort"), (6, "short\nshort"),
            (7, "ÄÖÜ ist nicht klein"), (8, "äöü ist nicht klein"), (9, "ÄÖÜ IST nicht klein"),
            (10, "twice in here only\ntwice in here only"), (11, " shared line here"),
            (None, "shared line here\nwithout an id at all"), (12, "without an id at all"),
            (13, "123456789\n1234567890"), (14, "123456789\n1234567890"), (14, "1234567890\nx")]
    assert run(spark, docs) == plain(docs)


def test_empty_table_and_repeated_rows(spark):
    assert run(spark, []) == []
    docs = [(1, "a line of some length\nb")] * 2 + [(2, "x\na line of some length")] * 3
    assert run(spark, docs) == plain(docs)


def test_long_texts_and_random_lines(spark):
    rng = random.Random(3)
    pool = [f"line number {i} of the pool" for i in range(60)]
    docs = [(i, "\n".join(rng.choice(pool) if rng.random() < .5 else f"own {i} {j} text"
                          for j in range(rng.randrange(200)))) for i in range(60)]
    docs.append((100, "\n".join(pool[0] if i % 3 else f"long document {i}" for i in range(30_000))))
    docs.append((101, "\n".join([f"long document {i}" for i in range(30_000)])))
    rng.shuffle(docs)
    assert run(spark, docs) == plain(docs)


def test_a_line_in_most_documents_is_kept_apart(spark):
    # a third of all lines have one key: it must not go through the range partitions
    docs = [(i, "\n".join(["the very same footer", f"own line of {i}", f"more text of {i}"]))
            for i in range(3000)]
    assert run(spark, docs) == plain(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    total = line_bitmaps(df).agg(F.sum("n_dropped")).first()[0]
    assert total == 2999


def test_main_path_is_native(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    plan = apply_bitmaps(df, line_bitmaps(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "rangepartitioning" in plan
    assert plan.split("== Physical Plan ==")[1].count("rangepartitioning(h1") == 1
