import os
import shutil

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import compare
from conftest import DATA
from ledgerlens.model import WORKSPACE, Tables
from ledgerlens.operators import portfolio, report
from ledgerlens.operators.catalogue import MissingColumnError, require_column, resolve_column
from ledgerlens.operators.skew import hot_keys, lookup_join, running_start
from ledgerlens.plans.questions import ask, question_intent
from ledgerlens.session import shared_folder
from ledgerlens.sources import files, generator, sinks
from ledgerlens.streaming import intake

QUICK = ["ag1_", "ag3_", "ag4_", "ag6_", "ag7_", "tk2_", "prj1_", "prj12", "prj14", "wn1_", "wn3_",
         "jn7_", "sc1_", "sc4_", "sc9_", "sc11", "sc19", "src3", "src6", "ag14", "tk1_nearest",
         "tf1_", "tf2_", "sm2"]


@pytest.mark.parametrize("prefix", QUICK)
def test_query_equals_its_twin(spark, prefix):
    queries, twins = entry.queries(), entry.oracle_sql()
    for name in [n for n in queries if n.startswith(prefix)]:
        text, _, same = compare(spark, DATA, name, queries, twins)
        assert same, f"{name}: {text}"


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_hot_keys_are_salted(spark):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(
        F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"))
    right = spark.createDataFrame([("hot", 1), ("4", 2), ("8", 3)], "k string, v int")
    assert hot_keys(left, "k", 0.1) == ["hot"]
    for how in ("left", "inner", "left_semi", "left_anti"):
        plain = left.join(right, "k", how)
        for hot in (["hot"], []):
            salted = lookup_join(left, right, "k", "k", ["id"], how, hot, 8)
            assert salted.select(plain.columns).exceptAll(plain).count() == 0
            assert salted.count() == plain.count()


def test_running_start(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.col("id").alias("n"),
                                  F.lit(2).alias("v"))
    out = running_start(df, ["g"], ["n"], "n", "v", "before", width=100)
    assert out.where(F.col("before") != F.floor(F.col("n") / 2) * 2).count() == 0


def test_questions(spark):
    t = Tables(spark, DATA)
    row = ask(t, "How many active policies are there?", WORKSPACE).first()
    assert row["active_policy_count"] == t.policy_core().where("status = 'active'").count()
    with pytest.raises(ValueError):
        ask(t, "What is the weather?", WORKSPACE)
    with pytest.raises(ValueError):
        ask(t, "  ", WORKSPACE)
    assert ask(t, "latest policies", WORKSPACE, 5).count() == 5


def test_intents(one):
    assert one(["unpaid active policies payment", "repeated policy number", "agent commission",
                "carrier payments", "x" * 1001, ""], question_intent) == [
        "active_policies_without_payments", "duplicate_policy_numbers", "commissions_by_agent",
        "payments_by_carrier", None, None]


def test_column_choice(spark):
    df = spark.createDataFrame([(1, "a", "b")], "id int, First_Name string, last_name string")
    assert resolve_column(df, ["x", "first_name"]) == "First_Name"
    with pytest.raises(MissingColumnError):
        require_column(df, ["amount"], "payment amount")
    assert df.select(portfolio.agent_display_name(df).alias("n")).first()["n"] == "a b"


def test_second_tenant_stays_apart(spark):
    t = Tables(spark, DATA)
    mixed = t.policy_core().withColumn("workspace_id", F.when(
        F.col("id") % 2 == 0, WORKSPACE).otherwise("other"))
    both = [portfolio.active_policy_count(mixed, w).first()[0] for w in (WORKSPACE, "other", None)]
    assert both[0] + both[1] == both[2] and both[0] > 0 and both[1] > 0


def test_generator(spark):
    for scale in (1, 3):
        p = generator.generate(spark, scale)
        assert generator.integrity_problems(p, scale).count() == 0
        assert p.policies.groupBy("policy_number").count().where("count = 2").count() == 5 * scale
        assert p.payments.select("source_record_id").distinct().count() == 85 * scale
    broken = generator.Portfolio(**{**p.tables(), "payments": p.payments.limit(100)})
    assert {r["problem"] for r in generator.integrity_problems(broken, 3).collect()} == {
        "count", "unexpected_unpaid"}
    _, orphans = generator.resolve_keys(
        p.payments.limit(3), p.policies.limit(0),
        {"policy_source_system": "source_system", "policy_source_record_id": "source_record_id"},
        "policy_number", "policy")
    with pytest.raises(ValueError):
        generator.require_none(orphans, "policy")


def test_uploads(spark):
    rows = [(1, "a/b/p.pdf", "application/pdf", b"%PDF-1"), (2, "p.pdf", "application/pdf", b"no"),
            (3, None, None, b"x"), (4, "x.exe", None, b"x"), (5, "r.csv", "text/csv;q=1", b""),
            (6, ".csv", "text/csv", b"x"), (7, "w.webp", "image/webp", b"RIFF0000WEBP"),
            (8, "w.webp", "image/webp", b"RIFF0000WAVE"), (9, "n" * 501 + ".csv", "text/csv", b"x"),
            (10, "r.csv", "text/plain", b"a,b"), (11, "b.xlsx", None, b"PK\x03\x04"),
            (12, "p.pdf", "image/png", b"%PDF-1")]
    df = spark.createDataFrame(rows, "upload_id int, file_name string, content_type string, content binary")
    got = {r["upload_id"]: (r["error"], r["document_type"]) for r in files.validate_uploads(df).collect()}
    assert got == {
        1: (None, "pdf"), 2: ("signature_mismatch", None), 3: ("missing_name", None),
        4: ("unsupported_extension", None), 5: ("empty_file", None), 6: ("missing_extension", None),
        7: (None, "image"), 8: ("signature_mismatch", None), 9: ("name_too_long", None),
        10: (None, "data"), 11: (None, "spreadsheet"), 12: ("content_type_mismatch", None)}


def test_csv_pages(spark):
    rows = [("u", "﻿a,b\r\n1,\r\n\"x, y\",\"q\"\"t\"\r\n".encode()), ("l", "é,b\nñ,2\n".encode("latin-1"))]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = {r["path"]: r for r in files.csv_pages(df).collect()}
    assert got["u"]["text_content"] == 'a,b\n1,\n"x, y","q""t"'
    assert (got["u"]["row_count"], got["u"]["column_count"], got["u"]["columns"]) == (2, 2, ["a", "b"])
    assert got["l"]["text_content"] == "é,b\nñ,2"


def test_ocr(spark):
    rows = [(1, 0, 0, 1, 0, "lo", "50"), (1, 0, 0, 0, 1, "there", "-1"), (1, 0, 0, 0, 2, "you", "100"),
            (1, 0, 0, 0, 0, "hi", "90"), (1, 1, 0, 0, 3, " ", "x"), (2, 0, 0, 0, 0, "z", "-1")]
    df = spark.createDataFrame(rows, "page_id int, block_num int, par_num int, line_num int, "
                                     "position int, word string, conf string")
    got = {r["page_id"]: r for r in files.ocr_pages(df).collect()}
    assert (got[1]["text_content"], got[1]["confidence_score"]) == ("hi there you\nlo", 0.8)
    assert got[2]["confidence_score"] is None


def test_report_file(spark, tmp_path):
    df = spark.createDataFrame([("r1", "=cmd", None), ("r1", "a,\"b\"", "é")],
                               "run_id string, message string, note string")
    sinks.write_report_csv(report.report_lines(df).coalesce(1), str(tmp_path / "o"), by_run=False)
    part = next(p for p in (tmp_path / "o").iterdir() if p.name.endswith(".csv"))
    assert part.read_bytes().decode("utf-8").split("\n")[0] == "﻿run_id,message,note"
    assert '"a,""b""",é' in part.read_text(encoding="utf-8") and "'=cmd" in part.read_text()


def test_index_write_replaces_runs(spark, tmp_path):
    def rows(run, n, tag):
        return spark.range(n).select(F.lit(run).cast("long").alias("processing_run_id"),
                                     F.col("id").alias("chunk_index"), F.lit(tag).alias("tag"))
    path = str(tmp_path / "idx")
    sinks.write_index(rows(1, 5, "old").unionAll(rows(2, 4, "old")), path, 2)
    sinks.write_index(rows(1, 3, "new"), path, 2)
    got = {(r["processing_run_id"], r["tag"]): r["count"] for r in spark.read.parquet(path).groupBy(
        "processing_run_id", "tag").count().collect()}
    assert got == {(1, "new"): 3, (2, "old"): 4}


def test_task_updates(spark):
    tasks = spark.createDataFrame(
        [("t1", "w", "open", None, None, None, None), ("t2", "w", "approved", None, "n", None, "u1"),
         ("t3", "w", "open", None, None, None, None)],
        "task_id string, workspace_id string, status string, assigned_to_user_id string, "
        "resolution_notes string, corrected_value string, resolved_by_user_id string"
    ).withColumn("resolved_at", F.lit(None).cast("timestamp"))
    users = spark.createDataFrame([("u1", "w", True), ("u2", "w", False), ("u3", "x", True)],
                                  "id string, workspace_id string, is_active boolean")
    fields = "task_id string, workspace_id string, user_id string, status string, set_status boolean, " \
             "assigned_to_user_id string, set_assigned_to_user_id boolean, resolution_notes string, " \
             "set_resolution_notes boolean, corrected_value string, set_corrected_value boolean"

    def apply(*row):
        updates = spark.createDataFrame([row], fields)
        checked, after = report.apply_task_updates(tasks, updates, users, F.lit("2026-01-01").cast("timestamp"))
        return checked.first()["error"], {r["task_id"]: r for r in after.collect()}[row[0]]

    error, row = apply("t1", "w", "me", "corrected", True, "u1", True, " done ", True, "5", True)
    assert error is None and (row["status"], row["resolution_notes"], row["corrected_value"],
                              row["resolved_by_user_id"], row["assigned_to_user_id"]) == (
        "corrected", "done", "5", "me", "u1") and row["resolved_at"] is not None
    no = (None, False)
    assert apply("t2", "w", "me", "open", True, *no, *no, *no)[0] == "already_resolved"
    assert apply("t1", "w", "me", "approved", True, *no, *no, *no)[0] == "notes_required"
    assert apply("t1", "w", "me", "corrected", True, *no, "x", True, *no)[0] == "corrected_value_required"
    assert apply("t1", "w", "me", *no, "u2", True, *no, *no)[0] == "assignee_inactive"
    assert apply("t1", "w", "me", *no, "u3", True, *no, *no)[0] == "assignee_not_in_workspace"
    assert apply("t1", "x", "me", "in_progress", True, *no, *no, *no)[0] == "task_not_found"
    assert apply("t1", "w", "me", *no, *no, *no, *no)[0] == "nothing_supplied"


def test_files_stream_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("x\n1")
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")

    def go():
        stream = intake.stream_files(spark, str(tmp_path / "in"), "*.csv")
        intake.run_available(stream, intake.overwrite_batch(
            out, lambda b: b.select("path", "length")), progress)
        return spark.read.parquet(out).count()

    assert go() == 1
    (tmp_path / "in" / "b.csv").write_text("y")
    assert go() == 2 and go() == 2


def test_shared_folder_is_used(spark):
    assert os.path.isdir(shared_folder(spark).replace("file:", ""))


def test_csv_as_users_have_it(spark):
    df = spark.createDataFrame([
        ("break", b'a,b\n"l1\nl2",x\n'), ("doubled", b'a,b\n"say ""hi""",y\n'),
        ("stray", b'a,b\nab"c,d\n'), ("closed early", b'a,b\n"a"b,c\n'),
        ("blank", b'a,b\n,\nNA,null\n'), ("open", b'a,b\n"abc,d\n'), ("wide", b"a\n1,2,3\n4\n1,2\n"),
        ("latin", "a\nä\n".encode("latin-1")), ("marked", b"\xef\xbb\xbfa\nx\n"), ("none", b"")],
        "path string, content binary")
    got = {r["path"]: r for r in files.csv_pages(df).collect()}
    assert got["break"]["text_content"] == 'a,b\n"l1\nl2",x' and got["break"]["row_count"] == 1
    assert got["doubled"]["text_content"] == 'a,b\n"say ""hi""",y'
    assert got["stray"]["text_content"] == 'a,b\n"ab""c",d'
    assert got["closed early"]["text_content"] == "a,b\nab,c"
    assert got["blank"]["text_content"] == "a,b\n,\nNA,null" and got["blank"]["row_count"] == 2
    assert got["open"]["error"] and got["open"]["text_content"] is None
    assert got["wide"]["error"] or got["wide"]["row_count"] == 3
    assert got["latin"]["text_content"] == "a\nä" and got["marked"]["columns"] == ["a"]
    assert got["none"]["text_content"] == "" and got["none"]["row_count"] == 0


def test_normalisation_of_long_blank_runs_is_linear(spark):
    import time
    from ledgerlens.functions.text import normalise_page_text
    text = "a" + " " * 1_000_000 + "b" + "\t \n" * 100_000 + "c"
    df = spark.createDataFrame([(text,)], "v string")
    started = time.perf_counter()
    assert df.select(normalise_page_text(F.col("v"))).first()[0] == "a b\nc"
    assert time.perf_counter() - started < 5


def test_full_case_folding(spark):
    from ledgerlens.functions.text import casefold_ascii_words, fold_case
    texts = ["show proﬁt", "Straße STRAẞE", "ſmall Kelvin",
             "ΟΔΟΣ ς", "ﬃ ǰ ŉ", "PLAIN text", None,
             "İx ᾀ Ꭰ ꭰ", "\U00010400 ŉ \U0001f600 ﬃ"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    got = {r["i"]: r for r in df.select("i", fold_case(F.col("v")).alias("f"),
                                        casefold_ascii_words(F.col("v")).alias("w")).collect()}
    for i, t in enumerate(texts):
        assert got[i]["f"] == (None if t is None else t.casefold()), t
    assert got[0]["w"] == "show profit" and got[1]["w"] == "strasse strasse"


def test_messages_and_status_over_batches_and_reruns(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "id long, document_id long, attempt_number long, " \
        "created_at timestamp, status string"
    from datetime import datetime
    batches = [[(1, 7, 1, datetime(2026, 1, 1, 20), "queued")],
               [(2, 7, 2, datetime(2026, 1, 1, 19), "running"),
                (1, 7, 1, datetime(2026, 1, 1, 20), "queued")],
               [(3, 8, 1, datetime(2026, 1, 1, 1), "completed")]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = intake.stream_table(spark, source, "*.parquet", 1)
        messages = intake.run_messages(stream, str(tmp_path / "messages"), "id")
        status = intake.run_status(stream, str(tmp_path / "status"))
        assert messages.count() == min(3, n + 1 + (n == 1) * 0)
        assert status.count() == (1 if n < 2 else 2)
    again = intake.run_status(stream, str(tmp_path / "status"))      # nothing new
    assert {r["document_id"]: r["status"] for r in again.collect()} == {7: "running", 8: "completed"}
    assert intake.run_messages(stream, str(tmp_path / "messages"), "id").count() == 3


def test_buckets_follow_the_table(spark, tmp_path):
    import glob
    from datetime import datetime
    path, day = str(tmp_path / "status"), datetime(2026, 1, 1)
    sink = intake.merge_buckets(path, "document_id", intake.current_status, bucket_rows=20)

    def batch(documents, attempt, status):
        sink(spark.createDataFrame(
            [(attempt * 1000 + d, d, attempt, day, status) for d in documents],
            "id long, document_id long, attempt_number long, created_at timestamp, status string"), 0)

    def files():
        return {f for f in glob.glob(f"{path}/of-32/bucket=*/*.parquet")}
    batch(range(100), 1, "queued")
    assert intake.stored_buckets(spark, path) == 8
    batch(range(50, 300), 2, "running")
    assert intake.stored_buckets(spark, path) == 32
    before = files()
    batch([7], 3, "completed")
    batch([7], 3, "completed")          # delivered again
    batch([7], 2, "failed")             # late
    assert len(before - files()) == 1
    got = {r["document_id"]: r["status"] for r in intake.read_merged(spark, path).collect()}
    assert got == {d: "completed" if d == 7 else "queued" if d < 50 else "running" for d in range(300)}


def test_a_table_streams_from_one_file_and_from_a_folder_of_parts(spark, tmp_path):
    """A table's name is a file in small sets and a folder of parts in larger ones."""
    spark.range(40).repartition(4).write.parquet(str(tmp_path / "parts" / "t.parquet"))
    spark.range(40).coalesce(1).write.parquet(str(tmp_path / "made"))
    (tmp_path / "single").mkdir()
    shutil.copy(next((tmp_path / "made").glob("*.parquet")), tmp_path / "single" / "t.parquet")
    for form, batches in (("parts", 2), ("single", 1)):
        out = str(tmp_path / f"{form}-out")
        stream = intake.stream_table(spark, str(tmp_path / form), "t.parquet", 2)
        for _ in range(2):
            intake.run_available(stream, intake.overwrite_batch(out, lambda b: b), out + "-progress")
        stored = spark.read.parquet(out)
        assert stored.select("id").distinct().count() == stored.count() == 40
        assert stored.select("batch").distinct().count() == batches


def test_payslips_are_dealt_to_all_cores(spark):
    from ledgerlens.plans.document_queries import payslips
    # one small file, which a scan gives to one task
    made = payslips(Tables(spark, DATA))
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert made.count() == spark.read.parquet(f"{DATA}/customer.parquet").count()


def test_upload_checks_of_odd_texts(spark, tmp_path):
    import duckdb
    path = tmp_path / "documents.parquet"
    duckdb.execute(f"""COPY (SELECT CAST(i * 10 + k AS BIGINT) AS doc_id, CASE i WHEN 0 THEN NULL
        WHEN 1 THEN '' WHEN 2 THEN '%PDF-1.7 x' WHEN 3 THEN 'plain' WHEN 4 THEN ' '
        ELSE repeat('é', {files.MAX_BYTES // 2 + 1}) END AS text
        FROM range(6) a(i), range(10) b(k) UNION ALL SELECT -3, 'below' UNION ALL
        SELECT NULL, 'none') TO '{path}' (FORMAT parquet)""")
    text, _, same = compare(spark, str(tmp_path), "src6_upload_checks", entry.queries(),
                            entry.oracle_sql())
    assert same and text == "equal 62", text
