import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import reconcile as rec
from ledgerlens.operators import report
from ledgerlens.plans.corpus import new_report, reconcile_pages

RECORD = "number_key string, policy_id long, policy_number string, policy_matches long, " \
         "record_customer string, record_carrier string, record_plan string, record_status string, " \
         "record_premium decimal(12,2), record_effective date, record_termination date, " \
         "record_signature date, has_payment boolean"
BASE = {
    "number": "Policy Number: POL-1000", "customer": "Insured: Ann Lee", "carrier": "Carrier: Aetna",
    "plan": "Plan: Value HMO", "effective": "Effective Date: 2026-03-14",
    "signature": "Signature Date: 2026-03-01", "premium": "Premium: 45.00", "status": "Status: Active"}


def run(spark, record=None, settings=rec.Settings(), persist=False, confidence=None, **lines):
    text = "\n".join(x for x in {**BASE, **lines}.values() if x)
    pages = spark.createDataFrame([(1, 1, 1, text, "completed", confidence)],
                                  "document_id long, page_id long, page_number int, "
                                  "text_content string, status string, confidence_score double")
    row = {"number_key": "POL-1000", "policy_id": 7, "policy_number": "pol-1000",
           "policy_matches": 1, "record_customer": "ANN LEÉ", "record_carrier": "Aetna",
           "record_plan": "Value-HMO", "record_status": "Active", "record_premium": Decimal("45.00"),
           "record_effective": dt.date(2026, 3, 14), "record_termination": None,
           "record_signature": None, "has_payment": True, **(record or {})}
    records = spark.createDataFrame([tuple(row.values())], RECORD)
    return reconcile_pages(pages, records, settings, persist)


def checks(result):
    return {r["rule_code"]: (r["status"], r["severity"], r["finding_type"])
            for r in result.findings.collect()}


def test_everything_matches(spark):
    got = checks(run(spark))
    assert len(got) == 12
    assert {c for c, x in got.items() if x[0] != "passed"} == {"REC007"}
    assert got["REC007"] == ("skipped", "info", "termination_date")


@pytest.mark.parametrize("record, lines, rule, want", [
    ({}, {"number": "Policy Number: POL-9"}, "REC001", ("failed", "high", "unmatched_policy")),
    ({"policy_matches": 3}, {}, "REC002", ("needs_review", "high", "duplicate_policy_number")),
    ({}, {"customer": "Insured: Bob Ray"}, "REC003", ("failed", "high", "customer_name")),
    ({}, {"customer": ""}, "REC003", ("needs_review", "high", "customer_name")),
    ({"record_carrier": None}, {}, "REC004", ("needs_review", "medium", "carrier_name")),
    ({"record_plan": None}, {"plan": ""}, "REC005", ("skipped", "info", "plan_name")),
    ({}, {"effective": "Effective Date: 2026-03-15"}, "REC006", ("failed", "high", "effective_date")),
    ({}, {"t": "End Date: 2027-01-01"}, "REC007", ("needs_review", "medium", "termination_date")),
    ({}, {"signature": ""}, "REC008", ("needs_review", "high", "missing_signature")),
    ({"record_signature": dt.date(2026, 3, 1)}, {}, "REC008",
     ("passed", "info", "signature_date_match")),
    ({"record_signature": dt.date(2026, 3, 2)}, {}, "REC008",
     ("failed", "high", "signature_date_mismatch")),
    ({}, {"premium": "Premium: 45.01"}, "REC009", ("passed", "info", "premium_match")),
    ({}, {"premium": "Premium: 45.02"}, "REC009", ("failed", "high", "premium_mismatch")),
    ({}, {"premium": ""}, "REC009", ("needs_review", "high", "premium_missing_document")),
    ({"record_premium": None}, {}, "REC009", ("needs_review", "high", "premium_missing_database")),
    ({"record_status": "Issued"}, {}, "REC010", ("passed", "info", "policy_status")),
    ({"record_status": "lapsed"}, {}, "REC010", ("failed", "medium", "policy_status")),
    ({"record_status": "Terminated"}, {}, "REC011", ("skipped", "info", "payment_presence")),
    ({"has_payment": False}, {}, "REC011", ("failed", "high", "missing_payment")),
    ({"has_payment": False, "record_status": "pending"}, {}, "REC011",
     ("failed", "medium", "missing_payment")),
])
def test_rules(spark, record, lines, rule, want):
    assert checks(run(spark, record, **lines))[rule] == want


def test_low_confidence_and_summary(spark):
    result = run(spark, confidence=0.6, persist=True)
    assert checks(result)["REC012"] == ("needs_review", "medium", "low_extraction_confidence")
    summary = result.runs.first()
    assert (summary["total_checks"], summary["passed_checks"], summary["review_checks"]) == (12, 10, 1)
    assert summary["overall_status"] == "needs_review" and summary["matched_policy_id"] == 7
    assert summary["status_counts"] == {"passed": 10, "needs_review": 1, "skipped": 1}
    task = result.tasks.collect()
    assert [(x["title"], x["priority"], x["status"]) for x in task] == [
        ("Low Extraction Confidence", "medium", "open")]


def test_unmatched_gives_two_checks(spark):
    result = run(spark, number="Policy Number: POL-9")
    assert [r["rule_code"] for r in result.findings.orderBy("check_no").collect()] == [
        "REC012", "REC001"]
    assert result.runs.first()["matched_policy_count"] == 0


def test_cancelled_kept_when_asked(spark):
    got = checks(run(spark, {"record_status": "cancelled", "has_payment": False},
                     rec.Settings(exclude_cancelled=False)))
    assert got["REC011"] == ("failed", "medium", "missing_payment")


def test_canonical_policy(spark):
    rows = [(1, "P-1", "synthetic_policy_admin", "2026-01-01"), (2, "p-1", "legacy_import", "2026-02-01"),
            (3, "P-1", "legacy_import", "2026-01-15"), (4, "Q", "legacy_import", "2026-01-01")]
    df = spark.createDataFrame(rows, "id long, policy_number string, source_system string, c string")
    df = df.select("id", "policy_number", "source_system", F.to_timestamp("c").alias("created_at"),
                   *[F.lit(0).alias(c) for c in ("customer_id", "carrier_id", "plan_id", "premium")],
                   F.lit("active").alias("status"), F.current_date().alias("effective_date"))
    got = {r["number_key"]: (r["policy_id"], r["policy_matches"])
           for r in rec.canonical_policies(df).collect()}
    assert got == {"P-1": (3, 3), "Q": (4, 1)}


def test_run_totals_equal_summaries(spark):
    result = run(spark, confidence=0.6)
    a = rec.run_totals(result.findings).select("document_id", "total_checks", "passed_checks",
                                               "review_task_count", "overall_status").collect()
    b = result.runs.select("document_id", "total_checks", "passed_checks", "review_task_count",
                           "overall_status").collect()
    assert a == b


@pytest.mark.parametrize("record, lines", [
    ({}, {}), ({"has_payment": False}, {"premium": "Premium: 99.00"}),
    ({}, {"number": "Policy Number: POL-9"})])
def test_a_new_report_is_the_report_of_what_would_be_stored(spark, record, lines):
    made = run(spark, record, **lines)
    name, when = F.lit("a.pdf"), F.lit("2026-01-01 00:00:00").cast("timestamp")
    head = made.runs.select("run_id", name.alias("document_name"),
                            F.col("overall_status").alias("status"),
                            F.lit("policy_document").alias("reconciliation_type"),
                            when.alias("created_at"))
    want = report.flat_report(head, made.findings, made.tasks)
    got = new_report(made.checked, name, "policy_document", when)
    assert got.dtypes == want.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    # run, finding and task meet in the document's row
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") < want._jdf.queryExecution().optimizedPlan().toString().count("Join")


def test_only_the_wanted_columns_of_a_check_are_made(spark):
    from ledgerlens.model import Tables
    from ledgerlens.plans.business_queries import findings_of, reconciled
    t = Tables(spark, "/root/testdata/sf0.001")
    made = findings_of(t, "rule_code", "status")
    assert made.columns == ["document_id", "check_no", "rule_code", "status", "run_id",
                            "finding_id"]
    wanted = reconciled(t).findings.select("document_id", "rule_code", "status")
    assert sorted(made.select(*wanted.columns).collect()) == sorted(wanted.collect())


def test_pages_of_findings_need_no_shuffle_of_findings(spark):
    import __spark_entry__ as entry
    from conftest import DATA
    pages = spark.createDataFrame([(1, 1, 10), (1, 1, 12), (1, 2, 11), (2, None, 13), (2, 3, None)],
                                  "processing_run_id long, page_number int, page_id long")
    findings = spark.createDataFrame([(r, n) for r in (1, 2, 3) for n in (1, 2, 3, None)],
                                     "processing_run_id long, source_page_number int")
    plain = rec.attach_pages(findings, pages)
    in_row = findings.join(rec.page_ids(pages), "processing_run_id", "left").withColumn(
        "document_page_id", rec.page_of_finding()).select(plain.columns)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(plain) == rows(in_row) and (1, 1, 12) in rows(in_row)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, -1)
    try:
        plan = entry.queries()["jn11_finding_pages"](spark, DATA)._jdf.queryExecution().executedPlan()
        dealt = [x for x in plan.toString().splitlines() if "hashpartitioning(" in x]
        assert dealt and not [x for x in dealt if "source_page_number" in x]
    finally:
        spark.conf.set(key, before)
