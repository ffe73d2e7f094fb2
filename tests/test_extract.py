import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.extract import best_candidates, candidates, extract_documents, usable_pages

SCHEMA = "document_id long, page_id long, page_number int, text_content string, status string, " \
         "confidence_score double"
FULL = """Policy Number: POL-2026-0001
Policyholder Name: Ann Lee
Carrier: Aetna
Plan Name: Aetna Value HMO
Effective Date: March 14, 2026
Termination Date: 03/14/2027
Signature Date: 2026-03-01
Premium Amount: $1,250.50
Policy Status: In Force"""


def pages(spark, *rows):
    return spark.createDataFrame(
        [(d, i, n, text, "completed", c) for i, (d, n, text, c) in enumerate(rows)], SCHEMA)


def extract(spark, *rows, **options):
    out = extract_documents(usable_pages(pages(spark, *rows)), **options).collect()
    return {r["document_id"]: r for r in out}


def test_all_fields(spark):
    r = extract(spark, (1, 1, FULL, 0.98))[1]
    got = [r[n]["value"] for n in ("policy_number", "customer_name", "carrier_name", "plan_name",
                                   "effective_date", "termination_date", "signature_date", "premium",
                                   "policy_status")]
    assert got == ["POL-2026-0001", "Ann Lee", "Aetna", "Aetna Value HMO", "2026-03-14",
                   "2027-03-14", "2026-03-01", "1250.50", "active"]
    assert r["warnings"] == [] and r["page_count"] == 1
    assert r["policy_number"]["source_text"] == "Policy Number: POL-2026-0001"


def test_next_line_conflict_and_missing(spark):
    text = "Policy ID\n\n  PX-9001\nPolicy Number: PX-9002\nPremium: none\nPlanning ahead\nStatus"
    r = extract(spark, (1, 1, text, None))[1]
    assert r["policy_number"]["value"] == "PX-9002"  # the same line beats the next line
    assert r["plan_name"]["value"] == "ning ahead"
    assert r["policy_status"]["found"] is False
    assert r["warnings"] == [
        "Could not normalize premium value 'none' on page 1.",
        "Conflicting values found for policy_number: PX-9001, PX-9002. Selected PX-9002 from page 1.",
        "Required field customer_name was not found.",
        "Required field effective_date was not found.",
        "Required field premium was not found."]


def test_low_confidence(spark):
    r = extract(spark, (1, 1, "Carrier: Humana", 0.5))[1]
    assert r["carrier_name"]["confidence_score"] == 0.5
    assert "Low-confidence extraction for carrier_name: 0.50." in r["warnings"]


def test_unlabelled_number(spark):
    loose = "Reference pol-12345 for you"
    got = extract(
        spark, (1, 1, loose, None), (1, 2, "Policy Number: POL-777", None),
        (2, 1, "Policy Number: POL-777", None), (2, 2, loose, None),
        (3, 1, loose, 0.8), (4, 1, "nothing here", None))
    assert got[1]["policy_number"]["value"] == "POL-777"  # better confidence than 0.75
    assert "POL-12345, POL-777" in got[1]["warnings"][0]
    assert got[2]["policy_number"]["value"] == "POL-777" and not any(
        "Conflicting" in w for w in got[2]["warnings"])
    third = got[3]["policy_number"]
    assert (third["value"], third["confidence_score"], third["extraction_method"]) == (
        "POL-12345", 0.65, "fallback_pattern")
    assert third["source_text"] == loose
    assert got[4]["policy_number"]["found"] is False and got[4]["document_confidence"] == 0.0


@pytest.mark.parametrize("blank_pages", [0, 5000])
def test_first_unlabelled_number_counts_at_any_length(spark, blank_pages):
    loose = "Reference pol-12345 for you"
    more = [(1, n, "nothing", 1.0) for n in range(3, 3 + blank_pages)]
    r = extract(spark, (1, 1, loose, 0.8), (1, 2, loose, 1.0), *more)[1]
    found = r["policy_number"]
    assert (found["page_number"], found["confidence_score"]) == (1, 0.65)
    assert r["page_count"] == 2 + blank_pages


def test_best_candidates_combines_repeats(spark):
    found = candidates(pages(spark, (1, 1, "Carrier: A\nCarrier: A\nCarrier: B", None)))
    rows = best_candidates(found).where("value IS NOT NULL").agg(F.count("*")).first()[0]
    assert rows == 2


def test_bad_threshold(spark):
    with pytest.raises(ValueError):
        extract_documents(pages(spark, (1, 1, "x", None)), minimum_confidence=1.5)


def test_documents_are_shuffled_once_by_id_and_never_by_plan(spark):
    """Two hundred plan ids would pile all policies up in few tasks of a large table."""
    from conftest import DATA
    from ledgerlens.model import Tables
    from ledgerlens.operators.extract import extract_documents, usable_pages
    from ledgerlens.sources.rendered import policy_pages
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        df = extract_documents(usable_pages(policy_pages(Tables(spark, DATA))))
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert "hashpartitioning(plan_id" not in plan and "rule_no" in plan
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "rule_no" in x]
    assert plan.count("Exchange hashpartitioning(document_id") == 1


def test_labels_in_letters_that_fold_to_plain_ones(spark):
    from ledgerlens.operators.extract import FIELD_RULES, candidates
    text = "ſtatus: Active\nPOLICY NO. AB-123\nSigned Date: 2026-01-02\nıNSURED: Ann Lee"
    rows = candidates(spark.createDataFrame(
        [(1, 1, 1, 0.98, text)],
        "document_id long, page_number int, page_id long, confidence_score double, "
        "text_content string")).where("kind = 'label'").select("field").collect()
    assert {r["field"] for r in rows} == {
        "policy_status", "policy_number", "signature_date", "customer_name"}
    assert all(len(s) == 2 and s.isascii() for rule in FIELD_RULES for s in rule.starts)


def test_rules_that_do_not_hit_make_no_rows(spark):
    from ledgerlens.model import Tables
    from ledgerlens.operators.extract import candidates, usable_pages
    from ledgerlens.sources.rendered import policy_pages
    found = candidates(usable_pages(policy_pages(Tables(spark, "/root/testdata/sf0.001"))))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert any("hits" in line and "filter(" in line for line in plan.splitlines())


def test_rules_are_tried_in_compiled_code(spark):
    found = candidates(usable_pages(pages(spark, (1, 1, FULL, 0.98))))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # a lambda over the array of rules would have them all interpreted
    assert "filter(array(CASE" not in plan
    assert found.where("kind = 'label'").count() == 9


def test_statuses_inside_a_value(spark):
    texts = ["Status: now active or lapsed", "Status: pending lapse of x", "Status: notissued"]
    r = extract(spark, *[(i, 1, text, 0.9) for i, text in enumerate(texts)])
    assert [r[i]["policy_status"]["value"] for i in range(3)] == ["active", "pending", None]
