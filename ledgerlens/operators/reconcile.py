"""Twelve deterministic checks of a document against its policy record."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import full_name, identifier_key, text_key
from ledgerlens.functions.values import record_date, record_money, record_status
from ledgerlens.operators.extract import FIELD_NAMES, presence
from ledgerlens.operators.skew import lookup_join

FINDING = [
    "rule_code", "finding_type", "field_name", "status", "severity", "expected_value",
    "actual_value", "message", "business_policy_id", "source_text", "source_page_number",
    "source_page_id", "confidence_score", "evidence_data",
]


@dataclass(frozen=True)
class Settings:
    minimum_confidence: float = 0.75
    premium_tolerance: str = "0.01"
    exclude_cancelled: bool = True

    def __post_init__(self) -> None:
        if not 0 <= self.minimum_confidence <= 1:
            raise ValueError("minimum_confidence must be between 0 and 1")
        if float(self.premium_tolerance) < 0:
            raise ValueError("premium_tolerance must not be negative")


def canonical_policies(policies: DataFrame) -> DataFrame:
    """One record per policy number, and how many rows share the number.

    The first row by source system, creation time and id speaks for the number.
    Both parts are aggregates, so a number shared by very many rows is combined
    map-side instead of being ranked in one task.
    """
    order = F.struct("source_system", "created_at", "id")
    record = F.struct("id", "policy_number", "customer_id", "carrier_id", "plan_id", "status",
                      "premium", "effective_date")
    return (policies.where(F.col("policy_number").isNotNull())
            .groupBy(F.upper("policy_number").alias("number_key"))
            .agg(F.min(F.struct(order.alias("o"), record.alias("r"))).alias("first"),
                 F.count("*").alias("policy_matches"))
            .select("number_key", "policy_matches", "first.r.*")
            .withColumnsRenamed({"id": "policy_id", "status": "record_status",
                                 "premium": "record_premium",
                                 "effective_date": "record_effective"}))


def policies_with_posted_payment(payments: DataFrame) -> DataFrame:
    return payments.where(F.lower("status") == "posted").select("policy_id").distinct()


def policy_records(policies: DataFrame, payments: DataFrame, customers: DataFrame,
                   carriers: DataFrame, plans: DataFrame) -> DataFrame:
    """Canonical records with customer, carrier and plan names and the payment flag.

    Termination and signature dates are not kept by the business tables.
    """
    people = customers.select(F.col("id").alias("customer_id"),
                              full_name(F.col("first_name"), F.col("last_name"))
                              .alias("record_customer"))
    firms = carriers.select(F.col("id").alias("carrier_id"), F.col("name").alias("record_carrier"))
    offers = plans.select(F.col("id").alias("plan_id"), F.col("name").alias("record_plan"))
    paid = policies_with_posted_payment(payments).withColumn("has_payment", F.lit(True))
    return (canonical_policies(policies)
            .join(paid, "policy_id", "left").join(people, "customer_id", "left")
            .join(firms, "carrier_id", "left").join(offers, "plan_id", "left")
            .select("number_key", "policy_id", "policy_number", "policy_matches",
                    "record_customer", "record_carrier", "record_plan", "record_status",
                    "record_premium", "record_effective",
                    F.lit(None).cast("date").alias("record_termination"),
                    F.lit(None).cast("date").alias("record_signature"),
                    F.coalesce("has_payment", F.lit(False)).alias("has_payment")))


def match_policies(extraction: DataFrame, records: DataFrame, spread_by: str = "document_id",
                   hot: list = ()) -> DataFrame:
    """Documents with the record their number names, case ignored; none when absent."""
    keyed = (extraction.withColumnsRenamed({n: f"x_{n}" for n in FIELD_NAMES})
             .withColumn("match_key", F.upper(presence(F.col("x_policy_number.value")))))
    return lookup_join(keyed, records, "match_key", "number_key", [spread_by], "left", hot)


def _keys(matched: DataFrame) -> DataFrame:
    """Comparison keys as columns of their own, so each is computed once."""
    value = lambda name: F.col(f"x_{name}.value")
    money = lambda c: c.cast("decimal(38,2)")
    keyed = matched.withColumns({
        "k_status_words": text_key(F.col("record_status")),
        "k_e_customer": text_key(F.col("record_customer")),
        "k_a_customer": text_key(value("customer_name")),
        "k_e_carrier": text_key(F.col("record_carrier")),
        "k_a_carrier": text_key(value("carrier_name")),
        "k_e_plan": text_key(F.col("record_plan")),
        "k_a_plan": text_key(value("plan_name")),
        "k_a_status": text_key(value("policy_status")),
        "k_e_effective": record_date(F.col("record_effective")),
        "k_a_effective": record_date(value("effective_date")),
        "k_e_termination": record_date(F.col("record_termination")),
        "k_a_termination": record_date(value("termination_date")),
        "k_e_signature": record_date(F.col("record_signature")),
        "k_a_signature": record_date(value("signature_date")),
        "k_e_premium": money(record_money(F.col("record_premium"))),
        "k_a_premium": money(record_money(value("premium"))),
    })
    return (keyed.withColumn("k_record_status", record_status(F.col("k_status_words")))
            .withColumn("k_e_status", F.replace("k_record_status", F.lit("_"), F.lit(" ")))
            .withColumn("k_gap", F.abs(F.col("k_e_premium") - F.col("k_a_premium"))))


def _cases(*branches: tuple[str, str], otherwise: str) -> str:
    """SQL CASE over (condition, value) pairs tried in order."""
    return "CASE " + " ".join(f"WHEN {t} THEN {v}" for t, v in branches) + f" ELSE {otherwise} END"


def _text(value: str) -> str:
    return f"'{value}'"


def _texts(*branches: tuple[str, str], otherwise: str) -> str:
    return _cases(*[(t, _text(v)) for t, v in branches], otherwise=_text(otherwise))


NO_EVIDENCE = "CAST(map() AS MAP<STRING, STRING>)"


def _finding(rule: str, kind: str, field: str | None, status: str, severity: str, expected: str,
             actual: str, message: str, policy: str = "policy_id", source: str | None = None,
             evidence: str = NO_EVIDENCE) -> dict[str, str]:
    """SQL of one check by column; arguments are SQL expressions except rule, field and source."""
    part = lambda name: f"x_{source}.{name}" if source else "NULL"
    return {
        "rule_code": _text(rule), "finding_type": kind,
        "field_name": _text(field) if field else "CAST(NULL AS STRING)",
        "status": status, "severity": severity,
        "expected_value": f"CAST({expected} AS STRING)",
        "actual_value": f"CAST({actual} AS STRING)", "message": message,
        "business_policy_id": f"CAST({policy} AS BIGINT)",
        "source_text": f"CAST({part('source_text')} AS STRING)",
        "source_page_number": f"CAST({part('page_number')} AS INT)",
        "source_page_id": f"CAST({part('page_id')} AS BIGINT)",
        "confidence_score": f"CAST({part('confidence_score')} AS DOUBLE)",
        "evidence_data": evidence}


def _struct(cells: dict[str, str], fields: tuple) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {cells[k]}" for k in fields) + ")"


def _comparison(rule: str, field: str, label: str, expected_key: str, actual_key: str,
                expected: str, actual: str, severity: str, required: bool,
                date: bool = False) -> dict[str, str]:
    """Two keys that must agree; a missing side asks for a review."""
    neither = f"{expected_key} IS NULL AND {actual_key} IS NULL"
    no_record, no_document = f"{expected_key} IS NULL", f"{actual_key} IS NULL"
    equal = f"{expected_key} = {actual_key}"
    status = _texts((neither, "needs_review" if required else "skipped"),
                    (no_record, "needs_review"), (no_document, "needs_review"),
                    (equal, "passed"), otherwise="failed")
    level = _texts((neither, severity if required else "info"), (no_record, severity),
                   (no_document, severity), (equal, "info"), otherwise=severity)
    only_document = (f"The database does not contain a usable {label}." if date else
                     f"The document contains {label}, but the database value is missing.")
    message = _texts(
        (neither, f"{label} is unavailable in both the document and database."),
        (no_record, only_document),
        (no_document, f"The document does not contain a usable {label}"
                      + ("." if date else " value.")),
        (equal, f"{label} matches the database."),
        otherwise=f"{label} differs between the document and database.")
    evidence = NO_EVIDENCE if date else _cases(
        (f"{expected_key} <> {actual_key}",
         f"map('normalized_expected', {expected_key}, 'normalized_actual', {actual_key})"),
        otherwise=NO_EVIDENCE)
    return _finding(rule, _text(field), field, status, level, expected_key if date else expected,
                    actual_key if date else actual, message, source=field, evidence=evidence)


def check_documents(matched: DataFrame, settings: Settings = Settings(),
                    fields: tuple = tuple(FINDING)) -> DataFrame:
    """Each document with its array of checks: two without a record, else twelve.

    ``fields`` are the columns of a check that the caller reads; others are not made.
    """
    floor = settings.minimum_confidence
    weak = ", ".join(f"CASE WHEN x_{n}.confidence_score < {floor}D THEN '{n}' END"
                     for n in FIELD_NAMES)
    left_out = ("coalesce(k_record_status = 'cancelled', false)"
                if settings.exclude_cancelled else "false")
    keyed = _keys(matched).withColumns({
        "k_weak": F.expr(f"array_compact(array({weak}))"),
        "k_same": F.coalesce(identifier_key(F.col("policy_number"))
                             == identifier_key(F.col("x_policy_number.value")), F.lit(False)),
        "k_left_out": F.expr(left_out),
    }).withColumn("k_good", F.expr(f"document_confidence >= {floor}D AND size(k_weak) = 0"))

    quality = _finding(
        "REC012", _texts(("k_good", "extraction_confidence"), otherwise="low_extraction_confidence"),
        None, _texts(("k_good", "passed"), otherwise="needs_review"),
        _texts(("k_good", "info"), otherwise="medium"), _text(str(floor)), "document_confidence",
        _texts(("k_good", "Document extraction confidence meets the required threshold."),
               otherwise="Document extraction confidence is below the required threshold."),
        "NULL", None, _cases(
            ("k_good", "map('low_confidence_fields', '[]')"),
            otherwise="map('low_confidence_fields', to_json(k_weak), 'extraction_warnings', "
                      "to_json(warnings))"))
    unmatched = _finding(
        "REC001", _text("unmatched_policy"), "policy_number", _text("failed"), _text("high"),
        _text("Existing policy record"), "x_policy_number.value",
        _text("No database policy matched the extracted policy number."), "NULL", "policy_number")
    number = _finding(
        "REC001", _texts(("k_same", "policy_match"), otherwise="policy_number_mismatch"),
        "policy_number", _texts(("k_same", "passed"), otherwise="failed"),
        _texts(("k_same", "info"), otherwise="high"), "policy_number", "x_policy_number.value",
        _texts(("k_same", "Policy number matches the database."),
               otherwise="Policy number differs between the document and database."),
        source="policy_number")
    many = "policy_matches > 1"
    unique = _finding(
        "REC002", _texts((many, "duplicate_policy_number"), otherwise="unique_policy_number"),
        "policy_number", _texts((many, "needs_review"), otherwise="passed"),
        _texts((many, "high"), otherwise="info"), _text("1"), "policy_matches",
        _texts((many, "Multiple database policies share this policy number."),
               otherwise="The policy number identifies one database record."),
        source="policy_number")

    unsigned, untracked = "k_a_signature IS NULL", "k_e_signature IS NULL"
    agree = "k_a_signature = k_e_signature"
    signature = _finding(
        "REC008",
        _texts((unsigned, "missing_signature"), (untracked, "signature_present"),
               (agree, "signature_date_match"), otherwise="signature_date_mismatch"),
        "signature_date",
        _texts((unsigned, "needs_review"), (untracked, "passed"), (agree, "passed"),
               otherwise="failed"),
        _texts((unsigned, "high"), (untracked, "info"), (agree, "info"), otherwise="high"),
        _cases((unsigned, "k_e_signature"), (untracked, _text("true")), otherwise="k_e_signature"),
        "k_a_signature",
        _texts((unsigned, "The document does not contain a valid signature date."),
               (untracked, "The document contains a valid signature date."),
               (agree, "Signature date matches the database."),
               otherwise="Signature date differs between the document and database."),
        source="signature_date", evidence=_cases(
            ("k_a_signature IS NOT NULL AND k_e_signature IS NULL",
             "map('database_signature_date_tracked', 'false')"),
            otherwise=NO_EVIDENCE))

    tolerance = f"CAST('{settings.premium_tolerance}' AS DECIMAL(38,2))"
    no_record, no_document = "k_e_premium IS NULL", "k_a_premium IS NULL"
    close = f"k_gap <= {tolerance}"
    premium = _finding(
        "REC009",
        _texts((no_record, "premium_missing_database"), (no_document, "premium_missing_document"),
               (close, "premium_match"), otherwise="premium_mismatch"),
        "premium",
        _texts((no_record, "needs_review"), (no_document, "needs_review"), (close, "passed"),
               otherwise="failed"),
        _texts((no_record, "high"), (no_document, "high"), (close, "info"), otherwise="high"),
        "k_e_premium", "k_a_premium",
        _texts((no_record, "The database premium is missing or invalid."),
               (no_document, "The document premium is missing or invalid."),
               (close, "Premium matches within the configured tolerance."),
               otherwise="Premium differs by more than the configured tolerance."),
        source="premium", evidence=_cases(
            (f"{no_record} OR {no_document}", NO_EVIDENCE),
            otherwise=f"map('difference', CAST(k_gap AS STRING), 'tolerance', "
                      f"CAST({tolerance} AS STRING))"))

    unknown, active = "has_payment IS NULL", "k_record_status = 'active'"
    payment = _finding(
        "REC011",
        _texts(("k_left_out", "payment_presence"), (unknown, "payment_presence_unknown"),
               ("has_payment", "payment_presence"), otherwise="missing_payment"),
        None,
        _texts(("k_left_out", "skipped"), (unknown, "needs_review"), ("has_payment", "passed"),
               otherwise="failed"),
        _texts(("k_left_out", "info"), (unknown, "medium"), ("has_payment", "info"),
               (active, "high"), otherwise="medium"),
        _text("true"), "has_payment",
        _texts(("k_left_out", "Payment validation was skipped because the policy is cancelled."),
               (unknown, "Payment availability could not be determined."),
               ("has_payment", "The policy has at least one associated payment."),
               otherwise="The policy does not have an associated payment."),
        evidence="map('policy_status', k_record_status)")

    checks = [
        quality, number, unique,
        _comparison("REC003", "customer_name", "Customer name", "k_e_customer", "k_a_customer",
                    "record_customer", "x_customer_name.value", "high", True),
        _comparison("REC004", "carrier_name", "Carrier name", "k_e_carrier", "k_a_carrier",
                    "record_carrier", "x_carrier_name.value", "medium", False),
        _comparison("REC005", "plan_name", "Plan name", "k_e_plan", "k_a_plan",
                    "record_plan", "x_plan_name.value", "medium", False),
        _comparison("REC006", "effective_date", "Effective date", "k_e_effective",
                    "k_a_effective", "", "", "high", True, date=True),
        _comparison("REC007", "termination_date", "Termination date", "k_e_termination",
                    "k_a_termination", "", "", "medium", False, date=True),
        signature, premium,
        _comparison("REC010", "policy_status", "Policy status", "k_e_status", "k_a_status",
                    "k_record_status", "x_policy_status.value", "medium", False),
        payment,
    ]
    array = lambda *made: f"array({', '.join(_struct(c, fields) for c in made)})"
    results = F.expr(f"CASE WHEN policy_id IS NULL THEN {array(quality, unmatched)} "
                     f"ELSE {array(*checks)} END")
    return keyed.withColumn("results", results)


def unfold(checked: DataFrame, keep: tuple = ()) -> DataFrame:
    """One row per document and check; ``keep`` names further columns of the document."""
    return (checked.select("document_id", *keep,
                           F.posexplode_outer("results").alias("check_no", "check"))
            .select("document_id", *keep, "check_no", "check.*"))


def evaluate(matched: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Findings of every document: the checks are one array that is unfolded, not
    twelve unions."""
    return unfold(check_documents(matched, settings))


def overall_status() -> Column:
    return F.expr("CASE WHEN exists(results, r -> r.status IN ('failed', 'needs_review')) "
                  "THEN 'needs_review' ELSE 'completed' END")


def summaries(checked: DataFrame) -> DataFrame:
    """Run summary per document, counted inside its row of checks: no shuffle."""
    def n(test: str) -> str:
        return f"CAST(size(filter(results, r -> {test})) AS BIGINT)"

    counts = {f"{name}_checks": n(f"r.status = '{status}'") for name, status in (
        ("passed", "passed"), ("failed", "failed"), ("review", "needs_review"),
        ("skipped", "skipped"))}
    by = lambda column, values: "map_filter(map(" + ", ".join(
        f"'{v}', {n(f'r.{column} = {chr(39)}{v}{chr(39)}')}" for v in values
    ) + "), (k, c) -> c > 0)"
    return checked.select(
        "document_id", F.size("results").cast("long").alias("total_checks"),
        *[F.expr(text).alias(name) for name, text in counts.items()],
        F.expr(n("r.status IN ('failed', 'needs_review') AND r.severity IN ('high', 'medium')"))
        .alias("review_task_count"),
        F.expr(by("status", ["passed", "failed", "needs_review", "skipped"])).alias("status_counts"),
        F.expr(by("severity", ["high", "medium", "low", "info"])).alias("severity_counts"),
        overall_status().alias("overall_status"),
        F.col("policy_id").alias("matched_policy_id"),
        F.col("x_policy_number.value").alias("extracted_policy_number"),
        "document_confidence", "warnings",
        F.coalesce("policy_matches", F.lit(0)).alias("matched_policy_count"))


# Which checks open a task, and what the task shows of its check.
NEEDS_TASK = ("({at}status IN ('failed', 'needs_review') "
              "AND {at}severity IN ('high', 'medium'))")
SHOWN_BY_TASK = ("rule_code", "finding_type", "field_name", "status", "severity", "message")


def needs_task() -> Column:
    return F.expr(NEEDS_TASK.format(at=""))


def task_priority(severity: Column) -> Column:
    return F.when(severity.isin("high", "medium"), severity).otherwise("low")


def task_title(finding_type: Column) -> Column:
    words = F.initcap(F.trim(F.replace(finding_type, F.lit("_"), F.lit(" "))))
    return F.substring(F.coalesce(F.nullif(words, F.lit("")), F.lit("Reconciliation Review")),
                       1, 255)


def finding_id() -> Column:
    return F.sha2(F.concat_ws("|", "run_id", "rule_code"), 256)


def task_id() -> Column:
    return F.sha2(F.concat_ws("|", F.lit("task"), "finding_id"), 256)


def with_new_tasks(findings: DataFrame) -> DataFrame:
    """Every finding with the task that ``review_tasks`` opens for it, made in its own row."""
    mine = {"review_task_id": task_id(), "review_status": F.lit("open"),
            "review_priority": task_priority(F.col("severity"))}
    empty = {c: "string" for c in ("assigned_to_user_id", "resolution_notes", "corrected_value",
                                   "resolved_by_user_id")} | {"resolved_at": "timestamp"}
    return findings.withColumns(
        {name: F.when(needs_task(), value) for name, value in mine.items()}
        | {name: F.lit(None).cast(kind) for name, kind in empty.items()})


def review_tasks(findings: DataFrame, *keep: str) -> DataFrame:
    """One open task per finding that a person must look at; ``keep`` names further columns."""
    return findings.where(needs_task()).select(
        task_id().alias("task_id"),
        "run_id", "finding_id", "document_id", F.lit("open").alias("status"),
        task_priority(F.col("severity")).alias("priority"),
        task_title(F.col("finding_type")).alias("title"),
        F.col("message").alias("description"),
        F.lit(None).cast("string").alias("assigned_to_user_id"),
        F.lit(None).cast("string").alias("resolution_notes"),
        F.lit(None).cast("string").alias("corrected_value"),
        F.lit(None).cast("string").alias("resolved_by_user_id"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
        F.map_from_arrays(
            F.array(*[F.lit(k) for k in ("rule_code", "finding_type", "field_name", "severity")]),
            F.array("rule_code", "finding_type", "field_name", "severity"))
        .alias("extra_metadata"), *keep)


def page_of_finding() -> Column:
    """Page id of a finding whose row has the ``page_ids`` of its run."""
    return F.try_element_at("page_ids", F.col("source_page_number"))


def page_ids(pages: DataFrame) -> DataFrame:
    """The page ids of each run by page number, in one row."""
    numbered = pages.where(F.col("page_number").isNotNull()).groupBy(
        "processing_run_id", "page_number").agg(F.max("page_id").alias("page_id"))
    return numbered.groupBy("processing_run_id").agg(F.map_from_entries(F.collect_list(
        F.struct("page_number", "page_id"))).alias("page_ids"))


def attach_pages(findings: DataFrame, pages: DataFrame) -> DataFrame:
    """Page id of each finding by run and source page number."""
    keys = pages.groupBy("processing_run_id", "page_number").agg(
        F.max("page_id").alias("document_page_id"))
    return findings.join(
        keys.withColumnRenamed("page_number", "source_page_number"),
        ["processing_run_id", "source_page_number"], "left")


def run_totals(findings: DataFrame, key: str = "document_id") -> DataFrame:
    """Counts per run, by status and by severity, and the overall status."""
    has = lambda column, value: F.count_if(F.col(column) == value)
    counts = findings.groupBy(key).agg(
        F.count("*").alias("total_checks"),
        has("status", "passed").alias("passed_checks"),
        has("status", "failed").alias("failed_checks"),
        has("status", "needs_review").alias("review_checks"),
        has("status", "skipped").alias("skipped_checks"),
        *[has("severity", s).alias(f"n_{s}") for s in ("high", "medium", "low", "info")],
        F.count_if(needs_task()).alias("review_task_count"),
        F.max("business_policy_id").alias("matched_policy_id"))

    def non_zero(names: dict[str, str]) -> Column:
        entries = [F.struct(F.lit(label).alias("k"), F.col(column).alias("v"))
                   for label, column in names.items()]
        return F.map_from_entries(F.filter(F.array(*entries), lambda x: x["v"] > 0))

    return counts.select(
        key, "total_checks", "passed_checks", "failed_checks", "review_checks",
        "skipped_checks", "review_task_count", "matched_policy_id",
        non_zero({"passed": "passed_checks", "failed": "failed_checks",
                  "needs_review": "review_checks", "skipped": "skipped_checks"})
        .alias("status_counts"),
        non_zero({s: f"n_{s}" for s in ("high", "medium", "low", "info")})
        .alias("severity_counts"),
        F.when(F.col("failed_checks") + F.col("review_checks") > 0, "needs_review")
        .otherwise("completed").alias("overall_status"))
