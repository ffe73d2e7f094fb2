"""Registered queries over business records and their reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.serialise import json_safe_rows, report_text
from ledgerlens.functions.text import full_name, identifier_key
from ledgerlens.functions.values import document_date, document_money, record_date, record_money
from ledgerlens.model import WORKSPACE, Tables
from ledgerlens.operators import catalogue, listing, portfolio, quality, report, tenants
from ledgerlens.operators import reconcile as rec
from ledgerlens.operators.extract import (
    FIELD_NAMES, best_candidates, candidates, extract_documents, flat_fields, page_lines,
    usable_pages, with_fallback)
from ledgerlens.operators.search import active_runs, latest_completed
from ledgerlens.operators.skew import running_start
from ledgerlens.plans.corpus import (
    Reconciliation, checked_runs, identified, new_report, reconcile_pages, with_page_ids)
from ledgerlens.plans.questions import capped
from ledgerlens.plans.registry import query
from ledgerlens.session import cut_lineage, scratch_path
from ledgerlens.sources import generator, run_store, sinks
from ledgerlens.sources.rendered import policy_pages

W = WORKSPACE
HOUR = 3600


def money(c: str):
    return F.col(c).cast("decimal(38,2)").cast("string").alias(c)


def iso(c: str):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def records(t: Tables) -> DataFrame:
    return rec.policy_records(t.policies(), t.payments(), t.customers(), t.carriers(),
                              t.policy_plans())


def reconciled(t: Tables) -> Reconciliation:
    return reconcile_pages(policy_pages(t), records(t))


def findings_of(t: Tables, *fields: str) -> DataFrame:
    """Findings with only these columns of their checks."""
    extraction = extract_documents(usable_pages(policy_pages(t)))
    checked = rec.check_documents(rec.match_policies(extraction, records(t)), fields=fields)
    return identified(rec.unfold(checked))


def numbered_log(t: Tables) -> DataFrame:
    """The run log with attempt numbers, which the given events lack.

    Counted inside hours and over the hours' totals, so that a document with very many
    attempts is never one window.
    """
    log = t.run_log().withColumns({"second": F.coalesce(F.unix_seconds("created_at"), F.lit(0)),
                                   "one": F.lit(1)})
    placed = running_start(log, ["document_id"], ["created_at", "id"], "second", "one",
                           "earlier", HOUR)
    return placed.withColumn("attempt_number", F.col("earlier") + 1).drop(
        "second", "one", "earlier")


# --- business tables and the eight portfolio questions -------------------------------------

@query("src1_business_tables", """
SELECT id, policy_number, status, CAST(premium AS VARCHAR) AS premium,
    strftime(effective_date, '%Y-%m-%d') AS effective_date, carrier_id FROM policies""",
       ["policies"])
def _(t):
    return t.policies().select("id", "policy_number", "status", money("premium"),
                               iso("effective_date"), "carrier_id")


@query("src2_workspace_totals", """
SELECT CASE WHEN id % 2 = 0 THEN '11111111-1111-4111-8111-111111111111'
    ELSE '22222222-2222-4222-8222-222222222222' END AS workspace_id, count(*) AS policies,
    CAST(sum(premium) AS VARCHAR) AS total_premium FROM policies GROUP BY 1""", ["policies"])
def _(t):
    from ledgerlens.model import SECOND_WORKSPACE
    two = t.policy_core().withColumn("workspace_id", F.when(F.col("id") % 2 == 0, W)
                                     .otherwise(SECOND_WORKSPACE))
    return two.groupBy("workspace_id").agg(
        F.count("*").alias("policies"),
        F.sum("premium").cast("decimal(38,2)").cast("string").alias("total_premium"))


_TENANT_SQL = """
tenants(w, odd, tail) AS (VALUES ('11111111-1111-4111-8111-111111111111', 0, ''),
    ('22222222-2222-4222-8222-222222222222', 1, ' B')),
own_policies AS (SELECT w, p.* FROM policies p JOIN tenants ON id % 2 = odd),
own_payments AS (SELECT w, y.* FROM payments y JOIN tenants ON (policy_id % 3 = 0)::INT = odd),
own_commissions AS (SELECT w, c.* FROM commissions c
    JOIN tenants ON (policy_id % 3 = 0)::INT = odd),
own_carriers AS (SELECT w, n_nationkey AS carrier_id, n_name || tail AS name FROM nation, tenants),
own_agents AS (SELECT w, s_suppkey AS agent_id, s_name || tail AS name FROM supplier, tenants)
"""


@query("src2_two_tenants", f""", {_TENANT_SQL}
SELECT w AS workspace_id, 'policies_by_carrier' AS question, name, count(*) AS n,
    CAST(NULL AS VARCHAR) AS total FROM own_policies JOIN own_carriers USING (w, carrier_id)
GROUP BY ALL
UNION ALL SELECT y.w, 'payments_by_carrier', name, count(*),
    CAST(CAST(sum(amount) AS DECIMAL(38,2)) AS VARCHAR) FROM own_payments y
    JOIN own_policies p ON p.w = y.w AND p.id = y.policy_id
    JOIN own_carriers c ON c.w = y.w AND c.carrier_id = p.carrier_id GROUP BY y.w, name
UNION ALL SELECT w, 'commissions_by_agent', name, count(*),
    CAST(CAST(sum(net_amount) AS DECIMAL(38,2)) AS VARCHAR) FROM own_commissions
    JOIN own_agents USING (w, agent_id) GROUP BY w, name""",
       ["policies", "payments", "commissions"])
def _(t):
    """Two tenants whose ids cross: carriers and agents have the same ids under other names,
    and a third of each tenant's payments belong to policies of the other one."""
    from ledgerlens.model import SECOND_WORKSPACE
    by = lambda odd: F.when(odd, SECOND_WORKSPACE).otherwise(W)
    twice = lambda df: df.withColumn("workspace_id", F.explode(
        F.array(F.lit(W), F.lit(SECOND_WORKSPACE)))).withColumn("name", F.concat(
            "name", F.when(F.col("workspace_id") == W, "").otherwise(" B")))
    stored = {
        "policies": t.policies().withColumn("workspace_id", by(F.col("id") % 2 == 1)),
        "payments": t.payments().withColumn("workspace_id", by(F.col("policy_id") % 3 == 0)),
        "commissions": t.commissions().withColumn("workspace_id", by(F.col("policy_id") % 3 == 0)),
        "carriers": twice(t.carriers()), "agents": twice(t.agents())}
    folder = scratch_path(t.spark, "tenants")
    tenants.write_tables(stored, folder)
    own = tenants.read_tables(t.spark, folder, list(stored))
    out = None
    for w in (W, SECOND_WORKSPACE):
        answers = {
            "policies_by_carrier": portfolio.policies_by_carrier(
                own["policies"], own["carriers"], w).withColumn("total", F.lit(None)),
            "payments_by_carrier": portfolio.payments_by_carrier(
                own["payments"], own["policies"], own["carriers"], w),
            "commissions_by_agent": portfolio.commissions_by_agent(
                own["commissions"], own["agents"], None, w)}
        for question, df in answers.items():
            name, n, total = tenants.require_tenant(df, w).columns
            part = df.select(
                F.lit(w).alias("workspace_id"), F.lit(question).alias("question"),
                F.col(name).alias("name"), F.col(n).alias("n"),
                F.col(total).cast("decimal(38,2)").cast("string").alias("total"))
            out = part if out is None else out.unionAll(part)
    return out


_COLUMNS = {
    "insurance_carriers": ("nation", {"id": "n_nationkey", "name": "n_name",
                                      "workspace_id": "1"}),
    "insurance_plans": ("part", {"id": "p_partkey", "carrier_id": "p_partkey", "name": "p_name",
                                 "plan_type": "p_type", "monthly_premium": "p_retailprice",
                                 "workspace_id": "1"}),
    "insurance_agents": ("supplier", {"id": "s_suppkey", "name": "s_name", "workspace_id": "1"}),
    "insurance_customers": ("customer", {"id": "c_custkey", "name": "c_name",
                                         "first_name": "c_name", "last_name": "c_name",
                                         "workspace_id": "1"}),
    "insurance_policies": ("orders JOIN customer ON o_custkey = c_custkey", {
        "id": "o_orderkey", "policy_number": "o_orderkey", "customer_id": "o_custkey",
        "plan_id": "o_orderkey", "status": "o_orderkey", "premium": "o_totalprice",
        "effective_date": "o_orderdate", "created_at": "o_orderdate", "source_system": "o_orderkey",
        "source_record_id": "o_orderkey", "carrier_id": "c_nationkey", "workspace_id": "1"}),
    "insurance_payments": ("lineitem", {"id": "l_orderkey", "policy_id": "l_orderkey",
                                        "amount": "l_extendedprice", "status": "1",
                                        "payment_date": "l_shipdate", "workspace_id": "1"}),
    "insurance_commissions": ("lineitem", {"id": "l_orderkey", "policy_id": "l_orderkey",
                                           "agent_id": "l_suppkey", "net_amount": "l_discount",
                                           "workspace_id": "1"}),
}
_TARGETS = {"carrier_id": "insurance_carriers", "policy_id": "insurance_policies", "agent_id": "insurance_agents",
            "customer_id": "insurance_customers", "plan_id": "insurance_plans"}


def _catalogue_sql() -> str:
    parts = []
    for table, (source, columns) in _COLUMNS.items():
        for name, raw in columns.items():
            target = _TARGETS.get(name, "NULL")
            target = target if target == "NULL" else f"'{target}'"
            parts.append(f"SELECT '{table}' AS table_name, '{name}' AS column_name, "
                         f"{'true' if name == 'id' else 'false'} AS primary_key, "
                         f"CAST({target} AS VARCHAR) AS references_table, "
                         f"count({raw}) AS non_null_rows FROM {source}")
    return " UNION ALL ".join(parts)


@query("src7_catalogue", _catalogue_sql())
def _(t):
    tables = t.business_tables()
    described = catalogue.catalogue(t.spark, tables)
    counts = None
    for name, df in tables.items():
        one = df.agg(*[F.count(c).alias(c) for c in df.columns])
        cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("non_null_rows"))
                          for c in df.columns])
        part = one.select(F.lit(name).alias("table_name"), F.explode(cells).alias("x")).select(
            "table_name", "x.*")
        counts = part if counts is None else counts.unionAll(part)
    return described.join(counts, ["table_name", "column_name"]).select(
        "table_name", "column_name", "primary_key", "references_table", "non_null_rows")


@query("ag1_policies_by_status",
       "SELECT status, count(*) AS policy_count FROM policies GROUP BY 1 ORDER BY 2 DESC, 1",
       ["policies"])
def _(t):
    return portfolio.policies_by_status(t.policy_core(), W)


@query("ag2_active_policy_count",
       "SELECT count(*) AS active_policy_count FROM policies WHERE status = 'active'", ["policies"])
def _(t):
    return portfolio.active_policy_count(t.policy_core(), W)


@query("ag3_policies_by_carrier", """
SELECT n_name AS carrier_name, count(*) AS policy_count FROM policies
JOIN nation ON n_nationkey = carrier_id GROUP BY 1""", ["policies"])
def _(t):
    return portfolio.policies_by_carrier(t.policies(), t.carriers(), W)


@query("ag4_active_without_payments", """
SELECT id AS policy_id, policy_number, status FROM policies
WHERE status = 'active' AND id NOT IN (SELECT policy_id FROM payments)""",
       ["policies", "payments"])
def _(t):
    return portfolio.active_without_payments(t.policy_core(), t.payments(), W)


@query("ag5_duplicate_policy_numbers", """
SELECT policy_number, count(*) AS duplicate_count FROM policies GROUP BY 1 HAVING count(*) > 1""",
       ["policies"])
def _(t):
    return portfolio.duplicate_policy_numbers(t.policy_core(), W)


@query("ag6_payments_by_carrier", """
SELECT n_name AS carrier_name, count(*) AS payment_count,
    CAST(CAST(sum(amount) AS DECIMAL(38,2)) AS VARCHAR) AS total_payment_amount
FROM payments y JOIN policies p ON p.id = y.policy_id JOIN nation ON n_nationkey = p.carrier_id
GROUP BY 1""", ["policies", "payments"])
def _(t):
    return portfolio.payments_by_carrier(t.payments(), t.policies(), t.carriers(), W).select(
        "carrier_name", "payment_count", money("total_payment_amount"))


@query("ag7_commissions_by_agent", """
SELECT s_name AS agent_name, count(*) AS commission_count,
    CAST(CAST(sum(net_amount) AS DECIMAL(38,2)) AS VARCHAR) AS total_commission_amount
FROM commissions JOIN supplier ON s_suppkey = agent_id GROUP BY 1""", ["commissions"])
def _(t):
    return portfolio.commissions_by_agent(t.commissions(), t.agents(), None, W).select(
        "agent_name", "commission_count", money("total_commission_amount"))


@query("jn3_commissions_through_policies", """
SELECT s_name AS agent_name, count(*) AS commission_count,
    CAST(CAST(sum(net_amount) AS DECIMAL(38,2)) AS VARCHAR) AS total_commission_amount
FROM commissions c JOIN policies p ON p.id = c.policy_id JOIN supplier ON s_suppkey = p.id % 10
GROUP BY 1""", ["policies", "commissions"])
def _(t):
    held = t.policy_core().withColumn("agent_id", F.col("id") % 10)
    return portfolio.commissions_by_agent(
        t.commissions().drop("agent_id"), t.agents(), held, W).select(
        "agent_name", "commission_count", money("total_commission_amount"))


@query("ag8_recent_policies", """
SELECT id AS policy_id, policy_number, status, strftime(effective_date, '%Y-%m-%d')
    AS effective_date, CAST(premium AS VARCHAR) AS premium FROM policies""", ["policies"])
def _(t):
    return portfolio.recent_policies(t.policy_core(), W).select(
        "policy_id", "policy_number", "status", iso("effective_date"), money("premium"))


@query("tk2_row_cap", """
SELECT id AS policy_id, policy_number, true AS limit_reached FROM policies
ORDER BY effective_date DESC, policy_number, id LIMIT 500""", ["policies"])
def _(t):
    return capped(portfolio.recent_policies(t.policy_core(), W), 500).select(
        "policy_id", "policy_number", "limit_reached")


@query("tk3_listing_page", """
SELECT id, status FROM run_log ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 100""",
       ["run_log"])
def _(t):
    return listing.page_of(t.run_log(), 100, 50).select("id", "status")


@query("st1_set_operations", """
SELECT 'union' AS kind, count(*) AS rows FROM (SELECT policy_id FROM payments UNION
    SELECT id FROM policies)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT policy_id FROM payments INTERSECT
    SELECT id FROM policies)
UNION ALL SELECT 'except', count(*) FROM (SELECT id FROM policies EXCEPT
    SELECT policy_id FROM payments)""", ["policies", "payments"])
def _(t):
    policies, payments = t.policy_core().select("id"), t.payments().select("policy_id")
    kinds = {"union": payments.union(policies).distinct(),
             "intersect": payments.intersect(policies), "except": policies.exceptAll(
                 payments.distinct())}
    out = None
    for kind, df in kinds.items():
        part = df.agg(F.count("*").alias("rows")).select(F.lit(kind).alias("kind"), "rows")
        out = part if out is None else out.unionAll(part)
    return out


@query("jn12_commission_base", """
SELECT p.id AS policy_id, count(*) AS commissions,
    CAST(CAST(sum(round(amount * 0.20, 2)) AS DECIMAL(38,2)) AS VARCHAR) AS gross_amount
FROM payments y JOIN policies p ON p.id = y.policy_id GROUP BY 1""", ["policies", "payments"])
def _(t):
    keyed = t.payments().select(
        F.concat(F.lit("POLREC-"), F.col("policy_id").cast("string")).alias("source_record_id"),
        F.round(F.col("amount") * F.lit("0.20").cast("decimal(4,2)"), 2).alias("gross"))
    per_key = keyed.groupBy("source_record_id").agg(F.count("*").alias("commissions"),
                                                    F.sum("gross").alias("gross_amount"))
    resolved, _ = generator.resolve_keys(
        per_key, t.policy_core(), {"source_record_id": "source_record_id"}, "id", "policy_id")
    return resolved.select("policy_id", "commissions", money("gross_amount"))


@query("src11_keyed_load", """
SELECT count(*) AS loaded, count(*) FILTER (WHERE p.id IS NULL) AS orphans
FROM payments y LEFT JOIN policies p ON p.id = y.policy_id""", ["policies", "payments"])
def _(t):
    keyed = t.payments().select(F.concat(F.lit("POLREC-"), F.col("policy_id").cast("string"))
                                .alias("source_record_id")).groupBy("source_record_id").count()
    resolved, orphans = generator.resolve_keys(
        keyed, t.policy_core(), {"source_record_id": "source_record_id"}, "id", "policy_id")
    both = resolved.select("count", F.lit(0).alias("lost")).unionAll(
        orphans.select("count", F.lit(1).alias("lost")))
    return both.agg(F.sum("count").alias("loaded"),
                    F.coalesce(F.sum(F.col("count") * F.col("lost")), F.lit(0)).alias("orphans"))


@query("prj1_json_safe_rows", """
SELECT id AS policy_id, CAST(premium AS VARCHAR) AS premium,
    strftime(effective_date, '%Y-%m-%d') AS effective_date,
    strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS created_at,
    lower(hex(policy_number)) AS raw_number FROM policies""", ["policies"])
def _(t):
    return json_safe_rows(t.policy_core().select(
        F.col("id").alias("policy_id"), "premium", "effective_date", "created_at",
        F.col("policy_number").cast("binary").alias("raw_number")))


@query("prj1_json_safe_floats", """
SELECT id AS policy_id, v AS value, v || '|2.0' AS inner_values FROM (SELECT id, CASE id % 7
    WHEN 0 THEN 'nan' WHEN 1 THEN 'inf' WHEN 2 THEN '-inf' WHEN 3 THEN NULL
    ELSE (id % 7) || '.0' END AS v FROM policies)""", ["policies"])
def _(t):
    k = F.col("id") % 7
    value = (F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf"))
             .when(k != 3, k.cast("double")))
    rows = json_safe_rows(t.policy_core().select(
        F.col("id").alias("policy_id"), value.alias("value"),
        F.array(value, F.lit(2.0)).alias("inner")))
    return rows.select("policy_id", "value", F.when(F.col("value").isNotNull(), F.array_join(
        "inner", "|")).alias("inner_values"))


@query("sc28_agent_display_name",
       "SELECT s_suppkey AS id, s_name AS display_name FROM supplier")
def _(t):
    agents = t.agents()
    return agents.select("id", portfolio.agent_display_name(agents).alias("display_name"))


@query("jn6_policy_records", """
SELECT policy_id, policy_number, policy_matches, record_customer, record_carrier, record_plan,
    record_status, CAST(record_premium AS VARCHAR) AS record_premium,
    strftime(record_effective, '%Y-%m-%d') AS record_effective, has_payment FROM records""",
       ["records"])
def _(t):
    return records(t).select(
        "policy_id", "policy_number", "policy_matches", "record_customer", "record_carrier",
        "record_plan", "record_status", money("record_premium"), iso("record_effective"),
        "has_payment")


@query("wn3_canonical_policy", """
SELECT policy_number, id AS policy_id, policy_matches FROM (SELECT *,
    row_number() OVER (PARTITION BY policy_number ORDER BY source_system, created_at, id) AS rn,
    count(*) OVER (PARTITION BY policy_number) AS policy_matches FROM policies) WHERE rn = 1""",
       ["policies"])
def _(t):
    return rec.canonical_policies(t.policies()).select(
        "policy_number", "policy_id", "policy_matches")


@query("jn7_posted_payment_flag", """
SELECT id AS policy_id, id IN (SELECT policy_id FROM payments WHERE status = 'posted')
    AS has_payment FROM policies""", ["policies", "payments"])
def _(t):
    paid = rec.policies_with_posted_payment(t.payments()).withColumn("yes", F.lit(True))
    return t.policy_core().select(F.col("id").alias("policy_id")).join(
        paid, "policy_id", "left").select("policy_id", F.coalesce("yes", F.lit(False))
                                          .alias("has_payment"))


# --- documents against records --------------------------------------------------------------

@query("tf9_document_extraction", """
SELECT document_id, 2 AS page_count, number AS policy_number, customer AS customer_name,
    carrier AS carrier_name, plan AS plan_name, strftime(effective, '%Y-%m-%d') AS effective_date,
    strftime(termination, '%Y-%m-%d') AS termination_date,
    strftime(signature, '%Y-%m-%d') AS signature_date, CAST(premium AS VARCHAR) AS premium,
    status AS policy_status, round(confidence, 4) AS document_confidence,
    CASE WHEN pc < 0.75 THEN 6 + (c4 IS NOT NULL)::INT + (c6 IS NOT NULL)::INT
        + (c7 IS NOT NULL)::INT ELSE 0 END AS warnings FROM graded""", ["scored"])
def _(t):
    e = extract_documents(usable_pages(policy_pages(t)))
    return e.select("document_id", "page_count",
                    *[F.col(f"{n}.value").alias(n) for n in FIELD_NAMES],
                    "document_confidence", F.size("warnings").alias("warnings"))


@query("tf7_labelled_fields", """
SELECT field_name, count(*) AS found, count(DISTINCT v) AS distinct_values FROM (
    SELECT 'policy_number' AS field_name, number AS v FROM shown
    UNION ALL SELECT 'customer_name', customer FROM shown
    UNION ALL SELECT 'carrier_name', carrier FROM shown
    UNION ALL SELECT 'plan_name', plan FROM shown WHERE plan IS NOT NULL
    UNION ALL SELECT 'effective_date', CAST(effective AS VARCHAR) FROM shown
    UNION ALL SELECT 'termination_date', CAST(termination AS VARCHAR) FROM shown
        WHERE termination IS NOT NULL
    UNION ALL SELECT 'signature_date', CAST(signature AS VARCHAR) FROM shown
        WHERE signature IS NOT NULL
    UNION ALL SELECT 'premium', CAST(premium AS VARCHAR) FROM shown
    UNION ALL SELECT 'policy_status', status FROM shown) GROUP BY 1""", ["shown"])
def _(t):
    found = candidates(usable_pages(policy_pages(t))).where("kind = 'label'")
    per_value = found.groupBy("field", "value").agg(F.count("*").alias("n"))
    return per_value.groupBy(F.col("field").alias("field_name")).agg(
        F.sum("n").alias("found"), F.count("value").alias("distinct_values"))


@query("tf8_unlabelled_number", """
SELECT document_id, number AS value, round(least(0.90, pc) - 0.15, 4) AS confidence_score
FROM shown WHERE number LIKE 'POL-%'""", ["shown"])
def _(t):
    pages = policy_pages(t).withColumn("text_content", F.regexp_replace(
        "text_content", r"(?m)^(Policy Number: |Contract No\. |Policy ID\n)", "Reference "))
    e = extract_documents(usable_pages(pages))
    return e.where("policy_number.found").select(
        "document_id", "policy_number.value", "policy_number.confidence_score")


def _field_sql(name: str, value: str, score: str, page: int) -> str:
    method = ("CASE WHEN number_penalty > 0 THEN 'labeled_next_line' ELSE 'labeled_line' END"
              if name == "policy_number" else "'labeled_line'")
    given = lambda x: f"CASE WHEN {value} IS NOT NULL THEN {x} END"
    return (f"SELECT document_id, '{name}' AS field_name, CAST({value} AS VARCHAR) AS value, "
            f"round({score}, 4) AS confidence_score, {given(method)} AS extraction_method, "
            f"{given(page)} AS page_number FROM scored")


@query("wn5_best_candidate", "\nUNION ALL ".join(_field_sql(*x) for x in [
    ("policy_number", "number", "c1", 1), ("customer_name", "customer", "c2", 1),
    ("carrier_name", "carrier", "c3", 1), ("plan_name", "plan", "c4", 1),
    ("effective_date", "effective", "c5", 2), ("termination_date", "termination", "c6", 2),
    ("signature_date", "signature", "c7", 2), ("premium", "premium", "c8", 2),
    ("policy_status", "status", "c9", 2)]), ["scored"])
def _(t):
    flat = flat_fields(extract_documents(usable_pages(policy_pages(t))))
    return flat.select("document_id", "field_name", "value", "confidence_score",
                       "extraction_method", "page_number")


@query("wn8_next_line_value", """
SELECT document_id, number AS next_line FROM shown WHERE number_penalty > 0""", ["shown"])
def _(t):
    lines = page_lines(with_fallback(usable_pages(policy_pages(t))), ["document_id"])
    from ledgerlens.operators.extract import next_non_empty
    return lines.where(F.col("line") == "Policy ID").select(
        "document_id", next_non_empty().alias("next_line"))


@query("tf10_findings", """
SELECT document_id, rule_code, finding_type, status, severity, expected_value, actual_value
FROM findings WHERE rule_code <> 'REC012'
UNION ALL SELECT document_id, rule_code, finding_type, status, severity, expected_value, NULL
FROM findings WHERE rule_code = 'REC012'""", ["findings"])
def _(t):
    return findings_of(t, "rule_code", "finding_type", "status", "severity", "expected_value",
                       "actual_value").select(
        "document_id", "rule_code", "finding_type", "status", "severity", "expected_value",
        F.when(F.col("rule_code") != "REC012", F.col("actual_value")).alias("actual_value"))


@query("tf11_run_summaries", """
SELECT g.document_id, total_checks, passed_checks, failed_checks, review_checks, skipped_checks,
    review_task_count, coalesce(policy_matches, 0) AS matched_policy_count, number
    AS extracted_policy_number,
    CASE WHEN failed_checks + review_checks > 0 THEN 'needs_review' ELSE 'completed' END
    AS overall_status FROM matched g JOIN (SELECT document_id, count(*) AS total_checks,
    count(*) FILTER (WHERE status = 'passed') AS passed_checks,
    count(*) FILTER (WHERE status = 'failed') AS failed_checks,
    count(*) FILTER (WHERE status = 'needs_review') AS review_checks,
    count(*) FILTER (WHERE status = 'skipped') AS skipped_checks,
    count(*) FILTER (WHERE status IN ('failed', 'needs_review') AND severity IN ('high', 'medium'))
    AS review_task_count FROM findings GROUP BY 1) f ON f.document_id = g.document_id""",
       ["findings"])
def _(t):
    return reconciled(t).runs.select(
        "document_id", "total_checks", "passed_checks", "failed_checks", "review_checks",
        "skipped_checks", "review_task_count", "matched_policy_count",
        "extracted_policy_number", "overall_status")


@query("tf12_review_tasks", """
SELECT document_id, 'open' AS status, severity AS priority,
    array_to_string(list_transform(string_split(finding_type, '_'),
        lambda w: upper(w[1]) || w[2:]), ' ') AS title, rule_code
FROM findings WHERE status IN ('failed', 'needs_review') AND severity IN ('high', 'medium')""",
       ["findings"])
def _(t):
    return rec.review_tasks(findings_of(t, "rule_code", "finding_type", "field_name", "status",
                                        "severity", "message")).select(
        "document_id", "status", "priority", "title",
        F.col("extra_metadata")["rule_code"].alias("rule_code"))


@query("ag9_rule_totals", """
SELECT rule_code, status, severity, count(*) AS findings FROM findings GROUP BY ALL""",
       ["findings"])
def _(t):
    return findings_of(t, "rule_code", "status", "severity").groupBy("rule_code", "status", "severity").agg(
        F.count("*").alias("findings"))


@query("ag10_status_counts_of_runs", """
SELECT document_id, count(*) FILTER (WHERE status = 'passed') AS passed,
    count(*) FILTER (WHERE severity = 'high') AS high, count(*) AS total_checks,
    max(CASE WHEN rule_code <> 'REC012' AND rule_code = 'REC001' AND status = 'passed'
        THEN expected_value END) AS policy_number FROM findings GROUP BY 1""", ["findings"])
def _(t):
    return reconciled(t).runs.select(
        "document_id", F.coalesce(F.col("status_counts")["passed"], F.lit(0)).alias("passed"),
        F.coalesce(F.col("severity_counts")["high"], F.lit(0)).alias("high"), "total_checks",
        F.when(F.col("matched_policy_id").isNotNull(), F.col("extracted_policy_number"))
        .alias("policy_number"))


@query("ag11_status_pivot", """
SELECT document_id, count(*) FILTER (WHERE status = 'passed') AS passed,
    count(*) FILTER (WHERE status = 'failed') AS failed,
    count(*) FILTER (WHERE status = 'needs_review') AS needs_review,
    count(*) FILTER (WHERE status = 'skipped') AS skipped FROM findings GROUP BY 1""",
       ["findings"])
def _(t):
    return report.status_counts(findings_of(t, "rule_code", "status"), "document_id")


def _report(t: Tables) -> DataFrame:
    name = F.concat(F.lit("policy "), F.col("document_id").cast("string"), F.lit(".pdf"))
    return new_report(reconciled(t).checked, name, "policy_document",
                      F.lit("2026-01-01 00:00:00").cast("timestamp"))


@query("tf14_flat_report", """
SELECT 'policy ' || document_id || '.pdf' AS document_name, rule_code, status AS finding_status,
    severity, coalesce(expected_value, '') AS expected_value,
    CASE WHEN status IN ('failed', 'needs_review') AND severity IN ('high', 'medium')
        THEN 'open' ELSE '' END AS review_status,
    CASE WHEN status IN ('failed', 'needs_review') AND severity IN ('high', 'medium')
        THEN severity ELSE '' END AS review_priority FROM findings""", ["findings"])
def _(t):
    return report.report_lines(_report(t)).select(
        "document_name", "rule_code", "finding_status", "severity", "expected_value",
        "review_status", "review_priority")


@query("snk4_report_csv", """
SELECT rule_code, status AS finding_status, count(*) AS lines FROM findings GROUP BY ALL""",
       ["findings"])
def _(t):
    path = scratch_path(t.spark, "report")
    sinks.write_report_csv(report.report_lines(_report(t)), path, by_run=False,
                           compression="gzip")
    back = t.spark.read.csv(path, header=True, escape='"', lineSep="\n", multiLine=True)
    return back.groupBy("rule_code", "finding_status").agg(F.count("*").alias("lines"))


@query("jn11_finding_pages", """
SELECT document_id, rule_code, CASE WHEN rule_code IN ('REC001', 'REC002', 'REC003', 'REC004',
    'REC005') AND actual_value IS NOT NULL THEN document_id * 2
    WHEN rule_code IN ('REC006', 'REC007', 'REC008', 'REC009', 'REC010')
    AND actual_value IS NOT NULL THEN document_id * 2 + 1 END AS document_page_id
FROM findings""", ["findings"])
def _(t):
    pages = policy_pages(t)
    documents = with_page_ids(extract_documents(usable_pages(pages)), pages)
    checked = rec.check_documents(rec.match_policies(documents, records(t)),
                                  fields=("rule_code", "source_page_number"))
    return rec.unfold(checked, ("page_ids",)).select(
        "document_id", "rule_code", rec.page_of_finding().alias("document_page_id"))


def stored_runs(t: Tables) -> str:
    """Folder of the reconciliation of all documents, written twice as after a retry."""
    name = F.concat(F.lit("policy "), F.col("document_id").cast("string"), F.lit(".pdf"))
    checked = checked_runs(policy_pages(t), records(t), name,
                           F.lit("2026-01-01 00:00:00").cast("timestamp"))
    folder = scratch_path(t.spark, "runs")
    for _ in range(2):
        run_store.write_checked(checked, folder)
    return folder


_TASK = "status IN ('failed', 'needs_review') AND severity IN ('high', 'medium')"


@query("snk3_stored_findings", f"""
SELECT 'finding' AS kind, document_id, rule_code, status, CASE WHEN rule_code IN ('REC001',
    'REC002', 'REC003', 'REC004', 'REC005') AND actual_value IS NOT NULL THEN document_id * 2
    WHEN rule_code IN ('REC006', 'REC007', 'REC008', 'REC009', 'REC010')
    AND actual_value IS NOT NULL THEN document_id * 2 + 1 END AS document_page_id FROM findings
UNION ALL SELECT 'task', document_id, rule_code, 'open', NULL FROM findings WHERE {_TASK}""",
       ["findings"])
def _(t):
    folder = stored_runs(t)
    findings, tasks = (run_store.read_current(t.spark, folder, n) for n in ("findings", "tasks"))
    return findings.select(F.lit("finding").alias("kind"), "document_id", "rule_code", "status",
                           "document_page_id").unionByName(tasks.select(
        F.lit("task").alias("kind"), "document_id",
        F.col("extra_metadata")["rule_code"].alias("rule_code"), "status",
        F.lit(None).cast("long").alias("document_page_id")))


@query("tf15_report_load", f"""
SELECT 'policy ' || document_id || '.pdf' AS document_name,
    CASE WHEN count(*) FILTER (WHERE status IN ('failed', 'needs_review')) > 0
        THEN 'needs_review' ELSE 'completed' END AS status,
    string_agg(rule_code, ',' ORDER BY finding_id) AS findings,
    coalesce(string_agg(rule_code, ',' ORDER BY sha256('task|' || finding_id))
        FILTER (WHERE {_TASK}), '') AS tasks
FROM (SELECT *, sha256(sha256('policy_document|' || document_id) || '|' || rule_code)
    AS finding_id FROM findings) GROUP BY document_id""", ["findings"])
def _(t):
    """A run has a finding a rule at most, so its ordered lists are short."""
    runs, findings, tasks = run_store.load_reports(t.spark, stored_runs(t), ordered=False)

    def listed(df: DataFrame, key: str, rule, name: str) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct("created_at", key, rule.alias("rule"))))
        return df.groupBy("run_id").agg(F.array_join(F.transform(
            rows, lambda r: r["rule"]), ",").alias(name))
    found = listed(findings, "finding_id", F.col("rule_code"), "findings")
    asked = listed(tasks, "task_id", F.col("extra_metadata")["rule_code"], "tasks")
    return runs.join(found, "run_id").join(asked, "run_id", "left").select(
        "document_name", "status", "findings", F.coalesce("tasks", F.lit("")).alias("tasks"))


@query("prj18_removal", """
WITH log AS (SELECT event_id // 3 AS document_id, event_id, CASE
    WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END AS busy FROM events),
docs AS (SELECT document_id, max(busy) = 0 AS free FROM log GROUP BY 1)
SELECT n.name AS table_name, count(*) AS rows_before,
    count(*) FILTER (WHERE NOT free) AS rows_after, count(*) FILTER (WHERE NOT free) AS rows_again
FROM (SELECT unnest(['tasks', 'findings', 'runs', 'chunks', 'pages']) AS name) n, log
    JOIN docs USING (document_id) GROUP BY 1
UNION ALL SELECT 'documents', count(*), count(*) FILTER (WHERE NOT free),
    count(*) FILTER (WHERE NOT free) FROM docs""")
def _(t):
    """All documents are asked to go, twice; those with a busy attempt stay with all they own."""
    log = t.run_log().select(F.floor(F.col("id") / 3).alias("document_id"), "id", "status")
    folder, buckets = scratch_path(t.spark, "owned"), 16
    documents = log.select("document_id").distinct()
    for name in run_store.DEPENDANTS:
        run_store.write_bucketed(documents if name == "documents" else log,
                                 f"{folder}/{name}", buckets)

    def sizes(label: str) -> DataFrame:
        counts = [t.spark.read.parquet(f"{folder}/{n}").agg(F.count("*").alias(label))
                  .select(F.lit(n).alias("table_name"), label) for n in run_store.DEPENDANTS]
        return cut_lineage(quality.all_of(counts))
    before = sizes("rows_before")
    run_store.remove_documents(t.spark, folder, documents, buckets)
    after = sizes("rows_after")
    run_store.remove_documents(t.spark, folder, documents, buckets)
    return before.join(after, "table_name").join(sizes("rows_again"), "table_name")


@query("tf13_repeated_updates", """
WITH up AS (SELECT user_id AS task_id, event_id, event_type,
    CASE event_type WHEN 'click' THEN 'in_progress' WHEN 'purchase' THEN 'approved'
        WHEN 'error' THEN 'rejected' WHEN 'signup' THEN 'open' END AS status FROM events),
first AS (SELECT task_id, min(event_id) AS at, arg_min(status, event_id) AS status FROM up
    WHERE status IN ('approved', 'rejected') GROUP BY 1),
judged AS (SELECT up.*, CASE WHEN up.status IS NOT NULL AND event_id > first.at
    AND up.status <> first.status THEN 'already_resolved' END AS error
    FROM up LEFT JOIN first USING (task_id))
SELECT task_id, count(*) AS updates, count(error) AS refused,
    coalesce(arg_max(status, event_id) FILTER (WHERE status IS NOT NULL AND error IS NULL), 'open')
        AS status,
    CAST(max(event_id) FILTER (WHERE error IS NULL) AS VARCHAR) AS notes
FROM judged GROUP BY 1""")
def _(t):
    """Every user is a task and every event an update of it, in the order of the events."""
    events = t.raw("events")
    none = F.lit(None).cast("string")
    tasks = events.select(F.col("user_id").alias("task_id")).distinct().select(
        "task_id", F.lit(W).alias("workspace_id"), F.lit("open").alias("status"),
        *[none.alias(c) for c in ("assigned_to_user_id", "resolution_notes", "corrected_value",
                                  "resolved_by_user_id")],
        F.lit(None).cast("timestamp").alias("resolved_at"))
    kind = F.col("event_type")
    status = (F.when(kind == "click", "in_progress").when(kind == "purchase", "approved")
              .when(kind == "error", "rejected").when(kind == "signup", "open"))
    updates = events.select(
        F.col("user_id").alias("task_id"), "event_id", F.lit(W).alias("workspace_id"),
        F.lit("reviewer").alias("user_id"), status.alias("status"),
        status.isNotNull().alias("set_status"), none.alias("assigned_to_user_id"),
        F.lit(False).alias("set_assigned_to_user_id"),
        F.col("event_id").cast("string").alias("resolution_notes"),
        F.lit(True).alias("set_resolution_notes"), none.alias("corrected_value"),
        F.lit(False).alias("set_corrected_value"))
    users = events.limit(0).select(F.lit("x").alias("id"), F.lit(W).alias("workspace_id"),
                                   F.lit(True).alias("is_active"))
    checked, after = report.apply_task_updates(
        tasks, updates, users, F.lit("2026-01-01").cast("timestamp"), "event_id")
    counts = checked.groupBy("task_id").agg(F.count("*").alias("updates"),
                                            F.count("error").alias("refused"))
    return after.join(counts, "task_id").select(
        "task_id", "updates", "refused", "status", F.col("resolution_notes").alias("notes"))


@query("tf13_task_updates", """
WITH tasks AS (SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'approved'
    WHEN event_type = 'view' THEN 'in_progress' ELSE 'open' END AS status FROM events),
updates AS (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'corrected'
    WHEN 2 THEN 'in_progress' ELSE NULL END AS status, event_id % 5 AS n, user_id % 7 AS who
    FROM events)
SELECT t.id, u.status AS requested, CASE
    WHEN u.status IN ('approved', 'corrected') AND u.n = 0 THEN 'notes_required'
    WHEN u.status = 'corrected' AND u.n < 3 THEN 'corrected_value_required'
    WHEN u.who = 6 THEN 'assignee_not_in_workspace' WHEN u.who = 5 THEN 'assignee_inactive'
    WHEN u.status IS NULL THEN NULL
    WHEN t.status = 'approved' AND u.status <> 'approved' THEN 'already_resolved' END AS error
FROM tasks t JOIN updates u ON t.id = u.id""")
def _(t):
    events = t.raw("events")
    tasks = events.select(
        F.col("event_id").alias("task_id"), F.lit(W).alias("workspace_id"),
        F.when(F.col("event_type") == "error", "approved")
        .when(F.col("event_type") == "view", "in_progress").otherwise("open").alias("status"),
        *[F.lit(None).cast("string").alias(c) for c in (
            "assigned_to_user_id", "resolution_notes", "corrected_value",
            "resolved_by_user_id")], F.lit(None).cast("timestamp").alias("resolved_at"))
    n, kind = F.col("event_id") % 5, F.col("event_id") % 4
    status = (F.when(kind == 0, "approved").when(kind == 1, "corrected")
              .when(kind == 2, "in_progress"))
    who = F.col("user_id") % 7
    updates = events.select(
        F.col("event_id").alias("task_id"), F.lit(W).alias("workspace_id"),
        F.lit("reviewer").alias("user_id"), status.alias("status"),
        status.isNotNull().alias("set_status"),
        F.concat(F.lit("u"), who.cast("string")).alias("assigned_to_user_id"),
        F.lit(True).alias("set_assigned_to_user_id"),
        F.when(n == 0, "  ").otherwise("checked").alias("resolution_notes"),
        F.lit(True).alias("set_resolution_notes"),
        F.lit("7").alias("corrected_value"), (n >= 3).alias("set_corrected_value"))
    users = events.select((F.col("user_id") % 7).alias("n")).distinct().select(
        F.concat(F.lit("u"), F.col("n").cast("string")).alias("id"),
        F.when(F.col("n") == 6, "elsewhere").otherwise(W).alias("workspace_id"),
        (F.col("n") != 5).alias("is_active"))
    checked, _ = report.apply_task_updates(tasks, updates, users, F.lit("2026-01-01").cast("timestamp"))
    return checked.select(F.col("task_id").alias("id"), F.col("status").alias("requested"), "error")


# --- runs, listings and data quality --------------------------------------------------------

@query("wn1_latest_completed_run", """
SELECT document_id, id AS processing_run_id, attempt_number FROM (SELECT *, row_number() OVER (
    PARTITION BY document_id ORDER BY attempt_number DESC, created_at DESC, id DESC) AS rn
    FROM run_log WHERE status = 'completed') WHERE rn = 1""", ["run_log"])
def _(t):
    return latest_completed(numbered_log(t)).select(
        "document_id", "processing_run_id", "attempt_number")


@query("wn2_active_run", """
SELECT document_id, id AS processing_run_id, status FROM (SELECT *, row_number() OVER (
    PARTITION BY document_id ORDER BY created_at DESC, id DESC) AS rn
    FROM run_log WHERE status IN ('queued', 'running')) WHERE rn = 1""", ["run_log"])
def _(t):
    return active_runs(t.run_log()).select("document_id", "processing_run_id", "status")


@query("jn8_latest_run_rows", """
SELECT r.id, r.document_id FROM run_log r JOIN (SELECT document_id, max(attempt_number) AS a
    FROM run_log WHERE status = 'completed' GROUP BY 1) m
    ON r.document_id = m.document_id AND r.attempt_number = m.a""", ["run_log"])
def _(t):
    log = numbered_log(t)
    pages = log.select(F.col("id").alias("processing_run_id"), "document_id")
    return listing.selected_pages(pages, latest_completed(log)).select(
        F.col("processing_run_id").alias("id"), "document_id")


@query("ag16_next_attempt", """
SELECT document_id, count(*) + 1 AS next_attempt FROM run_log GROUP BY 1""", ["run_log"])
def _(t):
    log = numbered_log(t)
    return listing.next_attempt(log, log.select("document_id").distinct()).select(
        "document_id", F.col("next_attempt").cast("long").alias("next_attempt"))


@query("prj9_filtered_listing", """
SELECT document_id, count(*) AS runs FROM run_log WHERE status = 'completed' GROUP BY 1""",
       ["run_log"])
def _(t):
    return listing.filtered(t.run_log(), status="completed", workspace_id=W, document_id=None) \
        .groupBy("document_id").agg(F.count("*").alias("runs"))


@query("ag17_listing_total", "SELECT count(*) AS total FROM run_log WHERE status = 'failed'",
       ["run_log"])
def _(t):
    return listing.total(listing.filtered(t.run_log(), status="failed"))


@query("ag18_record_counts", """
SELECT 'insurance_policies' AS table_name, count(*) AS records FROM policies
UNION ALL SELECT 'insurance_payments', count(*) FROM payments
UNION ALL SELECT 'insurance_commissions', count(*) FROM commissions
UNION ALL SELECT 'insurance_customers', count(*) FROM customer
UNION ALL SELECT 'insurance_agents', count(*) FROM supplier
UNION ALL SELECT 'insurance_plans', count(*) FROM part
UNION ALL SELECT 'insurance_carriers', count(*) FROM nation""",
       ["policies", "payments", "commissions"])
def _(t):
    return listing.record_counts(t.business_tables(), W)


@query("ag20_screen_counters", """
SELECT count(*) AS documents, count(*) FILTER (WHERE status = 'completed') AS processed,
    count(*) FILTER (WHERE status IN ('queued', 'running')) AS busy,
    count(*) FILTER (WHERE status = 'failed') AS failed,
    (SELECT count(*) FROM policies WHERE status <> 'cancelled') AS open_tasks FROM run_log""",
       ["policies", "run_log"])
def _(t):
    docs = t.run_log().withColumn("status", F.when(
        F.col("status") == "completed", "processed").otherwise(F.col("status")))
    tasks = t.policy_core().select(F.when(F.col("status") == "active", "open").when(
        F.col("status") == "pending", "in_progress").otherwise("approved").alias("status"))
    return listing.screen_counters(docs, tasks)


@query("prj12_row_rules", """
SELECT 'document_processing_runs' AS table_name, rule_name, broken_rows FROM (
    SELECT 'status_valid' AS rule_name, count(*) FILTER (WHERE status = 'failed') AS broken_rows
        FROM run_log
    UNION ALL SELECT 'attempt_number_positive', 0 FROM run_log LIMIT 2)
UNION ALL SELECT 'document_processing_runs', 'total_pages_non_negative', 0
UNION ALL SELECT 'document_processing_runs', 'extracted_pages_non_negative', 0
UNION ALL SELECT 'document_processing_runs', 'extracted_pages_within_total',
    count(*) FILTER (WHERE floor(value) > 50) FROM run_log""", ["run_log"])
def _(t):
    runs = numbered_log(t).select(
        F.when(F.col("status") == "failed", "broken").otherwise(F.col("status")).alias("status"),
        "attempt_number", F.lit(50).alias("total_pages"),
        F.floor("value").alias("extracted_pages"))
    return quality.violation_counts(runs, "document_processing_runs")


@query("prj12_broken_rows", """
SELECT 'document_processing_runs' AS table_name, CAST(id AS VARCHAR) AS row_id,
    'extracted_pages_within_total' AS rule_name FROM run_log WHERE floor(value) > 50""",
       ["run_log"])
def _(t):
    runs = t.run_log().select("id", "status", F.lit(50).alias("total_pages"),
                              F.floor("value").alias("extracted_pages"))
    return quality.row_violations(runs, "document_processing_runs", "id")


@query("prj13_duplicate_keys", """
SELECT 'insurance_policies' AS table_name, source_system || '|' || policy_number AS key,
    count(*) AS rows FROM policies GROUP BY 2 HAVING count(*) > 1""", ["policies"])
def _(t):
    return quality.duplicate_keys(t.policy_core(), ["source_system", "policy_number"],
                                  "insurance_policies")


@query("prj14_missing_references", """
SELECT 'payments.policy_id' AS reference_name, CAST(policy_id AS VARCHAR) AS missing_id,
    count(*) AS rows FROM payments WHERE policy_id NOT IN (SELECT id FROM policies) GROUP BY 2
UNION ALL SELECT 'commissions.agent_id', CAST(agent_id AS VARCHAR), count(*) FROM commissions
    WHERE agent_id NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 2
UNION ALL SELECT 'runs.policy_id', CAST(id AS VARCHAR), count(*) FROM run_log
    WHERE id NOT IN (SELECT policy_id FROM payments) GROUP BY 2""",
       ["policies", "payments", "commissions", "run_log"])
def _(t):
    return quality.all_of([
        quality.missing_references(t.payments(), "policy_id", t.policy_core(), "id",
                                   "payments.policy_id"),
        quality.missing_references(t.commissions(), "agent_id", t.agents(), "id",
                                   "commissions.agent_id"),
        quality.missing_references(t.run_log(), "id", t.payments().select("policy_id").distinct(),
                                   "policy_id", "runs.policy_id")])


@query("prj16_missing_lookups", """
SELECT DISTINCT l_orderkey + 7 AS id FROM lineitem WHERE l_orderkey + 7 NOT IN
    (SELECT o_orderkey FROM orders)""")
def _(t):
    wanted = t.raw("lineitem").select((F.col("l_orderkey") + 7).alias("id"))
    return listing.not_found(t.policy_core(), wanted, W)


@query("prj17_page_selection", """
SELECT e.document_id, count(*) AS pages FROM run_log e JOIN (SELECT document_id,
    max(attempt_number) AS a FROM run_log WHERE status = 'completed' GROUP BY 1) m
    ON e.document_id = m.document_id AND e.attempt_number = CASE WHEN e.document_id % 3 = 0
    THEN 1 ELSE m.a END GROUP BY 1""", ["run_log"])
def _(t):
    log = numbered_log(t)
    pages = log.select(F.col("id").alias("processing_run_id"), "document_id")
    given = log.where((F.col("document_id") % 3 == 0) & (F.col("attempt_number") == 1)).select(
        "document_id", F.col("id").alias("processing_run_id"))
    return listing.selected_pages(pages, latest_completed(log), given).groupBy(
        "document_id").agg(F.count("*").alias("pages"))


@query("prj18_removable_documents", """
SELECT event_id // 3 AS document_id FROM events GROUP BY 1
HAVING count(*) FILTER (WHERE event_type IN ('view', 'click')) = 0""")
def _(t):
    log = t.run_log().withColumn("document_id", F.floor(F.col("id") / 3))
    documents = log.select("document_id").distinct()
    return quality.removable_documents(documents, log, documents)


@query("prj19_presence", """
SELECT p_partkey AS id, nullif(trim(CASE WHEN p_size % 3 = 0 THEN '  ' ELSE ' ' || p_name || ' '
    END), '') AS value FROM part""")
def _(t):
    from ledgerlens.operators.extract import presence
    raw = F.when(F.col("p_size") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name", F.lit(" ")))
    return t.raw("part").select(F.col("p_partkey").alias("id"), presence(raw).alias("value"))


@query("prj20_identifiers", """
SELECT p_partkey AS id, CASE WHEN regexp_full_match(lower(v), '[a-z_][a-z0-9_]*') THEN lower(v) END
    AS identifier FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_type
    ELSE p_name END AS v FROM part)""")
def _(t):
    v = (F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).when(
        F.col("p_size") % 3 == 1, F.col("p_type")).otherwise(F.col("p_name")))
    return t.raw("part").select(F.col("p_partkey").alias("id"),
                                catalogue.valid_identifier(v).alias("identifier"))


@query("snk1_replace_workspace", """
SELECT status, count(*) AS policies, CAST(CAST(sum(premium) AS DECIMAL(38,2)) AS VARCHAR) AS premium
FROM policies GROUP BY 1""", ["policies"])
def _(t):
    path = scratch_path(t.spark, "policies")
    rows = t.policy_core().select("workspace_id", "id", "status", "premium")
    sinks.write_workspace(rows, path)
    sinks.write_workspace(rows, path)
    return t.spark.read.parquet(path).groupBy("status").agg(
        F.count("*").alias("policies"), F.sum("premium").alias("premium")).select(
        "status", "policies", money("premium"))


# --- scalar rules on business values --------------------------------------------------------

@query("sc5_identifier_key", """
SELECT c_custkey AS id, nullif(regexp_replace(upper(c_name || ' - ' || c_mktsegment),
    '[^A-Z0-9]', '', 'g'), '') AS key FROM customer""")
def _(t):
    return t.raw("customer").select(F.col("c_custkey").alias("id"), identifier_key(
        F.concat_ws(" - ", "c_name", "c_mktsegment")).alias("key"))


@query("sc8_record_dates", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 6 THEN 'soon ' || o_orderkey
    ELSE strftime(o_orderdate, '%Y-%m-%d') END AS value FROM orders""")
def _(t):
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 7
    raw = F.when(k == 6, F.concat(F.lit("soon "), F.col("o_orderkey").cast("string")))
    for n, shape in enumerate(["yyyy-MM-dd", "MM/dd/yyyy", "M-d-yyyy", "MM/dd/yy",
                               "MMMM d, yyyy", "MMM d yyyy"]):
        raw = raw.when(k == n, F.date_format(day, shape))
    return t.raw("orders").select(F.col("o_orderkey").alias("id"), record_date(raw).alias("value"))


@query("sc9_document_dates", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 <> 8
    THEN strftime(o_orderdate, '%Y-%m-%d') END AS value FROM orders""")
def _(t):
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 9
    raw = F.when(k == 8, F.lit("on 31 February 2026"))
    for n, shape in enumerate(["yyyy-M-d", "MM/dd/yyyy", "M-d-yyyy", "MM.dd.yyyy", "MM/dd/yy",
                               "MMMM d, yyyy", "MMM d yyyy", "d MMMM yyyy"]):
        raw = raw.when(k == n, F.concat(F.lit("from "), F.date_format(day, shape), F.lit(" on")))
    return t.raw("orders").select(F.col("o_orderkey").alias("id"), document_date(raw).alias("value"))


def _spelled(amount, k):
    plain = amount.cast("string")
    return (F.when(k == 0, F.concat(F.lit("$"), F.format_number(amount, 2)))
            .when(k == 1, F.concat(F.lit("USD "), plain))
            .when(k == 2, F.concat(F.lit("($"), plain, F.lit(")")))
            .when(k == 3, F.concat(plain, F.lit(" per month"))).otherwise(plain))


@query("sc10_record_money", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 3 THEN NULL ELSE CAST(CASE WHEN
    o_orderkey % 5 = 2 THEN -1 ELSE 1 END * CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) END
    AS value FROM orders""")
def _(t):
    amount = F.round("o_totalprice", 2).cast("decimal(12,2)")
    return t.raw("orders").select(F.col("o_orderkey").alias("id"), record_money(
        _spelled(amount, F.col("o_orderkey") % 5)).cast("string").alias("value"))


@query("sc11_document_money", """
SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 5 = 2 THEN -1 ELSE 1 END
    * CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS value FROM orders""")
def _(t):
    amount = F.round("o_totalprice", 2).cast("decimal(12,2)")
    return t.raw("orders").select(F.col("o_orderkey").alias("id"), document_money(
        _spelled(amount, F.col("o_orderkey") % 5)).cast("string").alias("value"))


@query("sc6_record_status", """
SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'cancelled'
    WHEN 2 THEN 'not_issued' WHEN 3 THEN 'on_hold' ELSE 'pending_lapse' END AS status FROM orders""")
def _(t):
    from ledgerlens.functions.text import text_key
    from ledgerlens.functions.values import record_status
    k = F.col("o_orderkey") % 5
    raw = (F.when(k == 0, "In Force").when(k == 1, "Terminated").when(k == 2, " DECLINED ")
           .when(k == 3, "On  Hold").otherwise("pending-lapse"))
    return t.raw("orders").select("o_orderkey", text_key(raw).alias("key")).select(
        F.col("o_orderkey").alias("id"), record_status(F.col("key")).alias("status"))


@query("sc7_document_status", """
SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'active' WHEN 1 THEN 'active'
    WHEN 2 THEN 'not_issued' WHEN 3 THEN 'active' WHEN 4 THEN 'pending_lapse' END AS status
FROM orders""")
def _(t):
    from ledgerlens.functions.values import document_status
    k = F.col("o_orderkey") % 6
    raw = (F.when(k == 0, "Active").when(k == 1, "currently in-force.").when(k == 2, "Not Issued")
           .when(k == 3, "policy not issued yet").when(k == 4, "Pending Lapse").otherwise("unknown"))
    return t.raw("orders").select(F.col("o_orderkey").alias("id"), document_status(raw).alias("status"))


@query("sc12_policy_number", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 3 THEN NULL
    ELSE 'POL-' || o_custkey || '-' || o_orderkey END AS value FROM orders""")
def _(t):
    from ledgerlens.functions.values import policy_number
    k, tail = F.col("o_orderkey") % 4, F.concat_ws("-", "o_custkey", "o_orderkey")
    raw = (F.when(k == 0, F.concat(F.lit("pol-"), tail)).when(k == 1, F.concat(F.lit("Pol - "), tail))
           .when(k == 2, F.concat(F.lit(": POL-"), tail, F.lit(";"))).otherwise(F.lit("A?B*C")))
    return t.raw("orders").select(F.col("o_orderkey").alias("id"), policy_number(raw).alias("value"))


@query("sc13_names", """
SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE replace(c_name, '#', ' ') END
    AS person, CASE WHEN c_custkey % 3 = 2 THEN '12 34' ELSE replace(c_name, '#', ' ') END AS plain,
    replace(c_name, '#', ' ') AS full_name FROM customer""")
def _(t):
    from ledgerlens.functions.values import person_name, plain_value
    raw = F.when(F.col("id") % 3 == 2, F.lit("12  34 ;")).otherwise(
        F.concat(F.lit("  "), "first_name", F.lit(" \t "), "last_name", F.lit(":")))
    return t.customers().select(
        "id", person_name(raw).alias("person"), plain_value(raw).alias("plain"),
        full_name(F.concat(F.lit(" "), "first_name"), F.col("last_name")).alias("full_name"))


@query("prj2_report_values", """
SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END,
    '') AS text_value, CASE WHEN o_orderstatus = 'O' THEN 'true' ELSE 'false' END AS flag,
    CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS amount,
    '{"custkey":"' || o_custkey || '","status":"' || o_orderstatus || '"}' AS facts FROM orders""")
def _(t):
    o = t.raw("orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("text_value"),
        (F.col("o_orderstatus") == "O").alias("flag"),
        F.round("o_totalprice", 2).cast("decimal(12,2)").alias("amount"),
        F.create_map(F.lit("status"), "o_orderstatus", F.lit("custkey"),
                     F.col("o_custkey").cast("string")).alias("facts"))
    return o.select("id", *[report_text(F.col(f.name), f.dataType).alias(f.name)
                            for f in o.schema.fields if f.name != "id"])
