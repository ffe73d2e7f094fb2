"""Where runnable queries and their plain-SQL twins are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.model import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}

# White space for RE2, the engine behind the SQL twins.
RE2_SPACE = (r"\t-\r\x{1c}- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
             r"\x{202f}\x{205f}\x{3000}")
RE2_SPACE_NOT_LF = RE2_SPACE.replace(r"\t-\r", r"\t\x{0b}-\r")

# Views of the business model in the twins' SQL.
SHARED = {
    "policies": """policies AS (SELECT o_orderkey AS id,
        'POL-' || o_custkey || '-' || year(o_orderdate) AS policy_number,
        o_custkey AS customer_id, o_orderkey % 200 AS plan_id,
        CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'pending' ELSE 'cancelled' END
            AS status,
        CAST(o_totalprice AS DECIMAL(12,2)) AS premium, CAST(o_orderdate AS DATE) AS effective_date,
        o_orderdate AS created_at,
        CASE WHEN o_orderpriority IN ('5-LOW', '1-URGENT') THEN 'legacy_import'
            ELSE 'synthetic_policy_admin' END AS source_system, c_nationkey AS carrier_id
        FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "payments": """payments AS (SELECT l_orderkey AS policy_id,
        CAST(l_extendedprice AS DECIMAL(12,2)) AS amount,
        CASE l_linestatus WHEN 'F' THEN 'posted' ELSE 'pending' END AS status,
        CAST(l_shipdate AS DATE) AS payment_date FROM lineitem)""",
    "commissions": """commissions AS (SELECT l_orderkey AS policy_id, l_suppkey AS agent_id,
        CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))
            AS DECIMAL(12,2)) AS net_amount FROM lineitem)""",
    "run_log": """run_log AS (SELECT event_id AS id, user_id AS document_id, ts AS created_at,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt_number,
        CASE WHEN event_type IN ('purchase', 'signup') THEN 'completed'
            WHEN event_type = 'view' THEN 'running' WHEN event_type = 'click' THEN 'queued'
            ELSE 'failed' END AS status, value FROM events)""",
    "records": """ranked AS (SELECT *, row_number() OVER (PARTITION BY upper(policy_number)
            ORDER BY source_system, created_at, id) AS rn,
            count(*) OVER (PARTITION BY upper(policy_number)) AS policy_matches FROM policies),
        records AS (SELECT r.id AS policy_id, r.policy_number, policy_matches,
            replace(c_name, '#', ' ') AS record_customer, n_name AS record_carrier,
            p_name AS record_plan, r.status AS record_status, r.premium AS record_premium,
            r.effective_date AS record_effective,
            EXISTS (SELECT 1 FROM payments y WHERE y.policy_id = r.id AND y.status = 'posted')
                AS has_payment
            FROM ranked r JOIN customer ON c_custkey = r.customer_id
            JOIN nation ON n_nationkey = r.carrier_id LEFT JOIN part ON p_partkey = r.plan_id
            WHERE rn = 1)""",
    "shown": """shown AS (SELECT p.id AS document_id,
        CASE WHEN p.id % 23 = 0 THEN 'UNK-' || p.id ELSE p.policy_number END AS number,
        CASE WHEN p.id % 17 = 0 THEN 'Changed ' ELSE '' END || replace(c_name, '#', ' ')
            AS customer, n_name AS carrier, p_name AS plan,
        p.effective_date + CASE WHEN p.id % 11 = 0 THEN 1 ELSE 0 END AS effective,
        CASE WHEN p.id % 31 = 0
            THEN CAST(p.effective_date + INTERVAL 12 MONTH AS DATE) END AS termination,
        CASE WHEN p.id % 19 <> 0 THEN p.effective_date - 7 END AS signature,
        CAST(p.premium + CASE WHEN p.id % 13 = 0 THEN 5 ELSE 0 END AS DECIMAL(12,2)) AS premium,
        p.status, CASE WHEN p.id % 29 = 0 THEN 0.6::DOUBLE ELSE 0.98::DOUBLE END AS pc,
        CASE WHEN p.id % 3 = 2 THEN 0.02::DOUBLE ELSE 0::DOUBLE END AS number_penalty
        FROM policies p JOIN customer ON c_custkey = p.customer_id
        JOIN nation ON n_nationkey = p.carrier_id LEFT JOIN part ON p_partkey = p.plan_id)""",
    "scored": """scored AS (SELECT *, least(0.99, pc) - number_penalty AS c1, least(0.96, pc) AS c2,
        least(0.94, pc) AS c3, CASE WHEN plan IS NOT NULL THEN least(0.94, pc) END AS c4,
        least(0.97, pc) AS c5,
        CASE WHEN termination IS NOT NULL THEN least(0.96, pc) END AS c6,
        CASE WHEN signature IS NOT NULL THEN least(0.96, pc) END AS c7,
        least(0.97, pc) AS c8, least(0.94, pc) AS c9 FROM shown),
        graded AS (SELECT *, round((round(c1, 4) + c2 + c3 + coalesce(c4, 0) + c5
            + coalesce(c6, 0) + coalesce(c7, 0) + c8 + c9)
            / (6 + (c4 IS NOT NULL)::INT + (c6 IS NOT NULL)::INT + (c7 IS NOT NULL)::INT), 4)
            AS confidence FROM scored)""",
    "findings": """matched AS (SELECT g.*, r.* FROM graded g
            LEFT JOIN records r ON upper(g.number) = upper(r.policy_number)),
        findings AS (
        SELECT document_id, 'REC012' AS rule_code,
            CASE WHEN pc >= 0.75 THEN 'passed' ELSE 'needs_review' END AS status,
            CASE WHEN pc >= 0.75 THEN 'info' ELSE 'medium' END AS severity,
            CASE WHEN pc >= 0.75 THEN 'extraction_confidence' ELSE 'low_extraction_confidence' END
                AS finding_type, '0.75' AS expected_value,
            CAST(confidence AS VARCHAR) AS actual_value FROM matched
        UNION ALL SELECT document_id, 'REC001',
            CASE WHEN policy_id IS NULL THEN 'failed' ELSE 'passed' END,
            CASE WHEN policy_id IS NULL THEN 'high' ELSE 'info' END,
            CASE WHEN policy_id IS NULL THEN 'unmatched_policy' ELSE 'policy_match' END,
            CASE WHEN policy_id IS NULL THEN 'Existing policy record' ELSE policy_number END,
            number FROM matched
        UNION ALL SELECT document_id, 'REC002',
            CASE WHEN policy_matches > 1 THEN 'needs_review' ELSE 'passed' END,
            CASE WHEN policy_matches > 1 THEN 'high' ELSE 'info' END,
            CASE WHEN policy_matches > 1 THEN 'duplicate_policy_number'
                ELSE 'unique_policy_number' END, '1', CAST(policy_matches AS VARCHAR)
            FROM matched WHERE policy_id IS NOT NULL
        UNION ALL SELECT document_id, 'REC003',
            CASE WHEN customer = record_customer THEN 'passed' ELSE 'failed' END,
            CASE WHEN customer = record_customer THEN 'info' ELSE 'high' END, 'customer_name',
            record_customer, customer FROM matched WHERE policy_id IS NOT NULL
        UNION ALL SELECT document_id, 'REC004',
            CASE WHEN carrier = record_carrier THEN 'passed' ELSE 'failed' END,
            CASE WHEN carrier = record_carrier THEN 'info' ELSE 'medium' END, 'carrier_name',
            record_carrier, carrier FROM matched WHERE policy_id IS NOT NULL
        UNION ALL SELECT document_id, 'REC005',
            CASE WHEN plan IS NULL AND record_plan IS NULL THEN 'skipped'
                WHEN plan IS NULL OR record_plan IS NULL THEN 'needs_review'
                WHEN plan = record_plan THEN 'passed' ELSE 'failed' END,
            CASE WHEN plan IS NULL AND record_plan IS NULL THEN 'info'
                WHEN plan = record_plan THEN 'info' ELSE 'medium' END, 'plan_name',
            record_plan, plan FROM matched WHERE policy_id IS NOT NULL
        UNION ALL SELECT document_id, 'REC006',
            CASE WHEN effective = record_effective THEN 'passed' ELSE 'failed' END,
            CASE WHEN effective = record_effective THEN 'info' ELSE 'high' END, 'effective_date',
            strftime(record_effective, '%Y-%m-%d'), strftime(effective, '%Y-%m-%d')
            FROM matched WHERE policy_id IS NOT NULL
        UNION ALL SELECT document_id, 'REC007',
            CASE WHEN termination IS NULL THEN 'skipped' ELSE 'needs_review' END,
            CASE WHEN termination IS NULL THEN 'info' ELSE 'medium' END, 'termination_date',
            NULL, strftime(termination, '%Y-%m-%d') FROM matched WHERE policy_id IS NOT NULL
        UNION ALL SELECT document_id, 'REC008',
            CASE WHEN signature IS NULL THEN 'needs_review' ELSE 'passed' END,
            CASE WHEN signature IS NULL THEN 'high' ELSE 'info' END,
            CASE WHEN signature IS NULL THEN 'missing_signature' ELSE 'signature_present' END,
            CASE WHEN signature IS NOT NULL THEN 'true' END, strftime(signature, '%Y-%m-%d')
            FROM matched WHERE policy_id IS NOT NULL
        UNION ALL SELECT document_id, 'REC009',
            CASE WHEN abs(premium - record_premium) <= 0.01 THEN 'passed' ELSE 'failed' END,
            CASE WHEN abs(premium - record_premium) <= 0.01 THEN 'info' ELSE 'high' END,
            CASE WHEN abs(premium - record_premium) <= 0.01 THEN 'premium_match'
                ELSE 'premium_mismatch' END,
            CAST(record_premium AS VARCHAR), CAST(premium AS VARCHAR)
            FROM matched WHERE policy_id IS NOT NULL
        UNION ALL SELECT document_id, 'REC010',
            CASE WHEN status = record_status THEN 'passed' ELSE 'failed' END,
            CASE WHEN status = record_status THEN 'info' ELSE 'medium' END, 'policy_status',
            record_status, status FROM matched WHERE policy_id IS NOT NULL
        UNION ALL SELECT document_id, 'REC011',
            CASE WHEN record_status = 'cancelled' THEN 'skipped' WHEN has_payment THEN 'passed'
                ELSE 'failed' END,
            CASE WHEN record_status = 'cancelled' OR has_payment THEN 'info'
                WHEN record_status = 'active' THEN 'high' ELSE 'medium' END,
            CASE WHEN record_status = 'cancelled' OR has_payment THEN 'payment_presence'
                ELSE 'missing_payment' END, 'true', CAST(has_payment AS VARCHAR)
            FROM matched WHERE policy_id IS NOT NULL)""",
}
NEEDS = {
    "records": ["policies", "payments"],
    "shown": ["policies"],
    "scored": ["policies", "shown"],
    "findings": ["policies", "payments", "records", "shown", "scored"],
}


def with_views(names: list[str], body: str) -> str:
    """SQL with the named shared views in front."""
    order: list[str] = []
    for name in names:
        for needed in [*NEEDS.get(name, []), name]:
            if needed not in order:
                order.append(needed)
    head = ",\n".join(SHARED[name] for name in order)
    return f"WITH {head}{body if body.startswith(',') else chr(10) + body}" if order else body


def query(name: str, sql: str | None = None, views: list[str] | None = None):
    """Registers ``fn(tables) -> DataFrame`` and its twin."""
    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            text = sql.replace("§N", RE2_SPACE_NOT_LF).replace("§", RE2_SPACE)
            TWINS[name] = with_views(views or [], text)
        return fn
    return add
