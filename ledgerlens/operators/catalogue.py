"""The business tables described as a table, and column choice by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Table and column descriptions shown to users.
TABLE_DESCRIPTIONS = {
    "insurance_carriers": "Insurance carrier or insurance company.",
    "insurance_plans": "Insurance plans offered by carriers.",
    "insurance_agents": "Agents responsible for insurance sales.",
    "insurance_customers": "Customers who own insurance policies.",
    "insurance_policies": "Insurance policies sold to customers.",
    "insurance_payments": "Payments received for insurance policies.",
    "insurance_commissions": "Agent commissions associated with policies.",
}
COLUMN_DESCRIPTIONS = {
    "insurance_policies.policy_number": "Unique policy identifier.",
    "insurance_policies.status": "Current policy status.",
    "insurance_policies.effective_date": "Date on which policy coverage begins.",
    "insurance_policies.termination_date": "Date on which policy coverage ends.",
    "insurance_policies.premium": "Policy premium amount.",
    "insurance_payments.amount": "Payment amount.",
    "insurance_commissions.amount": "Commission amount.",
    "insurance_carriers.name": "Carrier name.",
    "insurance_agents.first_name": "Agent first name.",
    "insurance_agents.last_name": "Agent last name.",
    "insurance_customers.first_name": "Customer first name.",
    "insurance_customers.last_name": "Customer last name.",
}
DEFAULT_TABLE_DESCRIPTION = "Approved insurance business table."

# Which column points at which table.
REFERENCES = {
    ("insurance_plans", "carrier_id"): "insurance_carriers",
    ("insurance_policies", "carrier_id"): "insurance_carriers",
    ("insurance_policies", "customer_id"): "insurance_customers",
    ("insurance_policies", "plan_id"): "insurance_plans",
    ("insurance_policies", "agent_id"): "insurance_agents",
    ("insurance_payments", "policy_id"): "insurance_policies",
    ("insurance_commissions", "policy_id"): "insurance_policies",
    ("insurance_commissions", "agent_id"): "insurance_agents",
}


class MissingColumnError(ValueError):
    """No candidate column exists in the table."""


def resolve_column(df: DataFrame, candidates: list[str]) -> str | None:
    """First candidate the table has, whatever its case."""
    present = {name.lower(): name for name in df.columns}
    return next((present[c.lower()] for c in candidates if c.lower() in present), None)


def require_column(df: DataFrame, candidates: list[str], meaning: str) -> str:
    found = resolve_column(df, candidates)
    if found is None:
        raise MissingColumnError(f"no column for {meaning}: expected one of {', '.join(candidates)}")
    return found


def valid_identifier(c: Column) -> Column:
    """Lower-case identifier, null when it is not one."""
    tidy = F.lower(F.trim(c))
    return F.when(tidy.rlike(r"^[a-z_][a-z0-9_]*$"), tidy)


def catalogue(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """One row per column of the allowed tables; references only to allowed tables."""
    rows = []
    for table, df in tables.items():
        for position, field in enumerate(df.schema.fields):
            target = REFERENCES.get((table, field.name))
            rows.append((
                table, TABLE_DESCRIPTIONS.get(table, DEFAULT_TABLE_DESCRIPTION), position,
                field.name, field.dataType.simpleString(), bool(field.nullable),
                field.name == "id", target if target in tables else None,
                "id" if target in tables else None,
                COLUMN_DESCRIPTIONS.get(f"{table}.{field.name}")))
    return spark.createDataFrame(
        rows, "table_name string, table_description string, position int, column_name string, "
              "data_type string, nullable boolean, primary_key boolean, references_table string, "
              "references_column string, description string")
