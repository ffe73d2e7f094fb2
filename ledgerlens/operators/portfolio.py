"""The eight portfolio questions.

Facts are reduced on their own key before they meet another table, so a policy,
carrier or agent that owns a third of the rows has already been combined
map-side. Small dimensions are broadcast by the optimiser's size check, never
by a hint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.catalogue import require_column, resolve_column

TOTAL = "decimal(38,2)"


def in_workspace(df: DataFrame, workspace: str | None) -> DataFrame:
    """Tenant restriction; applied to every table of a query."""
    return df if workspace is None else df.where(F.col("workspace_id") == workspace)


def policies_by_status(policies: DataFrame, workspace: str | None = None) -> DataFrame:
    return (in_workspace(policies, workspace).groupBy("status")
            .agg(F.count("*").alias("policy_count"))
            .orderBy(F.desc("policy_count"), "status"))


def active_policy_count(policies: DataFrame, workspace: str | None = None) -> DataFrame:
    return (in_workspace(policies, workspace).where(F.lower("status") == "active")
            .agg(F.count("*").alias("active_policy_count")))


def _carrier_names(carriers: DataFrame, workspace: str | None) -> DataFrame:
    name = require_column(carriers, ["name", "carrier_name"], "carrier name")
    return in_workspace(carriers, workspace).select(
        F.col("id").alias("carrier_id"), F.col(name).alias("carrier_name"))


def policies_by_carrier(policies: DataFrame, carriers: DataFrame,
                        workspace: str | None = None) -> DataFrame:
    per_carrier = (in_workspace(policies, workspace).groupBy("carrier_id")
                   .agg(F.count("*").alias("n")))
    return (per_carrier.join(_carrier_names(carriers, workspace), "carrier_id")
            .groupBy("carrier_name").agg(F.sum("n").alias("policy_count"))
            .orderBy(F.desc("policy_count"), "carrier_name"))


def active_without_payments(policies: DataFrame, payments: DataFrame,
                            workspace: str | None = None) -> DataFrame:
    active = in_workspace(policies, workspace).where(F.lower("status") == "active").select(
        F.col("id").alias("policy_id"), "policy_number", "status")
    paid = in_workspace(payments, workspace).select("policy_id").distinct()
    return active.join(paid, "policy_id", "left_anti").orderBy("policy_number", "policy_id")


def duplicate_policy_numbers(policies: DataFrame, workspace: str | None = None) -> DataFrame:
    return (in_workspace(policies, workspace).groupBy("policy_number")
            .agg(F.count("*").alias("duplicate_count")).where("duplicate_count > 1")
            .orderBy(F.desc("duplicate_count"), "policy_number"))


def payments_by_carrier(payments: DataFrame, policies: DataFrame, carriers: DataFrame,
                        workspace: str | None = None) -> DataFrame:
    amount = require_column(payments, ["amount", "payment_amount", "paid_amount"],
                            "payment amount")
    per_policy = (in_workspace(payments, workspace).groupBy("policy_id")
                  .agg(F.count("*").alias("n"), F.sum(amount).alias("amount")))
    owned = in_workspace(policies, workspace).select(
        F.col("id").alias("policy_id"), "carrier_id")
    per_carrier = (per_policy.join(owned, "policy_id").groupBy("carrier_id")
                   .agg(F.sum("n").alias("n"), F.sum("amount").alias("amount")))
    return (per_carrier.join(_carrier_names(carriers, workspace), "carrier_id")
            .groupBy("carrier_name")
            .agg(F.sum("n").alias("payment_count"),
                 F.coalesce(F.sum("amount"), F.lit(0)).cast(TOTAL).alias("total_payment_amount"))
            .orderBy(F.desc("total_payment_amount"), "carrier_name"))


def agent_display_name(agents: DataFrame) -> Column:
    """First and last name, else a name column, else an e-mail column."""
    first = resolve_column(agents, ["first_name", "firstname"])
    last = resolve_column(agents, ["last_name", "lastname"])
    if first and last:
        return F.trim(F.concat_ws(" ", first, last))
    name = resolve_column(agents, ["name", "full_name", "agent_name"])
    return F.col(name or require_column(agents, ["email", "work_email"], "agent display name"))


def commissions_by_agent(commissions: DataFrame, agents: DataFrame,
                         policies: DataFrame | None = None,
                         workspace: str | None = None) -> DataFrame:
    """Commissions reach their agent directly, or through the policy when they name none."""
    amount = require_column(commissions, ["amount", "commission_amount", "net_amount"],
                            "commission amount")
    rows = in_workspace(commissions, workspace)
    sums = [F.count("*").alias("n"), F.sum(amount).alias("amount")]
    if resolve_column(commissions, ["agent_id"]):
        per_agent = rows.groupBy("agent_id").agg(*sums)
    else:
        held = in_workspace(policies, workspace).select(F.col("id").alias("policy_id"), "agent_id")
        per_agent = (rows.groupBy("policy_id").agg(*sums).join(held, "policy_id")
                     .groupBy("agent_id")
                     .agg(F.sum("n").alias("n"), F.sum("amount").alias("amount")))
    people = in_workspace(agents, workspace)
    people = people.select(F.col("id").alias("agent_id"),
                           agent_display_name(people).alias("agent_name"))
    return (per_agent.join(people, "agent_id").groupBy("agent_name")
            .agg(F.sum("n").alias("commission_count"),
                 F.coalesce(F.sum("amount"), F.lit(0)).cast(TOTAL)
                 .alias("total_commission_amount"))
            .orderBy(F.desc("total_commission_amount"), "agent_name"))


def recent_policies(policies: DataFrame, workspace: str | None = None,
                    limit: int | None = None) -> DataFrame:
    day = require_column(policies, ["effective_date", "created_at"], "policy date")
    premium = resolve_column(policies, ["premium", "premium_amount", "monthly_premium"])
    columns = [F.col("id").alias("policy_id"), F.col("policy_number"), F.col("status"),
               F.col(day).alias("effective_date")]
    if premium:
        columns.append(F.col(premium).alias("premium"))
    ordered = (in_workspace(policies, workspace).select(*columns)
               .orderBy(F.desc("effective_date"), "policy_number", "policy_id"))
    return ordered.limit(limit) if limit else ordered
