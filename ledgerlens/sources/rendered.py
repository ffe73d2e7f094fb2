"""Policy documents rendered from the policy table.

The given documents never mention policies, so the document side of the
reconciliation is written by Spark from the records themselves: spelling varies
with the id, and known errors are planted at fixed intervals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.model import Tables


def policy_documents(t: Tables) -> DataFrame:
    """The values a document shows, one row per policy, planted errors included.

    Rows are laid out by document, so that pages and lines made of them stay together.
    """
    policies = t.policies()
    names = t.customers().select(F.col("id").alias("customer_id"),
                                 F.concat_ws(" ", "first_name", "last_name").alias("customer_name"))
    carriers = t.carriers().select(F.col("id").alias("carrier_id"),
                                   F.col("name").alias("carrier_name"))
    plans = t.policy_plans().select(F.col("id").alias("plan_id"), F.col("name").alias("plan_name"))
    base = (policies.join(names, "customer_id").join(carriers, "carrier_id")
            .join(plans, "plan_id", "left"))
    i = F.col("id")
    every = lambda k: i % k == 0
    shown = base.select(
        i.alias("document_id"), "workspace_id",
        F.when(every(23), F.concat(F.lit("UNK-"), i.cast("string")))
        .otherwise(F.col("policy_number")).alias("shown_number"),
        F.when(every(17), F.concat(F.lit("Changed "), F.col("customer_name")))
        .otherwise(F.col("customer_name")).alias("shown_customer"),
        F.col("carrier_name").alias("shown_carrier"), F.col("plan_name").alias("shown_plan"),
        F.when(every(11), F.date_add("effective_date", 1))
        .otherwise(F.col("effective_date")).alias("shown_effective"),
        F.when(every(31), F.add_months("effective_date", 12)).alias("shown_termination"),
        F.when(~every(19), F.date_sub("effective_date", 7)).alias("shown_signature"),
        F.when(every(13), F.col("premium") + 5).otherwise(F.col("premium"))
        .cast("decimal(12,2)").alias("shown_premium"),
        F.col("status").alias("shown_status"),
        F.when(every(29), 0.6).otherwise(0.98).alias("page_confidence"))
    return t.spread(shown, "document_id", t.raw("orders").count())   # from the files' footers


def policy_pages(t: Tables) -> DataFrame:
    """Two text pages per policy document."""
    d = policy_documents(t)
    i = F.col("document_id")
    pick = lambda k, *options: F.element_at(
        F.array(*[o if not isinstance(o, str) else F.lit(o) for o in options]),
        (i % k + 1).cast("int"))

    def line(label, value):
        return F.when(value.isNotNull(), F.concat(label, value))

    date = F.col("shown_effective")
    dates = [F.date_format(date, p) for p in
             ("yyyy-MM-dd", "MM/dd/yyyy", "MMMM d, yyyy", "MMM d yyyy", "d MMMM yyyy")]
    amount = F.col("shown_premium").cast("string")
    grouped = F.format_number("shown_premium", 2)
    premiums = [F.concat(F.lit("$"), grouped), F.concat(F.lit("USD "), amount), amount]
    statuses = (F.when(F.col("shown_status") == "active", pick(2, "Active", "In Force"))
                .when(F.col("shown_status") == "cancelled",
                      pick(3, "Cancelled", "Canceled", "Terminated"))
                .otherwise(F.lit("Pending")))
    first = F.concat_ws(
        "\n", F.lit("Coverage Schedule"),
        line(pick(3, "Policy Number: ", "Contract No. ", "Policy ID\n"), F.col("shown_number")),
        line(pick(2, "Policyholder Name: ", "Insured: "), F.col("shown_customer")),
        line(pick(2, "Carrier: ", "Insurance Company - "), F.col("shown_carrier")),
        line(pick(2, "Plan Name: ", "Product: "), F.col("shown_plan")),
        F.lit("Thank you for choosing us."))
    second = F.concat_ws(
        "\r\n", line(pick(2, "Effective Date: ", "Coverage Start Date = "), pick(5, *dates)),
        line(F.lit("Termination Date: "), F.date_format("shown_termination", "yyyy-MM-dd")),
        line(pick(3, "Premium Amount: ", "Monthly Premium: ", "Premium is "), pick(3, *premiums)),
        line(pick(2, "Policy Status: ", "Status: "), statuses),
        line(F.lit("Signature Date: "), F.date_format("shown_signature", "MM/dd/yyyy")))
    return d.select(
        "workspace_id", "document_id", i.alias("processing_run_id"), "page_confidence",
        F.posexplode(F.array(first, second)).alias("n", "text_content")).select(
        "workspace_id", "document_id", "processing_run_id",
        (F.col("document_id") * 2 + F.col("n")).alias("page_id"),
        (F.col("n") + 1).alias("page_number"), "text_content",
        F.lit("completed").alias("status"), F.col("page_confidence").alias("confidence_score"))
