"""LedgerLens: business-record analytics and document reconciliation on Spark."""
