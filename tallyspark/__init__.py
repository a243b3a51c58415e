"""Accounts-payable ledger checks as Spark DataFrame jobs."""
