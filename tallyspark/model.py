"""Schemas and options of the ledger checks."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

AMOUNT = T.DecimalType(18, 4)

INVOICE = T.StructType(
    [
        T.StructField("ledger_id", T.StringType(), False),
        T.StructField("seq", T.LongType()),
        T.StructField("id", T.StringType(), False),
        T.StructField("vendor_name", T.StringType()),
        T.StructField("invoice_number", T.StringType()),
        T.StructField("invoice_date", T.DateType()),
        T.StructField("amount", AMOUNT),
        T.StructField("currency", T.StringType()),
        T.StructField("reference", T.StringType()),
        T.StructField("bank_last4", T.StringType()),
    ]
)

FINDING_COLUMNS = ["ledger_id", "rule_ordinal", "rule_id", "severity", "amount_at_stake", "invoice_ids", "explanation", "finding_key"]

# The rules in the order in which their findings are listed.
RULES = [
    ("exact-duplicate", "high"),
    ("rekeyed-duplicate", "high"),
    ("vendor-spelling-duplicate", "high"),
    ("amount-transposition", "medium"),
    ("unapplied-credit", "medium"),
    ("bank-detail-change", "high"),
    ("round-number-outlier", "low"),
]
DUPLICATE_FAMILY = ["exact-duplicate", "rekeyed-duplicate", "vendor-spelling-duplicate", "amount-transposition"]


@dataclass(frozen=True)
class Options:
    """Limits of the rules; a caller overrides single fields."""

    rekey_window_days: int = 21
    min_amount: Decimal = Decimal("50")
    round_number_threshold: Decimal = Decimal("5000")
    vendor_similarity: float = 0.86


def severity_rank(severity: Column) -> Column:
    """0 for high, 1 for medium, 2 for low."""
    return F.when(severity == "high", 0).when(severity == "medium", 1).when(severity == "low", 2)


def reading_order(alias: str = "") -> Column:
    """Rows read by date, then by their place in the file; rows without a date come last."""
    name = (lambda c: f"{alias}.{c}") if alias else (lambda c: c)
    return F.struct(
        F.col(name("invoice_date")).isNull().alias("undated"),
        F.col(name("invoice_date")).alias("day"),
        F.col(name("seq")).alias("seq"),
        F.col(name("id")).alias("id"),
    )


def as_findings(rows: DataFrame, rule_id: str, stake: Column, ids: Column, explanation: Column) -> DataFrame:
    """Findings of one rule in the common layout."""
    ordinal = [name for name, _ in RULES].index(rule_id)
    return rows.select(
        "ledger_id",
        F.lit(ordinal).alias("rule_ordinal"),
        F.lit(rule_id).alias("rule_id"),
        F.lit(RULES[ordinal][1]).alias("severity"),
        stake.cast(AMOUNT).alias("amount_at_stake"),
        ids.alias("invoice_ids"),
        explanation.alias("explanation"),
        finding_key(F.lit(rule_id), ids).alias("finding_key"),
    )


def finding_key(rule_id: Column, ids: Column) -> Column:
    """A key that stays the same when the rules run again: the rule and its sorted row ids."""
    return F.concat(rule_id, F.lit(":"), F.array_join(F.array_sort(ids), "+"))
