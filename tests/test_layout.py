"""The layout that the rules share: same findings, hot suppliers in parts, no second shuffle."""

import datetime as dt
import random
from decimal import Decimal

import pytest

from tallyspark.model import INVOICE
from tallyspark.operators import rules
from tallyspark.operators.layout import PLACE, dealt

DAY = dt.date(2026, 1, 1)


def skewed(rows=1500):
    """Two thirds of the rows belong to one supplier; some have no date, number or name."""
    rng = random.Random(5)
    amounts = [Decimal(a) for a in ("123.45", "132.45", "80", "80.0049", "80.005", "7500", "610.10", "601.10", "95.5")]
    out = []
    for i in range(rows):
        name = rng.choice(["Hot Ltd", "Hot", "hot limited"]) if i % 3 else rng.choice(["A", "B Ltd", "Hott", None, "C"])
        amount = rng.choice(amounts) + (0 if rng.random() < 0.3 else Decimal(rng.randint(0, 90_000)) / 100)
        day = None if i % 40 == 3 else DAY + dt.timedelta(days=rng.randint(0, 120))
        bank = f"{rng.choice([1111, 1111, 1111, 2222, 3333])}" if i % 5 else None
        out.append(("l", i, f"r{i:04d}", name, None if i % 97 == 0 else f"INV-{rng.randint(1, 40)}", day, amount * (-1 if i % 7 == 0 else 1), rng.choice(["GBP", "EUR"]), None, bank))
    return out


@pytest.fixture(scope="module")
def frames(spark):
    invoices = spark.createDataFrame(skewed(), INVOICE)
    return rules.normalise(invoices).cache(), dealt(rules.normalise(invoices), invoices, hot_rows=150)


@pytest.mark.parametrize("rule", rules.ALL_RULES, ids=lambda r: r.__name__)
def test_same_findings(frames, rule):
    plain, parted = ([tuple(r) for r in rule(f).collect()] for f in frames)
    assert plain and sorted(plain, key=repr) == sorted(parted, key=repr)


def test_hot_supplier_lies_in_parts(frames):
    sizes = {tuple(r)[:3]: r["count"] for r in frames[1].groupBy(*PLACE).count().collect()}
    hot = [n for (_, name, _), n in sizes.items() if name == "hot"]
    assert len(hot) > 4 and sum(hot) > 900
    # Rows of one amount stay together; beyond them no part is much larger than the limit.
    assert max(hot) < 400
    assert all(part == 0 for (_, name, part) in sizes if name == "c")


def moved_rows(plan):
    """The exchanges of a plan that take the rows of a table as they are, without an aggregate, window or join below."""
    lines = [line for line in plan.splitlines() if "Join" in line or any(f"{word} " in line or f"{word}(" in line for word in ("Exchange", "Aggregate", "Window", "FileScan"))]
    return sum("Exchange hashpartitioning" in above and "FileScan" in below for above, below in zip(lines, lines[1:]))


@pytest.mark.parametrize(("rule", "most"), [(rules.exact_duplicates, 0), (rules.rekeyed_duplicates, 0), (rules.amount_transpositions, 0), (rules.unapplied_credits, 2), (rules.bank_detail_changes, 0)], ids=lambda r: getattr(r, "__name__", r))
def test_rows_are_not_shuffled_again(spark, frames, rule, most):
    """Only what shrank moves: counts, pairs, accounts; of the credit rule its credits."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        plan = rule(frames[1])._jdf.queryExecution().executedPlan().toString()
        assert moved_rows(plan) <= most, plan
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_empty(spark):
    invoices = spark.createDataFrame([], INVOICE)
    rows = dealt(rules.normalise(invoices), invoices)
    assert all(rule(rows).count() == 0 for rule in rules.ALL_RULES)
    assert set(INVOICE.names) <= set(rows.columns)
