"""Neighbours and cadences of calm and hot groups against plain Python."""

import datetime as dt
import random
from decimal import Decimal
from statistics import median

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import cadence, rules

DAY = dt.date(2026, 1, 1)
SCHEMA = "ledger_id string, seq long, id string, vendor_name string, invoice_number string, invoice_date date, amount decimal(18,4), currency string, reference string, bank_last4 string"


def ledger(seed, rows=400):
    """A supplier and amount with most rows, a steady contract, and undated rows."""
    rng = random.Random(seed)
    out = []
    for i in range(rows):
        day = None if i % 50 == 7 else DAY + dt.timedelta(days=rng.randint(0, 300))
        out.append(("l", rng.randint(0, 3), f"r{i:04d}", "Acme Ltd" if i % 4 else f"Other {i % 12}", f"N{rng.randint(0, 30)}", day, Decimal(100), "GBP", None, None))
    out += [("l", 0, f"c{i:03d}", "Steady", f"C{i}", DAY + dt.timedelta(days=14 * i), Decimal(70), "GBP", None, None) for i in range(26)]
    return out


def groups_of(rows):
    groups = {}
    for r in rows:
        groups.setdefault((r[3].removesuffix(" Ltd").lower(), r[6]), []).append(r)
    for key, own in groups.items():
        yield key, sorted(own, key=lambda r: (r[5] is None, r[5] or DAY, r[1], r[2]))


def brute(rows):
    cadences, pairs = {}, set()
    for key, own in groups_of(rows):
        gaps = [None if a[5] is None or b[5] is None else abs((b[5] - a[5]).days) for a, b in zip(own, own[1:])]
        known = [g for g in gaps if g is not None]
        pace = median(known) if known else None
        beat = lambda g: pace is not None and g is not None and abs(g - pace) <= max(3, 0.15 * pace)  # noqa: B023, E731
        steady = len(own) >= 3 and pace is not None and pace >= 5 and sum(map(beat, gaps)) * 10 >= (len(own) - 1) * 7
        cadences[key] = pace if steady else None
        for gap, a, b in zip(gaps, own, own[1:]):
            if gap is not None and gap <= 21 and a[4] != b[4] and not (steady and beat(gap)):
                pairs.add((a[2], b[2]))
    return cadences, pairs


@pytest.mark.parametrize("hot", [None, 20])
def test_hot_groups_equal_calm_ones(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(cadence, "HOT_ROWS", hot)
        monkeypatch.setattr(cadence, "HOT_SHARE", 100)
    rows = ledger(3)
    invoices = rules.normalise(spark.createDataFrame(rows, SCHEMA))
    cadences, pairs = brute(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        key = ["vendor_norm", "amount"]
        paired = cadence.with_previous(invoices, key, ["invoice_date"]).select(*key, F.datediff("invoice_date", "before.invoice_date").alias("gap"))
        found = cadence.gap_cadences(paired, key).withColumn("ok", cadence.is_steady(F.col("n"), F.col("pace"), F.col("held"))).collect()
        assert {(r.vendor_norm, r.amount): r.pace if r.ok else None for r in found} == cadences
        assert {tuple(r.invoice_ids) for r in rules.rekeyed_duplicates(invoices).collect()} == pairs
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_no_window_holds_a_hot_group(spark, monkeypatch):
    """All rows are one group; its rows are dealt over many ranges."""
    monkeypatch.setattr(cadence, "HOT_ROWS", 100)
    monkeypatch.setattr(cadence, "HOT_SHARE", 10**6)
    rows = [("l", 0, f"r{i:05d}", "Acme", f"N{i}", DAY + dt.timedelta(days=i % 900), Decimal(100), "GBP", None, None) for i in range(4000)]
    invoices = rules.normalise(spark.createDataFrame(rows, SCHEMA))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        paired = cadence.with_previous(invoices, ["vendor_norm"], ["id"])
        largest = paired.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
        assert paired.where("before is null").count() == 1 and largest < 2000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
