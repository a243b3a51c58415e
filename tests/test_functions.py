"""Case tables of the column functions."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import coercion, matching, money

DATES = [
    ("2026-03-04", None, "2026-03-04"), ("2026/03/04", None, "2026-03-04"), ("20260304", None, "2026-03-04"), ("04/03/2026", "dmy", "2026-03-04"),
    ("03/04/2026", "mdy", "2026-03-04"), ("04.03.2026", "dmy", "2026-03-04"), ("4 Mar 2026", None, "2026-03-04"), ("4 March 2026", None, "2026-03-04"),
    ("4-Mar-2026", None, "2026-03-04"), ("4-Mar-26", None, "2026-03-04"), ("Mar 4, 2026", None, "2026-03-04"), ("March 4 2026", None, "2026-03-04"),
    ("2026-03-04 00:00:00", None, "2026-03-04"), ("2026-03-04T09:31:00.000Z", None, "2026-03-04"), ("2026-03-04 09:31:00+01:00", None, "2026-03-04"),
    ("04/03/2026 09:31", "dmy", "2026-03-04"), ("4 Mar 2026 09:31", None, "2026-03-04"), ("25/12/2026", None, "2026-12-25"), ("12/25/2026", None, "2026-12-25"),
    ("03/03/2026", None, "2026-03-03"), ("1/2/69", "dmy", "2069-02-01"), ("1/2/70", "dmy", "1970-02-01"), ("29/02/2024", None, "2024-02-29"), (" 2026-03-04\t", None, "2026-03-04"),
]
BAD_DATES = [("03/04/2026", "ambiguous: 3 April 2026"), ("30/02/2026", "not a real date"), ("13/13/2026", "no valid month"), ("", "blank"), (None, "blank"), ("not-a-date", "not a date format"), ("4 Smarch 2026", "does not name a month"), ("2026-13-01", "month 13")]
AMOUNTS = [
    ("1,234.56", 1234.56, None), ("£1,234.56", 1234.56, "GBP"), ("$1,234.56", 1234.56, "USD"), ("€1.234,56", 1234.56, "EUR"), ("USD 1,234.56", 1234.56, "USD"),
    ("(1,234.56)", -1234.56, None), ("(£1,234.56)", -1234.56, "GBP"), ("-1,234.56", -1234.56, None), ("1,234.56-", -1234.56, None), ("1,234.56 CR", -1234.56, None),
    ("1234.56CR", -1234.56, None), ("1234.56 DR", 1234.56, None), ("1234,56", 1234.56, None), ("1 234,56", 1234.56, None), ("1 234,56", 1234.56, None),
    ("1.234.567,89", 1234567.89, None), ("1,234", 1234, None), ("1.500", 1500, None), ("1,234,567", 1234567, None), ("0.00", 0, None), ("1234", 1234, None),
    ("(-5)", 5, None), ("0.00005", 0.0001, None), (".5", 0.5, None),
]


def test_dates(spark):
    rows = spark.createDataFrame(DATES, "text string, hint string, expected string").withColumn("d", coercion.parse_date(F.col("text"), F.col("hint"))).collect()
    assert [(r.text, str(r.d.value), r.d.reason) for r in rows] == [(r.text, r.expected, None) for r in rows]


def test_bad_dates(spark):
    rows = spark.createDataFrame(BAD_DATES, "text string, why string").withColumn("d", coercion.parse_date(F.col("text"))).collect()
    assert all(r.d.value is None and r.why in r.d.reason for r in rows), rows


def test_amounts(spark):
    rows = spark.createDataFrame([(t, float(v), c) for t, v, c in AMOUNTS], "text string, expected double, code string").withColumn("m", coercion.parse_amount(F.col("text"))).collect()
    assert [(r.text, float(r.m.value), r.m.currency) for r in rows] == [(r.text, r.expected, r.code) for r in rows]


@pytest.mark.parametrize("text", ["", "N/A", "-", "see attached", "1.2.3.4.5x", "9" * 20, None])
def test_bad_amounts(spark, text):
    row = spark.createDataFrame([(text,)], "text string").select(coercion.parse_amount(F.col("text")).alias("m")).first()
    assert row.m.value is None and row.m.reason


def test_decimal_comma(spark):
    def sniff(cells):
        return spark.createDataFrame([(c,) for c in cells], "c string").agg(coercion.decimal_comma(coercion.comma_votes(F.col("c"))).alias("x")).first().x

    assert sniff(["1.234,56", "99,95", "2.500"])
    assert not sniff(["1,50", "1,234", "2,500"])
    assert not sniff(["1,50", "2,50", "3.50"])
    read = spark.range(1).select(coercion.parse_amount(F.lit("1,234"), F.lit(True))["value"].alias("a"), coercion.parse_amount(F.lit("1.234"), F.lit(True))["value"].alias("b")).first()
    assert (float(read.a), float(read.b)) == (1.234, 1234)


def test_currency_and_bank(spark):
    rows = spark.createDataFrame([("£",), ("eur",), ("",), ("12",)], "c string").select(coercion.coerce_currency(F.col("c")).alias("r")).collect()
    assert [r.r.value for r in rows] == ["GBP", "EUR", None, None] and rows[3].r.reason
    banks = spark.createDataFrame([("****1234",), ("N/A",), ("42",), ("Acct 884211",)], "c string").select(coercion.bank_digits(F.col("c")).alias("b")).collect()
    assert [r.b for r in banks] == ["1234", None, "42", "4211"]


def test_normal_forms(spark):
    names = [("Acme Ltd", "acme"), ("Smith & Sons, Inc.", "smith and sons"), ("Limited", "limited"), ("L.L.C. Foods", "l l c foods"), ("  A  B ", "a b")]
    rows = spark.createDataFrame(names, "n string, e string").withColumn("v", matching.normal_vendor(F.col("n"))).collect()
    assert [r.v for r in rows] == [r.e for r in rows]
    numbers = [("INV-0042", "inv42"), ("INV42", "inv42"), ("0007", "7"), ("A-0", "a0"), ("000", "0"), ("10/02", "1002")]
    rows = spark.createDataFrame(numbers, "n string, e string").withColumn("v", matching.normal_invoice_number(F.col("n"))).collect()
    assert [r.v for r in rows] == [r.e for r in rows]
    banks = spark.createDataFrame([("42", "0042"), ("GB00 1234", "1234"), (None, "0000")], "n string, e string").withColumn("v", matching.normal_bank(F.col("n"))).collect()
    assert [r.v for r in banks] == [r.e for r in banks]


def test_similarity_and_branches(spark):
    pairs = [("rookwood cleaning north", "rookwood cleaning south", True), ("acme", "acme 2", True), ("acme", "acme", False), ("harbour supplies", "harbor supplies", False), ("", "", False)]
    rows = spark.createDataFrame(pairs, "a string, b string, e boolean").select("e", matching.differs_only_by_branch(F.col("a"), F.col("b")).alias("d"), matching.vendor_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r.d for r in rows] == [r.e for r in rows]
    assert rows[0].s > 0.86 and rows[4].s == 1


def test_transposition(spark):
    cases = [(1890, 1980, True), (1000890, 1890000, False), (18.90, 19.80, True), (12.34, 21.34, True), (100, 100, False), (12, 120, False)]
    rows = spark.createDataFrame([(float(a), float(b), e) for a, b, e in cases], "a double, b double, e boolean").select("e", matching.is_transposition(F.col("a").cast("decimal(18,4)"), F.col("b").cast("decimal(18,4)")).alias("t")).collect()
    assert [r.t for r in rows] == [r.e for r in rows]


def test_cadence(spark):
    day = date(2026, 1, 1).toordinal()
    weekly = [date.fromordinal(day + 7 * k) for k in range(8)]
    odd = [date.fromordinal(day + k) for k in (0, 40, 42, 90, 91)]
    daily = [date.fromordinal(day + 3 * k) for k in range(8)]
    cases = [(weekly, 7.0), (odd, None), (daily, None), (weekly[:2], None), (weekly + [weekly[3]], 7.0)]
    rows = spark.createDataFrame(cases, "d array<date>, e double").withColumn("c", matching.schedule_cadence(F.col("d"))).collect()
    assert [r.c for r in rows] == [r.e for r in rows]


def test_money(spark):
    cases = [(0.125, "GBP", "£0.13"), (1234.5, "EUR", "€1,234.50"), (-5, "", "-£5.00"), (1, "usd", "US$1.00"), (1, "CHF", "CHF 1.00"), (1, "POUND", "1.00 POUND")]
    rows = spark.createDataFrame([(float(a), c, e) for a, c, e in cases], "a double, c string, e string").withColumn("t", money.money_text(F.col("a").cast("decimal(18,4)"), F.col("c"))).collect()
    assert [r.t for r in rows] == [r.e for r in rows]
