"""Two whole ledgers with known problems, known traps and known answers, from file to review queue."""

from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.model import INVOICE
from tallyspark.operators.combine import queued, summary
from tallyspark.operators.importing import ImportOptions, import_files
from tallyspark.plans.detection import detect
from tallyspark.sources.csv_files import EXPORT_HEADER, csv_line, export_columns

# The problems and the traps of a year's ledger: supplier, number, days after the start, amount, bank.
START = date(2025, 9, 1)
TRAPS = [
    *[("Rookwood Cleaning", f"RC-CONTRACT-{m + 1}", 30 * m + m // 2, "1450", "3071") for m in range(12)],
    *[("Bridgeway Insurance", f"BW-{2200 + i}", 12 + 45 * i, amount, "6120") for i, amount in enumerate(["8000", "12000", "6000", "15000", "9000", "11000"])],
    ("Fenwick Tooling", "FT-CN-901", 60, "-640", None),
    ("Fenwick Tooling", "FT-3320", 74, "640", "4410"),
]
PLANTED = [
    ("Harlow Print Services", "HAR-4471", 40, "3280.5", "2918"),
    ("Harlow Print Services", "HAR-4471", 47, "3280.5", "2918"),
    ("Kestrel Logistics", "KES-7781", 88, "5610.75", "7145"),
    ("Kestrel Logistics", "KES-7781-A", 93, "5610.75", "7145"),
    ("Westbay Electrical", "WB-2291", 120, "7420", "5532"),
    ("Westbay Electrical Ltd.", "WB2291", 131, "7420", "5532"),
    ("Marchmont Stationery", "MAR-5510", 150, "1890", "8260"),
    ("Marchmont Stationery", "MAR-5511", 156, "1980", "8260"),
    ("Sandsend Packaging", "SP-CN-118", 200, "-2310", None),
    ("Halden Site Services", "TS-9001", 210, "4150", "8842"),
    ("Halden Site Services", "TS-9002", 240, "4150.01", "8842"),
    ("Halden Site Services", "TS-9014", 268, "6890", "2077"),
]
# The answer, in the order of the queue: rule, stake, the planted rows by their place in the list.
ANSWER = [
    ("vendor-spelling-duplicate", "7420.00", (4, 5)),
    ("bank-detail-change", "6890.00", (10, 11)),
    ("rekeyed-duplicate", "5610.75", (2, 3)),
    ("exact-duplicate", "3280.50", (0, 1)),
    ("unapplied-credit", "2310.00", (8,)),
    ("amount-transposition", "1890.00", (6, 7)),
]
BANKS = {"Harlow Print Services": "2918", "Kestrel Logistics": "7145", "Westbay Electrical": "5532", "Marchmont Stationery": "8260", "Sandsend Packaging": "1187", "Rookwood Cleaning": "3071", "Fenwick Tooling": "4410"}


def traffic(suppliers, rows):
    """Ordinary invoices: odd amounts on uneven days, each supplier with one account."""
    for v, (supplier, bank) in enumerate(suppliers.items()):
        for i in range(rows):
            cents = 13_711 + 21_137 * v + 17_393 * i
            yield supplier, f"{supplier[:3].upper()}-{1000 + 97 * v + 31 * i}", 3 * v % 20 + 29 * i + (7 * i * i + v) % 11, str(Decimal(cents) / 100), bank


def invoices(spark, named, ledger_id="demo"):
    out = [(ledger_id, i, name, v, n, START + timedelta(days=day), Decimal(amount), "GBP", None, bank) for i, (name, (v, n, day, amount, bank)) in enumerate(named)]
    return spark.createDataFrame(out, INVOICE)


@pytest.fixture(scope="module")
def year(spark):
    ordinary = [*traffic(BANKS, 10), *TRAPS]
    named = [(f"o{i}", row) for i, row in enumerate(ordinary)] + [(f"p{i}", row) for i, row in enumerate(PLANTED)]
    return invoices(spark, named)


def test_year_queue(spark, year):
    findings = detect(year)
    queue = queued(findings).orderBy("queue_rank").collect()
    assert [(r.rule_id, f"{r.amount_at_stake:.2f}", tuple(r.invoice_ids)) for r in queue] == [(rule, stake, tuple(f"p{i}" for i in ids)) for rule, stake, ids in ANSWER]
    assert [r.queue_rank for r in queue] == [1, 2, 3, 4, 5, 6]
    total = summary(year, findings).first()
    assert (total.findings, total.total_at_stake) == (6, Decimal("27401.25"))


def test_year_survives_its_own_export(spark, year):
    written = year.orderBy("seq").select(csv_line(export_columns(year)).alias("line")).collect()
    content = "\n".join([",".join(EXPORT_HEADER), *(r.line for r in written)])
    result = import_files(spark.createDataFrame([("year.csv", content)], "file_id string, content string"), ImportOptions())
    assert result.errors.count() == 0 and result.invoices.count() == year.count()
    queue = queued(detect(result.invoices)).orderBy("queue_rank").collect()
    assert [(r.rule_id, f"{r.amount_at_stake:.2f}") for r in queue] == [(rule, stake) for rule, stake, _ in ANSWER]


# The problems of a day-first file: supplier, number, date, amount, bank.
FILE_HEADER = "Contact Name,Invoice Number,Invoice Date,Total,Currency,Reference,Bank Account"
FILE_PLANTED = [
    ("Bellamy Freight", "BF-88204", "09/03/2026", "3180.50", "8820"),
    ("Bellamy Freight", "BF-88204", "20/03/2026", "3180.50", "8820"),
    ("Fenwick Electrical", "FE-3312", "04/05/2026", "2240.00", "3308"),
    ("Fenwick Electrical", "FE-3312-A", "17/05/2026", "2240.00", "3308"),
    ("Corvid Print & Signage", "CPS-7741", "12/07/2026", "4150.00", "2019"),
    ("Corvid Print & Signage", "CPS-7741B", "15/07/2026", "1450.00", "2019"),
    *[("Halloway IT Services", f"HIT-99{m}", f"11/{m:02}/2026", "2875.00", "6108") for m in range(8, 13)],
    ("Draycott Facilities", "DF-5000", "23/09/2026", "5000.00", "6634"),
    ("Elmsworth Stationery", "ES-4410", "06/10/2026", "612.40", "7712"),
    ("Elmsworth Stationary", "ES-4410", "08/10/2026", "612.40", "7712"),
]
FILE_ANSWER = [
    ("bank-detail-change", "14375.00", 6),
    ("exact-duplicate", "3180.50", 2),
    ("rekeyed-duplicate", "2240.00", 2),
    ("vendor-spelling-duplicate", "612.40", 2),
    ("amount-transposition", "1450.00", 2),
    ("round-number-outlier", "5000.00", 1),
]
FILE_BANKS = {"Bellamy Freight": "8820", "Fenwick Electrical": "3308", "Corvid Print & Signage": "2019", "Halloway IT Services": "5527", "Draycott Facilities": "6634", "Elmsworth Stationery": "7712"}


def test_day_first_file(spark):
    ordinary = [(s, n, date(2026, 1, 3) + timedelta(days=day), amount, bank) for s, n, day, amount, bank in traffic(FILE_BANKS, 7)]
    contract = [("Northgate Cleaning Services", f"NGC-2026-{m:02}", date(2026, m, 2), "1450.00", "5541") for m in range(1, 13)]
    lines = [",".join((s, n, day.strftime("%d/%m/%Y"), amount, "GBP", "PO-1", bank)) for s, n, day, amount, bank in ordinary + contract]
    lines += [",".join((s, n, day, amount, "GBP", "PO-2", bank)) for s, n, day, amount, bank in FILE_PLANTED]
    files = spark.createDataFrame([("file.csv", "\n".join([FILE_HEADER, *lines]))], "file_id string, content string")
    result = import_files(files, ImportOptions(date_order="dmy"))
    assert result.errors.count() == 0 and result.invoices.count() == len(lines)
    findings = detect(result.invoices)
    told = [(r.rule_id, f"{r.amount_at_stake:.2f}", len(r.invoice_ids)) for r in findings.collect()]
    assert sorted(told) == sorted(FILE_ANSWER)
    first = len(ordinary) + len(contract) + 2
    ids = {r.rule_id: set(r.invoice_ids) for r in findings.where(F.col("rule_id") != "bank-detail-change").collect()}
    assert ids["exact-duplicate"] == {f"row-{first}", f"row-{first + 1}"} and ids["round-number-outlier"] == {f"row-{first + 11}"}
    assert findings.agg(F.sum("amount_at_stake")).first()[0] == Decimal("26857.90")


def test_queue_numbers_every_finding_of_every_ledger(spark):
    """Bands and their offsets give the same numbers as one sort of each ledger."""
    kinds = [("bank-detail-change", 5, "high"), ("rekeyed-duplicate", 1, "medium"), ("round-number-outlier", 6, "low")]
    rows = [(f"l{i % 2}", kinds[i % 3][1], kinds[i % 3][0], kinds[i % 3][2], Decimal(i * 7919 % 50 * 100), [f"r{i}"], "", f"{kinds[i % 3][0]}:r{i}") for i in range(300)]
    frame = spark.createDataFrame(rows, "ledger_id string, rule_ordinal int, rule_id string, severity string, amount_at_stake decimal(18,4), invoice_ids array<string>, explanation string, finding_key string")
    rank = {"high": 0, "medium": 1, "low": 2}
    want = {}
    for side in ("l0", "l1"):
        own = sorted((r for r in rows if r[0] == side), key=lambda r: (rank[r[3]], -r[4], r[1], r[7]))
        want.update({r[7]: place for place, r in enumerate(own, 1)})
    assert {r.finding_key: r.queue_rank for r in queued(frame).collect()} == want
