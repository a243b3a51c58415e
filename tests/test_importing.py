"""Tokenizer cases, column mapping, messy files and the round trip of a written ledger."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import importing, mapping
from tallyspark.sources import csv_files, tables

HEADER = "Supplier Name,Invoice No,Invoice Date,Net Amount,Currency,Reference,Bank Acc (last 4)"


def run(spark, *contents, **options):
    files = spark.createDataFrame([(f"f{i}", c) for i, c in enumerate(contents)], "file_id string, content string")
    return importing.import_files(files, importing.ImportOptions(**options))


def told(result):
    return [(r.file_id, r.row, r.column, r.reason) for r in result.errors.orderBy("file_id", "row", "reason").collect()]


@pytest.mark.parametrize(
    ("text", "records"),
    [
        ("a,b\n1,2\n", [(1, ["a", "b"], None), (2, ["1", "2"], None)]),
        ("a,b\r\n1,2\r3,4", [(1, ["a", "b"], None), (2, ["1", "2"], None), (3, ["3", "4"], None)]),
        ("﻿a , b\n\n \n", [(1, ["a", "b"], None)]),
        ('""\n', [(1, [""], None)]),
        ('"  x  ", y \n', [(1, ["  x  ", "y"], None)]),
        ('"say ""hi"", now",2\n', [(1, ['say "hi", now', "2"], None)]),
        ('"one\ntwo",2\n3,4\n', [(1, ["one\ntwo", "2"], None), (3, ["3", "4"], None)]),
        ('12" pipe,1\n', [(1, ['12" pipe', "1"], None)]),
        ('"Bracket 12" x 4",5\n', [(1, ['Bracket 12 x 4"', "5"], None)]),
        ('a,"b\nc\nd', [(1, ["a", "b\nc\nd"], 1)]),
        ("a,", [(1, ["a", ""], None)]),
        ("", []),
    ],
)
def test_records(text, records):
    assert list(csv_files.split_records(text)) == records


def guesses(spark, header, **overrides):
    heads = spark.createDataFrame([("f", header.split(","))], "file_id string, cells array<string>")
    return {r.field: r for r in mapping.suggest_mapping(heads, overrides).collect()}


@pytest.mark.parametrize(
    "header",
    [HEADER, "Payee,Invoice #,Doc Date,Gross,Currency,PO Number,Bank Acc (last 4)", "Vendor Name,Document Number,Posting Date,Value,CCY,Narrative,Last 4", "Supplier,Invoice No,Invoice Date,Net Amount,Currency,Description,Bank Account (last 4)"],
)
def test_known_layouts(spark, header):
    assert [guesses(spark, header)[f].column for f in mapping.FIELDS] == list(range(7))


def test_close_call_and_overrides(spark):
    close = guesses(spark, "Doc Date,Invoice Date,Amount,Vendor,Invoice No,Currency,Reference")
    assert close["invoiceDate"].column == 1 and close["invoiceDate"].confidence < 1 and "Doc Date" in close["invoiceDate"].reason
    own = guesses(spark, "Doc Date,Invoice Date,Amount,Vendor,Invoice No,Currency,Reference", invoiceDate="doc date", amount=2, reference=None, currency="Money")
    assert (own["invoiceDate"].column, own["invoiceDate"].confidence) == (0, 1.0) and own["amount"].column == 2
    assert own["reference"].column is None and own["currency"].column is None and "does not have" in own["currency"].reason


def test_required_takes_from_optional(spark):
    rows = guesses(spark, "Vendor,Invoice Reference,Doc Date,Net,Payment Details")
    assert rows["invoiceNumber"].column == 1 and "optional" in rows["invoiceNumber"].reason
    assert rows["reference"].column == 4
    alone = guesses(spark, "Vendor,Invoice Reference,Doc Date,Net")
    assert alone["reference"].column is None and "is required and had no other candidate" in alone["reference"].reason


def test_unmapped_and_low_confidence(spark):
    result = run(spark, f"{HEADER},Cost Centre,,Approver\n")
    assert [r.header for r in result.unmapped.orderBy("column").collect()] == ["Cost Centre", "(unnamed column 9)", "Approver"]
    assert mapping.low_confidence(result.mapping).count() == 0


def test_file_faults(spark):
    result = run(spark, "a\u0000b,c\n1,2", "x\nCaf�,2\n", "\n\n", 'Vendor,"Inv\n1,2', "Supplier Name,Invoice No,Net Amount\nA,1,2\nB,2,3\n")
    errors = told(result)
    assert [(e[0], e[1], e[2]) for e in errors] == [("f0", 1, "(file)"), ("f1", 2, "(file)"), ("f2", 0, "(file)"), ("f3", 1, "(row)"), ("f4", 1, "invoiceDate")]
    assert "UTF-16" in errors[0][3] and "line 2" in errors[1][3]
    assert result.invoices.count() == 0


def test_messy_rows(spark):
    body = [
        "Acme,1,2026-01-05,12.50,,,****1234", "Acme,2,2026-01-06,(8.00),EUR,,", ",,31/31/2026,x,1,,", "Acme,3,2026-01-07", "Acme,4,2026-01-08,5,,,,", '"Acme\nWorks",5,2026-01-09,€7,,PO 1,N/A', 'Acme,"6,2026-01-09,5,,,', "Acme,7,2026-01-10,5,,,",
    ]
    result = run(spark, "\n".join([HEADER, *body]))
    rows = {r.id: r for r in result.invoices.collect()}
    assert sorted(rows) == ["row-2", "row-3", "row-6", "row-7"]
    assert (float(rows["row-3"].amount), rows["row-3"].currency, rows["row-2"].bank_last4, rows["row-2"].currency) == (-8.0, "EUR", "1234", "GBP")
    assert (rows["row-7"].vendor_name, rows["row-7"].currency, rows["row-7"].reference, rows["row-7"].bank_last4) == ("Acme\nWorks", "EUR", "PO 1", None)
    errors = told(result)
    assert [e[1] for e in errors] == [4, 4, 4, 4, 4, 5, 9]
    assert "the 1 lines after it" in errors[-1][3]
    assert importing.unaccounted(result).count() == 0
    summary = importing.import_summary(result).first()
    assert (summary.rows_read, summary.rows_skipped, summary.ledger_name) == (4, 3, "f0 — 4 rows, 3 skipped")


def test_date_order(spark):
    text = f"{HEADER}\nA,1,03/04/2026,5,,,\nA,2,25/12/2026,5,,,\n"
    result = run(spark, text)
    assert [e[1] for e in told(result)] == [2] and "ambiguous" in told(result)[0][3]
    gated, ambiguous = importing.gate_ambiguous(result)
    assert gated.invoices.count() == 0 and ambiguous.first().ambiguous == 1
    assert [str(r.invoice_date) for r in run(spark, text, date_order="dmy").invoices.orderBy("seq").collect()] == ["2026-04-03", "2026-12-25"]
    against = run(spark, text, date_order="mdy")
    assert against.invoices.count() == 0 and "told the file is month-first" in told(against)[0][3]


def test_column_conventions(spark):
    comma = [f'N,{i},2026-03-0{i},"{a}",EUR,,' for i, a in enumerate(["1.234,56", "99,95", "2.500", "2,500"], 1)]
    lone = [f'N,{i},2026-03-0{i},"{a}",GBP,,' for i, a in enumerate(["1,50", "1,234", "2,500", "12,000"], 1)]
    rows = run(spark, "\n".join([HEADER, *comma]), "\n".join([HEADER, *lone])).invoices.orderBy("ledger_id", "seq").collect()
    assert [float(r.amount) for r in rows] == [1234.56, 99.95, 2500, 2.5, 1.5, 1234, 2500, 12000]


def test_written_ledger_reads_back(spark, tmp_path):
    rows = tables.projected_invoices(spark, "/root/testdata/sf0.001").limit(50)
    lines = [r.line for r in rows.select(csv_files.csv_line(csv_files.export_columns(rows)).alias("line")).collect()]
    Path(tmp_path / "out.csv").write_text("\n".join([",".join(csv_files.EXPORT_HEADER), *lines]), encoding="utf-8")
    result = importing.import_files(csv_files.read_files(spark, str(tmp_path)))
    key = ["vendor_name", "invoice_number", "invoice_date", "amount", "currency", "bank_last4"]
    assert sorted(map(str, result.invoices.select(*key).collect())) == sorted(map(str, rows.select(*key).collect()))
    csv_files.write_csv(rows, str(tmp_path / "written"))
    again = spark.read.option("header", True).csv(str(tmp_path / "written"))
    assert again.count() == 50 and again.columns == csv_files.EXPORT_HEADER
