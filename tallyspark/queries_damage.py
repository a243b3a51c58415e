"""Queries over damaged exports, unusual headers, erasure and retention, all derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.operators import importing, mapping, review
from tallyspark.queries import INVOICES_SQL, Query
from tallyspark.queries_files import SUPPLIER, supplier_of
from tallyspark.sources.csv_files import csv_line
from tallyspark.sources.stored import StoredTable, append_audit, erase_everywhere, hour_bucket, ledger_bucket, read_audit, sweep
from tallyspark.sources.tables import projected_invoices, read_table, shared_folder

KINDS = 8
HEADER = "Supplier Name,Invoice No,Invoice Date,Net Amount,Currency,Reference,Bank Acc (last 4)"
NO_CURRENCY = "Supplier Name,Invoice No,Invoice Date,Net Amount,Cost Centre,"
NO_AMOUNT = "Payee,Voucher No,Posting Date"


def _choose(test: Column, *cases: Column) -> Column:
    out = F.when(test == 0, cases[0])
    for k, case in enumerate(cases[1:], 1):
        out = out.when(test == k, case)
    return out


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's invoices by date, numbered as the lines of a file that begins with a header."""
    rows = projected_invoices(spark, sf_dir).withColumn("s", supplier_of(F.col("id")))
    return rows.withColumn("line", F.row_number().over(Window.partitionBy("s").orderBy("invoice_date", "id")) + 1)


def _files(rows: DataFrame, head: Column, line: Column) -> DataFrame:
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", line.alias("text")))), lambda r: r["text"]), "\n")
    files = rows.groupBy("s").agg(body.alias("body"))
    return files.select("s", F.concat(F.lit("supplier-"), F.col("s").cast("string")).alias("file_id"), F.concat(head, F.lit("\n"), F.col("body"), F.lit("\n")).alias("content"))


def damaged_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, content): an export for each supplier, damaged in one of eight ways by the supplier's number."""
    rows, kind, line = _lines(spark, sf_dir), F.col("s") % KINDS, F.col("line")
    date, amount = F.col("invoice_date").cast("string"), F.col("amount").cast("decimal(18,2)").cast("string")
    full = csv_line([F.col("vendor_name"), F.col("invoice_number"), date, amount, F.col("currency"), F.lit(""), F.coalesce("bank_last4", F.lit(""))])
    short = csv_line([F.col("vendor_name"), F.col("invoice_number"), date])
    ragged = F.when(line % 5 == 0, F.concat(full, F.lit(",x,y"))).when(line % 5 == 1, F.concat(full, F.lit(","))).when(line % 5 == 2, F.concat(F.col("vendor_name"), F.lit(",,31/31/2026,5,X1,,"))).otherwise(full)
    lost = F.when(line == 3, F.concat(F.lit("Caf�,"), full)).otherwise(full)
    last = F.count("*").over(Window.partitionBy("s")) + 1
    unclosed = F.when(line == F.col("last"), F.concat(F.lit('"'), full)).otherwise(full)
    noted = F.concat(F.when(F.col("currency") == "EUR", "€").when(line % 2 == 0, "USD ").otherwise(""), amount)
    bare = csv_line([F.col("vendor_name"), F.col("invoice_number"), date, noted, F.lit("CC1"), F.lit("")])
    text = _choose(kind, full, lost, full, short, short, ragged, unclosed, bare)
    head = _choose(kind, F.lit(HEADER.replace("Supplier", "Suppl\u0000ier", 1)), F.lit(HEADER), F.lit(HEADER), F.lit('Supplier Name,"Invoice No'), F.lit(NO_AMOUNT), F.lit(HEADER), F.lit(HEADER), F.lit(NO_CURRENCY))
    files = _files(rows.withColumn("last", last), head, text)
    return files.select("file_id", F.when(kind == 2, "\n \n").otherwise(F.col("content")).alias("content"))


def damaged_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importing.import_files(damaged_exports(spark, sf_dir)).errors.select("file_id", "row", "column", "value", "reason")


def damaged_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read of the damaged exports, with the currency that each row fell back to."""
    rows = importing.import_files(damaged_exports(spark, sf_dir)).invoices
    return rows.select("ledger_id", "id", "vendor_name", F.col("amount").cast("double").alias("amount"), "currency", "bank_last4")


def damaged_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows read and skipped of each damaged export, its ledger's name, and the first error of those without a row."""
    summary = importing.import_summary(importing.import_files(damaged_exports(spark, sf_dir)))
    return summary.select("file_id", "rows_read", "rows_skipped", "ledger_name", "first_error")


def damaged_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields without a column in the damaged exports and why; refused files have none for any field."""
    found = importing.import_files(damaged_exports(spark, sf_dir)).mapping
    return found.where("column is null").select("file_id", "field", "reason")


def damaged_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve errors of each damaged export in the order of the file; the limit is the feature."""
    errors = importing.first_errors(importing.import_files(damaged_exports(spark, sf_dir)))
    return errors.select("file_id", "place", "row", "column", "reason")


def damaged_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importing.import_files(damaged_exports(spark, sf_dir)).unmapped.select("file_id", "column", "header")


def _day_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports with dates as dd/MM/yyyy; those of even suppliers are dated up to the twelfth of a month."""
    rows = projected_invoices(spark, sf_dir).withColumn("s", supplier_of(F.col("id")))
    early = F.date_add(F.trunc("invoice_date", "month"), F.dayofmonth("invoice_date") % 12)
    rows = rows.withColumn("invoice_date", F.when(F.col("s") % 2 == 0, early).otherwise(F.col("invoice_date")))
    rows = rows.withColumn("line", F.row_number().over(Window.partitionBy("s").orderBy("invoice_date", "id")) + 1)
    text = csv_line([F.col("vendor_name"), F.col("invoice_number"), F.date_format("invoice_date", "dd/MM/yyyy"), F.col("amount").cast("decimal(18,2)").cast("string"), F.col("currency"), F.lit(""), F.lit("")])
    return _files(rows, F.lit(HEADER), text).select("file_id", "content")


def contradicted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day-first exports imported as month-first: one error for each file that contradicts it."""
    result = importing.import_files(_day_first(spark, sf_dir), importing.ImportOptions(date_order="mdy"))
    read = result.invoices.groupBy(F.col("ledger_id").alias("file_id")).agg(F.count("*").alias("rows_read"))
    return result.errors.join(read, "file_id", "full_outer").select("file_id", "row", "value", "reason", F.coalesce("rows_read", F.lit(0)).alias("rows_read"))


def ambiguous_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day-first exports imported without an order: how many dates read both ways, and what the gate lets through."""
    result = importing.import_files(_day_first(spark, sf_dir))
    gated, ambiguous = importing.gate_ambiguous(result)
    before, after = (r.invoices.groupBy(F.col("ledger_id").alias("file_id")).agg(F.count("*").alias(name)) for r, name in ((result, "readable"), (gated, "kept")))
    every = before.join(after, "file_id", "left").join(ambiguous, "file_id", "full_outer")
    return every.select("file_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("ambiguous", "readable", "kept")), "question")


HEADERS = [
    "Doc Date,Invoice Date,Amount,Vendor,Invoice No,Currency,Reference",
    "Vendor,Invoice Reference,Doc Date,Net",
    "Vendor,Invoice Reference,Doc Date,Net,Payment Details",
    "Supplier Name,Invoice No,Net Amount",
]


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unusual header row for each supplier."""
    suppliers = read_table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string")).alias("file_id"), (F.col("s_suppkey") % len(HEADERS)).alias("k"))
    return suppliers.select("file_id", F.split(_choose(F.col("k"), *(F.lit(h) for h in HEADERS)), ",").alias("cells"))


def mapping_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Close calls, required fields that take from optional ones, displaced and missing fields, with reasons."""
    found = mapping.suggest_mapping(_headers(spark, sf_dir))
    low = mapping.low_confidence(found).select("file_id", "field", F.lit(True).alias("low"))
    rows = found.join(low, ["file_id", "field"], "left")
    return rows.select("file_id", "field", "header", F.round("confidence", 2).alias("confidence"), F.coalesce("low", F.lit(False)).alias("low"), "reason")


def mapping_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' choices by header, by place, of nothing, and of a header that is not there."""
    found = mapping.suggest_mapping(_headers(spark, sf_dir), {"invoiceDate": "doc  DATE", "amount": 2, "reference": None, "currency": "Money"})
    return found.where("field in ('invoiceDate', 'amount', 'reference', 'currency')").select("file_id", "field", "column", "confidence", "reason")


def _ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as ledgers: a third are demos; uploads have one of five owners."""
    key = F.col("c_custkey")
    owner = F.concat(F.lit("Owner-"), (key % 5).cast("string"), F.lit("@example.org"))
    namespace = F.when(key % 3 == 0, review.DEMO).otherwise(review.UPLOADS)
    return read_table(spark, sf_dir, "customer").select(key.cast("string").alias("id"), namespace.alias("namespace"), owner.alias("owner_email"))


def erased_ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of ledgers and of their orders that are left when one owner erases all that may be erased."""
    ledgers = _ledgers(spark, sf_dir)
    events = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("ledger_id"), "o_orderkey")
    asked = ledgers.where("id % 2 = 0").select("id")
    left = review.without_ledgers({"ledgers": ledgers, "events": events}, review.erasable_of(ledgers, asked, "OWNER-2@example.org"))
    counts = left["events"].groupBy(F.col("ledger_id").alias("id")).agg(F.count("*").alias("events"))
    return left["ledgers"].join(counts, "id", "left").select("id", "namespace", F.coalesce("events", F.lit(0)).alias("events"))


def stored_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored orders after one owner's ledgers were erased from their files, some ledgers replaced, and old uploads swept."""
    ledgers, folder = _ledgers(spark, sf_dir), shared_folder(spark, "store-")
    made = F.timestamp_seconds(F.lit(1_700_000_000) - (F.col("o_orderkey") % 1440) * 60)
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("ledger_id"), F.col("o_orderkey").cast("long").alias("seq"), made.alias("created_at"))
    events = StoredTable(spark, f"{folder}/events", orders.schema, ledger_bucket(16), ("ledger_id", "seq"))
    events.put(orders)
    events.put(orders.where("ledger_id like '%7' and seq % 2 = 0"))
    asked = ledgers.where("id % 2 = 0").select("id")
    erase_everywhere([events], review.erasable_of(ledgers, asked, "OWNER-2@example.org"))
    files = StoredTable(spark, f"{folder}/files", orders.schema, hour_bucket(), ("created_at", "seq"))
    files.put(orders, key="seq")
    sweep(files, F.timestamp_seconds(F.lit(1_700_000_000 - 6 * 3600)))
    kept = events.read().groupBy("ledger_id").agg(F.count("*").alias("events"))
    live = files.read().groupBy("ledger_id").agg(F.count("*").alias("files"))
    return kept.join(live, "ledger_id", "full_outer").select("ledger_id", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("files", F.lit(0)).alias("files"))


def stored_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' lines appended in two batches, each of them twice."""
    folder = shared_folder(spark, "audit-")
    lines = _ledgers(spark, sf_dir).select(F.col("id").alias("ledger_id"), F.col("namespace").alias("action"))
    for batch in ("first", "second", "first", "second"):
        append_audit(spark, lines.where((F.col("ledger_id") % 2 == 0) == (batch == "first")), folder, batch)
    return read_audit(spark, folder, lines.schema)


def live_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as uploaded files of the last day: those that have not outlived six hours at noon."""
    files = read_table(spark, sf_dir, "orders").select("o_orderkey", F.timestamp_seconds(F.lit(1_700_000_000) - (F.col("o_orderkey") % 1440) * 60).alias("created_at"))
    return review.live_files(files, F.timestamp_seconds(F.lit(1_700_000_000))).select("o_orderkey")


# --- SQL ----------------------------------------------------------------------------------------

_LINES = f"""{INVOICES_SQL}, placed AS (
  SELECT *, {SUPPLIER} AS s, {SUPPLIER} % {KINDS} AS kind, 'supplier-' || {SUPPLIER} AS file_id, 1 + row_number() OVER (PARTITION BY {SUPPLIER} ORDER BY invoice_date, id) AS line FROM inv
), sized AS (
  SELECT *, count(*) OVER (PARTITION BY s) AS n, CAST(CAST(amount AS DECIMAL(18, 2)) AS VARCHAR) AS written,
    vendor_name || ',' || invoice_number || ',' || CAST(invoice_date AS VARCHAR) AS short, coalesce(bank_last4, '') AS bank FROM placed
), lined AS (
  SELECT *, short || ',' || written || ',' || currency || ',,' || bank AS full_line FROM sized
), texts AS (
  SELECT *, lead(full_line) OVER (PARTITION BY s ORDER BY line) AS next_line FROM lined
)"""
_FILES = f"{_LINES}, one AS (SELECT file_id, kind, any_value(n) AS n, string_agg(short, chr(10) ORDER BY line) FILTER (line <= 3) AS begun FROM texts GROUP BY file_id, kind)"


def _cut(text: str) -> str:
    return f"(CASE WHEN length({text}) > 80 THEN substr({text}, 1, 79) || '…' ELSE {text} END)"


def _said(name: str, **values: str) -> str:
    """A sentence of an import in SQL; the values are SQL texts."""
    text = "'" + importing.TOLD[name].replace("'", "''") + "'"
    for key, value in values.items():
        text = text.replace("{" + key + "}", f"' || {value} || '")
    return text


_BAD_ROW = "kind = 5 AND line % 5 = 2"
_DAMAGED_ERRORS = f"""WITH {_FILES}
SELECT file_id, 1 AS row, '(file)' AS "column", {_cut("'" + HEADER.replace("Supplier", "Suppl?ier", 1) + "'")} AS value, {_said("utf-16")} AS reason FROM one WHERE kind = 0
UNION ALL SELECT file_id, 3, '(file)', {_cut("'Caf?,' || full_line || chr(10) || coalesce(next_line, '') || chr(10)")}, {_said("lost byte", line="'3'")} FROM texts WHERE kind = 1 AND line = 3
UNION ALL SELECT file_id, 0, '(file)', '', {_said("empty")} FROM one WHERE kind = 2
UNION ALL SELECT file_id, 1, '(row)', {_cut("'Supplier Name,Invoice No' || chr(10) || begun || chr(10)")}, {_said("unclosed", line="'1'", what=_said("swallowed", n="(n + 1)"))} FROM one WHERE kind = 3
UNION ALL SELECT file_id, 1, 'amount', '{NO_AMOUNT}', {_said("missing", field="'amount'", why="'no column in this header row resembles amount'")} FROM one WHERE kind = 4
UNION ALL SELECT file_id, CAST(line AS INTEGER), '(row)', {_cut("full_line || ',x,y'")}, {_said("shape", n="'9'", of="'7'")} FROM texts WHERE kind = 5 AND line % 5 = 0
UNION ALL SELECT file_id, CAST(line AS INTEGER), 'Invoice No', '', 'invoiceNumber: ' || {_said("no number")} FROM texts WHERE {_BAD_ROW}
UNION ALL SELECT file_id, CAST(line AS INTEGER), 'Invoice Date', '31/31/2026', 'invoiceDate: "31/31/2026" has no valid month: neither 31 nor 31 can be one' FROM texts WHERE {_BAD_ROW}
UNION ALL SELECT file_id, CAST(line AS INTEGER), 'Currency', 'X1', 'currency: "X1" is not a currency code' FROM texts WHERE {_BAD_ROW}
UNION ALL SELECT file_id, CAST(line AS INTEGER), '(row)', {_cut("full_line || chr(10)")}, {_said("unclosed", line="line", what=_said("swallowed", n="'1'"))} FROM texts WHERE kind = 6 AND line = n + 1"""
_READ = "(kind = 5 AND line % 5 NOT IN (0, 2)) OR (kind = 6 AND line <= n) OR kind = 7"
_DAMAGED_INVOICES = f"""WITH {_LINES} SELECT file_id AS ledger_id, 'row-' || line AS id, vendor_name, CAST(amount AS DOUBLE) AS amount,
  CASE WHEN kind < 7 OR currency = 'EUR' THEN currency WHEN line % 2 = 0 THEN 'USD' ELSE 'GBP' END AS currency, CASE WHEN kind < 7 THEN bank_last4 END AS bank_last4 FROM texts WHERE {_READ}"""
_FIRST_ERROR = f"""CASE kind WHEN 0 THEN {_said("utf-16")} WHEN 1 THEN {_said("lost byte", line="'3'")} WHEN 2 THEN {_said("empty")}
  WHEN 3 THEN {_said("unclosed", line="'1'", what=_said("swallowed", n="(n + 1)"))} WHEN 4 THEN {_said("missing", field="'amount'", why="'no column in this header row resembles amount'")} END"""
_DAMAGED_SUMMARY = f"""WITH {_LINES}, t AS (
  SELECT file_id, kind, any_value(n) AS n, count(CASE WHEN {_READ} THEN 1 END) AS rows_read, count(CASE WHEN kind IN (5, 6) AND NOT ({_READ}) THEN 1 END) AS bad FROM texts GROUP BY file_id, kind
) SELECT file_id, rows_read, CASE WHEN kind < 5 THEN 1 ELSE bad END AS rows_skipped,
  CASE WHEN rows_read > 0 THEN file_id || ' — ' || format('{{:,}}', rows_read) || ' rows' || CASE WHEN bad > 0 THEN ', ' || bad || ' skipped' ELSE '' END END AS ledger_name,
  CASE WHEN rows_read = 0 THEN {_FIRST_ERROR} END AS first_error FROM t"""
_DAMAGED_PREVIEW = f"""WITH errors AS ({_DAMAGED_ERRORS}), t AS (
  SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY row, CASE split_part(reason, ':', 1) WHEN 'invoiceNumber' THEN 1 WHEN 'invoiceDate' THEN 2 WHEN 'currency' THEN 3 ELSE 0 END) AS place FROM errors
) SELECT file_id, CAST(place AS INTEGER) AS place, row, "column", reason FROM t WHERE place <= 12"""
_DAMAGED_MAPPING = f"""WITH {_FILES}, f(kind, fields) AS (VALUES
  (0, {mapping.FIELDS}), (1, {mapping.FIELDS}), (2, {mapping.FIELDS}), (3, {mapping.FIELDS}), (4, ['amount', 'currency', 'reference', 'bankLast4']), (7, ['currency', 'reference', 'bankLast4'])),
u AS (SELECT file_id, kind, unnest(fields) AS field FROM one JOIN f USING (kind))
SELECT file_id, field, CASE
  WHEN kind = 4 AND field = 'reference' THEN 'reference has no column of its own: "Voucher No" scored 0.45 for it, but is a stronger match for invoiceNumber'
  WHEN kind = 7 AND field = 'reference' THEN 'reference has no column of its own: "Invoice No" scored 0.45 for it, but is a stronger match for invoiceNumber'
  ELSE 'no column in this header row resembles ' || field END || CASE WHEN kind = 7 AND field = 'currency' THEN {_said("no currency column")} ELSE '' END AS reason FROM u"""
_DAMAGED_UNMAPPED = f"WITH {_FILES} SELECT file_id, unnest([4, 5]) AS \"column\", unnest(['Cost Centre', '(unnamed column 6)']) AS header FROM one WHERE kind = 7"
_DAY_FIRST = f"""{INVOICES_SQL}, moved AS (
  SELECT id, {SUPPLIER} AS s, CASE WHEN {SUPPLIER} % 2 = 0 THEN CAST(date_trunc('month', invoice_date) AS DATE) + CAST(day(invoice_date) % 12 AS INTEGER) ELSE invoice_date END AS invoice_date FROM inv
), dated AS (
  SELECT *, 'supplier-' || s AS file_id, day(invoice_date) AS d, month(invoice_date) AS m FROM moved
), placed AS (
  SELECT *, 1 + row_number() OVER (PARTITION BY s ORDER BY invoice_date, id) AS line FROM dated
)"""
_CONTRADICTED = f"""WITH {_DAY_FIRST}, t AS (
  SELECT file_id, min(CASE WHEN d > 12 THEN line END) AS first, arg_min(strftime(invoice_date, '%d/%m/%Y'), CASE WHEN d > 12 THEN line END) AS value, count(CASE WHEN d > 12 THEN 1 END) - 1 AS others, count(*) AS n FROM placed GROUP BY file_id
) SELECT file_id, CAST(first AS INTEGER) AS row, value,
  {_said("contradicted", said="'month-first'", value="value", line="first", more="CASE WHEN others > 0 THEN " + _said("nor", n="others", s="CASE others WHEN 1 THEN '' ELSE 's' END") + " ELSE '' END")} AS reason, CASE WHEN first IS NULL THEN n ELSE 0 END AS rows_read FROM t"""
_GATE = f"""WITH {_DAY_FIRST}, t AS (SELECT file_id, count(CASE WHEN d <= 12 AND d <> m THEN 1 END) AS ambiguous, count(CASE WHEN d > 12 OR d = m THEN 1 END) AS readable FROM placed GROUP BY file_id)
SELECT file_id, ambiguous, readable, CASE WHEN ambiguous > 0 THEN 0 ELSE readable END AS kept,
  CASE WHEN ambiguous > 0 THEN format('{{:,}}', ambiguous) || ' date' || CASE ambiguous WHEN 1 THEN '' ELSE 's' END || ' in this file could be read two ways. Choose which before importing.' END AS question FROM t"""
# Header, confidence, whether it is low, and reason of each field under each of HEADERS.
_REASONS = [
    (0, 'vendorName', 'Vendor', 0.99, False, '"Vendor" is exactly the known vendorName header "vendor"'),
    (0, 'invoiceNumber', 'Invoice No', 1.0, False, '"Invoice No" is exactly the known invoiceNumber header "invoice no"'),
    (0, 'invoiceDate', 'Invoice Date', 0.86, False, '"Invoice Date" is exactly the known invoiceDate header "invoice date"; "Doc Date" scored almost as well (0.99) and may be the right column instead'),
    (0, 'amount', 'Amount', 0.99, False, '"Amount" is exactly the known amount header "amount"'),
    (0, 'currency', 'Currency', 1.0, False, '"Currency" is exactly the known currency header "currency"'),
    (0, 'reference', 'Reference', 1.0, False, '"Reference" is exactly the known reference header "reference"'),
    (0, 'bankLast4', None, 0.0, False, 'no column in this header row resembles bankLast4'),
    (1, 'vendorName', 'Vendor', 0.99, False, '"Vendor" is exactly the known vendorName header "vendor"'),
    (1, 'invoiceNumber', 'Invoice Reference', 0.81, False, '"Invoice Reference" contains "invoice"; reference matched this column more closely, but reference is optional and an import with no invoiceNumber cannot run at all'),
    (1, 'invoiceDate', 'Doc Date', 0.99, False, '"Doc Date" is exactly the known invoiceDate header "doc date"'),
    (1, 'amount', 'Net', 0.97, False, '"Net" is exactly the known amount header "net"'),
    (1, 'currency', None, 0.0, False, 'no column in this header row resembles currency'),
    (1, 'reference', None, 0.0, False, 'reference has no column of its own: "Invoice Reference" was the best evidence for it, but invoiceNumber is required and had no other candidate, so the column went there'),
    (1, 'bankLast4', None, 0.0, False, 'no column in this header row resembles bankLast4'),
    (2, 'vendorName', 'Vendor', 0.99, False, '"Vendor" is exactly the known vendorName header "vendor"'),
    (2, 'invoiceNumber', 'Invoice Reference', 0.81, False, '"Invoice Reference" contains "invoice"; reference matched this column more closely, but reference is optional and an import with no invoiceNumber cannot run at all'),
    (2, 'invoiceDate', 'Doc Date', 0.99, False, '"Doc Date" is exactly the known invoiceDate header "doc date"'),
    (2, 'amount', 'Net', 0.97, False, '"Net" is exactly the known amount header "net"'),
    (2, 'currency', None, 0.0, False, 'no column in this header row resembles currency'),
    (2, 'reference', 'Payment Details', 0.59, True, '"Payment Details" contains "details"; "Invoice Reference" scored almost as well (0.82) and may be the right column instead'),
    (2, 'bankLast4', None, 0.0, False, 'no column in this header row resembles bankLast4'),
    (3, 'vendorName', 'Supplier Name', 1.0, False, '"Supplier Name" is exactly the known vendorName header "supplier name"'),
    (3, 'invoiceNumber', 'Invoice No', 1.0, False, '"Invoice No" is exactly the known invoiceNumber header "invoice no"'),
    (3, 'invoiceDate', None, 0.0, False, 'invoiceDate has no column of its own: "Invoice No" scored 0.47 for it, but is a stronger match for invoiceNumber'),
    (3, 'amount', 'Net Amount', 1.0, False, '"Net Amount" is exactly the known amount header "net amount"'),
    (3, 'currency', None, 0.0, False, 'no column in this header row resembles currency'),
    (3, 'reference', None, 0.0, False, 'reference has no column of its own: "Invoice No" scored 0.45 for it, but is a stronger match for invoiceNumber'),
    (3, 'bankLast4', None, 0.0, False, 'no column in this header row resembles bankLast4'),
]
_CHOICES = [
    ("invoiceDate", [0, 2, 2, None], [1.0, 1.0, 1.0, 0.0], ['you chose "Doc Date" for invoiceDate'] * 3 + ['you mapped invoiceDate to "doc  DATE", which this header row does not have']),
    ("amount", [2, 2, 2, 2], [1.0] * 4, [f'you chose "{name}" for amount' for name in ("Amount", "Doc Date", "Doc Date", "Net Amount")]),
    ("reference", [None] * 4, [0.0] * 4, ["you left reference without a column"] * 4),
    ("currency", [None] * 4, [0.0] * 4, ['you mapped currency to "Money", which this header row does not have'] * 4),
]


def _value(x: object) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


_OVERRIDES = (
    "WITH c(k, field, \"column\", confidence, reason) AS (VALUES "
    + ", ".join(f"({k}, '{field}', {_value(columns[k])}, CAST({sure[k]} AS DOUBLE), {_value(reasons[k])})" for field, columns, sure, reasons in _CHOICES for k in range(len(HEADERS)))
    + f") SELECT 'supplier-' || s_suppkey AS file_id, field, CAST(\"column\" AS INTEGER) AS \"column\", confidence, reason FROM supplier JOIN c ON k = s_suppkey % {len(HEADERS)}"
)
_MAPPING_REASONS = (
    "WITH c(k, field, header, confidence, low, reason) AS (VALUES "
    + ", ".join(f"({k}, '{field}', {_value(header)}, CAST({sure} AS DOUBLE), {low}, {_value(reason)})" for k, field, header, sure, low, reason in _REASONS)
    + f") SELECT 'supplier-' || s_suppkey AS file_id, field, header, confidence, low, reason FROM supplier JOIN c ON k = s_suppkey % {len(HEADERS)}"
)

QUERIES: dict[str, tuple[Query, str]] = {
    "mapping_reasons": (mapping_reasons, _MAPPING_REASONS),
    "damaged_errors": (damaged_errors, _DAMAGED_ERRORS),
    "damaged_invoices": (damaged_invoices, _DAMAGED_INVOICES),
    "damaged_summary": (damaged_summary, _DAMAGED_SUMMARY),
    "damaged_mapping": (damaged_mapping, _DAMAGED_MAPPING),
    "damaged_preview": (damaged_preview, _DAMAGED_PREVIEW),
    "damaged_unmapped": (damaged_unmapped, _DAMAGED_UNMAPPED),
    "contradicted_orders": (contradicted_orders, _CONTRADICTED),
    "ambiguous_gate": (ambiguous_gate, _GATE),
    "mapping_overrides": (mapping_overrides, _OVERRIDES),
    "erased_ledgers": (
        erased_ledgers,
        """WITH left_over AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'demo' ELSE 'uploads' END AS namespace FROM customer WHERE NOT (c_custkey % 2 = 0 AND c_custkey % 3 <> 0 AND c_custkey % 5 = 2))
SELECT CAST(k AS VARCHAR) AS id, namespace, count(o_orderkey) AS events FROM left_over LEFT JOIN orders ON o_custkey = k GROUP BY k, namespace""",
    ),
    "stored_erasure": (
        stored_erasure,
        """WITH o AS (SELECT o_custkey AS k, o_orderkey AS seq FROM orders),
replaced AS (SELECT DISTINCT k FROM o WHERE k % 10 = 7 AND seq % 2 = 0),
kept AS (SELECT k, count(*) AS events FROM o WHERE NOT (k % 2 = 0 AND k % 3 <> 0 AND k % 5 = 2) AND (k NOT IN (SELECT k FROM replaced) OR seq % 2 = 0) GROUP BY k),
live AS (SELECT k, count(*) AS files FROM o WHERE seq % 1440 <= 360 GROUP BY k)
SELECT CAST(coalesce(kept.k, live.k) AS VARCHAR) AS ledger_id, coalesce(events, 0) AS events, coalesce(files, 0) AS files FROM kept FULL JOIN live ON kept.k = live.k""",
    ),
    "stored_audit": (stored_audit, "SELECT CAST(c_custkey AS VARCHAR) AS ledger_id, CASE WHEN c_custkey % 3 = 0 THEN 'demo' ELSE 'uploads' END AS action FROM customer"),
    "live_uploads": (live_uploads, "SELECT o_orderkey FROM orders WHERE o_orderkey % 1440 <= 360"),
}


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
