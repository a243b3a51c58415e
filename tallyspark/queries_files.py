"""Queries that import exports and review findings; exports and decisions derive from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import coercion
from tallyspark.operators import importing, mapping, review
from tallyspark.plans.detection import detect
from tallyspark.plans.review import ReviewState, review_state
from tallyspark.queries import DETECT_SQL, INVOICES_SQL, Query
from tallyspark.sources.csv_files import csv_line, export_columns, write_csv
from tallyspark.sources.large_files import read_large_files
from tallyspark.sources.tables import projected_invoices, shared_folder

# Each supplier's export has one of three layouts.
HEADERS = [
    "Supplier Name,Invoice No,Invoice Date,Net Amount,Currency,Reference,Bank Acc (last 4)",
    "Payee,Invoice #,Doc Date,Gross,Currency,PO Number,Bank Acc (last 4)",
    "Vendor Name,Document Number,Posting Date,Value,CCY,Narrative,Last 4",
]
SUPPLIER = "CAST(CASE WHEN starts_with(id, 'CT-') THEN split_part(id, '-', 2) ELSE split_part(id, '-', 4) END AS INTEGER)"


def supplier_of(id_: Column) -> Column:
    return F.when(id_.startswith("CT-"), F.get(F.split(id_, "-"), F.lit(1))).otherwise(F.get(F.split(id_, "-"), F.lit(3))).cast("int")


def _layout(supplier: Column, *forms: Column) -> Column:
    return F.when(supplier % 3 == 0, forms[0]).when(supplier % 3 == 1, forms[1]).otherwise(forms[2])


def supplier_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, content): each supplier's invoices as an export, by date; amounts of 45 are unreadable."""
    rows = projected_invoices(spark, sf_dir).withColumn("s", supplier_of(F.col("id")))
    size = F.format_number(F.abs("amount"), 2)
    plain = F.concat(F.when(F.col("amount") < 0, "-").otherwise(""), F.regexp_replace(size, ",", ""))
    bracketed = F.when(F.col("amount") < 0, F.concat(F.lit("("), size, F.lit(")"))).otherwise(size)
    comma = F.concat(F.translate(size, ",.", ".,"), F.when(F.col("amount") < 0, " CR").otherwise(""))
    amount = F.when(F.col("amount") == 45, "n/a").otherwise(_layout(F.col("s"), plain, bracketed, comma))
    day = F.col("invoice_date")
    date = _layout(F.col("s"), day.cast("string"), F.date_format(day, "d MMM yyyy"), F.concat(F.date_format(day, "yyyyMMdd"), F.lit(" 00:00:00")))
    cells = [F.col("vendor_name"), F.col("invoice_number"), date, amount, F.col("currency"), F.lit(""), F.coalesce("bank_last4", F.lit(""))]
    lines = F.transform(F.array_sort(F.collect_list(F.struct("invoice_date", "id", csv_line(cells).alias("line")))), lambda r: r["line"])
    head = _layout(F.col("s"), *(F.lit(h) for h in HEADERS))
    files = rows.groupBy("s").agg(F.array_join(lines, "\n").alias("body"))
    return files.select(F.concat(F.lit("supplier-"), F.col("s").cast("string")).alias("file_id"), F.concat(head, F.lit("\n"), F.col("body"), F.lit("\n")).alias("content"))


def import_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = importing.import_files(supplier_exports(spark, sf_dir)).invoices
    return rows.select("ledger_id", "id", "vendor_name", "invoice_number", F.col("invoice_date").cast("string").alias("invoice_date"), F.col("amount").cast("double").alias("amount"), "currency", "bank_last4")


def import_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = importing.import_files(supplier_exports(spark, sf_dir)).errors
    return rows.select("file_id", "row", "column", "value", "reason")


def import_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importing.map_files(supplier_exports(spark, sf_dir)).select("file_id", "field", "column", "header")


def import_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importing.import_summary(importing.import_files(supplier_exports(spark, sf_dir)))


def import_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records of each file are neither an invoice nor an error, with the files' records."""
    result = importing.import_files(supplier_exports(spark, sf_dir))
    lost = importing.unaccounted(result).groupBy("file_id").agg(F.count("*").alias("unaccounted"))
    known = result.records.where("idx > 0").groupBy("file_id").agg(F.count("*").alias("records"))
    return known.join(lost, "file_id", "left").select("file_id", "records", F.coalesce("unaccounted", F.lit(0)).alias("unaccounted"))


def import_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five records of each file; the limit is the feature."""
    first = importing.first_records(supplier_exports(spark, sf_dir))
    return first.select("file_id", "line", F.array_join("cells", "|").alias("cells"))


def _noted(rows: DataFrame) -> DataFrame:
    """The invoices with references that hold quotes, commas and line ends."""
    note = F.when(F.col("amount") < 0, F.lit('credit "as agreed",\nsee letter')).when(F.col("amount") == 45, F.lit("fee\r\n(set)")).otherwise(F.col("reference"))
    return rows.withColumn("reference", note)


def large_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All invoices written as a few large exports with line ends inside cells, and imported by splits."""
    rows = _noted(projected_invoices(spark, sf_dir))
    folder = shared_folder(spark, "exports-")
    write_csv(rows, folder)
    result = importing.import_records(read_large_files(spark, folder))
    kept = ["vendor_name", "invoice_number", F.col("invoice_date").cast("string").alias("invoice_date"), F.col("amount").cast("double").alias("amount"), "currency", "reference", "bank_last4"]
    return result.invoices.select(*kept).groupBy("vendor_name", "invoice_number", "invoice_date", "amount", "currency", "reference", "bank_last4").agg(F.count("*").alias("rows"))


def header_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each different header reads as each field, over all exports."""
    heads = supplier_exports(spark, sf_dir).select(F.explode(F.split(F.split_part("content", F.lit("\n"), F.lit(1)), ",")).alias("header"))
    return mapping.header_scores(heads).select("header", "field", F.round("score", 6).alias("score"))


def ledger_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = projected_invoices(spark, sf_dir)
    return rows.select("id", csv_line(export_columns(rows)).alias("line"))


def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in five ways, read back; month-first is asked for where a text reads both ways."""
    rows = projected_invoices(spark, sf_dir).select("id", "invoice_date")
    forms = ["yyyy/MM/dd", "d-MMM-yy", "MMMM d, yyyy", "MM/dd/yyyy HH:mm", "yyyyMMdd"]
    texts = rows.withColumn("text", F.explode(F.array(*(F.date_format("invoice_date", f) for f in forms))))
    read = texts.withColumn("d", coercion.parse_date(F.col("text"), F.lit("mdy")))
    return read.groupBy("id").agg(F.min("d.value").cast("string").alias("first"), F.max("d.value").cast("string").alias("last"), F.count("d.value").alias("texts"))


def ambiguous_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = projected_invoices(spark, sf_dir).select("id", F.date_format("invoice_date", "dd/MM/yyyy").alias("text"))
    read = rows.withColumn("d", coercion.parse_date(F.col("text")))
    return read.select("id", F.col("d.value").cast("string").alias("date"), "d.reason", coercion.forced_order(F.col("text")).alias("forced"))


def parse_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts written in five ways, read back."""
    rows = projected_invoices(spark, sf_dir).select("id", "amount", "currency")
    size = F.format_number(F.abs("amount"), 2)
    minus = F.col("amount") < 0
    sign = F.when(F.col("currency") == "EUR", "€").otherwise("£")
    forms = [
        F.concat(F.when(minus, "-").otherwise(""), size),
        F.when(minus, F.concat(F.lit("("), sign, size, F.lit(")"))).otherwise(F.concat(sign, size)),
        F.concat(F.translate(size, ",.", ".,"), F.when(minus, "-").otherwise("")),
        F.concat(F.col("currency"), F.lit(" "), F.translate(size, ",", " "), F.when(minus, " CR").otherwise("")),
        F.concat(F.translate(size, ",", " "), F.when(minus, "CR").otherwise("DR")),
    ]
    texts = rows.withColumn("text", F.explode(F.array(*forms))).withColumn("m", coercion.parse_amount(F.col("text")))
    return texts.groupBy("id").agg(F.min("m.value").cast("double").alias("low"), F.max("m.value").cast("double").alias("high"), F.count("m.value").alias("texts"), F.max("m.currency").alias("currency"))


def decision_events(findings: DataFrame) -> DataFrame:
    """Events by the length of a finding's key: accepted, rejected, reopened, rejected without a reason; some name no finding."""
    n = F.length("finding_key")

    def event(test: Column, action: str, seq: int, reason: str | None, key: Column = F.col("finding_key")) -> Column:
        at = F.timestamp_seconds(F.lit(1_700_000_000 + seq))
        return F.when(test, F.struct(key.alias("finding_key"), F.lit(action).alias("action"), F.lit("pat").alias("who"), at.alias("at"), F.lit(seq).alias("seq"), F.lit(reason).cast("string").alias("reason")))

    events = F.array(
        event(n % 5 == 0, "accepted", 1, None),
        event(n % 5 == 1, "rejected", 2, "  seen the papers  "),
        event(n % 5 == 2, "accepted", 3, None),
        event(n % 5 == 2, "reopen", 4, None),
        event(n % 5 == 3, "rejected", 5, "   "),
        event(n % 5 == 4, "accepted", 6, None, F.concat(F.col("finding_key"), F.lit("?"))),
    )
    return findings.select("ledger_id", F.explode(F.array_compact(events)).alias("e")).select("ledger_id", "e.*")


def _ledgers(invoices: DataFrame) -> DataFrame:
    return invoices.groupBy(F.col("ledger_id").alias("id")).agg(F.count("*").alias("row_count")).select(
        "id", F.lit(review.DEMO).alias("namespace"), F.lit("Projection").alias("name"), F.timestamp_seconds(F.lit(1_699_999_999)).alias("created_at"), "row_count", F.lit(None).cast("string").alias("owner_email")
    )


def _review(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, ReviewState]:
    invoices = projected_invoices(spark, sf_dir)
    # The findings are read by every part of the review.
    findings = detect(invoices).persist()
    ledgers = _ledgers(invoices)
    return invoices, findings, ledgers, review_state(ledgers, findings, decision_events(findings))


def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _review(spark, sf_dir)[3].findings.select("finding_key", "decision", "reason")


def review_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    invoices, _, _, state = _review(spark, sf_dir)
    totals = review.totals_text(state.totals, review.ledger_currency(invoices))
    return totals.select("ledger_id", *(F.col(f"{n}_count") for n in ("open", "accepted", "rejected", "all")), *(F.col(f"{n}_value").cast("double").alias(f"{n}_value") for n in ("open", "accepted", "rejected", "all")), "all_text")


def review_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Read twice, without rows and sentences.
    findings = detect(projected_invoices(spark, sf_dir)).select("ledger_id", "finding_key").persist()
    checked = review.validated_events(decision_events(findings), findings)
    return checked.where("refused is not null").groupBy("refused").agg(F.count("*").alias("events"))


def review_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _review(spark, sf_dir)[3].audit.select("ledger_id", "who", "action", "detail")


def finding_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    invoices = projected_invoices(spark, sf_dir)
    # Read twice, without the sentences.
    findings = detect(invoices).select("ledger_id", "finding_key", "invoice_ids").persist()
    return review.evidence(findings, invoices).select("finding_key", "pos", "id", F.col("amount").cast("double").alias("amount"))


def flagged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    invoices = projected_invoices(spark, sf_dir)
    return review.flagged_rows(detect(invoices), invoices).select("id", "flagged_by")


def ledger_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    invoices = projected_invoices(spark, sf_dir)
    stats = review.ledger_stats(review.flagged_rows(detect(invoices), invoices), "suplier")
    return stats.select("ledger_id", "rows_shown", "suppliers", "flagged", F.col("first_date").cast("string").alias("first_date"), F.col("last_date").cast("string").alias("last_date"))


def rows_of_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.rows_view(projected_invoices(spark, sf_dir), " #000000001 ").select("id", "vendor_name", F.col("invoice_date").cast("string").alias("invoice_date"))


def ledger_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    invoices = projected_invoices(spark, sf_dir)
    # Read three times, without rows and sentences.
    findings = detect(invoices).select("ledger_id", "finding_key", "amount_at_stake").persist()
    valid = review.validated_events(decision_events(findings), findings).where("refused is null")
    ledgers = _ledgers(invoices)
    totals = review.review_totals(review.reviewed(findings, review.current_decisions(valid)), ledgers)
    return review.ledger_list(ledgers, totals, None).select("id", "row_count", "open_count", F.col("open_value").cast("double").alias("open_value"))


def known_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings against contract rows as traps and round figures as planted problems."""
    invoices, findings, _, _ = _review(spark, sf_dir)
    planted = invoices.where("amount = 7500").select("ledger_id", F.lit("round-number-outlier").alias("rule_id"), F.array("id").alias("ids"))
    traps = invoices.where(F.col("id").startswith("CT-")).select("ledger_id", "id")
    return review.score_known(findings, planted, traps).select("ledger_id", "planted", "found", "missed", "traps_touched", "unmatched", F.round("recall", 6).alias("recall"))


_LINES = f"""{INVOICES_SQL}, placed AS (
  SELECT *, {SUPPLIER} AS s, 'supplier-' || {SUPPLIER} AS file_id, 1 + row_number() OVER (PARTITION BY {SUPPLIER} ORDER BY invoice_date, id) AS line FROM inv
)"""
_AMOUNT_HEADER = "CASE s % 3 WHEN 0 THEN 'Net Amount' WHEN 1 THEN 'Gross' ELSE 'Value' END"
_COLUMNS = " UNION ALL ".join(f"SELECT {layout} AS layout, {place} AS \"column\", '{name}' AS header, '{field}' AS field" for layout, head in enumerate(HEADERS) for place, (name, field) in enumerate(zip(head.split(","), mapping.FIELDS, strict=True)))
_SIZE, _MINUS = "format('{:,.2f}', CAST(abs(amount) AS DOUBLE))", "CASE WHEN amount < 0 THEN"
_WRITTEN = f"""SELECT *, CASE s % 3 WHEN 0 THEN CAST(invoice_date AS VARCHAR) WHEN 1 THEN strftime(invoice_date, '%-d %b %Y') ELSE strftime(invoice_date, '%Y%m%d 00:00:00') END AS day,
  CASE s % 3 WHEN 0 THEN {_MINUS} '-' ELSE '' END || replace({_SIZE}, ',', '') WHEN 1 THEN {_MINUS} '(' || {_SIZE} || ')' ELSE {_SIZE} END ELSE translate({_SIZE}, ',.', '.,') || {_MINUS} ' CR' ELSE '' END END AS written
FROM placed"""
_DECIDED = f"""{DETECT_SQL}, decided AS (
  SELECT *, CASE length(finding_key) % 5 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' END AS decision, CASE length(finding_key) % 5 WHEN 1 THEN 'seen the papers' END AS reason FROM found
)"""
_SUMS = ", ".join(f"count(CASE WHEN {test} THEN 1 END) AS {name}_count, CAST(coalesce(sum(CASE WHEN {test} THEN amount_at_stake END), 0) AS DOUBLE) AS {name}_value" for name, test in [("open", "decision IS NULL"), ("accepted", "decision = 'accepted'"), ("rejected", "decision = 'rejected'"), ("all", "true")])
_IDS = "unnest(string_split(invoice_ids, '|')) AS id, unnest(range(len(string_split(invoice_ids, '|')))) AS pos"
_RANK = "row_number() OVER (PARTITION BY ledger_id ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, amount_at_stake DESC, list_position(['exact-duplicate', 'rekeyed-duplicate', 'vendor-spelling-duplicate', 'amount-transposition', 'unapplied-credit', 'bank-detail-change', 'round-number-outlier'], rule_id), finding_key)"
_FLAGS = f"flags AS (SELECT id, arg_max(rule_id, q) AS flagged_by FROM (SELECT rule_id, q, unnest(string_split(invoice_ids, '|')) AS id FROM (SELECT *, {_RANK} AS q FROM found)) GROUP BY id)"
_MONTHS = "['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December']"
_PHRASES = ", ".join(f"('{field}', '{phrase}', {place})" for field, known in mapping.PHRASES.items() for place, phrase in enumerate(known))
_AGAINST = ", ".join(f"('{field}', '{token}', {weight})" for field, token, weight, _ in mapping.PENALTIES)

QUERIES: dict[str, tuple[Query, str]] = {
    "import_invoices": (import_invoices, f"WITH {_LINES} SELECT file_id AS ledger_id, 'row-' || line AS id, vendor_name, invoice_number, CAST(invoice_date AS VARCHAR) AS invoice_date, CAST(amount AS DOUBLE) AS amount, currency, bank_last4 FROM placed WHERE amount <> 45"),
    "import_errors": (import_errors, f"WITH {_LINES} SELECT file_id, CAST(line AS INTEGER) AS row, {_AMOUNT_HEADER} AS \"column\", 'n/a' AS value, 'amount: \"n/a\" is not a number' AS reason FROM placed WHERE amount = 45"),
    "import_mapping": (import_mapping, f"WITH c AS ({_COLUMNS}) SELECT 'supplier-' || s_suppkey AS file_id, field, \"column\", header FROM supplier JOIN c ON layout = s_suppkey % 3"),
    "import_summary": (
        import_summary,
        f"""WITH {_LINES}, t AS (SELECT file_id, count(CASE WHEN amount <> 45 THEN 1 END) AS rows_read, count(CASE WHEN amount = 45 THEN 1 END) AS rows_skipped FROM placed GROUP BY file_id)
SELECT file_id, rows_read, rows_skipped, file_id || ' — ' || format('{{:,}}', rows_read) || ' rows' || CASE WHEN rows_skipped > 0 THEN ', ' || rows_skipped || ' skipped' ELSE '' END AS ledger_name, CAST(NULL AS VARCHAR) AS first_error FROM t""",
    ),
    "import_reconciliation": (import_reconciliation, f"WITH {_LINES} SELECT file_id, count(*) AS records, 0 AS unaccounted FROM placed GROUP BY file_id"),
    "import_preview": (import_preview, f"WITH {_LINES}, t AS ({_WRITTEN}) SELECT file_id, CAST(line AS INTEGER) AS line, vendor_name || '|' || invoice_number || '|' || day || '|' || CASE WHEN amount = 45 THEN 'n/a' ELSE written END || '|' || currency || '||' || coalesce(bank_last4, '') AS cells FROM t WHERE line <= 6"),
    "large_files": (
        large_files,
        f"""WITH {INVOICES_SQL} SELECT vendor_name, invoice_number, CAST(invoice_date AS VARCHAR) AS invoice_date, CAST(amount AS DOUBLE) AS amount, currency,
  CASE WHEN amount < 0 THEN 'credit "as agreed",' || chr(10) || 'see letter' WHEN amount = 45 THEN 'fee' || chr(13) || chr(10) || '(set)' END AS reference, bank_last4, count(*) AS rows FROM inv GROUP BY ALL""",
    ),
    "header_scores": (
        header_scores,
        f"""WITH c AS ({_COLUMNS}), k(field, phrase, place) AS (VALUES {_PHRASES}), p(field, token, weight) AS (VALUES {_AGAINST}),
h AS (SELECT DISTINCT header, trim(regexp_replace(lower(header), '[^a-z0-9]+', ' ', 'g')) AS norm FROM c JOIN supplier ON layout = s_suppkey % 3),
m AS (SELECT header, norm, field, phrase, place, string_split(norm, ' ') AS hay, string_split(phrase, ' ') AS needle FROM h, k),
s AS (SELECT *, len(list_intersect(needle, hay)) / len(needle) AS shared, 1 - levenshtein(norm, phrase) / greatest(length(norm), length(phrase)) AS fuzzy FROM m),
o AS (SELECT *, CASE WHEN shared > 0 THEN 0.3 + 0.35 * shared ELSE 0 END AS overlap FROM s),
r AS (SELECT *, CASE WHEN norm = phrase THEN 1 WHEN contains(' ' || norm || ' ', ' ' || phrase || ' ') THEN 0.7 + 0.25 * (len(needle) / len(hay)) WHEN fuzzy > 0.75 AND fuzzy * 0.7 > overlap THEN fuzzy * 0.7 ELSE overlap END AS raw FROM o),
a AS (SELECT header, phrase, m.field, sum(weight) AS weight FROM m JOIN p ON p.field = m.field AND list_contains(hay, token) AND NOT list_contains(needle, token) GROUP BY ALL)
SELECT header, r.field, round(greatest(max(CASE WHEN raw > 0 THEN raw - 0.005 * least(place, 10) - coalesce(a.weight, 0) ELSE 0 END), 0)::DOUBLE, 6) AS score
FROM r LEFT JOIN a USING (header, phrase, field) GROUP BY header, r.field""",
    ),
    "ledger_csv": (ledger_csv, f"WITH {INVOICES_SQL} SELECT id, vendor_name || ',' || invoice_number || ',' || invoice_date || ',' || format('{{:.2f}}', CAST(amount AS DOUBLE)) || ',' || currency || ',,' || coalesce(bank_last4, '') AS line FROM inv"),
    "parse_dates": (parse_dates, f"WITH {INVOICES_SQL} SELECT id, CAST(invoice_date AS VARCHAR) AS first, CAST(invoice_date AS VARCHAR) AS last, 5 AS texts FROM inv"),
    "ambiguous_dates": (
        ambiguous_dates,
        f"""WITH {INVOICES_SQL}, d AS (SELECT *, day(invoice_date) AS d, month(invoice_date) AS m, year(invoice_date) AS y, strftime(invoice_date, '%d/%m/%Y') AS text FROM inv)
SELECT id, CASE WHEN d > 12 OR d = m THEN CAST(invoice_date AS VARCHAR) END AS date,
  CASE WHEN d <= 12 AND d <> m THEN '"' || text || '" is ambiguous: ' || d || ' ' || {_MONTHS}[m] || ' ' || y || ' if the file is day-first, ' || m || ' ' || {_MONTHS}[d] || ' ' || y || ' if it is month-first — set dateOrder to "dmy" or "mdy"' END AS reason,
  CASE WHEN d > 12 THEN 'dmy' END AS forced FROM d""",
    ),
    "parse_amounts": (parse_amounts, f"WITH {INVOICES_SQL} SELECT id, CAST(amount AS DOUBLE) AS low, CAST(amount AS DOUBLE) AS high, 5 AS texts, currency FROM inv"),
    "review_decisions": (review_decisions, f"WITH {_DECIDED} SELECT finding_key, decision, reason FROM decided"),
    "review_totals": (review_totals, f"WITH {_DECIDED}, t AS (SELECT ledger_id, {_SUMS} FROM decided GROUP BY ledger_id) SELECT *, format('{{:,.2f}}', all_value) || ' (mixed currencies)' AS all_text FROM t"),
    "review_refused": (review_refused, f"WITH {DETECT_SQL} SELECT CASE length(finding_key) % 5 WHEN 3 THEN 'a rejection needs a reason' ELSE 'no such finding on this ledger' END AS refused, count(*) AS events FROM found WHERE length(finding_key) % 5 > 2 GROUP BY 1"),
    "review_audit": (
        review_audit,
        f"""WITH {DETECT_SQL}, e AS (SELECT *, unnest(CASE length(finding_key) % 5 WHEN 0 THEN ['accepted'] WHEN 1 THEN ['rejected'] WHEN 2 THEN ['accepted', 'reopened'] ELSE [] END) AS action FROM found)
SELECT ledger_id, 'pat' AS who, action, rule_id || ' — ' || explanation || CASE WHEN action = 'rejected' THEN ' (seen the papers)' ELSE '' END AS detail FROM e
UNION ALL SELECT 'ap', 'system', 'created', format('{{:,}}', (SELECT count(*) FROM inv)) || ' invoices, ' || (SELECT count(*) FROM found) || ' findings'""",
    ),
    "finding_evidence": (finding_evidence, f"WITH {DETECT_SQL}, e AS (SELECT finding_key, {_IDS} FROM found) SELECT finding_key, CAST(pos AS INTEGER) AS pos, id, CAST(amount AS DOUBLE) AS amount FROM e JOIN inv USING (id)"),
    "flagged_rows": (flagged_rows, f"WITH {DETECT_SQL}, {_FLAGS} SELECT id, flagged_by FROM inv LEFT JOIN flags USING (id)"),
    "ledger_stats": (
        ledger_stats,
        f"""WITH {DETECT_SQL}, {_FLAGS} SELECT ledger_id, count(CASE WHEN contains(lower(vendor_name), 'suplier') THEN 1 END) AS rows_shown, count(DISTINCT vendor_name) AS suppliers, count(flagged_by) AS flagged,
  CAST(min(invoice_date) AS VARCHAR) AS first_date, CAST(max(invoice_date) AS VARCHAR) AS last_date FROM inv LEFT JOIN flags USING (id) GROUP BY ledger_id""",
    ),
    "rows_of_supplier": (rows_of_supplier, f"WITH {INVOICES_SQL} SELECT id, vendor_name, CAST(invoice_date AS VARCHAR) AS invoice_date FROM inv WHERE contains(lower(vendor_name), '#000000001')"),
    "ledger_list": (ledger_overview, f"WITH {_DECIDED} SELECT 'ap' AS id, (SELECT count(*) FROM inv) AS row_count, count(*) AS open_count, CAST(sum(amount_at_stake) AS DOUBLE) AS open_value FROM decided WHERE decision IS NULL"),
    "known_problems": (
        known_problems,
        f"""WITH {DETECT_SQL}, p AS (SELECT id FROM inv WHERE amount = 7500), r AS (SELECT invoice_ids AS id FROM round_number), named AS (SELECT unnest(string_split(invoice_ids, '|')) AS id FROM found)
SELECT 'ap' AS ledger_id, (SELECT count(*) FROM p) AS planted, (SELECT count(*) FROM p JOIN r USING (id)) AS found, (SELECT count(*) FROM p) - (SELECT count(*) FROM p JOIN r USING (id)) AS missed,
  (SELECT count(DISTINCT id) FROM named WHERE starts_with(id, 'CT-')) AS traps_touched, (SELECT count(*) FROM found) - (SELECT count(*) FROM p JOIN r USING (id)) AS unmatched,
  round((SELECT count(*) FROM p JOIN r USING (id)) / (SELECT count(*) FROM p), 6) AS recall""",
    ),
}


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
