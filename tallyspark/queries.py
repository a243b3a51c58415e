"""Queries over the given tables, and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.matching import BRANCH_WORDS, LEGAL_SUFFIXES
from tallyspark.functions.money import mixed_text, money_text
from tallyspark.model import FINDING_COLUMNS
from tallyspark.operators import combine, rules
from tallyspark.operators.cadence import gap_cadences, is_steady, with_previous
from tallyspark.plans.detection import detect, raw_findings
from tallyspark.sources.tables import projected_invoices, written_once

Query = Callable[[SparkSession, str], DataFrame]


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


# --- SQL shared by the oracles ------------------------------------------------------------------

INVOICES_SQL = """
inv AS (
  SELECT 'ap' AS ledger_id,
    l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_quantity AS INTEGER) || '-' || strftime(l_shipdate, '%Y%m%d') AS id,
    CASE WHEN l_partkey % 11 = 0 THEN replace(s_name, 'Supplier', 'Suplier') ELSE s_name END
      || CASE l_linenumber % 4 WHEN 1 THEN ' Ltd' WHEN 2 THEN ' Limited.' ELSE '' END AS vendor_name,
    'INV-' || lpad(CAST(l_orderkey % 1000 AS VARCHAR), 5, '0') AS invoice_number,
    CAST(l_shipdate AS DATE) AS invoice_date,
    CAST(CASE WHEN l_partkey % 997 = 0 THEN 7500 WHEN l_partkey % 503 = 0 THEN 45 ELSE l_quantity * 90 END
      * CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN -1 ELSE 1 END AS DECIMAL(18, 4)) AS amount,
    CASE WHEN l_linestatus = 'O' THEN 'GBP' ELSE 'EUR' END AS currency,
    CASE WHEN l_linenumber <> 7 THEN lpad(CAST((l_suppkey * 7919 + CASE WHEN l_shipdate >= DATE '1999-01-01' AND l_suppkey % 5 = 0 THEN 13 ELSE 0 END) % 10000 AS VARCHAR), 4, '0') END AS bank_last4
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  UNION ALL
  SELECT 'ap', 'CT-' || s_suppkey || '-' || k, s_name, 'CONTRACT-' || k, CAST(DATE '1996-01-01' + CAST(14 * k AS INTEGER) AS DATE), CAST(1450 AS DECIMAL(18, 4)), 'GBP',
    lpad(CAST(s_suppkey * 7919 % 10000 AS VARCHAR), 4, '0')
  FROM supplier, range(26) t(k)
)"""

_VENDOR_BASE = "trim(regexp_replace(replace(lower(vendor_name), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
NORMAL_SQL = f"""{INVOICES_SQL}, parts AS (
  SELECT *, {_VENDOR_BASE} AS base, list_filter(string_split({_VENDOR_BASE}, ' '), lambda w: NOT list_contains({_list(LEGAL_SUFFIXES)}, w)) AS kept FROM inv
), norm AS (
  SELECT * EXCLUDE (base, kept), CASE WHEN len(kept) > 0 THEN array_to_string(kept, ' ') ELSE base END AS vendor_norm,
    regexp_replace(regexp_replace(lower(invoice_number), '[^a-z0-9]', '', 'g'), '^([a-z]*)0+([0-9])', '\\1\\2') AS invoice_norm,
    upper(coalesce(nullif(currency, ''), 'GBP')) AS cur
  FROM parts
), paid AS (
  SELECT * FROM norm WHERE amount >= 50
)"""


def _money(amount: str, currency: str) -> str:
    return f"(CASE {currency} WHEN 'GBP' THEN '£' WHEN 'EUR' THEN '€' ELSE {currency} END || format('{{:,.2f}}', CAST({amount} AS DOUBLE)))"


def _finding(rule: str, severity: str, stake: str, ids: str, text: str, source: str) -> str:
    return f"""SELECT ledger_id, '{rule}' AS rule_id, '{severity}' AS severity, CAST({stake} AS DOUBLE) AS amount_at_stake,
  array_to_string({ids}, '|') AS invoice_ids, {text} AS explanation, '{rule}:' || array_to_string(list_sort({ids}), '+') AS finding_key
FROM {source}"""


EXACT = f"""exact_groups AS (
  SELECT ledger_id, vendor_name, cur, amount, invoice_norm, count(*) AS n, list(id ORDER BY invoice_date, id) AS ids,
    list(invoice_number ORDER BY invoice_date, id)[1] AS number, list(currency ORDER BY invoice_date, id)[1] AS money_of
  FROM paid GROUP BY ALL HAVING count(*) > 1
), exact AS ({_finding("exact-duplicate", "high", "amount * (n - 1)", "ids", f"vendor_name || ' invoice ' || number || ' for ' || {_money('amount', 'money_of')} || ' appears ' || n || ' times. ' || CASE WHEN n = 2 THEN 'One is' ELSE (n - 1) || ' are' END || ' probably a duplicate payment.'", "exact_groups")})"""

REKEYED = f"""steps AS (
  SELECT *, lag(id) OVER o AS id0, lag(vendor_name) OVER o AS name0, lag(invoice_number) OVER o AS number0, lag(invoice_norm) OVER o AS norm0, lag(currency) OVER o AS currency0,
    abs(date_diff('day', lag(invoice_date) OVER o, invoice_date)) AS gap
  FROM paid WINDOW o AS (PARTITION BY ledger_id, vendor_norm, cur, amount ORDER BY invoice_date, id)
), paces AS (
  SELECT *, median(gap) OVER g AS pace, count(*) OVER g AS n FROM steps WINDOW g AS (PARTITION BY ledger_id, vendor_norm, cur, amount)
), beats AS (
  SELECT *, abs(gap - pace) <= greatest(3, pace * 0.15) AS beat, count(CASE WHEN abs(gap - pace) <= greatest(3, pace * 0.15) THEN 1 END) OVER (PARTITION BY ledger_id, vendor_norm, cur, amount) AS held FROM paces
), pairs2 AS (
  SELECT * FROM beats WHERE gap <= 21 AND norm0 <> invoice_norm AND NOT (n >= 3 AND pace >= 5 AND held * 10 >= (n - 1) * 7 AND beat)
), rekeyed AS ({_finding("rekeyed-duplicate", "high", "amount", "[id0, id]", f"name0 || ' was billed ' || {_money('amount', 'currency0')} || ' twice within ' || gap || CASE WHEN gap = 1 THEN ' day' ELSE ' days' END || ' under different invoice numbers (' || number0 || ' and ' || invoice_number || '). This is the pattern of an invoice entered twice.'", "pairs2")})"""

_ODD = "list_filter(list_concat(list_filter(string_split(anchor, ' '), lambda w: NOT list_contains(string_split(vendor_norm, ' '), w)), list_filter(string_split(vendor_norm, ' '), lambda w: NOT list_contains(string_split(anchor, ' '), w))), lambda w: w <> '')"
SPELLING = f"""anchored AS (
  SELECT *, first_value(vendor_norm) OVER o AS anchor, row_number() OVER o AS rn FROM paid
  WINDOW o AS (PARTITION BY ledger_id, invoice_norm, cur, amount ORDER BY invoice_date, id)
), company AS (
  SELECT * FROM anchored WHERE rn = 1 OR vendor_norm = anchor
    OR (1 - levenshtein(anchor, vendor_norm) / greatest(length(anchor), length(vendor_norm)) >= 0.86
      AND NOT (len({_ODD}) > 0 AND len(list_filter({_ODD}, lambda w: NOT (list_contains({_list(BRANCH_WORDS)}, w) OR regexp_full_match(w, '[0-9]+')))) = 0))
), spelled AS (
  SELECT ledger_id, invoice_norm, cur, amount, count(*) AS n, list(id ORDER BY invoice_date, id) AS ids, list(vendor_name ORDER BY invoice_date, id) AS names,
    list(invoice_number ORDER BY invoice_date, id)[1] AS number, list(currency ORDER BY invoice_date, id)[1] AS money_of
  FROM company GROUP BY ALL HAVING count(*) > 1 AND count(DISTINCT vendor_name) > 1
), spellings AS (
  SELECT *, list_transform(list_filter(list_zip(names, range(1, len(names) + 1)), lambda z: list_position(names, z[1]) = z[2]), lambda z: '"' || z[1] || '"') AS shown FROM spelled
), spelling AS ({_finding("vendor-spelling-duplicate", "high", "amount * (n - 1)", "ids", f"'Invoice ' || number || ' for ' || {_money('amount', 'money_of')} || ' appears ' || n || ' times, against supplier records that look like the same company: ' || array_to_string(shown, ', ') || '.'", "spellings")})"""

TRANSPOSED = f"""coins AS MATERIALIZED (
  SELECT ledger_id, vendor_norm, cur, id, vendor_name, amount, currency, invoice_date, CAST(invoice_date - DATE '1970-01-01' AS BIGINT) // 22 AS span, CAST(CAST(round(amount * 100) AS BIGINT) AS VARCHAR) AS c FROM paid
), turned AS MATERIALIZED (
  SELECT *, unnest(list_transform(list_filter(range(1, length(c)), lambda i: substr(c, i, 1) <> substr(c, i + 1, 1)),
    lambda i: substr(c, 1, i - 1) || substr(c, i + 1, 1) || substr(c, i, 1) || substr(c, i + 2))) AS swapped FROM coins
), cells AS MATERIALIZED (
  SELECT DISTINCT vendor_norm, cur, c FROM coins
), asked AS MATERIALIZED (
  SELECT t.*, unnest([span, span + 1]) AS beside FROM turned t SEMI JOIN cells k ON t.vendor_norm = k.vendor_norm AND t.cur = k.cur AND t.swapped = k.c
), swaps AS (
  SELECT a.ledger_id, a.id AS id1, b.id AS id2, a.vendor_name, a.amount AS amount1, b.amount AS amount2, a.currency AS currency1, b.currency AS currency2
  FROM asked a JOIN coins b ON a.vendor_norm = b.vendor_norm AND a.cur = b.cur AND a.swapped = b.c AND a.beside = b.span
  WHERE a.ledger_id = b.ledger_id AND (a.invoice_date, a.id) < (b.invoice_date, b.id) AND date_diff('day', a.invoice_date, b.invoice_date) <= 21
), transposed AS ({_finding("amount-transposition", "medium", "least(amount1, amount2)", "[id1, id2]", f"vendor_name || ' has two invoices days apart for ' || {_money('amount1', 'currency1')} || ' and ' || {_money('amount2', 'currency2')} || ' — the same digits in a different order, which is how a mistyped amount usually looks.'", "swaps")})"""

CREDIT = f"""unused AS (
  SELECT * FROM norm c WHERE amount <= -50 AND NOT EXISTS (
    SELECT 1 FROM norm p WHERE p.amount > 0 AND p.ledger_id = c.ledger_id AND p.vendor_norm = c.vendor_norm AND p.cur = c.cur AND p.invoice_date >= c.invoice_date AND abs(p.amount + c.amount) < 0.005)
), credit AS ({_finding("unapplied-credit", "medium", "-amount", "[id]", f"vendor_name || ' issued a credit note (' || invoice_number || ') for ' || {_money('-amount', 'currency')} || ' on ' || CAST(invoice_date AS VARCHAR) || ' and nothing since appears to use it. This is money you are owed.'", "unused")})"""

BANK = f"""banked AS (
  SELECT *, lpad(right(regexp_replace(bank_last4, '[^0-9]', '', 'g'), 4), 4, '0') AS account FROM paid WHERE bank_last4 <> ''
), numbered AS (
  SELECT *, row_number() OVER o AS rn, lag(id) OVER o AS id0 FROM banked WINDOW o AS (PARTITION BY ledger_id, vendor_norm ORDER BY invoice_date, id)
), accounts AS (
  SELECT ledger_id, vendor_norm, account, min(rn) AS rn, arg_min(id0, rn) AS id0, arg_min(vendor_name, rn) AS vendor_name, arg_min(currency, rn) AS currency,
    min(invoice_date) AS since, list(id ORDER BY rn) AS own, sum(amount) AS total
  FROM numbered GROUP BY ledger_id, vendor_norm, account
), moves AS (
  SELECT *, list(account) OVER (PARTITION BY ledger_id, vendor_norm ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM accounts
), bank AS ({_finding("bank-detail-change", "high", "total", "list_concat([id0], own)", f"'Payments to ' || vendor_name || ' moved to a new bank account ending ' || account || ' on ' || CAST(since AS VARCHAR) || ', after previously going to ' || array_to_string(earlier, ', ') || '.' || CASE WHEN len(own) > 1 THEN ' ' || len(own) || ' invoices totalling ' || {_money('total', 'currency')} || ' have gone to the new account since.' ELSE '' END || ' Confirm the change by phone using a number you already hold, not one from the invoice.'", "moves WHERE rn > 1")})"""

ROUND = f"""habits AS (
  SELECT *, count(*) OVER g AS n, count(CASE WHEN amount >= 5000 AND amount % 500 = 0 THEN 1 END) OVER g AS rounds
  FROM norm WHERE amount > 0 WINDOW g AS (PARTITION BY ledger_id, vendor_norm, cur)
), round_number AS ({_finding("round-number-outlier", "low", "amount", "[id]", f"vendor_name || ' is usually billed in odd amounts, but invoice ' || invoice_number || ' is exactly ' || {_money('amount', 'currency')} || '. Worth confirming what it covers.'", "habits WHERE amount >= 5000 AND amount % 500 = 0 AND n >= 4 AND rounds < 3 AND rounds / n <= 0.3")})"""

ALL_FINDINGS_SQL = ", ".join([NORMAL_SQL, EXACT, REKEYED, SPELLING, TRANSPOSED, CREDIT, BANK, ROUND])
RULE_TABLES = ["exact", "rekeyed", "spelling", "transposed", "credit", "bank", "round_number"]
#: All findings; the rules' findings over the projection never share a set of rows.
DETECT_SQL = f"{ALL_FINDINGS_SQL}, found AS ({' UNION ALL '.join(f'SELECT * FROM {t}' for t in RULE_TABLES)})"


# --- Queries ------------------------------------------------------------------------------------


def flat(findings: DataFrame) -> DataFrame:
    """Findings with plain column types, as reports hold them."""
    return findings.select("ledger_id", "rule_id", "severity", F.col("amount_at_stake").cast("double").alias("amount_at_stake"), F.array_join("invoice_ids", "|").alias("invoice_ids"), "explanation", "finding_key")


def _rule(rule: Callable) -> Query:
    return lambda spark, sf_dir: flat(rule(written_once(rules.normalise(projected_invoices(spark, sf_dir)))))


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.normalise(projected_invoices(spark, sf_dir))
    return rows.select("id", "vendor_norm", "invoice_norm", "cur", F.col("amount").cast("double").alias("amount"))


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(detect(projected_invoices(spark, sf_dir)))


def detection_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = combine.rule_totals(detect(projected_invoices(spark, sf_dir)))
    return totals.select("ledger_id", "rule_id", "findings", F.col("at_stake").cast("double").alias("at_stake"))


def detection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    invoices = projected_invoices(spark, sf_dir)
    totals = combine.summary(invoices, detect(invoices))
    return totals.select("ledger_id", "invoices_examined", "findings", F.col("total_at_stake").cast("double").alias("total_at_stake"), mixed_text(F.col("total_at_stake")).alias("total_text"))


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the queue's first fifty findings of each ledger, with label; ``review_queue_all`` is the whole queue."""
    queue = combine.labelled(combine.first_queued(detect(projected_invoices(spark, sf_dir)), 50))
    return queue.select("ledger_id", "queue_rank", "finding_key", "label", F.col("amount_at_stake").cast("double").alias("amount_at_stake"))


def review_queue_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole queue of each ledger, with label."""
    queue = combine.labelled(combine.queued(detect(projected_invoices(spark, sf_dir))))
    return queue.select("ledger_id", "queue_rank", "finding_key", "label", F.col("amount_at_stake").cast("double").alias("amount_at_stake"))


def collapsed_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collapse over findings that do share sets of rows: each is joined by a weaker copy from every duplicate rule."""
    found = raw_findings(projected_invoices(spark, sf_dir)).drop("finding_key")
    weaker = found.where(F.col("rule_id") == "exact-duplicate").withColumn("rule_id", F.lit("amount-transposition")).withColumn("severity", F.lit("medium")).withColumn("rule_ordinal", F.lit(3))
    larger = weaker.withColumn("rule_id", F.lit("rekeyed-duplicate")).withColumn("severity", F.lit("high")).withColumn("rule_ordinal", F.lit(1)).withColumn("amount_at_stake", (F.col("amount_at_stake") * 2).cast("decimal(18,4)"))
    from tallyspark.model import finding_key

    every = found.unionByName(weaker).unionByName(larger)
    every = every.withColumn("finding_key", finding_key(F.col("rule_id"), F.col("invoice_ids")))
    return flat(combine.collapse(every.select(*FINDING_COLUMNS)))


def money_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = projected_invoices(spark, sf_dir)
    return rows.select("id", money_text(F.col("amount"), F.col("currency")).alias("amount_text"))


def vendor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity and branch test of each supplier record against its supplier's plain name."""
    from tallyspark.functions import matching as m

    rows = projected_invoices(spark, sf_dir).select("vendor_name", F.regexp_extract("vendor_name", "#[0-9]+", 0).alias("code")).distinct()
    rows = rows.select("vendor_name", m.normal_vendor(F.col("vendor_name")).alias("a"), m.normal_vendor(F.concat(F.lit("Supplier"), F.translate("code", "0", "1"))).alias("b"))
    return rows.select("vendor_name", F.round(m.vendor_similarity(F.col("a"), F.col("b")), 6).alias("similarity"), m.differs_only_by_branch(F.col("a"), F.col("b")).alias("branch_only"))


def transposed_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's price against the price with its last two whole digits exchanged."""
    from tallyspark.functions import matching as m
    from tallyspark.sources.tables import read_table

    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    text = cents.cast("string")
    n = F.length(text)
    turned = F.concat(F.left(text, n - 4), F.substring(text, n - 2, F.lit(1)), F.substring(text, n - 3, F.lit(1)), F.right(text, F.lit(2))).cast("decimal(18,4)") / 100
    parts = read_table(spark, sf_dir, "part")
    return parts.select("p_partkey", m.is_transposition(F.col("p_retailprice").cast("decimal(18,4)"), turned.cast("decimal(18,4)")).alias("transposed"))


def supplier_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cadence of each supplier's bills of one amount and currency."""
    key = ["vendor_norm", "cur", "amount"]
    rows = written_once(rules.normalise(projected_invoices(spark, sf_dir)).where("amount >= 50"))
    paired = with_previous(rows, key, ["invoice_date"])
    groups = gap_cadences(paired.select(*key, F.datediff("invoice_date", "before.invoice_date").alias("gap")), key)
    cadence = F.when(is_steady(F.col("n"), F.col("pace"), F.col("held")), F.col("pace").cast("double"))
    return groups.select("vendor_norm", "cur", F.col("amount").cast("double").alias("amount"), cadence.alias("cadence"))


_FOUND = "SELECT ledger_id, rule_id, severity, amount_at_stake, invoice_ids, explanation, finding_key FROM"
_RANKED = "row_number() OVER (PARTITION BY ledger_id ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, amount_at_stake DESC, list_position(['exact-duplicate', 'rekeyed-duplicate', 'vendor-spelling-duplicate', 'amount-transposition', 'unapplied-credit', 'bank-detail-change', 'round-number-outlier'], rule_id), finding_key)"
_LABEL = "CASE rule_id " + " ".join(f"WHEN '{rule}' THEN '{label}'" for rule, label, _ in combine.GUIDE) + " END"
_PACED = "SELECT vendor_norm, cur, amount, count(*) AS n, any_value(pace) AS pace, count(CASE WHEN beat THEN 1 END) AS held FROM beats GROUP BY vendor_norm, cur, amount"
_CODE = "translate(regexp_extract(vendor_name, '#([0-9]+)', 1), '0', '1')"
_A = "trim(regexp_replace(lower(regexp_replace(vendor_name, ' (Ltd|Limited\\.)$', '')), '[^a-z0-9]+', ' ', 'g'))"

QUERIES: dict[str, tuple[Query, str]] = {
    "normalised_invoices": (normalised, f"WITH {NORMAL_SQL} SELECT id, vendor_norm, invoice_norm, cur, CAST(amount AS DOUBLE) AS amount FROM norm"),
    "money_lines": (money_lines, f"WITH {INVOICES_SQL} SELECT id, CASE WHEN amount < 0 THEN '-' ELSE '' END || {_money('abs(amount)', 'currency')} AS amount_text FROM inv"),
    "vendor_pairs": (
        vendor_pairs,
        f"""WITH {INVOICES_SQL}, n AS (SELECT DISTINCT vendor_name, {_A} AS a, 'supplier ' || {_CODE} AS b FROM inv)
SELECT vendor_name, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS similarity, a <> b AND split_part(a, ' ', 1) = 'supplier' AS branch_only FROM n""",
    ),
    "supplier_cadence": (
        supplier_cadence,
        f"""WITH {NORMAL_SQL}, {REKEYED}, g AS ({_PACED})
SELECT vendor_norm, cur, CAST(amount AS DOUBLE) AS amount, CASE WHEN n >= 3 AND pace >= 5 AND held * 10 >= (n - 1) * 7 THEN pace END AS cadence FROM g""",
    ),
    "transposed_prices": (
        transposed_prices,
        "SELECT p_partkey, CAST(floor(p_retailprice / 10) AS BIGINT) % 10 <> CAST(floor(p_retailprice) AS BIGINT) % 10 AS transposed FROM part",
    ),
    "rule_exact_duplicate": (_rule(rules.exact_duplicates), f"WITH {NORMAL_SQL}, {EXACT} {_FOUND} exact"),
    "rule_rekeyed_duplicate": (_rule(rules.rekeyed_duplicates), f"WITH {NORMAL_SQL}, {REKEYED} {_FOUND} rekeyed"),
    "rule_vendor_spelling_duplicate": (_rule(rules.vendor_spelling_duplicates), f"WITH {NORMAL_SQL}, {SPELLING} {_FOUND} spelling"),
    "rule_amount_transposition": (_rule(rules.amount_transpositions), f"WITH {NORMAL_SQL}, {TRANSPOSED} {_FOUND} transposed"),
    "rule_unapplied_credit": (_rule(rules.unapplied_credits), f"WITH {NORMAL_SQL}, {CREDIT} {_FOUND} credit"),
    "rule_bank_detail_change": (_rule(rules.bank_detail_changes), f"WITH {NORMAL_SQL}, {BANK} {_FOUND} bank"),
    "rule_round_number_outlier": (_rule(rules.round_number_outliers), f"WITH {NORMAL_SQL}, {ROUND} {_FOUND} round_number"),
    "detect": (detected, f"WITH {DETECT_SQL} {_FOUND} found"),
    "detection_totals": (detection_totals, f"WITH {DETECT_SQL} SELECT ledger_id, rule_id, count(*) AS findings, sum(amount_at_stake) AS at_stake FROM found GROUP BY ledger_id, rule_id"),
    "detection_summary": (
        detection_summary,
        f"""WITH {DETECT_SQL}, t AS (SELECT ledger_id, count(*) AS findings, sum(amount_at_stake) AS total_at_stake FROM found GROUP BY ledger_id)
SELECT ledger_id, invoices_examined, findings, total_at_stake, format('{{:,.2f}}', total_at_stake) || ' (mixed currencies)' AS total_text
FROM (SELECT ledger_id, count(*) AS invoices_examined FROM inv GROUP BY ledger_id) JOIN t USING (ledger_id)""",
    ),
    "review_queue": (review_queue, f"WITH {DETECT_SQL}, q AS (SELECT *, {_RANKED} AS queue_rank FROM found) SELECT ledger_id, queue_rank, finding_key, {_LABEL} AS label, amount_at_stake FROM q WHERE queue_rank <= 50"),
    "review_queue_all": (review_queue_all, f"WITH {DETECT_SQL}, q AS (SELECT *, {_RANKED} AS queue_rank FROM found) SELECT ledger_id, queue_rank, finding_key, {_LABEL} AS label, amount_at_stake FROM q"),
    "collapse_duplicates": (
        collapsed_duplicates,
        f"""WITH {DETECT_SQL} {_FOUND} found WHERE rule_id <> 'exact-duplicate' UNION ALL
SELECT ledger_id, 'rekeyed-duplicate', 'high', amount_at_stake * 2, invoice_ids, explanation, replace(finding_key, 'exact-duplicate', 'rekeyed-duplicate') FROM exact""",
    ),
}


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
