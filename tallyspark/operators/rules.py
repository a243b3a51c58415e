"""The seven rules.  Each takes normalised invoices and options and returns findings.

Rows of two ledgers never meet: ``ledger_id`` leads every key.  No rule gathers a supplier's rows in
one task unless they are a finding's evidence, so a supplier with a third of all rows is dealt out.
Rows dealt by ``layout.dealt`` are shuffled once more, for the spelling rule; the others group them
where they lie.  Their joins ask for the layout's columns and more: Spark then moves the small side only
if ``spark.sql.requireAllClusterKeysForCoPartition`` is off, which a session with large ledgers should set.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import matching as m
from tallyspark.functions.money import money_text
from tallyspark.model import AMOUNT, Options, as_findings, reading_order
from tallyspark.operators.cadence import gap_cadences, is_steady, with_previous
from tallyspark.operators.layout import PLACE, STEP, part_of, step_of

#: Round figures are multiples of this.
ROUND_STEP = 500
#: A supplier with so many round figures, or fewer invoices, tells nothing.
MOST_ROUNDS, LEAST_HISTORY, MOST_ROUND_SHARE = 2, 4, 0.3
# A credit is used by a payable less than ``STEP`` ten-thousandths away.


def normalise(invoices: DataFrame) -> DataFrame:
    """Invoices with the columns that the rules compare.  Each supplier is one part; no name counts as an empty one."""
    return invoices.withColumns(
        {
            "vendor_norm": F.coalesce(m.normal_vendor(F.col("vendor_name")), F.lit("")),
            "invoice_norm": m.normal_invoice_number(F.col("invoice_number")),
            "cur": m.normal_currency(F.col("currency")),
            "amount": F.col("amount").cast(AMOUNT),
            "part": F.lit(0),
            "parts": F.lit(1),
        }
    )


def _payables(rows: DataFrame, least: object | None = None) -> DataFrame:
    rows = rows.where(F.col("amount") > 0)
    return rows if least is None else rows.where(F.col("amount") >= F.lit(least))


def _gathered(*columns: str) -> Column:
    """A group's rows in reading order."""
    return F.array_sort(F.collect_list(F.struct(reading_order().alias("at"), *columns)))


def _ids(rows: str) -> Column:
    return F.transform(F.col(rows), lambda r: r["id"])


def exact_duplicates(rows: DataFrame, options: Options = Options()) -> DataFrame:
    """Same supplier record, amount and invoice number."""
    key = [*PLACE, "vendor_name", "cur", "amount", "invoice_norm"]
    paid = _payables(rows, options.min_amount)
    # Hardly any group repeats: rows are counted where they lie before any is gathered.
    repeated = paid.withColumn("n", F.count("*").over(Window.partitionBy(*key))).where("n > 1")
    groups = repeated.groupBy(*key).agg(_gathered("id", "invoice_number", "currency").alias("rows"))
    first, n = F.get("rows", F.lit(0)), F.size("rows")
    text = F.concat(
        F.col("vendor_name"), F.lit(" invoice "), first["invoice_number"], F.lit(" for "), money_text(F.col("amount"), first["currency"]), F.lit(" appears "), n.cast("string"), F.lit(" times. "),
        F.when(n == 2, "One is").otherwise(F.concat((n - 1).cast("string"), F.lit(" are"))), F.lit(" probably a duplicate payment."),
    )
    return as_findings(groups, "exact-duplicate", F.col("amount") * (n - 1), _ids("rows"), text)


def rekeyed_duplicates(rows: DataFrame, options: Options = Options()) -> DataFrame:
    """Neighbouring bills of one amount under different numbers, off the beat of a contract."""
    key = [*PLACE, "cur", "amount"]
    paid = _payables(rows, options.min_amount)
    paired = with_previous(paid, key, ["id", "vendor_name", "invoice_number", "invoice_norm", "currency", "invoice_date"])
    paired = paired.withColumn("gap", m.days_between(F.col("before.invoice_date"), F.col("invoice_date")))
    near = paired.where((F.col("gap") <= options.rekey_window_days) & (F.col("before.invoice_norm") != F.col("invoice_norm")))
    paces = gap_cadences(paired.select(*key, "gap"), key).where(is_steady(F.col("n"), F.col("pace"), F.col("held"))).select(*key, "pace")
    found = near.join(paces, key, "left").where(~F.coalesce(m.on_schedule(F.col("gap"), F.col("pace")), F.lit(False)))
    text = F.concat(
        F.col("before.vendor_name"), F.lit(" was billed "), money_text(F.col("amount"), F.col("before.currency")), F.lit(" twice within "), F.col("gap").cast("string"),
        F.when(F.col("gap") == 1, " day").otherwise(" days"), F.lit(" under different invoice numbers ("), F.col("before.invoice_number"), F.lit(" and "), F.col("invoice_number"),
        F.lit("). This is the pattern of an invoice entered twice."),
    )
    return as_findings(found, "rekeyed-duplicate", F.col("amount"), F.array("before.id", "id"), text)


def vendor_spelling_duplicates(rows: DataFrame, options: Options = Options()) -> DataFrame:
    """One number and amount under several spellings that resemble the group's first."""
    key = ["ledger_id", "invoice_norm", "cur", "amount"]
    paid = _payables(rows, options.min_amount)
    # Only groups with several spellings matter; short numbers collide over all suppliers, so the
    # spellings are counted before any row is gathered.
    mixed = paid.groupBy(*key).agg(F.min("vendor_name").alias("a"), F.max("vendor_name").alias("b"), F.min(F.struct(reading_order().alias("at"), "vendor_norm", F.col("vendor_name").alias("name"))).alias("first"))
    mixed = mixed.where("a <> b").drop("a", "b")
    near = paid.join(mixed, key)
    anchor, own = F.col("first.vendor_norm"), F.col("vendor_norm")
    alike = (m.vendor_similarity(anchor, own) >= options.vendor_similarity) & ~m.differs_only_by_branch(anchor, own)
    near = near.where((reading_order() == F.col("first.at")) | (own == anchor) | alike)
    groups = near.groupBy(*key).agg(_gathered("id", "vendor_name", "invoice_number", "currency").alias("rows"))
    groups = groups.withColumn("spellings", F.array_distinct(F.transform("rows", lambda r: r["vendor_name"]))).where("size(rows) > 1 and size(spellings) > 1")
    first, n = F.get("rows", F.lit(0)), F.size("rows")
    text = F.concat(
        F.lit("Invoice "), first["invoice_number"], F.lit(" for "), money_text(F.col("amount"), first["currency"]), F.lit(" appears "), n.cast("string"),
        F.lit(" times, against supplier records that look like the same company: "), F.array_join(F.transform("spellings", lambda s: F.concat(F.lit('"'), s, F.lit('"'))), ", "), F.lit("."),
    )
    return as_findings(groups, "vendor-spelling-duplicate", F.col("amount") * (n - 1), _ids("rows"), text)


def amount_transpositions(rows: DataFrame, options: Options = Options()) -> DataFrame:
    """Two bills of one supplier, close in time, whose amounts differ by a swap of neighbouring digits.

    Amounts look their swapped forms up by an equal join.  Days are dealt into spans of the window's
    length, so a common amount of a busy supplier is not one key.
    """
    span = options.rekey_window_days + 1
    paid = _payables(rows, options.min_amount).where(F.col("invoice_date").isNotNull())
    cell = [*PLACE, "cur", "span", "cents"]
    paid = paid.select(*PLACE, "cur", F.floor(F.unix_date("invoice_date") / span).alias("span"), m.cents(F.col("amount")).alias("cents"), "vendor_name", "currency", "amount", "invoice_date", "seq", "id")
    # Cells that hold a row, then pairs of such cells; only rows of paired cells are joined.
    cells = paid.select(*cell).distinct()
    raised = cells.select("*", F.explode(m.raised_swaps(F.col("cents"))).alias("other")).withColumn("beside", F.explode(F.array(*(F.col("span") + k for k in (-1, 0, 1)))))
    others = cells.select("ledger_id", "vendor_norm", F.col("part").alias("other_part"), "cur", F.col("span").alias("beside"), F.col("cents").alias("other"))
    paired = raised.join(others, ["ledger_id", "vendor_norm", "cur", "beside", "other"])
    keep = F.struct("vendor_name", "currency", "amount", "invoice_date", "seq", "id")
    low = paired.join(paid.select(*cell, keep.alias("x")), cell)
    high = paid.select(*PLACE, "cur", F.col("span").alias("beside"), F.col("cents").alias("other"), keep.alias("y"))
    low = low.drop("part", "span", "cents").withColumnRenamed("other_part", "part")
    pairs = low.join(high, [*PLACE, "cur", "beside", "other"]).where(m.days_between(F.col("x.invoice_date"), F.col("y.invoice_date")) <= options.rekey_window_days)
    first = reading_order("x") < reading_order("y")
    pairs = pairs.select("ledger_id", F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("b"))
    text = F.concat(
        F.col("a.vendor_name"), F.lit(" has two invoices days apart for "), money_text(F.col("a.amount"), F.col("a.currency")), F.lit(" and "), money_text(F.col("b.amount"), F.col("b.currency")),
        F.lit(" — the same digits in a different order, which is how a mistyped amount usually looks."),
    )
    return as_findings(pairs, "amount-transposition", F.least("a.amount", "b.amount"), F.array("a.id", "b.id"), text)


def unapplied_credits(rows: DataFrame, options: Options = Options()) -> DataFrame:
    """Credit notes that no payable of the same size uses on their day or later.

    Payables shrink to the last day of each amount before they meet the credits.  Amounts have four
    decimals: a credit asks for its own step of the layout and the two beside it.
    """
    unit = F.abs(F.col("amount")) * 10_000
    key = [*PLACE, "cur"]
    sized = rows.withColumn("u", unit.cast("decimal(24,0)"))
    last = sized.where("amount > 0").groupBy(*key, "u").agg(F.max("invoice_date").alias("last")).withColumn("span", step_of(F.col("u")))
    credits = sized.where((F.col("amount") < 0) & (F.abs(F.col("amount")) >= F.lit(options.min_amount)))
    asked = credits.select("ledger_id", "vendor_norm", "parts", "cur", "id", F.col("u").alias("c"), "invoice_date", F.explode(F.array(*(step_of(F.col("u")) + k for k in (-1, 0, 1)))).alias("span"))
    asked = asked.withColumn("part", part_of(F.col("cur"), F.col("span"), F.col("parts"))).drop("parts")
    used = asked.join(last, [*key, "span"]).where((F.abs(F.col("u") - F.col("c")) < STEP) & (F.col("last") >= F.col("invoice_date"))).select("ledger_id", "id").distinct()
    open_ = credits.join(used, ["ledger_id", "id"], "left_anti")
    value = F.abs(F.col("amount"))
    text = F.concat(
        F.col("vendor_name"), F.lit(" issued a credit note ("), F.col("invoice_number"), F.lit(") for "), money_text(value, F.col("currency")), F.lit(" on "), F.coalesce(F.col("invoice_date").cast("string"), F.lit("")),
        F.lit(" and nothing since appears to use it. This is money you are owed."),
    )
    return as_findings(open_, "unapplied-credit", value, F.array("id"), text)


def bank_detail_changes(rows: DataFrame, options: Options = Options()) -> DataFrame:
    """Each account of a supplier after the first, with the payments that went there.

    Rows shrink to one for each supplier and account; only suppliers with several accounts go on.
    The evidence begins with the row just before the account's first, whatever its account.
    """
    key = ["ledger_id", "vendor_norm"]
    paid = _payables(rows, options.min_amount).where(F.col("bank_last4") != "").withColumn("account", m.normal_bank(F.col("bank_last4")))
    paid = paid.withColumn("at", reading_order())
    firsts = paid.groupBy(*key, "account").agg(F.min(F.struct("at", "vendor_name", "currency", "invoice_date")).alias("first"), F.max("parts").alias("parts"))
    ranked = firsts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("first", "account"))).alias("accounts"), F.max("parts").alias("parts")).where("size(accounts) > 1")
    moved = ranked.select(*key, "parts", F.posexplode("accounts").alias("place", "one"), "accounts").where("place > 0")
    moved = moved.select(*key, "parts", F.col("one.account").alias("account"), F.col("one.first").alias("first"), F.array_join(F.transform(F.slice("accounts", F.lit(1), F.col("place")), lambda a: a["account"]), ", ").alias("earlier"))
    # Suppliers with several accounts go to each of their parts.
    everywhere = lambda few: few.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    own = paid.join(everywhere(moved.select(*key, "parts", "account")), [*PLACE, "account"]).groupBy(*key, "account").agg(F.array_sort(F.collect_list("at")).alias("rows"), F.sum("amount").alias("total"))
    # The row before an account's first: one of an earlier row of that day, else the last of an earlier day.
    # Rows shrink to each day's last before days are put in order; only the days of first rows keep their rows.
    begun = moved.select(*key, "account", F.col("first.at").alias("start"), F.col("first.at.undated").alias("undated"), F.col("first.at.day").alias("day"))
    dated = paid.join(everywhere(moved.select(*key, "parts").distinct()), PLACE, "left_semi").select(*key, "at", F.col("at.undated").alias("undated"), F.col("at.day").alias("day"))
    days = dated.groupBy(*key, "undated", "day").agg(F.max("at").alias("last"))
    earlier_days = Window.partitionBy(*key).orderBy("undated", "day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("eve", F.max("last").over(earlier_days)).drop("last")
    alike = lambda other: [F.col(f"b.{c}") == F.col(f"{other}.{c}") for c in key] + [F.col(f"b.{c}").eqNullSafe(F.col(f"{other}.{c}")) for c in ("undated", "day")]
    eves = begun.alias("b").join(days.alias("d"), alike("d"), "left").select(*(f"b.{c}" for c in (*key, "account", "start")), "b.undated", "b.day", "d.eve")
    within = eves.alias("b").join(dated.alias("p"), alike("p"), "left").where("p.at < b.start or b.eve is not null")
    earlier = F.when(F.col("p.at") < F.col("b.start"), F.col("p.at"))
    prior = within.groupBy(*(F.col(f"b.{c}").alias(c) for c in (*key, "account"))).agg(F.coalesce(F.max(earlier), F.max("b.eve")).alias("prior"))
    found = moved.join(own, [*key, "account"]).join(prior, [*key, "account"])
    n = F.size("rows")
    more = F.concat(F.lit(" "), n.cast("string"), F.lit(" invoices totalling "), money_text(F.col("total"), F.col("first.currency")), F.lit(" have gone to the new account since."))
    text = F.concat(
        F.lit("Payments to "), F.col("first.vendor_name"), F.lit(" moved to a new bank account ending "), F.col("account"), F.lit(" on "), F.coalesce(F.col("first.invoice_date").cast("string"), F.lit("")),
        F.lit(", after previously going to "), F.col("earlier"), F.lit("."), F.when(n > 1, more).otherwise(""), F.lit(" Confirm the change by phone using a number you already hold, not one from the invoice."),
    )
    return as_findings(found, "bank-detail-change", F.col("total"), F.concat(F.array("prior.id"), _ids("rows")), text)


def round_number_outliers(rows: DataFrame, options: Options = Options()) -> DataFrame:
    """Round figures of a supplier that hardly ever bills them."""
    key = ["ledger_id", "vendor_norm", "cur"]
    is_round = (F.col("amount") >= F.lit(options.round_number_threshold)) & (F.col("amount") % ROUND_STEP == 0)
    paid = _payables(rows)
    habits = paid.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(is_round).alias("rounds"))
    habits = habits.where((F.col("n") >= LEAST_HISTORY) & F.col("rounds").between(1, MOST_ROUNDS) & (F.col("rounds") / F.col("n") <= MOST_ROUND_SHARE))
    found = paid.where(is_round).join(habits, key)
    text = F.concat(
        F.col("vendor_name"), F.lit(" is usually billed in odd amounts, but invoice "), F.col("invoice_number"), F.lit(" is exactly "), money_text(F.col("amount"), F.col("currency")), F.lit(". Worth confirming what it covers."),
    )
    return as_findings(found, "round-number-outlier", F.col("amount"), F.array("id"), text)


ALL_RULES: list[Callable[[DataFrame, Options], DataFrame]] = [
    exact_duplicates,
    rekeyed_duplicates,
    vendor_spelling_duplicates,
    amount_transpositions,
    unapplied_credits,
    bank_detail_changes,
    round_number_outliers,
]
