"""From exports to typed invoices, with an account of every line that could not be read."""

from __future__ import annotations

from collections.abc import Mapping
from copy import copy
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import coercion as c
from tallyspark.functions.sentences import sentence
from tallyspark.model import INVOICE
from tallyspark.operators.mapping import FIELDS, REQUIRED, suggest_mapping, unmapped_columns
from tallyspark.sources.csv_files import read_records
from tallyspark.sources.tables import written_once

SHOWN = 80
#: ``nth`` is the place of an error among those of one row.
ERROR = ["file_id", "row", "nth", "column", "value", "reason"]
PROBLEM = "struct<row:int,column:string,value:string,reason:string>"
DEFAULT_CURRENCY = "GBP"
#: Headers of fewer characters in all are sent to every task, so the rows of a few large files are not gathered by file.
SMALL_HEADERS = 2_000_000

# What an import says about what it could not read.
TOLD = {
    "utf-16": 'this file is not UTF-8: every letter is padded with a NUL byte, which is what UTF-16 looks like read as UTF-8 — Excel writes it when you save as "Unicode Text". Export it again as CSV UTF-8 and the column names will come back.',
    "lost byte": "this file is not UTF-8: line {line} has a byte the decoder could not read, so a character is missing and any supplier name around it is no longer the name your system holds. Export it again as CSV UTF-8.",
    "empty": "the file has no rows, so there is nothing to map or import",
    "unclosed": "a quoted value opened on line {line} and never closed, {what}. Close the quote or take it out, and import again.",
    "swallowed": "so the {n} lines after it were read as part of this row rather than as invoices",
    "swallowed rest": "so the rest of the file was read as part of this row",
    "missing": "{field} has no column: {why}. Confirm the mapping and import again.",
    "contradicted": 'this import was told the file is {said}, but "{value}" on line {line} cannot be{more}. The rest of the column would still be read {said}, so the ledger would carry both conventions and most of its dates would be out by months. Check which way round the export writes them and import again.',
    "nor": ", and nor can {n} other date{s} in this column",
    "shape": "this row has {n} values but the header has {of}, so the columns no longer line up",
    "ambiguous": "{n} date{s} in this file could be read two ways. Choose which before importing.",
    "ledger": "{file} — {n} rows{more}",
    "skipped": ", {n} skipped",
    "no rows": "No rows could be read from that file.",
    "no supplier": "the supplier name is blank",
    "no number": "the invoice number is blank",
    "no currency column": "; with no currency column, rows fall back to any symbol in the amount and then to GBP — pass defaultCurrency to change that",
}


def told(name: str, **values: Column | str) -> Column:
    """A sentence of ``TOLD`` with its places filled in."""
    return sentence(TOLD[name], **values)


@dataclass(frozen=True)
class ImportOptions:
    """How to read dates that read both ways, columns that the user chose, and the currency of last resort."""

    date_order: str | None = None
    mapping: Mapping[str, str | int | None] = field(default_factory=dict)
    default_currency: str | None = None


def cut(text: Column, most: int = SHOWN) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit("…"))).otherwise(text)


def _error(rows: DataFrame, row: Column, column: Column, value: Column, reason: Column, nth: Column | None = None) -> DataFrame:
    return rows.select("file_id", row.cast("int").alias("row"), (F.lit(0) if nth is None else nth).cast("int").alias("nth"), column.alias("column"), value.alias("value"), reason.alias("reason"))


def _problem(row: Column, column: Column, value: Column, reason: Column) -> Column:
    return F.struct(row.cast("int").alias("row"), column.alias("column"), value.alias("value"), reason.alias("reason"))


def refused_files(records: DataFrame) -> DataFrame:
    """An error for each file that could not be read: wrongly encoded, or empty."""
    kind, line = F.get("cells", F.lit(0)), F.col("line")
    reason = F.when(kind == "utf-16", told("utf-16")).when(kind == "lost byte", told("lost byte", line=line)).otherwise(told("empty"))
    return _error(records.where("idx = -1"), line, F.lit("(file)"), cut(F.get("cells", F.lit(1))), reason)


def unclosed_quote() -> Column:
    """What is wrong with a record whose quote never closes, with the number of lines that it swallowed."""
    swallowed = F.col("swallowed")
    what = F.when(swallowed > 0, told("swallowed", n=swallowed)).otherwise(told("swallowed rest"))
    return _problem(F.col("unterminated_quote"), F.lit("(row)"), cut(F.array_join("cells", ",")), told("unclosed", line=F.col("unterminated_quote"), what=what))


def missing_fields(headers: DataFrame, mapping: DataFrame) -> DataFrame:
    """One error for each required field without a column."""
    lacking = mapping.where(F.col("column").isNull() & F.col("field").isin(REQUIRED)).select("file_id", "field", F.col("reason").alias("why"))
    nth = F.array_position(F.array(*map(F.lit, FIELDS)), F.col("field"))
    return _error(lacking.join(headers, "file_id"), F.col("line"), F.col("field"), cut(F.array_join("cells", ",")), told("missing", field=F.col("field"), why=F.col("why")), nth)


def _cell(name: str) -> Column:
    """The stripped cell of a mapped field; an unmapped one is empty."""
    return c.strip(F.coalesce(F.get("cells", F.col(f"at.{name}")), F.lit("")))


def file_facts(body: DataFrame, order: str | None) -> DataFrame:
    """(file_id, comma, against, others) of each file: whether its amounts have decimal commas, and the
    first date, and how many others, that cannot be read in the order that was given."""
    readable = body.where("unterminated_quote is null").select("file_id", "line", _cell("invoiceDate").alias("date"), c.comma_votes(_cell("amount")).alias("vote"))
    wrong = (c.forced_order(F.col("date")) != order) if order else F.lit(False)
    first = F.min(F.when(wrong, F.struct("line", F.col("date").alias("value"))))
    return readable.groupBy("file_id").agg(c.decimal_comma(F.col("vote")).alias("comma"), first.alias("against"), (F.count_if(wrong) - 1).alias("others"))


def contradicted_order(files: DataFrame, order: str) -> DataFrame:
    """An error for each file of ``files(file_id, header, at, against, others)`` whose dates contradict the order."""
    said, n = "day-first" if order == "dmy" else "month-first", F.col("others")
    more = F.when(n > 0, told("nor", n=n, s=F.when(n == 1, "").otherwise("s"))).otherwise("")
    named = F.get("header", F.col("at.invoiceDate"))
    reason = told("contradicted", said=said, value=F.col("against.value"), line=F.col("against.line"), more=more)
    return _error(files.where("against is not null"), F.col("against.line"), F.when(named != "", named).otherwise("invoiceDate"), F.col("against.value"), reason)


def coerced(body: DataFrame, options: ImportOptions) -> DataFrame:
    """Records with their cells read; ``problems`` lists all that is wrong with a record.

    ``body`` has the columns of records, their file's ``header``, the places ``at`` of the fields, and
    ``comma``.  A record whose quote never closes, or with a wrong number of cells, has that one problem.
    """
    # One empty cell too many at the end is a trailing comma.
    spare = (F.size("cells") == F.size("header") + 1) & (F.element_at("cells", -1) == "")
    trimmed = F.when(spare, F.slice("cells", F.lit(1), F.size("header"))).otherwise(F.col("cells"))
    rows = body.withColumn("whole", F.col("cells")).withColumn("cells", trimmed)
    rows = rows.select("file_id", "line", "unterminated_quote", "swallowed", "header", "at", "comma", "cells", "whole", *(_cell(f).alias(f) for f in FIELDS))
    rows = c.read_column(rows, F.col("invoiceDate"), c.date_steps(F.lit(options.date_order).cast("string")), "date")
    rows = c.read_column(rows, F.col("amount"), c.amount_steps(F.col("comma")), "money")
    rows = rows.withColumn("code", c.coerce_currency(F.col("currency")))

    def problem(name: str, value: Column, reason: Column) -> Column:
        named = F.get("header", F.col(f"at.{name}"))
        row = _problem(F.col("line"), F.coalesce(F.when(named != "", named), F.lit(name)), value, F.concat(F.lit(f"{name}: "), reason))
        return F.when(reason.isNotNull(), row)

    blank = lambda name, sentence: F.when(F.col(name) == "", told(sentence))
    found = F.array_compact(
        F.array(
            problem("vendorName", F.lit(""), blank("vendorName", "no supplier")),
            problem("invoiceNumber", F.lit(""), blank("invoiceNumber", "no number")),
            problem("invoiceDate", F.col("invoiceDate"), F.col("date.reason")),
            problem("amount", F.col("amount"), F.col("money.reason")),
            problem("currency", F.col("currency"), F.col("code.reason")),
        )
    )
    n, of = F.size("cells"), F.size("header")
    shape = _problem(F.col("line"), F.lit("(row)"), cut(F.array_join("whole", ",")), told("shape", n=n, of=of))
    problems = F.when(F.col("unterminated_quote").isNotNull(), F.array(unclosed_quote())).when(n != of, F.array(shape)).otherwise(found)
    ambiguous = F.col("unterminated_quote").isNull() & (n == of) & F.lit(options.date_order is None) & c.is_ambiguous_date(F.col("invoiceDate"))
    return rows.withColumn("problems", problems.cast(f"array<{PROBLEM}>")).withColumn("ambiguous", ambiguous)


def _places(mapping: DataFrame) -> DataFrame:
    """(file_id, at): the places of each file's fields, for files that have all the required ones."""
    at = mapping.groupBy("file_id").agg(F.struct(*(F.max(F.when(F.col("field") == f, F.col("column"))).alias(f) for f in FIELDS)).alias("at"))
    return at.where(reduce(lambda a, b: a & b, (F.col(f"at.{f}").isNotNull() for f in REQUIRED)))


class ImportResult:
    """What an import of ``records`` gives; each part is worked out when it is first asked for.

    ``invoices`` (``ledger_id`` is the file), ``mapping`` of columns, ``unmapped`` columns, ``errors``, the
    ``records`` themselves, and ``ambiguous``: (file_id, ambiguous) of files with dates that read both ways and no
    order given.  Mapping reads header rows only, unless a date order is given, which the dates may contradict.
    Coerced records are written once: invoices and errors read the same rows.
    """

    def __init__(self, records: DataFrame, options: ImportOptions = ImportOptions()) -> None:
        self.records, self.options = records, options

    @cached_property
    def _headers(self) -> DataFrame:
        whole = self.records.where("idx = 0 and unterminated_quote is null")
        return written_once(whole.select("file_id", "line", "cells"))

    def _known_files(self, files: DataFrame) -> DataFrame:
        """``files``, one row for each, as a side to join records with."""
        size = self._headers.agg(F.sum(F.length(F.array_join("cells", ",")) + F.length("file_id"))).first()[0] or 0
        return F.broadcast(files) if size < SMALL_HEADERS else files

    @cached_property
    def _broken(self) -> DataFrame:
        """Files whose header has a quote that never closes."""
        broken = self.records.where("idx = 0 and unterminated_quote is not null")
        return broken.select("file_id", F.lit(0).alias("nth"), unclosed_quote().alias("p")).select("file_id", "nth", "p.*")

    @cached_property
    def _suggested(self) -> DataFrame:
        return written_once(suggest_mapping(self._headers, self.options.mapping))

    @cached_property
    def _facts(self) -> DataFrame:
        """The files that have all columns, with what their records say about all of them."""
        files = self._headers.select("file_id", F.col("cells").alias("header")).join(_places(self._suggested), "file_id")
        body = self.records.where("idx > 0").join(self._known_files(files), "file_id")
        return written_once(files.join(file_facts(body, self.options.date_order), "file_id", "left"))

    @cached_property
    def _stopped(self) -> list[DataFrame]:
        """Errors that stop a whole file."""
        against = [contradicted_order(self._facts, self.options.date_order)] if self.options.date_order else []
        return [refused_files(self.records), self._broken, missing_fields(self._headers, self._suggested), *against]

    @cached_property
    def _read(self) -> DataFrame:
        whole = self._facts.where("against is null").drop("against", "others")
        rows = coerced(self.records.where("idx > 0").join(self._known_files(whole), "file_id"), self.options)
        # What invoices and errors read; the cells and their file's header stay behind.
        money, code = F.struct("money.value", "money.currency").alias("money"), F.struct("code.value").alias("code")
        date = F.struct("date.value").alias("date")
        return written_once(rows.select("file_id", "line", "vendorName", "invoiceNumber", date, money, code, "reference", "bankLast4", "problems", "ambiguous"))

    @cached_property
    def errors(self) -> DataFrame:
        rows = self._read.select("file_id", F.posexplode("problems").alias("nth", "p")).select("file_id", "nth", "p.*")
        return reduce(DataFrame.unionByName, [*self._stopped, rows]).select(*ERROR)

    @cached_property
    def invoices(self) -> DataFrame:
        fallback = F.lit(self.options.default_currency or DEFAULT_CURRENCY)
        rows = self._read.where(F.size("problems") == 0).select(
            F.col("file_id").alias("ledger_id"),
            F.col("line").cast("long").alias("seq"),
            F.concat(F.lit("row-"), F.col("line").cast("string")).alias("id"),
            F.col("vendorName").alias("vendor_name"),
            F.col("invoiceNumber").alias("invoice_number"),
            F.col("date.value").alias("invoice_date"),
            F.col("money.value").alias("amount"),
            F.coalesce("code.value", "money.currency", fallback).alias("currency"),
            F.when(F.col("reference") != "", F.col("reference")).alias("reference"),
            c.bank_digits(F.col("bankLast4")).alias("bank_last4"),
        )
        return rows.select([f.name for f in INVOICE.fields])

    @cached_property
    def ambiguous(self) -> DataFrame:
        return self._read.where("ambiguous").groupBy("file_id").agg(F.count("*").alias("ambiguous"))

    @cached_property
    def unmapped(self) -> DataFrame:
        return unmapped_columns(self._headers, self._suggested)

    @cached_property
    def mapping(self) -> DataFrame:
        mapping = self._suggested
        if not self.options.default_currency:
            noted = F.when((F.col("field") == "currency") & F.col("column").isNull(), F.concat("reason", told("no currency column"))).otherwise(F.col("reason"))
            # Files that stop before their rows keep the plain reason.
            stopped = reduce(DataFrame.unionByName, self._stopped).select("file_id", F.lit(True).alias("stopped")).distinct()
            mapping = mapping.join(stopped, "file_id", "left").withColumn("reason", F.when(F.col("stopped"), F.col("reason")).otherwise(noted)).drop("stopped")
        # Files of which no header was read have no column for any field.
        nothing = [F.struct(F.lit(f).alias("field"), F.lit(f"no column in this header row resembles {f}").alias("reason")) for f in FIELDS]
        bare = self._broken.select("file_id").unionByName(refused_files(self.records).select("file_id")).select("file_id", F.explode(F.array(*nothing)).alias("m"))
        bare = bare.select("file_id", "m.field", F.lit(None).cast("int").alias("column"), F.lit(None).cast("string").alias("header"), F.lit(0.0).alias("confidence"), "m.reason")
        return mapping.unionByName(bare)

    def with_invoices(self, invoices: DataFrame) -> ImportResult:
        """The same result with other invoices."""
        other = copy(self)
        other.__dict__["invoices"] = invoices
        return other


def import_records(records: DataFrame, options: ImportOptions = ImportOptions()) -> ImportResult:
    """Invoices and errors of the ``records`` of ``read_records`` or ``read_large_files``."""
    return ImportResult(records, options)


def import_files(files: DataFrame, options: ImportOptions = ImportOptions()) -> ImportResult:
    """Import ``files(file_id, content)``; each file becomes a ledger.  The files are read once."""
    return import_records(written_once(read_records(files)), options)


def map_files(files: DataFrame, options: ImportOptions = ImportOptions()) -> DataFrame:
    """The mapping of ``files(file_id, content)``, of which only header rows are split into cells."""
    return import_records(written_once(read_records(files, first=0)), options).mapping


def gate_ambiguous(result: ImportResult) -> tuple[ImportResult, DataFrame]:
    """The result without invoices of files with ambiguous dates, and these files with their number and what to ask."""
    kept = result.invoices.join(result.ambiguous.select(F.col("file_id").alias("ledger_id")), "ledger_id", "left_anti")
    n = F.col("ambiguous")
    asked = told("ambiguous", n=F.format_number(n, 0), s=F.when(n == 1, "").otherwise("s"))
    return result.with_invoices(kept), result.ambiguous.withColumn("question", asked)


def import_summary(result: ImportResult) -> DataFrame:
    """Rows read, rows skipped (each once) and the ledger's name for each file; a file without rows has its first error instead of a name."""
    read = result.invoices.groupBy(F.col("ledger_id").alias("file_id")).agg(F.count("*").alias("rows_read"))
    skipped = result.errors.groupBy("file_id").agg(F.count_distinct("row").alias("rows_skipped"), F.min_by("reason", F.struct("row", "nth")).alias("first"))
    every = result.mapping.select("file_id").distinct().join(read, "file_id", "left").join(skipped, "file_id", "left").fillna(0, ["rows_read", "rows_skipped"])
    more = F.when(F.col("rows_skipped") > 0, told("skipped", n=F.col("rows_skipped"))).otherwise("")
    name = told("ledger", file=F.col("file_id"), n=F.format_number("rows_read", 0), more=more)
    first = F.coalesce("first", F.lit(TOLD["no rows"]))
    return every.select("file_id", "rows_read", "rows_skipped", F.when(F.col("rows_read") > 0, name).alias("ledger_name"), F.when(F.col("rows_read") == 0, first).alias("first_error"))


def unaccounted(result: ImportResult) -> DataFrame:
    """(file_id, line) of records of imported files that are neither an invoice nor an error: none."""
    stopped = result.errors.where("column = '(file)'").select("file_id").distinct()
    lines = result.records.where("idx > 0").select("file_id", F.coalesce("unterminated_quote", "line").alias("line"))
    refused = result.mapping.where(F.col("column").isNull() & F.col("field").isin(REQUIRED)).select("file_id").distinct()
    lines = lines.join(stopped, "file_id", "left_anti").join(refused, "file_id", "left_anti")
    known = result.invoices.select(F.col("ledger_id").alias("file_id"), F.col("seq").cast("int").alias("line")).unionByName(result.errors.select("file_id", F.col("row").alias("line")))
    return lines.join(known, ["file_id", "line"], "left_anti")


def first_records(files: DataFrame, records: int = 5) -> DataFrame:
    """The first records of each file of ``files(file_id, content)``; what is behind them is not split into cells."""
    return read_records(files, first=records).where("idx > 0")


def first_errors(result: ImportResult, errors: int = 12) -> DataFrame:
    """The first errors of each file, in the order of the file, with their place."""
    place = F.row_number().over(Window.partitionBy("file_id").orderBy("row", "nth"))
    return result.errors.withColumn("place", place).where(F.col("place") <= errors)
