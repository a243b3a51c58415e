"""Reading exports as records of cells, and writing ledgers as CSV."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.money import number_text

#: Files of one Arrow batch; a file may have 25 MB.
FILES_AT_ONCE = 2

# White space that is stripped from unquoted cells, without line ends.
_BLANK = " \t\x0b\x0c\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_CELL = re.compile(rf'[{_BLANK}]*"(?P<quoted>(?:[^"]+|"")*)(?P<closed>"?)(?P<tail>[^,\r\n]*)|(?P<plain>[^,\r\n]*)')
_ENDS = re.compile(rf"^[{_BLANK}]+|[{_BLANK}]+$")
# The same characters one by one, a line without quotes, and a line whose quoted cells hold no quote or line end.
_BLANKS = _BLANK.replace("\u2000-\u200a", "".join(map(chr, range(0x2000, 0x200B))))
_UNQUOTED = re.compile(r'[^"\r\n]*+(?=[\r\n]|\Z)')
_WHOLE = re.compile(r'(?:"[^"\r\n]*+"|[^",\r\n]*+)(?:,(?:"[^"\r\n]*+"|[^",\r\n]*+))*+(?=[\r\n]|\Z)')
_PARTS = re.compile(r'(?:^|,)(?:("[^"]*")|([^",]*))')
#: ``idx`` is 0 for a file's header, -1 for a file that cannot be read, and otherwise above 0 and rising with the line;
#: ``swallowed`` counts the line feeds behind a quote that never closes.
RECORD = "file_id string, idx int, line int, cells array<string>, unterminated_quote int, swallowed long"
_NAMES = [field.split()[0] for field in RECORD.split(", ")]
_KINDS = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.int64()]


class Record(NamedTuple):
    """Where a record begins and ends in its text, its lines, cells and the line of a quote that never closes."""

    begin: int
    end: int
    line: int
    next_line: int
    cells: list[str]
    open_line: int | None
    blank: bool


def records_from(text: str, at: int = 0, line: int = 1) -> Iterator[Record]:
    """The records of ``text`` from a record's start on, blank ones included.

    A quote opens a cell only at its start.  Quoted cells keep every character, text after the closing
    quote included; unquoted cells are stripped.  Only line feeds count as lines inside quotes.
    """
    n = len(text)
    while at < n:
        begin, cells, start, quotes, open_line = at, [], line, False, None
        # Most records are one line, whose cells need no search for the end of a quote.
        if plain := _UNQUOTED.match(text, at):
            cells, at = [cell.strip(_BLANKS) for cell in plain[0].split(",")], plain.end()
        elif whole := _WHOLE.match(text, at):
            cells, at, quotes = [cell[1:-1] if cell else bare.strip(_BLANKS) for cell, bare in _PARTS.findall(whole[0])], whole.end(), True
        while not cells or text[at : at + 1] == ",":
            at += bool(cells)
            cell = _CELL.match(text, at)
            at = cell.end()
            if cell["plain"] is None:
                quotes = True
                if not cell["closed"]:
                    open_line = line
                line += cell["quoted"].count("\n")
                cells.append(cell["quoted"].replace('""', '"') + cell["tail"].rstrip(" \t"))
            else:
                cells.append(_ENDS.sub("", cell["plain"]))
        if at < n:
            at += 2 if text.startswith("\r\n", at) else 1
            line += 1
        yield Record(begin, at, start, line, cells, open_line, not quotes and cells == [""])


def split_records(text: str) -> Iterator[tuple[int, list[str], int | None]]:
    """(start line, cells, line of an unclosed quote) of each record of a file that is not blank."""
    return ((r.line, r.cells, r.open_line) for r in records_from(text, int(text[:1] == "\ufeff")) if not r.blank)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, content) of the files below ``path``; a byte that is not UTF-8 becomes U+FFFD."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("file_id"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def file_fault(text: str) -> tuple[int, str, str] | None:
    """(line, kind, text from that line's start) of the first NUL or lost byte, or of a file without records."""
    bad = re.search("[\0\ufffd]", text) if "\0" in text or "\ufffd" in text else None
    if bad is None:
        return None if next(split_records(text), None) else (0, "empty", "")
    before = text[: bad.start()]
    begun = max(before.rfind("\n"), before.rfind("\r")) + 1
    return len(re.split("\r\n|\r|\n", before)), "utf-16" if "\0" in text else "lost byte", re.sub("[\0\ufffd]", "?", text[begun : begun + 200])


def read_records(files: DataFrame, first: int | None = None) -> DataFrame:
    """The records of each file of ``files(file_id, content)``; only the header and ``first`` more, if that is given.

    A file that cannot be read has one row instead, numbered -1, whose cells are the kind of its fault
    and the text where it lies.
    """

    def rows_of(file_id: str, text: str) -> Iterator[tuple]:
        if fault := file_fault(text):
            yield (file_id, -1, fault[0], list(fault[1:]), None, None)
            return
        known = split_records(text)
        for i, (line, cells, quote) in enumerate(known if first is None else islice(known, first + 1)):
            yield (file_id, i, line, cells, quote, None if quote is None else cells[-1].count("\n"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, content in zip(*batch.columns, strict=True):
                rows = rows_of(file_id.as_py(), content.as_py() or "")
                while part := list(islice(rows, 20_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*part, strict=True), _KINDS, strict=True)], names=_NAMES)

    return files.select("file_id", "content").mapInArrow(split, RECORD)


def record_frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["file_id", "idx", "line", "cells", "unterminated_quote", "swallowed"])
    return frame.astype({"unterminated_quote": "Int32", "swallowed": "Int64"})


def read_clean_file(spark: SparkSession, path: str, id_column: str) -> DataFrame:
    """The built-in reader for one huge, well-formed file: no lines are known, so the file names its rows.

    Unlike ``read_records`` it keeps the opening quote of a cell with text after its closing quote and
    does not report an unclosed one.
    """
    rows = spark.read.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return rows.withColumn("id", F.col(id_column))


# The columns of a written ledger.
EXPORT_HEADER = ["Supplier Name", "Invoice No", "Invoice Date", "Net Amount", "Currency", "Reference", "Bank Acc (last 4)"]


def export_columns(invoices: DataFrame) -> list[Column]:
    """A ledger's columns as text, amounts with two decimals."""
    amount = F.regexp_replace(number_text(F.col("amount")), ",", "")
    source = [F.col("vendor_name"), F.col("invoice_number"), F.col("invoice_date").cast("string"), amount, F.col("currency"), F.col("reference"), F.col("bank_last4")]
    return [F.coalesce(c, F.lit("")).alias(name) for c, name in zip(source, EXPORT_HEADER, strict=True)]


def csv_line(cells: list[Column]) -> Column:
    """One line of CSV: cells with commas, quotes or line ends are quoted, quotes doubled."""
    special = lambda c: c.contains(",") | c.contains('"') | c.contains("\n") | c.contains("\r")
    return F.concat_ws(",", *(F.when(special(c), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in cells))


def write_csv(invoices: DataFrame, path: str) -> None:
    """Write a ledger as CSV files with a header, in parallel."""
    invoices.select(*export_columns(invoices)).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
