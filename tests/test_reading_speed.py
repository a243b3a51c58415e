"""What makes an import fast and must not change its results: one-line records, stripped cells, compiled code."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import coercion
from tallyspark.operators import importing
from tallyspark.sources import csv_files

ALPHABET = 'a1,,,""\n\n\r\r\n \t ﻿x"\x85 .'


def test_one_line_records_equal_the_search_for_quotes(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 25))) for _ in range(20_000)]
    quick = [list(csv_files.records_from(t)) for t in texts]
    never = re.compile(r"(?!)")
    monkeypatch.setattr(csv_files, "_UNQUOTED", never)
    monkeypatch.setattr(csv_files, "_WHOLE", never)
    assert quick == [list(csv_files.records_from(t)) for t in texts]


def test_strip_equals_the_pattern(spark):
    rng = random.Random(4)
    texts = [("".join(rng.choice(ALPHABET + coercion.SPACES) for _ in range(rng.randint(0, 9))),) for _ in range(500)] + [(None,)]
    by_pattern = F.regexp_replace("t", f"^[{coercion.SPACE}]+|[{coercion.SPACE}]+\\z", "")
    rows = spark.createDataFrame(texts, "t string").select(coercion.strip(F.col("t")).alias("a"), by_pattern.alias("b"))
    assert rows.where("not a <=> b").count() == 0


@pytest.mark.parametrize("order", [None, "dmy"])
def test_the_jvm_compiles_what_reads_cells(spark, order):
    """The JVM never compiles a method of 8,000 bytes or more; such code runs several times slower."""
    body = spark.createDataFrame([], "file_id string, line int, unterminated_quote int, swallowed long, cells array<string>, header array<string>, comma boolean, " + "at struct<" + ",".join(f"{f}:int" for f in importing.FIELDS) + ">")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = importing.coerced(body, importing.ImportOptions(date_order=order))
        told = rows._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", told)]
    assert sizes and max(sizes) < 8000


def test_rows_of_a_few_large_files_are_not_gathered_by_file(spark):
    """All rows of a file went to one task; with few headers they are read where they lie, with many they are joined as before."""
    head = ",".join(["Supplier Name", "Invoice No", "Invoice Date", "Net Amount"])
    text = head + "\n" + "A,1,2026-01-02,3.00\n" * 50
    files = spark.createDataFrame([("f", text)], "file_id string, content string")
    result = importing.import_files(files)
    plan = result.records.where("idx > 0").join(result._known_files(result._facts), "file_id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(file_id" not in plan
    assert result.invoices.count() == 50
