"""Files read by splits against the same files read whole."""

import random
from pathlib import Path

import pytest

from tallyspark.operators import importing
from tallyspark.sources import csv_files, large_files

HEADER = "Supplier Name,Invoice No,Invoice Date,Net Amount,Currency,Reference,Bank Acc (last 4)"
PARTS = ["a", "b", ",", '"', '""', "\n", "\r\n", "\r", " ", "\t", "é", "\n\n", "x,y", '"q\nr"', ',"']


def texts():
    rng = random.Random(11)
    out = ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 150))) for _ in range(60)]
    out += ["﻿a,b\n1,2\n" * 9, "a,b\n" + '1,"' + "x\n" * 80, 'a,"b\n' + "c\n" * 40 + '"\n1,2', "x\n" * 20 + "a\0b\nc" + "d\n" * 30, "x\n" * 20 + "caf�,1\n", "", "\n \n", "only", 'h,"1\n2"\n' + 'k,"' + "l\n" * 50 + '",m\nn,o\n']
    return out


def key(rows):
    return sorted((r.line, r.idx if r.idx <= 0 else 1, tuple(r.cells), r.unterminated_quote, r.swallowed) for r in rows)


@pytest.mark.parametrize("chunk", [7, 10**6])
def test_splits_give_the_records_of_the_whole(spark, tmp_path, chunk):
    known = texts()
    for i, text in enumerate(known):
        Path(tmp_path / f"f{i:03d}.csv").write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = large_files.read_large_files(spark, str(tmp_path), chunk).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    found = {}
    for r in rows:
        found.setdefault(int(r.file_id.rsplit("/f", 1)[1][:3]), []).append(r)
    whole = csv_files.read_records(spark.createDataFrame([(str(i), t) for i, t in enumerate(known)], "file_id string, content string")).collect()
    want = {}
    for r in whole:
        want.setdefault(int(r.file_id), []).append(r)
    for i, text in ((i, t) for i, t in enumerate(known) if t):
        assert key(found.get(i, [])) == key(want.get(i, [])), text


def test_an_unclosed_quote_does_not_gather_the_file(spark, tmp_path, monkeypatch):
    text = HEADER + "\nAcme,1,2026-01-05,5,,,\n" + 'Acme,"2,2026-01-06,6,,,\n' + "Acme,3,2026-01-07,7,,,\n" * 400
    Path(tmp_path / "f.csv").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        records = large_files.read_large_files(spark, str(tmp_path))
        assert large_files.lines_of(spark, str(tmp_path)).rdd.getNumPartitions() > 5
        result = importing.import_records(records)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    last = records.where("unterminated_quote is not null").first()
    assert last.swallowed == 401 and len(last.cells[-1]) < 1500
    assert [r.id for r in result.invoices.collect()] == ["row-2"]
    assert "so the 401 lines after it" in result.errors.first().reason


def test_follow_both_states():
    assert large_files.follow('a,"b\nc",d\r\ne\n', False) == (False, 3, True, True, True)
    assert large_files.follow('b\nc",d\r\n', True) == (False, 2, False, True, False)
    assert large_files.follow("b\r\nc\n", True) == (True, 2, False, False, False)
    assert large_files.follow('x"\n,"y\n', True) == (True, 2, True, True, True)
