"""Stored ledgers: replacement, erasure, sweeps and audit, whole and broken off half way."""

import hashlib
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyspark.sources import stored
from tallyspark.sources.tables import projected_invoices

SF = "/root/testdata/sf0.001"


def ledgers(spark, number, rows=40):
    some = projected_invoices(spark, SF).limit(rows)
    return some.crossJoin(spark.range(number).select(F.format_string("ledger-%05d", "id").alias("name"))).withColumn("ledger_id", F.col("name")).drop("name")


def files_of(path):
    return {str(p): hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(path).rglob("*.parquet") if "/data/" in str(p)}


def named_in_files(spark, path):
    """The ledgers whose rows lie in any data file, committed or not."""
    found = list(files_of(path))
    return {r.ledger_id for r in spark.read.parquet(*found).select("ledger_id").distinct().collect()} if found else set()


def counts(rows):
    return {r.ledger_id: r["count"] for r in rows.groupBy("ledger_id").count().collect()}


def test_ledgers_are_replaced_and_read_one_by_one(spark, tmp_path):
    path = str(tmp_path / "l")
    rows = ledgers(spark, 3)
    stored.write_ledgers(rows, path, 4)
    stored.write_ledgers(rows.where("ledger_id = 'ledger-00001'").limit(5), path, 4)
    assert counts(stored.read_ledgers(spark, path, buckets=4)) == {"ledger-00000": 40, "ledger-00001": 5, "ledger-00002": 40}
    one = stored.read_ledgers(spark, path, "ledger-00001", 4)
    assert one.count() == 5 and one.schema == stored.read_ledgers(spark, path, buckets=4).schema
    assert stored.read_ledgers(spark, path, "nobody", 4).count() == 0


def test_many_ledgers_make_few_files(spark, tmp_path):
    path = str(tmp_path / "l")
    stored.write_ledgers(ledgers(spark, 3000, 2), path, 8)
    # A file for each bucket and range at most, far fewer than ledgers.
    assert len(files_of(path)) <= 8 + int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = stored.read_ledgers(spark, path, "ledger-02000", 8)
    assert one.count() == 2 and len(one.inputFiles()) <= 2


@pytest.mark.parametrize("broken", [None, "_write", "_commit", "vacuum"])
def test_erased_ledgers_leave_all_files(spark, tmp_path, monkeypatch, broken):
    path = str(tmp_path / "l")
    rows = ledgers(spark, 12)
    stored.write_ledgers(rows, path, 4)
    store, before = stored.ledger_store(spark, path, 4), files_of(path)
    gone = spark.createDataFrame([("ledger-00003",), ("unknown",)], "ledger_id string")
    if broken:
        real = getattr(stored.StoredTable, broken)

        def fail(self, *args, **kwargs):
            if broken == "_commit":
                raise RuntimeError("lost")
            if broken == "_write":
                real(self, *args, **kwargs)
            raise RuntimeError("lost")

        with monkeypatch.context() as patch:
            patch.setattr(stored.StoredTable, broken, fail)
            with pytest.raises(RuntimeError):
                stored.erase_everywhere([store], gone)
        expected = 12 if broken in ("_write", "_commit") else 11
        assert len(counts(store.read())) == expected
    for _ in range(2):
        stored.erase_everywhere([store], gone)
        assert counts(store.read()) == {f"ledger-{k:05d}": 40 for k in range(12) if k != 3}
        assert named_in_files(spark, path) == {f"ledger-{k:05d}" for k in range(12) if k != 3}
    # Buckets of other ledgers keep their files as they were.
    own = f"bucket={store.buckets_of(gone.limit(1))[0]}/"
    assert {f: h for f, h in before.items() if own not in f}.items() <= files_of(path).items()


def test_all_of_a_bucket_can_go(spark, tmp_path):
    path = str(tmp_path / "l")
    stored.write_ledgers(ledgers(spark, 2), path, 1)
    store = stored.ledger_store(spark, path, 1)
    store.erase(spark.createDataFrame([("ledger-00000",), ("ledger-00001",)], "ledger_id string"))
    assert store.read().count() == 0 and store.current() == {} and not files_of(path)
    store.put(ledgers(spark, 1))
    assert counts(store.read()) == {"ledger-00000": 40}


def test_sweep_drops_old_files(spark, tmp_path):
    noon = datetime(2026, 1, 2, 12, 30)
    rows = [(f"f{k}", noon - timedelta(minutes=37 * k), "a,b\n") for k in range(30)]
    frame = spark.createDataFrame(rows, "ledger_id string, created_at timestamp, content string")
    table = stored.StoredTable(spark, str(tmp_path / "raw"), frame.schema, stored.hour_bucket(), ("created_at",))
    table.put(frame)
    for _ in range(2):
        stored.sweep(table, F.lit(noon - timedelta(hours=6)))
        assert {r.ledger_id for r in table.read().collect()} == {f"f{k}" for k in range(30) if 37 * k <= 360}
    assert named_in_files(spark, str(tmp_path / "raw")) == {f"f{k}" for k in range(30) if 37 * k <= 360}


def test_audit_batches_are_added_once(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "audit"), "ledger_id string, action string"
    lines = spark.createDataFrame([("a", "x"), ("a", "y")], schema)
    assert stored.read_audit(spark, path, schema).count() == 0
    # Broken off between the lines and their commit.
    lines.write.parquet(f"{path}/lines/one")
    assert stored.read_audit(spark, path, schema).count() == 0
    for _ in range(3):
        stored.append_audit(spark, lines, path, "one")
    stored.append_audit(spark, lines.limit(1), path, "two")
    assert stored.read_audit(spark, path, schema).count() == 3
