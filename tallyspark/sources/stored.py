"""Stored tables that are rewritten by buckets, with a commit that readers follow.

A table is a folder of versions.  A version holds Parquet files of some buckets, and a row in the table of
commits says which version of a bucket counts.  Whatever changes a table writes a new version of the buckets
it touches, then commits them all at once by one file, then deletes what no bucket refers to any more.  A run
that breaks off before its commit has changed nothing; one that breaks off behind it has only files left to
delete, which the next run or ``vacuum`` does.  One writer at a time is assumed; readers need no lock.

Ledgers share a fixed number of buckets by the hash of their id and lie sorted by it, so many small ledgers
make few files, and one ledger is read from the few files whose range holds it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.model import INVOICE
from tallyspark.sources.tables import written_once

#: Buckets of a store of ledgers; a store keeps the number it was made with.
BUCKETS = 64
_COMMIT = "bucket long, version string, number long"


def ledger_bucket(buckets: int = BUCKETS, column: str = "ledger_id") -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets))


def hour_bucket(column: str = "created_at") -> Column:
    """The hour of a time, by which raw files are stored and swept."""
    return F.floor(F.unix_seconds(column) / 3600)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _children(spark: SparkSession, path: str) -> list[str]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in system.listStatus(folder)] if system.exists(folder) else []


@dataclass(frozen=True)
class StoredTable:
    """A table below ``path`` with rows of ``schema``; ``bucket`` gives a row's bucket, ``order`` how rows lie in it."""

    spark: SparkSession
    path: str
    schema: T.StructType
    bucket: Column
    order: tuple[str, ...]

    def _commits(self) -> DataFrame:
        known = _children(self.spark, f"{self.path}/commits")
        return self.spark.read.schema(_COMMIT).parquet(f"{self.path}/commits") if known else self.spark.createDataFrame([], _COMMIT)

    def _last_number(self) -> int:
        return self._commits().agg(F.max("number").alias("n")).first().n or 0

    def current(self) -> dict[int, str]:
        """The version of each bucket that holds rows."""
        last = self._commits().groupBy("bucket").agg(F.max_by("version", "number").alias("version"))
        return {r.bucket: r.version for r in last.where("version <> ''").collect()}

    def read(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        known = self.current()
        paths = [f"{self.path}/data/{version}/bucket={b}" for b, version in sorted(known.items()) if buckets is None or b in set(buckets)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def buckets_of(self, keys: DataFrame) -> list[int]:
        """The buckets of ``keys``, which has the columns that the bucket is worked out from."""
        return [r.b for r in keys.select(self.bucket.alias("b")).distinct().collect()]

    def rewrite(self, buckets: Iterable[int], change: Callable[[DataFrame], DataFrame]) -> None:
        """Put ``change`` of the rows of some buckets in their place."""
        touched = sorted(set(buckets))
        if touched:
            self._commit(self._write(change(self.read(touched))), touched)
        self.vacuum()

    def put(self, rows: DataFrame, key: str = "ledger_id") -> None:
        """Add rows; what is stored under a key among them is replaced."""
        rows = written_once(rows.select(self.schema.names))
        keys = rows.select(key).distinct()
        self.rewrite(self.buckets_of(rows), lambda old: old.join(keys, key, "left_anti").select(self.schema.names).unionByName(rows))

    def erase(self, keys: DataFrame) -> None:
        """Drop all rows with the ids in ``keys``, a table of one column, from the store's files."""
        (key,) = keys.columns
        gone = written_once(keys.distinct())
        # Only buckets that hold a row of theirs are written anew.
        found = self.read(self.buckets_of(gone)).join(gone, key, "left_semi")
        self.rewrite(self.buckets_of(found), lambda old: old.join(gone, key, "left_anti"))

    def _write(self, rows: DataFrame) -> str:
        version = uuid.uuid4().hex
        # By ranges, so that a ledger with a third of all rows is shared out; the files stay sorted.
        placed = rows.select(*self.schema.names, self.bucket.alias("bucket"))
        ranged = placed.repartitionByRange("bucket", *self.order).sortWithinPartitions("bucket", *self.order)
        ranged.write.partitionBy("bucket").parquet(f"{self.path}/data/{version}")
        return version

    def _commit(self, version: str, touched: list[int]) -> None:
        written = {int(name.removeprefix("bucket=")) for name in _children(self.spark, f"{self.path}/data/{version}") if name.startswith("bucket=")}
        number = self._last_number() + 1
        rows = [(b, version if b in written else "", number) for b in touched]
        self.spark.createDataFrame(rows, _COMMIT).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def vacuum(self) -> None:
        """Delete the files that no bucket refers to."""
        known = self.current()
        for version in _children(self.spark, f"{self.path}/data"):
            own = {f"bucket={b}" for b, v in known.items() if v == version}
            if not own:
                _delete(self.spark, f"{self.path}/data/{version}")
                continue
            for name in _children(self.spark, f"{self.path}/data/{version}"):
                if name.startswith("bucket=") and name not in own:
                    _delete(self.spark, f"{self.path}/data/{version}/{name}")


def ledger_store(spark: SparkSession, path: str, buckets: int = BUCKETS) -> StoredTable:
    """The table of typed invoices below ``path``."""
    return StoredTable(spark, path, INVOICE, ledger_bucket(buckets), ("ledger_id", "seq", "id"))


def read_ledgers(spark: SparkSession, path: str, ledger_id: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Invoices that ``write_ledgers`` has written, of one ledger or of all."""
    store = ledger_store(spark, path, buckets)
    if ledger_id is None:
        return store.read()
    own = store.buckets_of(spark.createDataFrame([(ledger_id,)], "ledger_id string"))
    return store.read(own).where(F.col("ledger_id") == ledger_id)


def write_ledgers(invoices: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store ledgers; a stored ledger of the same id is replaced."""
    ledger_store(invoices.sparkSession, path, buckets).put(invoices)


def erase_everywhere(tables: Iterable[StoredTable], gone: DataFrame) -> None:
    """Erase ledgers from every table; run again after a failure, it finishes what is left."""
    gone = written_once(gone.select("ledger_id"))
    for table in tables:
        table.erase(gone)


def sweep(raw_files: StoredTable, cutoff: Column) -> None:
    """Drop raw files made before ``cutoff`` from a table stored by the hour."""
    last = raw_files.spark.range(1).select(F.floor(F.unix_seconds(cutoff) / 3600).alias("hour")).first().hour
    raw_files.rewrite([b for b in raw_files.current() if b <= last], lambda old: old.where(F.col("created_at") >= cutoff))


def append_audit(spark: SparkSession, lines: DataFrame, path: str, batch: str) -> None:
    """Add a batch of audit lines exactly once; earlier lines are never touched.

    A batch that was committed is not added again, whatever is given.  One that broke off has no commit:
    its lines are not read, and a second call writes them anew.
    """
    if batch in committed_batches(spark, path):
        return
    lines.write.mode("overwrite").parquet(f"{path}/lines/{batch}")
    spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").parquet(f"{path}/commits")


def committed_batches(spark: SparkSession, path: str) -> set[str]:
    if not _children(spark, f"{path}/commits"):
        return set()
    return {r.batch for r in spark.read.schema("batch string").parquet(f"{path}/commits").distinct().collect()}


def read_audit(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The lines of all committed batches."""
    paths = [f"{path}/lines/{batch}" for batch in sorted(committed_batches(spark, path))]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
