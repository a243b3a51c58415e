"""Invoices projected from the order tables, and frames that several readers share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.model import AMOUNT

CONTRACT_PERIODS = 26


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written_once(rows: DataFrame) -> DataFrame:
    """``rows`` for several readers: written to the checkpoint folder if the session has one, else cached.

    The written rows have no history, so plans that read them stay short.  Spark removes their files with
    the last reference only where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on, which a cluster
    should set.  A cached frame stays until the session's cache is cleared.
    """
    context = rows.sparkSession.sparkContext
    folder = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
    if folder and context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return rows.checkpoint(eager=True) if context.getCheckpointDir() else rows.persist()


def shared_folder(spark: SparkSession, prefix: str) -> str:
    """A new folder that all executors share: below ``spark.checkpoint.dir``, or a temporary one on a single machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/{prefix}{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix=prefix) + "/rows"


def projected_invoices(spark: SparkSession, sf_dir: str, ledger_id: str = "ap") -> DataFrame:
    """Line items as supplier invoices, and a fortnightly contract for each supplier."""
    suppliers = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    items = read_table(spark, sf_dir, "lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    spelled = F.when(F.col("l_partkey") % 11 == 0, F.replace("s_name", F.lit("Supplier"), F.lit("Suplier"))).otherwise(F.col("s_name"))
    tail = F.when(F.col("l_linenumber") % 4 == 1, " Ltd").when(F.col("l_linenumber") % 4 == 2, " Limited.").otherwise("")
    size = F.when(F.col("l_partkey") % 997 == 0, 7500.0).when(F.col("l_partkey") % 503 == 0, 45.0).otherwise(F.col("l_quantity") * 90)
    sign = F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1), -1).otherwise(1)
    day = F.to_date("l_shipdate")
    moved = F.when((day >= F.lit("1999-01-01").cast("date")) & (F.col("l_suppkey") % 5 == 0), 13).otherwise(0)
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"), F.date_format(day, "yyyyMMdd"))
    billed = items.select(
        F.lit(ledger_id).alias("ledger_id"),
        F.lit(0).cast("long").alias("seq"),
        key.alias("id"),
        F.concat(spelled, tail).alias("vendor_name"),
        F.concat(F.lit("INV-"), F.lpad((F.col("l_orderkey") % 1000).cast("string"), 5, "0")).alias("invoice_number"),
        day.alias("invoice_date"),
        (size * sign).cast(AMOUNT).alias("amount"),
        F.when(F.col("l_linestatus") == "O", "GBP").otherwise("EUR").alias("currency"),
        F.lit(None).cast("string").alias("reference"),
        F.when(F.col("l_linenumber") != 7, F.lpad(((F.col("l_suppkey") * 7919 + moved) % 10000).cast("string"), 4, "0")).alias("bank_last4"),
    )
    periods = suppliers.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(CONTRACT_PERIODS - 1))))
    contracts = periods.select(
        F.lit(ledger_id).alias("ledger_id"),
        F.lit(0).cast("long").alias("seq"),
        F.concat_ws("-", F.lit("CT"), "s_suppkey", "k").alias("id"),
        F.col("s_name").alias("vendor_name"),
        F.concat(F.lit("CONTRACT-"), F.col("k").cast("string")).alias("invoice_number"),
        F.date_add(F.lit("1996-01-01").cast("date"), F.col("k") * 14).alias("invoice_date"),
        F.lit(1450).cast(AMOUNT).alias("amount"),
        F.lit("GBP").alias("currency"),
        F.lit(None).cast("string").alias("reference"),
        F.lpad((F.col("s_suppkey") * 7919 % 10000).cast("string"), 4, "0").alias("bank_last4"),
    )
    return billed.unionByName(contracts)
