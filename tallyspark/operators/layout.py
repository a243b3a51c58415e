"""One layout of invoices that the rules share, so that they group a supplier's rows without shuffling them again.

Rows are dealt by (ledger, supplier, part) into the buckets of a table.  A supplier is one part unless
it is hot; the parts of a hot one hold whole amounts, so what compares rows of one amount never leaves
a part, and what looks at all of a supplier adds up the results of its parts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import matching as m
from tallyspark.sources.tables import shared_folder

#: The columns by which rows are dealt.
PLACE = ["ledger_id", "vendor_norm", "part"]
#: Amounts are dealt by these steps of a ten-thousandth.
STEP = 50
#: Rows of a bucket, and the most buckets that Spark allows.
BUCKET_ROWS, MOST_BUCKETS = 4_000_000, 100_000
#: A supplier is hot beyond this many rows and this share of all, so fewer than ``HOT_SHARE`` suppliers
#: are, and a hot one has fewer than ``HOT_SHARE`` parts.
HOT_ROWS, HOT_SHARE = 1_000_000, 1000


def step_of(units: Column) -> Column:
    """The step that holds an amount of ``units`` ten-thousandths."""
    return F.floor(units / STEP).cast("long")


def part_of(currency: Column, step: Column, parts: Column) -> Column:
    """The part of a supplier of ``parts`` parts that holds amounts of this step."""
    return F.pmod(F.xxhash64(currency, step), parts).cast("int")


def dealt(rows: DataFrame, invoices: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Normalised ``rows`` of ``invoices`` as a table of buckets, sorted by supplier.

    Suppliers are counted before their rows are normalised: rows shrink to one for each spelling.  The
    table lies in a folder that all executors share; its name and files stay until the caller drops them.
    """
    spark = rows.sparkSession
    spelt = invoices.groupBy("ledger_id", "vendor_name").agg(F.count("*").alias("n"))
    supplier = F.coalesce(m.normal_vendor(F.col("vendor_name")), F.lit(""))
    sizes = spelt.groupBy("ledger_id", supplier.alias("vendor_norm")).agg(F.sum("n").alias("n")).persist()
    total = sizes.agg(F.sum("n")).first()[0] or 0
    large = max(HOT_ROWS if hot_rows is None else hot_rows, total // HOT_SHARE)
    hot = sizes.where(F.col("n") > large).select("ledger_id", "vendor_norm", F.ceil(F.col("n") / large).cast("int").alias("__parts"))
    # Fewer than HOT_SHARE rows.
    marked = rows.drop("part", "parts").join(F.broadcast(hot), ["ledger_id", "vendor_norm"], "left").withColumn("parts", F.coalesce("__parts", F.lit(1))).drop("__parts")
    buckets = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_ROWS + 1))
    part = part_of(F.col("cur"), step_of(F.abs(F.col("amount")) * 10_000), F.col("parts"))
    name = f"invoices_{uuid.uuid4().hex}"
    writer = marked.withColumn("part", part).repartition(buckets, *PLACE).write.bucketBy(buckets, *PLACE).sortBy(*PLACE)
    # A cluster without a checkpoint folder keeps the table in its warehouse.
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.master.startswith("local"):
        writer = writer.option("path", shared_folder(spark, "invoices-"))
    writer.saveAsTable(name, format="parquet")
    sizes.unpersist()
    return spark.table(name)
