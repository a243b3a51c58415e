"""Neighbours and cadences within groups of rows, of which one may hold a third of the table.

A calm group is one window.  A hot group is cut into ranges of its order, so that many tasks share it:
each row finds its neighbour within its range, and the first row of a range takes the last row of the
range before.  The median of a group's gaps comes from a histogram, as gaps are whole days and few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import matching as m
from tallyspark.model import reading_order
from tallyspark.sources.tables import written_once

#: A group is hot beyond this many rows and this share of all, so fewer than ``HOT_SHARE`` groups are.
HOT_ROWS, HOT_SHARE = 100_000, 1000


def _neighbours(rows: DataFrame, group: list[str], row: Column) -> DataFrame:
    return rows.withColumn("before", F.lag(row).over(Window.partitionBy(*group).orderBy(reading_order())))


def with_previous(rows: DataFrame, key: list[str], fields: list[str], hot_rows: int | None = None) -> DataFrame:
    """``rows`` with ``before``: the ``fields`` of the row before in the group, in reading order.  Key columns are not null."""
    sizes = rows.groupBy(*key).agg(F.count("*").alias("__n"))
    total = sizes.agg(F.sum("__n")).first()[0] or 0
    large = max(HOT_ROWS if hot_rows is None else hot_rows, total // HOT_SHARE)
    hot = written_once(sizes.where(F.col("__n") > large).select(*key, F.lit(True).alias("__hot")))
    row = F.struct(*fields)
    if hot.isEmpty():
        return _neighbours(rows, key, row)
    # Fewer than HOT_SHARE keys.
    marked = rows.join(F.broadcast(hot), key, "left")
    calm = _neighbours(marked.where("__hot is null").drop("__hot"), key, row)
    order = [F.col("invoice_date").asc_nulls_last(), "seq", "id"]
    ranged = marked.where("__hot").drop("__hot").repartitionByRange(*key, *order)
    ranged = written_once(ranged.withColumn("__range", F.spark_partition_id()))
    ends = ranged.groupBy(*key, "__range").agg(F.max(F.struct(reading_order().alias("at"), row.alias("row"))).alias("last"))
    # A row for each range of a hot group.
    ends = ends.select(*key, "__range", F.lag("last.row").over(Window.partitionBy(*key).orderBy("__range")).alias("__carried"))
    near = _neighbours(ranged, [*key, "__range"], row).join(F.broadcast(ends), [*key, "__range"])
    return calm.unionByName(near.withColumn("before", F.coalesce("before", "__carried")).select(*calm.columns))


def gap_cadences(paired: DataFrame, key: list[str]) -> DataFrame:
    """(key, n, pace, held) of each group of ``paired(key, gap)``: its rows, the median of its gaps, and how many lie on that beat."""
    histogram = paired.groupBy(*key, "gap").agg(F.count("*").alias("rows"))
    known = F.when(F.col("gap").isNotNull(), F.col("rows")).otherwise(0)
    group = Window.partitionBy(*key)
    upto = group.orderBy("gap").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = histogram.withColumn("upto", F.sum(known).over(upto)).withColumn("gaps", F.sum(known).over(group))

    def nth(place: Column) -> Column:
        return F.min(F.when(F.col("gap").isNotNull() & (F.col("upto") >= place), F.col("gap"))).over(group)

    paced = counted.withColumn("pace", (nth(F.floor((F.col("gaps") + 1) / 2)) + nth(F.floor(F.col("gaps") / 2) + 1)) / 2)
    held = F.sum(F.when(m.on_schedule(F.col("gap"), F.col("pace")), F.col("rows")).otherwise(0))
    return paced.groupBy(*key).agg(F.sum("rows").alias("n"), F.first("pace").alias("pace"), held.alias("held"))


def is_steady(n: Column, pace: Column, held: Column) -> Column:
    """Whether a group keeps a beat: three rows, five days, seven tenths of its gaps."""
    return (n >= 3) & (pace >= 5) & (held * 10 >= (n - 1) * 7)
