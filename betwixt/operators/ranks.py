"""Running totals and row numbers over a whole table, without a task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import written


def running_total(rows: DataFrame, name: str, order: list[Column], amount: Column) -> DataFrame:
    """``rows`` with the sum of ``amount`` over them and all before them in a total order.

    Rows are sorted over partitions by ranges and added up in each; the partitions' totals (a row for each) go on top.
    """
    part, own = f"{name}__part", f"{name}__own"
    ranged = written(rows.withColumn(own, amount).orderBy(*order).withColumn(part, F.spark_partition_id()), "ranged")
    totals = ranged.groupBy(part).agg(F.sum(own).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select(part, before.alias("__before"))
    inner = F.sum(own).over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn(name, inner).join(F.broadcast(offsets), part).withColumn(name, F.col(name) + F.col("__before")).drop(part, own, "__before")


def with_rank(rows: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """``rows`` with their number from 1 in a total order."""
    return running_total(rows, name, order, F.lit(1).cast("long"))
