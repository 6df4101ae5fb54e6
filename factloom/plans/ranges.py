"""Numbers and running sums over an order of all rows, without a task that holds them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.plans.shared import materialize


def sums_before(rows: DataFrame, order: Sequence[str | Column], value: str | Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows that come earlier in the order.

    Rows are dealt into ranges of the order and stored, so that the ranges stay the same; sums run
    inside a range and are moved by the sums of the ranges before, one row for each of those.
    """
    keyed = rows.select("*", *[(F.expr(c) if isinstance(c, str) else c).alias(f"_o{i}") for i, c in enumerate(order)], (F.col(value) if isinstance(value, str) else value).cast("long").alias("_value"))
    keys = [f"_o{i}" for i in range(len(order))]
    dealt = materialize(keyed.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ranges")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_range").agg(F.sum("_value").alias("_size"))
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(earlier(Window.orderBy("_range"))), F.lit(0)).alias("_start"))
    inside = F.coalesce(F.sum("_value").over(earlier(Window.partitionBy("_range").orderBy(*keys))), F.lit(0))
    out = dealt.withColumn("_inside", inside).join(F.broadcast(starts), "_range")
    return out.withColumn(name, F.col("_start") + F.col("_inside")).drop("_range", "_start", "_inside", "_value", *keys)


def number_rows(rows: DataFrame, order: Sequence[str | Column], name: str = "place") -> DataFrame:
    """``rows`` numbered from 1 in an order over all of them."""
    return sums_before(rows, order, F.lit(1), name).withColumn(name, F.col(name) + 1)
