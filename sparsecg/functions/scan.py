"""Distributed prefix sums and ranks: sums inside sorted ranges, shifted by the totals of the ranges before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written


def _ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """df cut into sorted ranges of the order; the cut is stored, as sampling could place it elsewhere next time."""
    return written(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")


def prefix_sum(df: DataFrame, order: list[str], value: Column, name: str, exclusive: bool = False) -> DataFrame:
    """df with the running sum of value in the given order, which must be unique; exclusive leaves out the own row."""
    cut = _ranges(df.withColumn("__value", value), order)
    totals = cut.groupBy("__range").agg(F.sum("__value").alias("__total"))  # a row for each range
    shift = totals.select("__range", (F.sum("__total").over(Window.orderBy("__range")) - F.col("__total")).alias("__shift"))
    within = F.sum("__value").over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    # a row for each range, of which there are as many as shuffle partitions
    out = cut.withColumn("__within", within).join(F.broadcast(shift), "__range")
    total = F.col("__within") + F.col("__shift") - (F.col("__value") if exclusive else F.lit(0))
    return out.withColumn(name, total).drop("__range", "__value", "__within", "__shift")


def row_rank(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with each row's place in the order, from 0; the order must be unique."""
    return prefix_sum(df, order, F.lit(1).cast("long"), name, exclusive=True)


def dense_rank(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df with the place of each row's key among the distinct keys, from 0."""
    return df.join(row_rank(df.select(*keys).distinct(), keys, name), keys)
