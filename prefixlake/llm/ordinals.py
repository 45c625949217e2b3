"""Positions and running sums over a total order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prefixlake.session import materialize


def running_totals(df: DataFrame, group: Column | None, order: list[Column], amount: Column, label: str) -> DataFrame:
    """``df``, stored, with ``before``: the sum of ``amount`` of the group's rows that come earlier.

    Rows are dealt by range of (group, order), summed inside each range, and shifted by the
    totals of the ranges before it, so one group of any size spans many tasks. ``order``
    should end in a column that differs between equal rows. The written ranges hold still
    if a task is run again.
    """
    key = F.lit(0) if group is None else group
    names = df.columns
    keyed = df.withColumns({"_group": key, "_amount": amount, **{f"_order{k}": c for k, c in enumerate(order)}})
    orders = [f"_order{k}" for k in range(len(order))]
    ranged = materialize(
        keyed.repartitionByRange("_group", *orders).withColumn("_range", F.spark_partition_id()), label)
    inside = Window.partitionBy("_range", "_group").orderBy(*orders).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        ranged.groupBy("_range", "_group").agg(F.sum("_amount").alias("_total"))
        .withColumn("_shift", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
        .select("_range", F.col("_group").alias("_shift_group"), "_shift")
    )
    summed = ranged.withColumn("_inside", F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
    right = shifts.withColumnRenamed("_range", "_shift_range")
    joined = summed.join(
        right, (F.col("_range") == F.col("_shift_range")) & F.col("_group").eqNullSafe(F.col("_shift_group")))
    return joined.select(*names, (F.col("_inside") + F.col("_shift")).alias("before"))
