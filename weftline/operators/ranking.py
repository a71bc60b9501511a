"""Positions among all rows without a task that holds all rows: range partitions, sums of partitions, and windows inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.shared import stored


def positions(df: DataFrame, order: list[Column | str], name: str = "position", weight: str | None = None) -> DataFrame:
    """``df`` with how many rows come before (or the sum of their ``weight``) in an order without ties.

    The rows are written once in range partitions, so positions hold whatever a later task that runs again does. Only a
    row for each partition is summed in one task.
    """
    ranged = stored(df.repartitionByRange(*order).withColumn("rk_part", F.spark_partition_id()), "ranked")
    one = F.lit(1).cast("long") if weight is None else F.col(weight)
    parts = ranged.groupBy("rk_part").agg(F.sum(one).alias("rk_sum"))
    upto = Window.partitionBy(F.lit(0)).orderBy("rk_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = parts.select("rk_part", F.coalesce(F.sum("rk_sum").over(upto), F.lit(0)).alias("rk_ahead"))
    inside = Window.partitionBy("rk_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = ranged.withColumn("rk_near", F.coalesce(F.sum(one).over(inside), F.lit(0)))
    return near.join(F.broadcast(ahead), "rk_part").withColumn(name, (F.col("rk_near") + F.col("rk_ahead")).cast("long")).drop("rk_part", "rk_near", "rk_ahead")
