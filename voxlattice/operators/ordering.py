"""Running totals in an order, without a task that holds all rows of a group.

Rows are range-partitioned by group and order, so a group may lie in many partitions; totals of a group's partitions are
summed up in their order (a row a partition), and a running sum inside each partition is added to that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def running_total(rows: DataFrame, by: list[str], order: list[str], weight: Column | None = None, name: str = "before") -> DataFrame:
    """rows with `name`: the sum of the weights (1 if none is given) of the rows of the same group that stand before.

    Rows of a group must differ in `order`, whose nulls come first. The ranges are written to the shared folder, so that
    they are made once.
    """
    w = F.lit(1) if weight is None else weight
    ranged = rows.withColumns({"_weight": w.cast("long"), "_group": F.lit(0)}).repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id())
    ranged = stored(ranged, "ranges")
    # _group is a column of the table, so the last sum is of the partitions of a group, also where `by` is empty.
    keys = ["_group", *by]
    parts = ranged.groupBy(*keys, "_part").agg(F.sum("_weight").alias("_of"))
    earlier = parts.withColumn("_earlier", F.sum("_of").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_of")).drop("_of")
    inside = F.sum("_weight").over(Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_weight")
    left = ranged.withColumn("_inside", inside)
    right = earlier.select(*[F.col(k).alias(f"_{k}_2") for k in keys], F.col("_part").alias("_part_2"), "_earlier")
    same = [left[k].eqNullSafe(right[f"_{k}_2"]) for k in keys] + [left["_part"] == right["_part_2"]]
    return left.join(right, same).select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_earlier") + F.col("_inside")).alias(name))
