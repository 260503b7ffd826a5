"""Running values of groups of any size: by ranges of the order, not by a window that holds a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafweave.sources.tables import settled


def running(df: DataFrame, group: Sequence[str], order: Sequence[str], **values: Column) -> DataFrame:
    """df with, for each value, its sum over the rows of the group that come before in the order.

    Rows are dealt by range of (group, order) and kept so; sums within a range are added to those of the ranges
    before, which are one row for each range and group. No task holds more than a range."""
    columns = df.columns
    placed = settled(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))
    key = ["_part", *group]
    within = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = placed.groupBy(*key).agg(*(F.sum(v).alias(f"_{k}") for k, v in values.items()))
    before = totals.select(*(F.col(c).alias(f"_of_{c}") for c in key), *(F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)).alias(f"_{k}") for k in values))
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    rows = placed.select("*", *(F.coalesce(F.sum(v).over(within), F.lit(0)).alias(k) for k, v in values.items()))
    return rows.join(before, same).select(*columns, *((F.col(k) + F.col(f"_{k}")).cast("long").alias(k) for k in values))
