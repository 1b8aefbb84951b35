"""Running sums over an order of the whole table, without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.work import kept


def running_before(table: DataFrame, by: str, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """table with before: the sum of value over rows of the same keys with a smaller ``by``, which tells rows of the same keys apart; 0 for the first.

    Rows are dealt to ranges of (keys, by). A range's own sums come from a window within it, and what lies before from the sums of the
    ranges, a row a range and key that meets it. Null keys are a key of their own.
    """
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = kept(table.repartitionByRange(parts, *keys, by).withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy(*keys, "part").agg(F.sum(value).alias("own"))
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*(F.col(k).alias(f"of_{k}") for k in keys), F.col("part").alias("of_part"), F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("start"))
    same = F.col("part") == F.col("of_part")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"of_{k}"))
    within = Window.partitionBy(*keys, "part").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.withColumn("inner", F.coalesce(F.sum(value).over(within), F.lit(0))).join(starts, same)
    return rows.withColumn("before", F.col("start") + F.col("inner")).select(*table.columns, "before")
