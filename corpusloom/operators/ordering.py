"""Global running sums without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.session import ensure_checkpoint_dir


def running_sum(df: DataFrame, order: list[str | Column], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over all rows before, in ``order`` (which must tell rows apart).

    Rows are dealt to ranges of the order and the dealing is fixed by a checkpoint; each range sums up for
    itself, and the sums of the ranges before (one number each) are added.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    sums = dealt.groupBy("_part").agg(F.sum(value).alias("_sum"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.withColumn("_own", F.coalesce(F.sum(value).over(within), F.lit(0)))
        .join(F.broadcast(offsets), "_part")  # a row for each partition
        .withColumn(name, F.col("_own") + F.col("_offset")).drop("_part", "_own", "_offset")
    )
