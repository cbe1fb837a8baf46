"""Ranks that do not need one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group.

    Spark turns the rank filter into a group limit that runs before the
    shuffle, so at most ``k`` rows per group and partition travel.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def distributed_rank(df: DataFrame, group: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """Exact 1-based position of every row in its group, whatever the group's size.

    Rows are range-partitioned on (group, order), so a large group spreads over
    many tasks.  A position is the place inside the partition plus the number
    of the group's rows in earlier partitions; only those counts, one row per
    partition and group met there, are windowed.
    """
    keys = [F.col(c) for c in group]
    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    placed = materialize(
        df.repartitionByRange(int(parts), *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_mono", F.monotonically_increasing_id())
        .withColumn("_part", F.spark_partition_id())
    )
    counts = placed.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_mono").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return (
        placed.join(offsets.drop("_n"), [*group, "_part"])
        .withColumn(rank, F.col("_before") + F.col("_mono") - F.col("_first") + 1)
        .drop("_mono", "_part", "_first", "_before")
    )


def ordered_prefix(df: DataFrame, order: list[Column], value: str, pos: str = "pos", run: str = "run") -> DataFrame:
    """Global position and running sum of ``value`` along ``order``.

    Range partitions are summed on their own and shifted by the totals of the
    partitions before them; only those totals are windowed together.
    """
    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    placed = materialize(
        df.repartitionByRange(int(parts), *order).sortWithinPartitions(*order)
        .withColumn("_mono", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id())
    )
    inside = Window.partitionBy("_part").orderBy("_mono")
    local = placed.withColumn("_run", F.sum(value).over(inside))
    totals = placed.groupBy("_part").agg(
        F.count("*").alias("_n"), F.min("_mono").alias("_first"), F.sum(value).alias("_total"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(
        "_part", "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows"),
        F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_sum"),
    )
    return (
        local.join(F.broadcast(shifts), "_part")  # one row per partition
        .withColumn(pos, F.col("_rows") + F.col("_mono") - F.col("_first") + 1)
        .withColumn(run, F.col("_run") + F.col("_sum"))
        .drop("_mono", "_part", "_run", "_first", "_rows", "_sum")
    )
