"""Dealing rows over tasks by their number, for work that is heavy per row or per pair of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def width(spark: SparkSession) -> int:
    """How many tasks a shuffle starts with, and no fewer than run at a time."""
    given = int(spark.conf.get("spark.sql.shuffle.partitions"))
    initial = int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "1"))
    return max(given, initial, spark.sparkContext.defaultParallelism)


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """`rows` over as many tasks as a shuffle starts with, evenly, or by a hash of `by`.

    AQE merges partitions by their bytes and a file of one row group is read by one task, however
    much is to be done for a row. The number is given, which AQE leaves as it is.
    """
    return rows.repartition(width(rows.sparkSession), *by)
