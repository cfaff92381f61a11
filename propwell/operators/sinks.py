"""Writes to stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from propwell.functions.geometry import place_order
from propwell.session import scratch_path


def _counted(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """`rows` with a count that the write of them takes along.

    To be put right before a write: its tasks are those of the last stage, each of which counts
    once however often it is run, while a stage before a shuffle counts again when lost output is made anew.
    """
    written = Observation()
    return rows.observe(written, F.count(F.lit(1)).alias("n")), written


def append_records(records: DataFrame, path: str) -> int:
    """Append raw records: one folder per source, rows in time order within files; how many.

    REBALANCE lets AQE split a source that holds most rows over many files and merge
    small ones. Bloom filters let point lookups by record or listing skip row groups.
    """
    laid = records.hint("rebalance", "source_name").sortWithinPartitions("source_name", F.col("ingested_at").desc())
    rows, written = _counted(laid)
    (
        rows.write.partitionBy("source_name")
        .option("parquet.bloom.filter.enabled#record_id", True)
        .option("parquet.bloom.filter.enabled#listing_id", True)
        .mode("append")
        .parquet(path)
    )
    return written.get["n"]


def save_bucketed(records: DataFrame, table: str, buckets: int) -> int:
    """Append to a table bucketed by hash, which ingest compares with in place; how many rows.

    Rows go to the task of their bucket first, so an append adds one file per bucket (and
    source, where the table has a folder per source).
    """
    folders = ["source_name"] if "source_name" in records.columns else []
    rows, written = _counted(records.repartition(buckets, "content_hash"))
    writer = rows.write.mode("append")
    if folders:
        writer = writer.partitionBy(*folders)
    writer.bucketBy(buckets, "content_hash").sortBy("content_hash").saveAsTable(table)
    return written.get["n"]


def append_rows(rows: DataFrame, path: str) -> None:
    """Append rows of a small table."""
    rows.write.mode("append").parquet(path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared scratch folder and read it back: parsed once, used often."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """`materialize`, and how many rows it wrote."""
    rows, written = _counted(df)
    return materialize(rows, label), written.get["n"]


def save_layer(features: DataFrame, path: str) -> None:
    """Write a layer along a curve over the map, so that boxes skip files and row groups.

    Needs `lng` and `lat`, or the bounds of `layers.with_bounds`, whose middle is taken. The
    row number breaks ties, so that one place with very many rows fills several files.
    """
    if {"lng", "lat"} <= set(features.columns):
        lng, lat = F.col("lng"), F.col("lat")
    else:
        lng, lat = (F.col("min_lng") + F.col("max_lng")) / 2, (F.col("min_lat") + F.col("max_lat")) / 2
    placed = features.withColumn("_place", place_order(lng, lat))
    ordered = placed.repartitionByRange("_place", F.monotonically_increasing_id())
    ordered.sortWithinPartitions("_place").drop("_place").write.mode("overwrite").parquet(path)
