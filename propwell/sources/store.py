"""Scans of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from propwell import schema
from propwell.operators.jobs import filter_jobs_by_status
from propwell.operators.records import filter_records


def scan_raw_records(spark: SparkSession, path: str, **predicates: object) -> DataFrame:
    """The record store under optional predicates; they reach folders and row groups."""
    return filter_records(spark.read.schema(schema.RAW_RECORDS).parquet(path), **predicates)


def scan_jobs(spark: SparkSession, path: str, status: str | None = None) -> DataFrame:
    """The job table, optionally of one status."""
    return filter_jobs_by_status(spark.read.schema(schema.JOBS).parquet(path), status)


def scan_logs(spark: SparkSession, path: str, job_id: str) -> DataFrame:
    """The log of one job."""
    logs = spark.read.schema(schema.LOGS).parquet(path)
    return logs.filter(logs["job_id"] == job_id)


def scan_sources(spark: SparkSession, path: str) -> DataFrame:
    """The registry by name."""
    return spark.read.schema(schema.SOURCES).parquet(path).orderBy("name")


def scan_layer_features(spark: SparkSession, layers: DataFrame, layer_id: str, root: str) -> DataFrame:
    """The features of one configured layer, from the table its configuration names.

    The layer table is small and bounded; one row of it is looked up.
    """
    found = layers.filter(layers["id"] == layer_id).select("source").head(1)
    if not found:
        raise LookupError(f"no layer {layer_id!r}")
    return spark.read.parquet(f"{root.rstrip('/')}/{found[0].source}")
