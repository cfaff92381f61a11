"""The source registry and the per-source status view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propwell import fixed, schema
from propwell.functions.scalars import normalize_source_name
from propwell.operators.dedup import first_by
from propwell.operators.records import page_records


def seed_sources(spark: SparkSession) -> DataFrame:
    """The registry rows every installation starts with."""
    return spark.createDataFrame(list(fixed.SEED_SOURCES), schema.SOURCES)


def upsert_sources(registry: DataFrame, updates: DataFrame, key: str = "name") -> DataFrame:
    """Merge by key: columns of `updates` overwrite, new keys are inserted.

    `updates` holds each key once. Registry columns it lacks survive.
    """
    marked = updates.select(
        F.col(key).alias("_key"),
        F.struct(*[name for name in updates.columns if name != key]).alias("_set"),
    )
    merged = registry.join(marked, F.col(key) == F.col("_key"), "full_outer")
    columns = []
    for name in registry.columns:
        if name == key:
            columns.append(F.coalesce("_key", key).alias(key))
        elif name in updates.columns:
            new = F.col("_set").getField(name)
            columns.append(F.when(F.col("_key").isNotNull(), new).otherwise(F.col(name)).alias(name))
        else:
            columns.append(F.col(name))
    return merged.select(*columns)


def page_sources(
    registry: DataFrame, limit: int = fixed.DEFAULT_PAGE_LIMIT, offset: int = 0
) -> DataFrame:
    """A page of the registry by name."""
    return registry.orderBy("name").offset(offset).limit(limit)


def count_sources(registry: DataFrame) -> DataFrame:
    """One row: `total`."""
    return registry.agg(F.count("*").alias("total"))


def filter_active_sources(registry: DataFrame) -> DataFrame:
    """Sources with status `active`."""
    return registry.filter("status = 'active'")


def runnable_source_check(
    requests: DataFrame, registry: DataFrame, implemented: DataFrame, name: str = "source_name"
) -> DataFrame:
    """Adds `verdict`: runnable, planned, not_implemented or not_found.

    `registry` holds (name, status) once per name, `implemented` the names with a scan.
    """
    asked = requests.withColumn("_name", normalize_source_name(F.col(name)))
    known = registry.select(F.col("name").alias("_name"), F.col("status").alias("_status"))
    able = implemented.select(F.col("name").alias("_name"), F.lit(True).alias("_able"))
    joined = asked.join(known, "_name", "left").join(able, "_name", "left")
    verdict = (
        F.when(F.col("_status") == "planned", "planned")
        .when(F.col("_able"), "runnable")
        .when(F.col("_status").isNotNull(), "not_implemented")
        .otherwise("not_found")
    )
    return joined.withColumn("verdict", verdict).select(*requests.columns, "verdict")


def latest_job_per_source(
    jobs: DataFrame,
    key: str = "source_name",
    at: str = "created_at",
    tie: str = "job_id",
    lookback: int | None = None,
) -> DataFrame:
    """The newest job of each source; with `lookback`, among that many newest jobs overall."""
    order: Sequence = [F.col(at).desc(), F.col(tie).desc()]
    if lookback is not None:
        jobs = jobs.orderBy(*order).limit(lookback)
    return first_by(jobs, [key], order)


def source_status(sources: DataFrame, jobs: DataFrame, lookback: int | None = None) -> DataFrame:
    """One row per source with its newest job; 0 inserted only where there is no job."""
    latest = latest_job_per_source(jobs, lookback=lookback).select(
        F.col("source_name").alias("name"),
        F.col("status").alias("last_job_status"),
        F.col("job_id").alias("last_job_id"),
        F.col("completed_at").alias("last_run_at"),
        F.col("records_inserted").alias("_inserted"),
    )
    return sources.join(latest, "name", "left").select(
        F.col("name").alias("source_name"),
        F.coalesce("display_name", "name").alias("display_name"),
        "status",
        "last_job_status",
        "last_job_id",
        "last_run_at",
        F.when(F.col("last_job_id").isNull(), F.lit(0)).otherwise(F.col("_inserted"))
        .cast("bigint")
        .alias("last_records_inserted"),
    )


def page_status(
    status: DataFrame, limit: int = fixed.DEFAULT_PAGE_LIMIT, offset: int = 0
) -> DataFrame:
    """A page of the status view, by name."""
    return page_records(status, "source_name", False, limit, offset, tie="source_name")
