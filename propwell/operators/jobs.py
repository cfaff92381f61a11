"""Ingestion jobs and their log. Each function returns the table as it should be."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propwell import fixed, schema
from propwell.functions.times import at
from propwell.operators.records import page_records

_OPEN = ("pending", "running")


def create_jobs(jobs: DataFrame, requests: DataFrame, created_at: datetime) -> DataFrame:
    """`jobs` plus one pending row per request (job_id, source_name)."""
    fresh = {
        "job_id": F.col("job_id"),
        "source_name": F.col("source_name"),
        "status": F.lit("pending"),
        "created_at": at(created_at, jobs.schema["created_at"].dataType),
        "records_inserted": F.lit(0),
        "records_skipped": F.lit(0),
        "sub_job_ids": F.array(),
    }
    return jobs.unionByName(
        requests.select(
            *[
                fresh.get(field.name, F.lit(None)).cast(field.dataType).alias(field.name)
                for field in jobs.schema.fields
            ]
        )
    )


def transition_jobs(
    jobs: DataFrame, changes: DataFrame, fields: Sequence[str], key: str = "job_id", seq: str = "seq"
) -> DataFrame:
    """Set `status` and the fields each change names in `set_fields`; others survive.

    A field set to NULL becomes NULL. Of several changes to a job the later `seq` wins,
    field by field. Unknown ids change nothing.
    """
    latest = [F.max_by("status", seq).alias("_status")]
    for name in fields:
        is_set = F.array_contains("set_fields", name)
        boxed = F.when(is_set, F.struct(F.col(name)))
        latest.append(F.max_by(boxed, F.when(is_set, F.col(seq))).alias(f"_{name}"))
    merged = jobs.join(changes.groupBy(key).agg(*latest), key, "left")
    updated = {"status": F.coalesce("_status", "status")}
    for name in fields:
        box = F.col(f"_{name}")
        updated[name] = F.when(box.isNotNull(), box.getField(name)).otherwise(F.col(name))
    return merged.withColumns(updated).select(*jobs.columns)


def recover_stale_jobs(jobs: DataFrame, now: datetime) -> DataFrame:
    """Every open job becomes failed at `now`."""
    stale = F.col("status").isin(*_OPEN)
    ended = at(now, jobs.schema["completed_at"].dataType)
    return jobs.withColumns(
        {
            "status": F.when(stale, "failed").otherwise(F.col("status")),
            "completed_at": F.when(stale, ended).otherwise(F.col("completed_at")),
            "error_message": F.when(stale, fixed.STALE_JOB_MESSAGE).otherwise(F.col("error_message")),
        }
    )


def open_jobs(jobs: DataFrame) -> DataFrame:
    """The jobs that `recover_stale_jobs` changes."""
    return jobs.filter(F.col("status").isin(*_OPEN))


def count_stale_jobs(jobs: DataFrame) -> DataFrame:
    """One row: how many jobs `recover_stale_jobs` would change."""
    return jobs.agg(F.count_if(F.col("status").isin(*_OPEN)).alias("recovered"))


def filter_jobs_by_status(jobs: DataFrame, status: str | None = None) -> DataFrame:
    """Optional equality; any text is accepted as a status."""
    return jobs.filter(F.col("status") == status) if status else jobs


def page_jobs(
    jobs: DataFrame, status: str | None = None, limit: int = fixed.DEFAULT_PAGE_LIMIT, offset: int = 0
) -> DataFrame:
    """Newest jobs first."""
    return page_records(
        filter_jobs_by_status(jobs, status), "created_at", True, limit, offset, tie="job_id"
    )


def all_jobs(jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """Jobs, newest first; all of them unless a limit is given."""
    newest = jobs.orderBy(F.col("created_at").desc(), F.col("job_id").desc())
    return newest if limit is None else newest.limit(limit)


def page_logs(logs: DataFrame, job_id: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """One job's log, oldest first; all of it after `offset` unless a limit is given."""
    own = logs.filter(F.col("job_id") == job_id).orderBy("created_at", "log_id").offset(offset)
    return own if limit is None else own.limit(limit)


def append_logs(logs: DataFrame, entries: DataFrame) -> DataFrame:
    """`logs` plus new entries."""
    return logs.unionByName(entries)


def has_running_job(requests: DataFrame, jobs: DataFrame, key: str = "source_name") -> DataFrame:
    """Requests whose source has a running job; pending ones do not count."""
    running = jobs.filter("status = 'running'").select(key).distinct()
    return requests.join(running, key, "left_semi")


def child_links(parents: DataFrame) -> DataFrame:
    """(parent_id, job_id) for every child id a parent lists."""
    return parents.select(
        F.col("job_id").alias("parent_id"), F.explode("sub_job_ids").alias("job_id")
    )


def parent_children(links: DataFrame, children: DataFrame) -> DataFrame:
    """Children of each parent; listed ids without a job are ignored."""
    return links.join(children, "job_id")


def rollup_parent_status(parents: DataFrame, family: DataFrame) -> DataFrame:
    """(job_id, final, rolled_status): `partial` if any child failed, else `completed`.

    Not final while a child is open; no children means completed. `family` holds
    (parent_id, status) per child and is reduced in the map tasks first.
    """
    verdict = family.groupBy("parent_id").agg(
        F.bool_or(F.col("status").isin(*_OPEN)).alias("_open"),
        F.bool_or(F.col("status") == "failed").alias("_failed"),
    )
    joined = parents.join(verdict.withColumnRenamed("parent_id", "job_id"), "job_id", "left")
    is_open = F.coalesce("_open", F.lit(False))
    any_failed = F.coalesce("_failed", F.lit(False))
    return joined.select(
        "job_id",
        (~is_open).alias("final"),
        F.when(is_open, F.lit("running"))
        .when(any_failed, F.lit("partial"))
        .otherwise(F.lit("completed"))
        .alias("rolled_status"),
    )


def run_status(runs: DataFrame, empty_ok: Sequence[str] = (fixed.LISTINGS_SOURCE,)) -> DataFrame:
    """Adds `run_status` from `records` and `errors` counts and an optional `crashed` flag.

    A run without records is `empty`; sources in `empty_ok` are `failed` when they had
    errors and `success` otherwise.
    """
    crashed = F.col("crashed") if "crashed" in runs.columns else F.lit(False)
    lenient = F.col("source_name").isin(*empty_ok) if empty_ok else F.lit(False)
    return runs.withColumn(
        "run_status",
        F.when(crashed, F.lit("failed"))
        .when(F.col("records") > 0, F.lit("success"))
        .when(lenient & (F.col("errors") > 0), F.lit("failed"))
        .when(lenient, F.lit("success"))
        .otherwise(F.lit("empty")),
    )


def run_metrics(rows: DataFrame, by: Sequence[str], started: str, ended: str) -> DataFrame:
    """(records_count, duration_ms) per run; duration runs from first start to last end."""
    duration = F.timestamp_diff("MILLISECOND", F.min(started), F.max(ended))
    return rows.groupBy(*by).agg(
        F.count("*").alias("records_count"), duration.alias("duration_ms")
    )


def empty_jobs(spark) -> DataFrame:
    """A job table without rows."""
    return spark.createDataFrame([], schema.JOBS)
