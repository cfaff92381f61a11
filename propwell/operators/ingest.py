"""Ingest: wrap, hash, insert what is new, count."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propwell import fixed
from propwell.functions.times import at
from propwell.operators.dedup import first_by
from propwell.operators.joins import join_per_key
from propwell.sources.items import ARRIVAL


def record_envelope(
    items: DataFrame,
    *,
    source_name: str,
    source_url: str,
    retrieval_method: str,
    job_id: str,
    ingested_at: datetime,
) -> DataFrame:
    """Wrap items as raw records; the arrival columns stay for `ingest_dedup`.

    One timestamp per run, so that a rerun gives the same rows. A missing hash is ''.
    """
    digest = F.coalesce(F.col("content_hash"), F.lit(""))
    return items.select(
        *ARRIVAL,
        F.substring(digest, 1, 24).alias("record_id"),
        F.lit(source_name).alias("source_name"),
        F.lit(source_url).alias("source_url"),
        at(ingested_at, T.TimestampType()).alias("ingested_at"),
        F.lit(retrieval_method).alias("retrieval_method"),
        F.parse_json("payload_json").alias("raw_payload"),
        F.lit("raw").alias("parsing_status"),
        digest.alias("content_hash"),
        F.lit(fixed.SCHEMA_VERSION).alias("schema_version"),
        F.array().cast("array<string>").alias("tags"),
        F.lit(job_id).alias("job_id"),
        "listing_id",
    )


def existing_hash_antijoin(
    batch: DataFrame, store: DataFrame, key: str = "content_hash", spread_by: str | None = None
) -> DataFrame:
    """Rows of `batch` whose hash the store, which holds each hash once, does not have.

    Only the hash column of the store is read. It moves once per ingest unless the store
    is a table bucketed by hash (`sinks.save_bucketed`), which is read in place. For a
    batch that still repeats hashes, `spread_by` names a column that tells the copies apart.
    """
    known = store.select(key)
    if spread_by is not None:
        return join_per_key(batch, known, [key], spread_by, "left_anti")
    return batch.join(known, key, "left_anti")


def ingest_dedup(
    batch: DataFrame, store: DataFrame | None, arrival: Sequence[str] = ARRIVAL
) -> DataFrame:
    """Rows to append: first arrival of each hash the store lacks. Existing rows win.

    Repeats collapse in the map tasks; the anti-join then reuses the same partitioning
    by hash, so the batch is shuffled once.
    """
    keyed = batch.withColumn("content_hash", F.coalesce("content_hash", F.lit("")))
    fresh = first_by(keyed, ["content_hash"], list(arrival))
    return fresh if store is None else existing_hash_antijoin(fresh, store)


def ingest_counts(batch: DataFrame, fresh: DataFrame, by: Sequence[str]) -> DataFrame:
    """(inserted, skipped) per run key: rows that came in against rows that are new.

    Both sides are counted in the map tasks; the join is over one row per key.
    """
    seen = batch.groupBy(*by).agg(F.count("*").alias("_seen"))
    new = fresh.groupBy(*by).agg(F.count("*").alias("_new"))
    inserted = F.coalesce("_new", F.lit(0).cast("bigint"))
    return seen.join(new, list(by), "left").select(
        *by, inserted.alias("inserted"), (F.col("_seen") - inserted).alias("skipped")
    )
