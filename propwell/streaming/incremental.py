"""Incremental ingest: landed rows are deduplicated and stored batch by batch.

A batch is compared with everything stored before it is appended. That also makes it safe
to run one again: rows its first attempt stored are skipped like any other existing row.
What earlier batches stored stays when a later one fails.

Every batch reads the hash column of the store. Let batches be large (`availableNow` takes
all that landed), or keep the store bucketed by hash, which is then read in place.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from propwell.operators.ingest import ingest_dedup
from propwell.sources.items import ARRIVAL


def existing_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """The store as it is now, None while nothing was written."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def store_batch(
    batch: DataFrame,
    existing: Callable[[], DataFrame | None],
    append: Callable[[DataFrame], None],
    arrival: Sequence[str] = ARRIVAL,
) -> None:
    """Append what is new in `batch`; `existing` looks the store up anew."""
    append(ingest_dedup(batch, existing(), arrival))


def incremental_ingest(
    stream: DataFrame,
    existing: Callable[[], DataFrame | None],
    append: Callable[[DataFrame], None],
    checkpoint: str,
    arrival: Sequence[str] = ARRIVAL,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    after: Callable[[DataFrame], None] | None = None,
) -> StreamingQuery:
    """Ingest everything landed so far and stop; the next start goes on from there.

    `prepare` turns a micro-batch into rows with `content_hash`; `after` sees these rows
    once they are stored.
    """

    def store(batch: DataFrame, _batch_id: int) -> None:
        rows = prepare(batch) if prepare else batch
        store_batch(rows, existing, append, arrival)
        if after:
            after(rows)

    return (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
