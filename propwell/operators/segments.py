"""Running values over keys of any size: ordered chunks, and one row per chunk carried on.

A window over a key alone puts all its rows into one task. Here all rows are laid out by range of
(key, order), so that a key with many rows fills several partitions; a chunk is what one
partition holds of a key. Windows run within chunks, and what a chunk needs from the ones before it
is computed from one row per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propwell.operators.joins import join_per_key
from propwell.operators.sinks import materialize

CHUNK = "_chunk"
MOST_ROWS = 1_000_000


def segmented(rows: DataFrame, keys: Sequence[str], order: Sequence[str], most_rows: int = MOST_ROWS) -> DataFrame:
    """`rows` with `_chunk`, which rises with `order` within a key.

    Chunks hold about half of `most_rows` rows at most: range bounds are quantiles of a sample, and
    the other half is for its error. The layout is written once, so chunks stay what they are. Rows
    equal in key and order share a chunk.
    """
    parts = max(1, -(-2 * rows.count() // most_rows))
    if parts == 1:
        return rows.withColumn(CHUNK, F.lit(0))
    return materialize(rows.repartitionByRange(parts, *keys, *order).withColumn(CHUNK, F.spark_partition_id()), "segments")


def _local(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)


def segmented_lag(chunked: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Rows of `segmented` with `name`: `value` of the row before in its key, NULL on the first."""
    within = _local(keys, order)
    local = chunked.withColumns(
        {
            "_first": F.row_number().over(within) == 1,
            "_last": F.lead(F.lit(True)).over(within).isNull(),
            "_before": F.lag(value).over(within),
        }
    )
    tails = local.filter("_last").select(*keys, CHUNK, F.col(value).alias("_tail"))
    over_chunks = Window.partitionBy(*keys).orderBy(CHUNK)
    carried = tails.select(*keys, CHUNK, F.lag("_tail").over(over_chunks).alias("_carried"))
    joined = join_per_key(local, carried, [*keys, CHUNK], spread_by=order[-1])
    shown = F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_before"))
    return joined.select(*[c for c in chunked.columns if c != CHUNK], shown.alias(name))


def segmented_sum(chunked: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Rows of `segmented` with `name`: the sum of `value` over the rows of its key up to this one."""
    within = _local(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    valued = chunked.withColumn("_value", value)
    totals = valued.groupBy(*keys, CHUNK).agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, CHUNK, F.sum("_total").over(before).alias("_carried"))
    local = valued.withColumn("_here", F.sum("_value").over(within))
    joined = join_per_key(local, carried, [*keys, CHUNK], spread_by=order[-1])
    shown = F.coalesce("_here", F.lit(0)) + F.coalesce("_carried", F.lit(0))
    return joined.select(*[c for c in chunked.columns if c != CHUNK], shown.alias(name))
