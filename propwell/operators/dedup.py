"""First-occurrence operators.

All use `row_number() = 1`, for which Spark keeps one row per key in every map task
before the shuffle (WindowGroupLimit): a hash or id that holds a third of all rows
reaches its reducer as one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propwell.sources.items import ARRIVAL


def first_by(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in the given order."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


def first_seen_hash(rows: DataFrame, order: Sequence[str] = ARRIVAL) -> DataFrame:
    """First arrival of each content hash, across all units."""
    return first_by(rows, ["content_hash"], order)


def first_seen_listing(
    rows: DataFrame, keys: Sequence[str], listing_id: str, order: Sequence[str]
) -> DataFrame:
    """First row of each listing id within `keys`; rows without an id are all kept.

    Rows without an id get their place as key, so they spread over all tasks.
    """
    own_place = F.when(
        F.coalesce(F.col(listing_id), F.lit("")) == "",
        F.to_json(F.struct(*order)),
    )
    placed = rows.withColumn("_place", own_place)
    return first_by(placed, [*keys, listing_id, "_place"], order).drop("_place")


def cap_per_group(rows: DataFrame, position: str, most: int) -> DataFrame:
    """The first `most` members of each response, by their place in it (from 0)."""
    return rows.filter(F.col(position) < most)
