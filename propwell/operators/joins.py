"""Joining one row per key to all rows of the key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WAYS = 8


def join_per_key(
    rows: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    spread_by: str,
    how: str = "left",
    ways: int = WAYS,
) -> DataFrame:
    """`rows` joined with `per_key`, which has at most one row per key.

    A key may hold a large part of `rows`. `per_key` is mostly an aggregate over the same
    keys; joined as it is, it would be used in the partitioning it has, and AQE splits a
    skewed partition only where both sides come straight from a shuffle. So every key is
    cut `ways` ways by a hash of `spread_by`, and the few rows of `per_key` are copied
    that often. This needs a shuffle of them of its own, after which AQE can split what is
    still too large, or broadcast them when they turn out small.
    """
    cut = rows.withColumn("_way", F.pmod(F.xxhash64(spread_by), F.lit(ways)))
    every_way = F.sequence(F.lit(0).cast("bigint"), F.lit(ways - 1).cast("bigint"))
    copies = per_key.withColumn("_way", F.explode(every_way))
    return cut.join(copies, [*keys, "_way"], how).drop("_way")
