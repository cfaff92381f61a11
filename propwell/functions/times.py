"""Point-in-time literals."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def at(value: datetime, dtype: T.DataType) -> Column:
    """`value` as a literal of a column's own type, so comparisons push down.

    A value without zone is UTC.
    """
    if isinstance(dtype, T.TimestampNTZType):
        if value.tzinfo is not None:
            value = value.astimezone(timezone.utc).replace(tzinfo=None)
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    if value.tzinfo is None:
        value = value.replace(tzinfo=timezone.utc)
    return F.lit(value).cast(dtype)
