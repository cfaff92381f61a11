"""Values of landed JSON as they were sent, kept as VARIANT; no member takes its neighbours down."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# what counts as absent where a source means "nothing" by it
_EMPTY = ("null", "false", "0", '""', "[]", "{}")


def members(value: Column) -> Column:
    """The members of a list, NULL for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")


def fields(value: Column) -> Column:
    """The fields of an object as a map, NULL for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def field(of: Column, name: str) -> Column:
    """A field of `fields`; NULL where it is absent."""
    return F.try_element_at(of, F.lit(name))


def is_empty(value: Column) -> Column:
    """Absent, null, false, zero, or an empty text, list or object."""
    return F.coalesce(F.to_json(value).isin(*_EMPTY), F.lit(True))


def as_type(value: Column, dtype: str) -> Column:
    """The typed view of a value: numbers sent as text are numbers, what does not fit is NULL."""
    return F.try_variant_get(value, "$", dtype)
