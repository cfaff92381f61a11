"""A page far into an order, without sorting all that comes before it.

A top-k of offset + limit rows holds all of them in one task. Here the row the page starts near is found
by counting: quantiles of the sort key cut the rows into ranges, the range that holds the offset is cut
again until it is small, and the page is a top-k of what is left of the offset there. Where many rows
tie, the search goes on in the tie-breaking column. Counts are exact, quantiles only choose the cuts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges a step cuts the rows into, and rows a page may have to sort before its first.
RANGES = 64
MOST_SKIPPED = 100_000


@dataclass(frozen=True)
class _Key:
    """One sort column. Values travel as text that reads back exactly."""

    name: str
    dtype: T.DataType
    descending: bool

    @property
    def column(self) -> Column:
        return F.col(self.name)

    def shown(self, value: Column) -> Column:
        return (F.unix_micros(value) if isinstance(self.dtype, T.TimestampType) else value).cast("string")

    def read(self, text: str) -> Column:
        if isinstance(self.dtype, T.TimestampType):
            return F.timestamp_micros(F.lit(int(text)))
        return F.lit(text).cast(self.dtype)

    def starts(self, value: Column) -> Column:
        """At `value` or after it in the order."""
        return self.column <= value if self.descending else self.column >= value

    def after(self, value: Column) -> Column:
        return self.column < value if self.descending else self.column > value

    def order(self) -> Column:
        return self.column.desc() if self.descending else self.column.asc()


def _cuts(rows: DataFrame, key: _Key, prefix: int) -> tuple[list[str], bool]:
    """Some values of the key to cut at, in its order: quantiles, or of texts the beginnings of one more character.

    Also whether beginnings were left out, because there are more than RANGES of them.
    """
    if isinstance(key.dtype, T.StringType):
        found = rows.select(F.substring(key.column, 1, prefix + 1).alias("cut")).distinct().orderBy("cut").collect()
        step = max(1, -(-len(found) // RANGES))
        cuts, thinned = [row.cut for row in found[::step]], step > 1
    else:
        at = [i / RANGES for i in range(RANGES + 1)]
        quantiles = rows.agg(F.percentile_approx(key.column, at, 100 * RANGES).alias("q"))
        shown = quantiles.select(F.transform("q", key.shown).alias("q")).head().q
        cuts, thinned = list(dict.fromkeys(shown)), False
    return (cuts[::-1] if key.descending else cuts), thinned


def _search(rows: DataFrame, key: _Key, skip: int, most: int) -> tuple[DataFrame, DataFrame | None, int]:
    """(rows that begin the answer's side, rows of one value if the offset lies in them, rows still to skip).

    The first frame has the rows of the value or range that holds row `skip`, and all after it.
    """
    prefix, here, rest = 0, rows, rows
    while skip > most:
        cuts, thinned = _cuts(here, key, prefix)
        # rows equal to a cut are a range of their own, so that a value most rows share does not hide the others
        reached = [test(key.read(cut)).cast("int") for cut in cuts for test in (key.starts, key.after)]
        place = sum(reached, F.lit(0))
        counted = here.groupBy(place.alias("range")).agg(
            F.count(F.lit(1)).alias("n"), key.shown(F.min(key.column)).alias("low"), key.shown(F.max(key.column)).alias("high")
        )
        ranges = sorted(counted.collect(), key=lambda row: row.range)
        chosen = None
        for row in ranges:
            if skip < row.n:
                chosen = row
                break
            skip -= row.n
        if chosen is None:  # the offset is beyond the last row
            return rest.limit(0), None, 0
        first, last = (chosen.high, chosen.low) if key.descending else (chosen.low, chosen.high)
        rest = rest.filter(key.starts(key.read(first)))
        if chosen.low == chosen.high:
            return rest.filter(key.after(key.read(first))), rest.filter(key.column == key.read(first)), skip
        here = here.filter(key.starts(key.read(first)) & ~key.after(key.read(last)))
        prefix += not thinned
    return rest, None, skip


def page_at_depth(
    rows: DataFrame, sort_by: str, descending: bool, limit: int, offset: int, tie: str, most_skipped: int = MOST_SKIPPED
) -> DataFrame:
    """Rows `offset` to `offset + limit` by `sort_by` and `tie`, as `records.page_records` gives them.

    No task sorts more than `most_skipped + limit` rows, rows equal in both columns aside. Each step of the
    search reads the sort columns alone, of the range the step before it left. Null keys come last
    in a descending order and first in an ascending one. Sort columns are numbers, dates,
    timestamps or texts.
    """
    keys = [_Key(name, rows.schema[name].dataType, descending) for name in ((sort_by, tie) if tie != sort_by else (sort_by,))]
    page, skip = _from(rows, keys, offset, limit, most_skipped)
    return page.orderBy(*[key.order() for key in keys]).offset(skip).limit(limit)


def _from(rows: DataFrame, keys: list[_Key], skip: int, limit: int, most: int) -> tuple[DataFrame, int]:
    """Rows that hold the page, and how many of them come before it."""
    if skip <= most or not keys:
        return rows, skip
    key, others = keys[0], keys[1:]
    absent, present = rows.filter(key.column.isNull()), rows.filter(key.column.isNotNull())
    counts = rows.agg(F.count(key.column).alias("present"), F.count_if(key.column.isNull()).alias("absent")).head()
    if not key.descending and counts.absent:
        if skip < counts.absent:
            page, left = _from(absent, others, skip, limit, most)
            return page.unionByName(present), left
        skip -= counts.absent
    elif skip >= counts.present:
        return _from(absent, others, skip - counts.present, limit, most)
    tail = absent if key.descending else rows.limit(0)
    after, tied, skip = _search(present, key, skip, most)
    if tied is not None:
        page, skip = _from(tied, others, skip, limit, most)
        after = page.unionByName(after)
    return after.unionByName(tail) if counts.absent and key.descending else after, skip
