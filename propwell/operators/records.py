"""Filtered, sorted and paged reads of the record store."""

from __future__ import annotations

import re
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propwell import fixed
from propwell.functions.times import at
from propwell.operators import deep_pages, segments

_RECORD_ID = re.compile(r"[0-9a-f]{24}")


def filter_records(
    records: DataFrame,
    source_name: str | None = None,
    parsing_status: str | None = None,
    job_id: str | None = None,
    ingested_after: datetime | None = None,
    ingested_before: datetime | None = None,
    *,
    ingested_at: str = "ingested_at",
) -> DataFrame:
    """Conjunction of the predicates given; None and '' mean no predicate.

    The time range is closed on both sides.
    """
    wanted = {"source_name": source_name, "parsing_status": parsing_status, "job_id": job_id}
    predicates = [F.col(name) == value for name, value in wanted.items() if value]
    if ingested_after:
        predicates.append(F.col(ingested_at) >= at(ingested_after, records.schema[ingested_at].dataType))
    if ingested_before:
        predicates.append(F.col(ingested_at) <= at(ingested_before, records.schema[ingested_at].dataType))
    return records.filter(reduce(and_, predicates)) if predicates else records


def count_records(records: DataFrame) -> DataFrame:
    """One row: `total`."""
    return records.agg(F.count("*").alias("total"))


def page_records(
    records: DataFrame,
    sort_by: str = "ingested_at",
    descending: bool = True,
    limit: int = fixed.DEFAULT_PAGE_LIMIT,
    offset: int = 0,
    tie: str = "record_id",
    max_limit: int = fixed.MAX_PAGE_LIMIT,
) -> DataFrame:
    """One page in sort order; ties follow the id. Runs as one top-k, not a full sort.

    Beyond `deep_pages.MOST_SKIPPED` rows the page is found by counting first (`deep_pages.page_at_depth`),
    so that no task sorts all that comes before it; that runs some small jobs when it is called.
    """
    if not 1 <= limit <= max_limit:
        raise ValueError(f"limit must be within 1..{max_limit}")
    if offset < 0:
        raise ValueError("offset must not be negative")
    if offset > deep_pages.MOST_SKIPPED:
        return deep_pages.page_at_depth(records, sort_by, descending, limit, offset, tie)
    order = F.col(sort_by).desc() if descending else F.col(sort_by).asc()
    tie_order = F.col(tie).desc() if descending else F.col(tie).asc()
    return records.orderBy(order, tie_order).offset(offset).limit(limit)


def page_after(
    records: DataFrame, last: dict[str, object] | None, sort_by: str = "ingested_at", descending: bool = True,
    limit: int = fixed.DEFAULT_PAGE_LIMIT, tie: str = "record_id",
) -> DataFrame:
    """The page after the row `last` (its sort and tie values), the first page without one.

    A keyset cursor: the scan starts at the cursor, and the top-k is one page wide at any depth. Both columns
    must not be null. `last` holds values as `page_records` returned them.
    """
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in (sort_by, tie)]
    if last is not None:
        at_sort, at_tie = (F.lit(last[c]).cast(records.schema[c].dataType) for c in (sort_by, tie))
        beyond = F.col(tie) < at_tie if descending else F.col(tie) > at_tie
        further = F.col(sort_by) < at_sort if descending else F.col(sort_by) > at_sort
        reached = F.col(sort_by) <= at_sort if descending else F.col(sort_by) >= at_sort
        records = records.filter(reached & (further | beyond))
    return records.orderBy(*order).limit(limit)


def page_records_with_total(records: DataFrame, **page: object) -> DataFrame:
    """A page with the count under the same predicate in `total`.

    The count is a scalar subquery: no window over all rows and no join.
    """
    total = count_records(records).scalar()
    return page_records(records, **page).withColumn("total", total)


def lookup_by_id(df: DataFrame, value: str, id_column: str = "record_id") -> DataFrame:
    """Point lookup; a malformed record id finds nothing."""
    if id_column == "record_id" and not _RECORD_ID.fullmatch(value):
        return df.filter(F.lit(False))
    return df.filter(F.col(id_column) == value)


def lookup_listing(records: DataFrame, source_name: str, listing_id: str) -> DataFrame:
    """Every stored version of one listing, by promoted columns."""
    return records.filter((F.col("source_name") == source_name) & (F.col("listing_id") == listing_id))


def listing_price_history(
    versions: DataFrame, keys: list[str], seen_at: str, tie: str, price: str, hot_rows: int = segments.MOST_ROWS
) -> DataFrame:
    """Each version with `previous_price`, its predecessor's price.

    A listing with very many versions is cut into chunks of at most `hot_rows` rows, and the last price
    of a chunk, one row, is carried to the first version of the next. Rows without a key have no
    predecessor and are left out.
    """
    chunked = segments.segmented(versions.dropna(subset=keys), keys, [seen_at, tie], hot_rows)
    return segments.segmented_lag(chunked, keys, [seen_at, tie], price, "previous_price")
