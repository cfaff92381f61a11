"""Where a sequence of landed pages ends.

A sequence is asked for page by page until a page says stop; landed pages after that are
not part of the result. The end is one small row per sequence, aggregated in the map
tasks and joined back by `join_per_key`, so a long sequence is never gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propwell import fixed
from propwell.operators.joins import join_per_key


def sequence_ends(
    rows: DataFrame, keys: Sequence[str], page: str, stop: Column, failed: Column | None = None
) -> DataFrame:
    """Per sequence: `last_page` (first page that stops or fails) and whether it `failed`.

    Sequences that nothing ends have no row.
    """
    failed = F.lit(False) if failed is None else F.coalesce(failed, F.lit(False))
    stop = F.coalesce(stop, F.lit(False))
    ending = rows.select(*keys, F.col(page).alias("_page"), stop.alias("_s"), failed.alias("_f"))
    # fixed-width min keeps this a hash aggregate: a failing end gets the odd number
    code = F.min(F.col("_page").cast("bigint") * 2 + F.col("_f").cast("bigint"))
    ends = ending.filter("_s OR _f").groupBy(*keys).agg(code.alias("_code"))
    return ends.select(
        *keys,
        F.floor(F.col("_code") / 2).alias("last_page"),
        (F.col("_code") % 2 == 1).alias("failed"),
    )


def cut_at_end(rows: DataFrame, ends: DataFrame, keys: Sequence[str], page: str) -> DataFrame:
    """Rows up to and including the last page; none of a failed sequence."""
    ends = ends.withColumnsRenamed({"last_page": "_last", "failed": "_bad"})
    joined = join_per_key(rows, ends, keys, page)
    inside = F.col("_last").isNull() | (~F.col("_bad") & (F.col(page) <= F.col("_last")))
    return joined.filter(inside).drop("_last", "_bad")


def page_prefix_cut(
    rows: DataFrame, keys: Sequence[str], page: str, stop: Column, failed: Column | None = None
) -> DataFrame:
    """Keep each sequence up to its stop page and leave out sequences that failed first."""
    return cut_at_end(rows, sequence_ends(rows, keys, page, stop, failed), keys, page)


def union_skip_failed(
    rows: DataFrame, keys: Sequence[str], bad: Column, spread_by: str
) -> tuple[DataFrame, DataFrame]:
    """(rows of units without a bad row, one row per failed unit)."""
    failed = rows.filter(bad).select(*keys).distinct()
    return join_per_key(rows, failed, keys, spread_by, "left_anti"), failed


def union_batches(*batches: DataFrame) -> DataFrame:
    """UNION ALL by column name; a column a batch lacks is NULL."""
    result = batches[0]
    for batch in batches[1:]:
        result = result.unionByName(batch, allowMissingColumns=True)
    return result


def listing_ends(
    rows: DataFrame,
    fresh: DataFrame,
    page_size: int = fixed.LISTINGS_PAGE_SIZE,
    max_pages: int | None = None,
    keys: Sequence[str] = ("unit",),
) -> DataFrame:
    """Ends of listing sequences: empty or short page, announced total reached, page limit.

    `rows` holds every listing (an empty page as one row without position), `fresh` the
    first occurrences. The running sum is over one row per page of a city. Without
    `max_pages` every landed page counts.
    """
    within = F.lit(True) if max_pages is None else F.col("page") <= max_pages
    pages = (
        rows.filter(within)
        .groupBy(*keys, "page")
        .agg(
            F.count("position").alias("n_on_page"),
            F.max("total").alias("total"),
            F.bool_or("failed").alias("failed"),
        )
    )
    new = fresh.filter(within).groupBy(*keys, "page").agg(F.count("*").alias("n_new"))
    counted = pages.join(new, [*keys, "page"], "left")
    so_far = F.sum(F.coalesce("n_new", F.lit(0))).over(
        Window.partitionBy(*keys).orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    )
    counted = counted.withColumn("so_far", so_far)
    stop = (
        (F.col("n_on_page") < page_size)
        | ((F.col("total") > 0) & (F.col("so_far") >= F.col("total")))
        | (F.lit(False) if max_pages is None else F.col("page") == max_pages)
    )
    return sequence_ends(counted, keys, "page", stop, F.col("failed"))


def listing_pages_cut(
    rows: DataFrame,
    fresh: DataFrame,
    page_size: int = fixed.LISTINGS_PAGE_SIZE,
    max_pages: int | None = None,
    keys: Sequence[str] = ("unit",),
) -> DataFrame:
    """First occurrences that lie on pages the sequence reaches."""
    ends = listing_ends(rows, fresh, page_size, max_pages, keys)
    within = fresh if max_pages is None else fresh.filter(F.col("page") <= max_pages)
    return cut_at_end(within, ends, keys, "page")
