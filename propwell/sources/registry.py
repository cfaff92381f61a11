"""Sources by name: how landed data becomes items.

Adding a source means adding a scan here; ingest is shared.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propwell import fixed
from propwell.operators.sinks import materialize
from propwell.sources import archive, deals, index_pages, listings
from propwell.sources.items import read_landed_pages

Scan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Scanned:
    """Items, (run_id, unit) of the units that were left out because they failed, and, where the
    scan tells them, (run_id, unit, page, error, n) of members that were left out by themselves."""

    items: DataFrame
    failed: DataFrame
    rejected: DataFrame | None = None


PageScan = Callable[[SparkSession, str, DataFrame], Scanned]


@dataclass(frozen=True)
class Source:
    """A named scan from a landed path to items (see `sources.items`).

    `scan_pages` does the same for some of the landed pages only, for ingest bit by bit, and
    names failed units; the pages it gets hold whole sequences.
    """

    name: str
    source_url: str
    retrieval_method: str
    scan: Scan
    pages: str = ""
    scan_pages: PageScan | None = None


_SOURCES: dict[str, Source] = {}


def register_source(
    name: str,
    scan: Scan,
    source_url: str = "",
    retrieval_method: str = "http_get",
    pages: str = "",
    scan_pages: PageScan | None = None,
) -> Source:
    """Make `scan` available under `name`; a later registration replaces an earlier one.

    `pages` is the folder of the landed path that `scan_pages` gets its pages from.
    """
    if retrieval_method not in fixed.RETRIEVAL_METHODS:
        raise ValueError(f"unknown retrieval method {retrieval_method!r}")
    _SOURCES[name] = Source(name, source_url, retrieval_method, scan, pages, scan_pages)
    return _SOURCES[name]


def get_source(name: str) -> Source:
    """The source of that name; '-' and '_' are the same."""
    try:
        return _SOURCES[name.replace("-", "_")]
    except KeyError:
        raise LookupError(f"no source {name!r}") from None


def implemented_sources(spark: SparkSession) -> DataFrame:
    """(name) of every registered source."""
    return spark.createDataFrame([(name,) for name in sorted(_SOURCES)], "name STRING")


# Parsed rows are written once to the shared scratch folder: the cut at the last page and
# the result both read them, and landed pages are far larger than their rows.


def _archive_items(spark: SparkSession, path: str) -> DataFrame:
    return archive.collect_archive(archive.scan_archive_sheets(archive.read_archives(spark, path)))


def _deal_items(spark: SparkSession, path: str, pages: DataFrame) -> Scanned:
    rows = materialize(deals.scan_deal_pages(pages), "deals")
    places, polygons = (read_landed_pages(spark, f"{path}/{name}") for name in ("places", "polygons"))
    return Scanned(deals.collect_deals(places, polygons, rows), deals.failed_cities(places, polygons, rows), deals.rejected_deals(rows))


def _index_items(spark: SparkSession, path: str, pages: DataFrame) -> Scanned:
    rows = materialize(index_pages.scan_index_rows(pages), "index")
    return Scanned(index_pages.collect_index(rows), index_pages.failed_series(rows), index_pages.rejected_entries(rows))


def _listing_items(spark: SparkSession, path: str, pages: DataFrame) -> Scanned:
    rows = materialize(listings.scan_listing_rows(pages), "listings")
    scraped_at = datetime.now(timezone.utc).isoformat()
    return Scanned(listings.collect_listings(rows, F.lit(scraped_at)), listings.failed_cities(rows))


def _register_page_source(name: str, pages: str, scan_pages: PageScan) -> None:
    def scan(spark: SparkSession, path: str) -> DataFrame:
        return scan_pages(spark, path, read_landed_pages(spark, f"{path}/{pages}".rstrip("/"))).items

    register_source(name, scan, _URLS[name], "http_get", pages, scan_pages)


_URLS = {seed[0]: seed[4] for seed in fixed.SEED_SOURCES}
register_source(fixed.ARCHIVE_SOURCE, _archive_items, _URLS[fixed.ARCHIVE_SOURCE], "zip_download")
_register_page_source(fixed.DEALS_SOURCE, "deals", _deal_items)
_register_page_source(fixed.INDEX_SOURCE, "", _index_items)
_register_page_source(fixed.LISTINGS_SOURCE, "", _listing_items)
