"""Listing pages: state embedded in a script, listing cards and detail pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propwell import fixed, schema
from propwell.functions import scalars
from propwell.functions.canonical import canonical_json, listing_key_hash
from propwell.functions.markup import with_elements
from propwell.operators.dedup import first_seen_listing
from propwell.operators.paging import listing_ends, listing_pages_cut
from propwell.sources.items import items, with_run

_STATE_PATH = "reduxInitialState.domainData.searchList.data.searchPoiV2"


def embedded_state_text(html: Column) -> Column:
    """JSON text assigned to the page state; later assignments may follow it."""
    found = F.regexp_extract(html, "(?d)" + fixed.EMBEDDED_STATE_PATTERN, 1)
    return scalars.clean_js_literals(F.nullif(found, F.lit("")))


def scan_embedded_state(pages: DataFrame, body: str = "body") -> DataFrame:
    """Adds `poi` (array of listings) and `total`; a page without readable state has
    an empty array and 0. The JSON reader stops after the first value."""
    state = F.from_json(embedded_state_text(F.col(body)), schema.EMBEDDED_STATE)
    for step in _STATE_PATH.split("."):
        state = state.getField(step)
    scanned = pages.withColumn("_state", state)
    return scanned.select(
        *[name for name in pages.columns if name != body],
        F.coalesce(F.col("_state.poi"), F.array().cast(f"ARRAY<{schema.LISTING}>")).alias("poi"),
        F.coalesce(F.try_variant_get("_state.total", "$", "bigint"), F.lit(0)).alias("total"),
    )


def _given(value: Column) -> Column:
    """JSON null counts as NULL."""
    return F.when(~F.is_variant_null(value), value)


def flatten_listing(
    listing: Column, city_slug: Column, scraped_at: Column
) -> list[Column]:
    """The 25 flat columns of one nested listing."""
    address = listing.getField("addressDetails")
    location = listing.getField("locationPoint")
    paths = F.transform(listing.getField("images"), lambda image: image.getField("imageUrl"))
    return [
        listing.getField("id").alias("listing_id"),
        scalars.listing_url(listing.getField("id")).alias("listing_url"),
        listing.getField("address").alias("address"),
        address.getField("city").alias("city"),
        address.getField("neighbourhood").alias("neighbourhood"),
        address.getField("streetName").alias("street_name"),
        address.getField("streetNumber").alias("street_number"),
        address.getField("district").alias("district"),
        location.getField("lat").alias("lat"),
        location.getField("lng").alias("lng"),
        _given(listing.getField("price")).alias("price"),
        _given(listing.getField("beds")).alias("rooms"),
        _given(listing.getField("floor")).alias("floor"),
        _given(listing.getField("area")).alias("area_sqm"),
        _given(listing.getField("baths")).alias("baths"),
        _given(listing.getField("buildingYear")).alias("building_year"),
        listing.getField("buildingClass").alias("building_class"),
        listing.getField("generalCondition").alias("general_condition"),
        listing.getField("dealType").alias("deal_type"),
        listing.getField("type").alias("poi_type"),
        listing.getField("firstTimeSeen").alias("first_time_seen"),
        listing.getField("lastUpdated").alias("last_updated"),
        scalars.image_urls(paths).alias("image_urls"),
        city_slug.alias("city_slug"),
        scraped_at.alias("scraped_at"),
    ]


def typed_listing(listings: DataFrame) -> DataFrame:
    """Numbers of the flat listing columns as numbers; unreadable ones are NULL."""
    types = {
        "price": "bigint", "rooms": "double", "floor": "int",
        "area_sqm": "double", "baths": "double", "building_year": "int",
    }
    return listings.withColumns(
        {name: F.try_variant_get(name, "$", dtype) for name, dtype in types.items()}
    ).withColumns(
        {name: F.try_to_timestamp(name) for name in ("first_time_seen", "last_updated")}
    )


def scan_listing_rows(pages: DataFrame) -> DataFrame:
    """Landed listing pages (city in `unit`) -> one row per listing, before any cut.

    A refused page (403) counts as empty; an empty page leaves one row without position.
    """
    refused = F.coalesce(F.col("status_code") == 403, F.lit(False))
    readable = pages.withColumn("body", F.when(~refused, F.col("body")))
    rows = scan_embedded_state(readable).select(
        *[name for name in ("run_id", "unit") if name in pages.columns],
        "page",
        (~refused & F.coalesce(F.col("status_code") >= 400, F.lit(False))).alias("failed"),
        "total",
        F.posexplode_outer("poi").alias("position", "listing"),
    )
    return rows.withColumn("listing_id", F.col("listing.id"))


#: What a sequence of pages is asked for by: a city, once per crawl.
SEQUENCE = ["run_id", "unit"]


def _fresh(rows: DataFrame) -> DataFrame:
    present = rows.filter("position IS NOT NULL")
    return first_seen_listing(present, SEQUENCE, "listing_id", ["page", "position"])


def failed_cities(rows: DataFrame) -> DataFrame:
    """(run_id, unit) of the cities whose sequence breaks off with a bad page."""
    rows = with_run(rows)
    return listing_ends(rows, _fresh(rows), keys=SEQUENCE).filter("failed").select(*SEQUENCE)


def collect_listings(rows: DataFrame, scraped_at: Column) -> DataFrame:
    """Rows of `scan_listing_rows` -> items, each listing once per city and crawl.

    A city that meets a bad page is left out of that crawl.
    """
    rows = with_run(rows)
    kept = listing_pages_cut(rows, _fresh(rows), keys=SEQUENCE)
    flat = kept.select("page", "position", *flatten_listing(F.col("listing"), F.col("unit"), scraped_at))
    fields = [name for name in flat.columns if name not in ("page", "position")]
    return items(
        flat,
        canonical_json(flat, fields),
        listing_key_hash(flat),
        unit=F.col("city_slug"),
        page=F.col("page"),
        position=F.col("position"),
        listing_id=F.col("listing_id"),
    )


def _text(name: str) -> Column:
    return F.nullif(F.col(f"_elements.{name}"), F.lit(""))


def scan_listing_cards(cards: DataFrame, html: str = "html") -> DataFrame:
    """Adds the nine typed fields of a listing card; missing ones are NULL."""
    read = with_elements(cards, html, fixed.CARD_ELEMENTS, "_elements")
    return read.select(
        *[name for name in cards.columns if name != html],
        scalars.listing_id_from_url(F.col("_elements.link")).alias("listing_id"),
        F.col("_elements.link").alias("listing_url"),
        scalars.normalize_price(_text("price")).alias("price"),
        _text("address").alias("address"),
        scalars.normalize_rooms(_text("rooms")).alias("rooms"),
        scalars.normalize_area(_text("area")).alias("area_sqm"),
        scalars.normalize_floor(_text("floor")).alias("floor"),
        _text("property_type").alias("property_type"),
        _text("neighborhood").alias("neighborhood"),
    )


def scan_listing_details(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds the six fields only the detail page has."""
    read = with_elements(pages, html, fixed.DETAIL_ELEMENTS, "_elements", images=True)
    return read.select(
        *[name for name in pages.columns if name != html],
        _text("description").alias("description"),
        _text("agent_name").alias("agent_name"),
        _text("agent_phone").alias("agent_phone"),
        _text("listing_date").alias("listing_date"),
        scalars.normalize_floor(_text("total_floors")).alias("total_floors"),
        F.coalesce(F.col("_elements.images"), F.array().cast("array<string>")).alias("image_urls"),
    )
