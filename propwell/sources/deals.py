"""Deals around a place: place lookup -> polygons nearby -> pages of deals per polygon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propwell import fixed, schema
from propwell.functions.canonical import (
    canonical_rename,
    content_hash,
    json_map,
    let,
    with_entries,
)
from propwell.functions.json_values import as_type, field, fields, is_empty, members
from propwell.functions.scalars import parse_point
from propwell.operators.dedup import cap_per_group, first_by, first_seen_hash
from propwell.operators.joins import join_per_key
from propwell.operators.paging import cut_at_end, sequence_ends
from propwell.operators.sinks import materialize
from propwell.sources.items import items, with_run


def scan_place_responses(places: DataFrame, body: str = "body") -> DataFrame:
    """First result of each place lookup; adds `point` STRUCT<lon, lat>, NULL without one."""
    first = F.get(F.from_json(F.col(body), schema.PLACE_RESPONSE).getField("results"), 0)
    found = places.withColumn("_first", first)
    fields = [F.col(f"_first.{name}") for name in ("shape", "x", "lon", "y", "lat")]
    return found.withColumn("point", parse_point(*fields)).drop("_first")


def scan_polygon_pages(polygons: DataFrame, body: str = "body") -> DataFrame:
    """Polygon ids of bare arrays with their place in the response; anything else is empty.

    An empty id (null, '', 0) is none; members that are not objects have none either.
    """
    listed = polygons.select(
        *[name for name in polygons.columns if name != body],
        F.posexplode(members(F.try_parse_json(body))).alias("position", "_member"),
    ).withColumn("_polygon", fields(F.col("_member")))
    spellings = []
    for name in ("polygon_id", "polygonId"):
        given = field(F.col("_polygon"), name)
        spellings.append(F.when(~is_empty(given), as_type(given, "string")))
    return listed.withColumn("polygon_id", F.coalesce(*spellings)).drop("_member", "_polygon")


def scan_deal_pages(pages: DataFrame, body: str = "body") -> DataFrame:
    """One row per deal of `{"data": [...]}` or bare-array pages.

    `deal` is an open payload in landed key order. A page that holds anything else is
    empty and leaves one row without position; `failed` marks bodies that are not JSON. A member
    that is not an object counts as one of the page, and is a row with `error` and no deal.
    """
    deals = "ARRAY<MAP<STRING, VARIANT>>"
    kept = [name for name in pages.columns if name != body]
    bare = F.ltrim(F.col(body)).startswith("[")
    wrapped = F.from_json(body, f"data {deals}").getField("data")
    parsed = pages.withColumn("_deals", F.when(bare, F.from_json(body, deals)).otherwise(wrapped))
    # a list whose members are not all objects is read again, each member by itself: as text, which keeps
    # the order of keys, and as VARIANT, which tells an object from a text that looks like one
    texts = F.when(bare, F.from_json(body, "ARRAY<STRING>")).otherwise(F.from_json(body, "data ARRAY<STRING>").getField("data"))
    mixed = F.col("_deals").isNull() | F.exists("_deals", lambda d: d.isNull())
    page = F.when(mixed, F.try_parse_json(body))
    read = parsed.withColumns({"_page": page, "_texts": F.when(mixed, texts)}).withColumn(
        "_members", F.coalesce(members(F.col("_page")), members(field(fields(F.col("_page")), "data")))
    )
    one_by_one = F.zip_with(
        "_members", "_texts", lambda m, t: F.when(fields(m).isNotNull(), F.from_json(t, "MAP<STRING, VARIANT>"))
    )
    return read.select(
        *kept,
        F.col("_page").isNull().alias("_no_page"),
        mixed.alias("_mixed"),
        F.when(mixed, one_by_one).otherwise(F.col("_deals")).alias("_deals"),
    ).select(
        *kept,
        F.coalesce(F.array_size("_deals"), F.lit(0)).alias("n_on_page"),
        (F.col("_mixed") & F.col("_no_page")).alias("failed"),
        F.posexplode_outer("_deals").alias("position", "deal"),
    ).withColumn("error", F.when(F.col("position").isNotNull() & F.col("deal").isNull(), "deal is not an object"))


def add_provenance(payload: Column, requested_polygon: Column) -> Column:
    """Set `polygon_id` and `source`; both take part in the hash."""

    def marked(deal: Column) -> Column:
        given = F.try_element_at(deal, F.lit("polygon_id"))
        polygon = F.when(~is_empty(given), given).otherwise(requested_polygon.cast("variant"))
        source = F.lit(fixed.DEALS_PROVENANCE).cast("variant")
        return with_entries(deal, {"polygon_id": polygon, "source": source})

    return let(payload, marked)


#: What a sequence of pages is asked for by: a polygon, once per crawl.
SEQUENCE = ["run_id", "request_id"]


def deal_sequence_ends(rows: DataFrame, limit: int = fixed.DEALS_PAGE_LIMIT) -> DataFrame:
    """Ends of deal sequences: 404, or fewer deals than a full page."""
    gone = F.coalesce(F.col("status_code") == 404, F.lit(False))
    stop = gone | (F.col("n_on_page") < limit)
    failed = ~gone & (F.coalesce(F.col("status_code") >= 400, F.lit(False)) | F.col("failed"))
    return sequence_ends(rows, SEQUENCE, "page", stop, failed)


def asked_polygons(
    places: DataFrame, polygons: DataFrame, most: int | None = None
) -> DataFrame:
    """(unit, request_id, turn): the polygons each city with a point asks for.

    A cap, where one is given, counts members of the response before those without an id
    are dropped.
    """
    located = scan_place_responses(places).filter("point IS NOT NULL").select("unit").distinct()
    listed = scan_polygon_pages(polygons)
    if most is not None:
        listed = cap_per_group(listed, "position", most)
    return (
        listed.filter("polygon_id IS NOT NULL")
        .join(located, "unit", "left_semi")
        .select("unit", F.col("polygon_id").alias("request_id"), F.col("position").alias("turn"))
    )


def city_polygon_deals(asked: DataFrame, deals: DataFrame) -> DataFrame:
    """Deals of the polygons every city asks for.

    `deals` are rows of `scan_deal_pages` with the polygon in `request_id`. A polygon that
    several cities ask for yields its deals once per city.
    """
    return deals.drop("unit").join(asked, "request_id")


def _bad_cities(asked: DataFrame, ends: DataFrame) -> DataFrame:
    failed = ends.filter("failed").select(*SEQUENCE)
    return asked.join(failed, "request_id").select("run_id", "unit").distinct()


def failed_cities(places: DataFrame, polygons: DataFrame, rows: DataFrame) -> DataFrame:
    """(run_id, unit) of the cities that ask for a polygon whose pages break off with a bad one."""
    return _bad_cities(asked_polygons(places, polygons), deal_sequence_ends(with_run(rows)))


def collect_deals(places: DataFrame, polygons: DataFrame, rows: DataFrame) -> DataFrame:
    """Landed place and polygon pages and rows of `scan_deal_pages` -> items.

    A city that meets a bad page is left out of that crawl; of the rest, each hash comes once.
    The hash does not depend on the city, so a polygon goes to the first city that asks for it.
    """
    rows = with_run(rows)
    asked = materialize(asked_polygons(places, polygons), "asked")
    ends = deal_sequence_ends(rows)
    crawled = rows.select(*SEQUENCE).distinct().join(asked, "request_id")
    first = first_by(
        crawled.join(_bad_cities(asked, ends), ["run_id", "unit"], "left_anti"), SEQUENCE, ["unit", "turn"]
    )
    # text and hash come first, so that no shuffle holds the deal itself, which is several times as wide
    payload = add_provenance(canonical_rename(F.col("deal")), F.col("request_id"))
    texts = rows.filter("position IS NOT NULL AND error IS NULL").select(
        *SEQUENCE, "page", "position", json_map(payload, T.VariantType()).alias("payload_json")
    )
    hashed = texts.withColumn("content_hash", content_hash(F.col("payload_json")))
    told = first.join(ends, SEQUENCE, "left")
    # a file of deals is small for its rows: told to merge, Spark does not broadcast them
    found = join_per_key(hashed, told.hint("merge"), SEQUENCE, "page", how="inner").filter(
        F.col("last_page").isNull() | (~F.col("failed") & (F.col("page") <= F.col("last_page")))
    )
    collected = items(
        found,
        F.col("payload_json"),
        F.col("content_hash"),
        unit=F.col("unit"),
        request_id=F.lpad(F.col("turn").cast("string"), 10, "0"),
        page=F.col("page"),
        position=F.col("position"),
    )
    return first_seen_hash(collected)


def rejected_deals(rows: DataFrame) -> DataFrame:
    """(run_id, unit, page, error, n): bad members of the pages that count; `unit` is the polygon."""
    rows = with_run(rows)
    kept = cut_at_end(rows, deal_sequence_ends(rows), SEQUENCE, "page").filter("error IS NOT NULL")
    return kept.groupBy("run_id", F.col("request_id").alias("unit"), "page", "error").agg(F.count("*").alias("n"))
