"""Scans: landed payloads are built from the given tables row by row, then read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propwell.fixed import LISTINGS_PAGE_SIZE
from propwell.functions.canonical import canonical_rename, open_payload
from propwell.operators.paging import page_prefix_cut as cut_pages
from propwell.operators.paging import union_batches as union_by_name
from propwell.operators.sinks import materialize
from propwell.operators.spread import spread
from propwell.queries.base import query, table
from propwell.queries.views import text
from propwell.queries.workbooks import ARCHIVE, customer_archives
from propwell.sources import archive, deals, index_pages, listings

_KEEP_NULLS = {"ignoreNullFields": "false"}


def _null(dtype: str) -> Column:
    return F.lit(None).cast(dtype)


# spreadsheet archives


def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return spread(customers).mapInPandas(customer_archives, ARCHIVE)


@query("SELECT c_custkey AS price, c_name AS full_address, c_mktsegment AS block, 3 AS n_keys FROM customer")
def scan_archive_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two equal headers the last column wins; a column without header is left out."""
    rows = archive.scan_archive_sheets(_archives(spark, sf_dir))
    payload = rows.select(canonical_rename(open_payload(F.col("cells"))).alias("payload"))

    def read(key: str, dtype: str) -> Column:
        return F.variant_get(F.col("payload")[key], "$", dtype).alias(key)

    return payload.select(
        read("price", "bigint"), read("full_address", "string"), read("block", "string"),
        F.size("payload").alias("n_keys"),
    )


@query(
    """SELECT sha256('{"block": "' || c_mktsegment || '", "full_address": "' || c_name ||
      '", "price": ' || c_custkey || '}') AS content_hash FROM customer"""
)
def collect_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archive.scan_archive_sheets(_archives(spark, sf_dir))
    return archive.collect_archive(rows).select("content_hash")


# price-index pages


def _index_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per line: a month entry and a quarter entry of the order's series.

    Years of some pages are sent as text; some lists have a member that is no entry.
    """
    shipped, series = F.col("l_shipdate"), F.col("l_orderkey").cast("string")

    def one(*point: Column) -> Column:
        entry = F.struct(F.year(shipped).alias("year"), *point)
        return F.array(
            F.struct(series.alias("code"), F.col("l_returnflag").alias("name"), F.array(entry).alias("date"))
        )

    month = one(
        F.month(shipped).alias("month"),
        F.col("l_linestatus").alias("monthDesc"),
        F.col("l_discount").alias("percent"),
        F.struct(F.col("l_quantity").alias("value"), F.col("l_returnflag").alias("baseDesc")).alias("currBase"),
    )
    quarter = one(
        F.quarter(shipped).alias("quarter"),
        F.col("l_linestatus").alias("quarterDesc"),
        F.col("l_tax").alias("percentYear"),
        F.struct(F.col("l_quantity").alias("value")).alias("prevBase"),
    )
    successor = F.when(F.col("l_returnflag") != "R", "next")
    body = F.struct(
        F.when(F.col("l_linestatus") == "F", month).alias("month"),
        quarter.alias("quarter"),
        F.struct(successor.alias("next_url")).alias("paging"),
    )
    sent = F.to_json(body)
    # numbers as text, and members that are no entry
    sent = F.when(F.col("l_returnflag") == "A", F.regexp_replace(sent, r'"year":(\d+)', r'"year":"$1"')).otherwise(sent)
    sent = F.when(F.col("l_quantity") == 49, F.replace(sent, F.lit('"date":['), F.lit('"date":[7,'))).otherwise(sent)
    return table(spark, sf_dir, "lineitem").select(
        series.alias("unit"),
        _null("string").alias("request_id"),
        F.col("l_linenumber").alias("page"),
        F.when((F.col("l_quantity") == 50) & (F.col("l_tax") > 0.05), 500).otherwise(200).alias("status_code"),
        sent.alias("body"),
    )


_ENTRIES_SQL = """(SELECT l_orderkey::VARCHAR AS series_code, l_returnflag AS series_name,
    'month' AS period_type, year(l_shipdate)::INTEGER AS year, l_discount AS percent_change,
    NULL::DOUBLE AS percent_change_annual, l_quantity AS current_base,
    l_returnflag AS base_description, NULL::DOUBLE AS previous_base, 'cbs' AS source,
    month(l_shipdate)::INTEGER AS month, l_linestatus AS month_name_he, NULL::INTEGER AS quarter,
    NULL::VARCHAR AS "quarterDesc", l_linenumber AS page,
    l_quantity = 50 AND l_tax > 0.05 AS broken FROM lineitem WHERE l_linestatus = 'F'
  UNION ALL SELECT l_orderkey::VARCHAR, l_returnflag, 'quarter', year(l_shipdate)::INTEGER, NULL,
    l_tax, NULL, NULL, l_quantity, 'cbs', NULL, NULL, quarter(l_shipdate)::INTEGER, l_linestatus,
    l_linenumber, l_quantity = 50 AND l_tax > 0.05 FROM lineitem)"""


@query(
    """SELECT l_orderkey::VARCHAR AS unit, l_linenumber AS page,
      CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS n_month, 1 AS n_quarter,
      CASE WHEN l_returnflag <> 'R' THEN 'next' END AS next_url, false AS failed FROM lineitem"""
)
def scan_index_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = index_pages.scan_index_pages(_index_pages(spark, sf_dir))
    return scanned.select(
        "unit",
        "page",
        F.array_size("months").alias("n_month"),
        F.array_size("quarters").alias("n_quarter"),
        "next_url",
        "failed",
    )


@query(f"SELECT * EXCLUDE (page, broken) FROM {_ENTRIES_SQL}")
def flatten_index_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = index_pages.index_view(index_pages.scan_index_rows(_index_pages(spark, sf_dir)))
    return rows.drop("unit", "request_id", "page", "status_code", "failed", "next_url", "position")


def _sent_number(column: str) -> str:
    return f"regexp_replace({column}::VARCHAR, '\\.0$', '')"


_INDEX_HASH_SQL = f"""sha256(CASE period_type WHEN 'month' THEN
    '{{"base_description": "' || base_description || '", "current_base": ' || {_sent_number("current_base")} ||
    ', "month": ' || month || ', "month_name_he": "' || month_name_he || '", "percent_change": ' ||
    {_sent_number("percent_change")} || ', "percent_change_annual": null, "period_type": "month", "previous_base": null'
    ELSE '{{"base_description": null, "current_base": null, "percent_change": null, ' ||
    '"percent_change_annual": ' || {_sent_number("percent_change_annual")} || ', "period_type": "quarter", ' ||
    '"previous_base": ' || {_sent_number("previous_base")} || ', "quarter": ' || quarter || ', "quarterDesc": "' ||
    "quarterDesc" || '"' END || ', "series_code": "' || series_code || '", "series_name": "' ||
    series_name || '", "source": "cbs", "year": ' || CASE series_name WHEN 'A' THEN '"' || year || '"' ELSE year::VARCHAR END || '}}')"""


@query(
    f"""WITH ends AS (SELECT l_orderkey::VARCHAR AS series_code, min(l_linenumber) AS last_page
      FROM lineitem WHERE l_returnflag = 'R' OR (l_quantity = 50 AND l_tax > 0.05) GROUP BY 1)
    SELECT series_code AS unit, page::BIGINT AS page, {_INDEX_HASH_SQL} AS content_hash
    FROM {_ENTRIES_SQL} LEFT JOIN ends USING (series_code)
    WHERE NOT broken AND (last_page IS NULL OR page <= last_page)"""
)
def collect_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series cut at the first broken page or page without a successor, then hashed."""
    rows = materialize(index_pages.scan_index_rows(_index_pages(spark, sf_dir)), "index")
    return index_pages.collect_index(rows).select("unit", "page", "content_hash")


@query(
    """WITH ends AS (SELECT l_orderkey, min(l_linenumber) AS last_page
      FROM lineitem WHERE l_returnflag = 'R' OR (l_quantity = 50 AND l_tax > 0.05) GROUP BY 1)
    SELECT l_orderkey::VARCHAR AS unit, l_linenumber AS page, 'entry is not an object' AS error,
      sum(CASE l_linestatus WHEN 'F' THEN 2 ELSE 1 END)::BIGINT AS n FROM lineitem LEFT JOIN ends USING (l_orderkey)
    WHERE l_quantity = 49 AND (last_page IS NULL OR l_linenumber <= last_page) GROUP BY 1, 2"""
)
def rejected_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the log gets of members that are no entry."""
    rows = materialize(index_pages.scan_index_rows(_index_pages(spark, sf_dir)), "index")
    return index_pages.rejected_entries(rows).drop("run_id")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
    LEFT JOIN (SELECT l_orderkey, min(l_linenumber) AS last_page FROM lineitem
      WHERE l_returnflag = 'R' GROUP BY 1) USING (l_orderkey)
    WHERE last_page IS NULL OR l_linenumber <= last_page"""
)
def page_prefix_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"
    )
    stop = F.col("l_returnflag") == "R"
    return cut_pages(lines, ["l_orderkey"], "l_linenumber", stop).drop("l_returnflag")


@query(
    """SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment, NULL::VARCHAR AS brand FROM customer
    UNION ALL SELECT s_suppkey, s_name, NULL, NULL FROM supplier
    UNION ALL SELECT p_partkey, p_name, NULL, p_brand FROM part"""
)
def union_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_by_name(
        table(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
        ),
        table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("key")),
        table(spark, sf_dir, "part").select(
            F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand")
        ),
    )


# deals


@query(
    """SELECT event_id, i + CASE WHEN event_id % 5 = 0 THEN i ELSE 0 END AS position, event_id + i AS price,
      event_type AS property_type, CASE WHEN event_id % 5 = 0 THEN 4 ELSE 2 END AS n_on_page
    FROM events, (VALUES (0), (1)) AS n(i) WHERE event_type NOT IN ('signup', 'error')"""
)
def scan_deal_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare arrays, wrapped arrays, a null list and a body that is neither; members that are no deal."""
    kind, key = F.col("event_type"), F.col("event_id")

    def deal(amount: Column) -> Column:
        return F.struct(amount.alias("dealAmount"), kind.alias("dealNatureDescription"))

    both = F.array(deal(key), deal(key + 1))
    body = (
        F.when(kind == "click", F.to_json(both))
        .when(kind == "signup", '{"data": null, "total": 0}')
        .when(kind == "error", '"oops"')
        .otherwise(F.to_json(F.struct(both.alias("data"))))
    )
    spoilt = F.replace(F.replace(body, F.lit("},{"), F.lit('},"gone",{')), F.lit("}]"), F.lit("},[1]]"))
    body = F.when((key % 5 == 0) & ~kind.isin("signup", "error"), spoilt).otherwise(body)
    pages = table(spark, sf_dir, "events").select("event_id", body.alias("body"))
    rows = deals.scan_deal_pages(pages).filter("position IS NOT NULL AND error IS NULL")
    payload = rows.select("event_id", "position", "n_on_page", canonical_rename(F.col("deal")).alias("payload"))
    return payload.select(
        "event_id",
        "position",
        F.variant_get(F.col("payload")["price"], "$", "bigint").alias("price"),
        F.variant_get(F.col("payload")["property_type"], "$", "string").alias("property_type"),
        "n_on_page",
    )


@query(
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'own' ELSE 'P' || user_id END AS polygon_id,
      'govmap' AS source, 3 AS n_keys FROM events"""
)
def add_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payload's own polygon stays; missing, null and empty ones are filled."""
    kind = F.col("event_type")
    own = (
        F.when(kind == "click", ',"polygonId":"own"')
        .when(kind == "view", ',"polygonId":null')
        .when(kind == "error", ',"polygonId":""')
        .otherwise("")
    )
    body = text('{"dealAmount":', F.col("event_id"), own, "}")
    payload = canonical_rename(open_payload(body))
    marked = table(spark, sf_dir, "events").select(
        "event_id", deals.add_provenance(payload, text("P", F.col("user_id"))).alias("payload")
    )
    return marked.select(
        "event_id",
        F.variant_get(F.col("payload")["polygon_id"], "$", "string").alias("polygon_id"),
        F.variant_get(F.col("payload")["source"], "$", "string").alias("source"),
        F.size("payload").alias("n_keys"),
    )


def _polygon_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response per customer: two spellings of an id and a member without one."""
    key = F.col("c_custkey")
    body = text('[{"polygon_id":"P', key, '"},{"x":1},{"polygonId":', key, "}]")
    return table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("string").alias("unit"),
        "c_custkey",
        F.when(F.col("c_mktsegment") == "BUILDING", '{"error": "none"}').otherwise(body).alias("body"),
    )


@query(
    """SELECT c_custkey, position, CASE position WHEN 0 THEN 'P' || c_custkey ELSE c_custkey::VARCHAR END
      AS polygon_id FROM customer, (VALUES (0), (2)) AS n(position) WHERE c_mktsegment <> 'BUILDING' AND (position = 0 OR c_custkey <> 0)"""
)
def scan_polygon_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = deals.scan_polygon_pages(_polygon_pages(spark, sf_dir))
    return listed.filter("polygon_id IS NOT NULL").drop("unit")


def _place_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    point = text('{"results":[{"shape":"POINT(', key + 180000, ' 665000.5)","x":1,"y":2},{"x":9}]}')
    body = (
        F.when(F.col("c_mktsegment") == "BUILDING", point)
        .when(F.col("c_mktsegment") == "MACHINERY", text('{"results":[{"x":0,"lon":', key + 1, ',"lat":"7.5"}]}'))
        .when(F.col("c_mktsegment") == "HOUSEHOLD", '{"results":[]}')
        .otherwise('["not an object"]')
    )
    return table(spark, sf_dir, "customer").select("c_custkey", body.alias("body"))


@query(
    """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 180000.0 + c_custkey
      WHEN 'MACHINERY' THEN c_custkey + 1 END::DOUBLE AS lon, CASE c_mktsegment
      WHEN 'BUILDING' THEN 665000.5 WHEN 'MACHINERY' THEN 7.5 END::DOUBLE AS lat FROM customer"""
)
def scan_place_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deals.scan_place_responses(_place_pages(spark, sf_dir))
    return found.select("c_custkey", "point.lon", "point.lat")


def _deal_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nations as cities, customers as polygons, orders as deals."""
    located = text('{"results":[{"shape":"POINT(', F.col("n_nationkey") + 1, ' 2)"}]}')
    places = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("string").alias("unit"),
        F.when(F.col("n_regionkey") == 0, '{"results":[]}').otherwise(located).alias("body"),
    )
    status = F.col("o_orderstatus")
    deal = F.struct(
        F.col("o_orderkey").alias("dealAmount"),
        status.alias("dealNatureDescription"),
        F.when(status != "P", F.col("o_orderpriority")).alias("propertyTypeDescription"),
        F.when(status == "F", "own").alias("polygonId"),
        F.col("o_custkey").alias("extra"),
    )
    pages = table(spark, sf_dir, "orders").select(
        _null("string").alias("unit"),
        text("P", F.col("o_custkey")).alias("request_id"),
        F.lit(1).alias("page"),
        F.lit(200).alias("status_code"),
        F.to_json(F.array(deal), _KEEP_NULLS).alias("body"),
    )
    return places, _polygon_pages(spark, sf_dir), deals.scan_deal_pages(pages)


_ASKED_SQL = """orders JOIN customer ON c_custkey = o_custkey AND c_mktsegment <> 'BUILDING'
    JOIN nation ON n_nationkey = c_nationkey AND n_regionkey <> 0"""


@query(
    f"""SELECT c_nationkey::VARCHAR AS unit, 'P' || o_custkey AS request_id, o_orderkey AS price
    FROM {_ASKED_SQL}"""
)
def city_polygon_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    places, polygons, rows = _deal_rows(spark, sf_dir)
    found = deals.city_polygon_deals(deals.asked_polygons(places, polygons), rows)
    price = F.variant_get(F.col("deal")["dealAmount"], "$", "bigint").alias("price")
    return found.select("unit", "request_id", price)


@query(
    f"""SELECT c_nationkey::VARCHAR AS unit, sha256('{{"extra": ' || o_custkey || ', "polygon_id": "' ||
      CASE WHEN o_orderstatus = 'F' THEN 'own' ELSE 'P' || o_custkey END || '", "price": ' ||
      o_orderkey || ', "property_type": ' || CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE
      '"' || o_orderpriority || '"' END || ', "source": "govmap"}}') AS content_hash FROM {_ASKED_SQL}"""
)
def collect_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    places, polygons, rows = _deal_rows(spark, sf_dir)
    return deals.collect_deals(places, polygons, materialize(rows, "deals")).select("unit", "content_hash")


# listings


def _listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose script assigns the state on a line that goes on with other assignments."""
    key = F.col("p_partkey").cast("string")
    listing = F.struct(
        key.alias("id"),
        F.concat(F.col("p_name"), F.lit(" {street}")).alias("address"),
        F.col("p_size").alias("price"),
        F.struct(F.col("p_brand").alias("city"), F.col("p_type").alias("neighbourhood")).alias("addressDetails"),
        F.when(
            F.col("p_type") != "PROMO",
            F.struct((F.col("p_size") + 0.5).alias("lat"), (F.col("p_size") * 2 + 0.25).alias("lng")),
        ).alias("locationPoint"),
        F.array(F.struct(F.col("p_brand").alias("imageUrl")), F.struct(F.lit("").alias("imageUrl"))).alias("images"),
    )
    state = text(
        '{"flags":{"a":undefined,"b":Infinity},"reduxInitialState":{"domainData":{"searchList":{"data":'
        '{"searchPoiV2":{"total":', F.col("p_size") % 7, ',"poi":[', F.to_json(listing),
        "]}}}}}}",
    )
    page = text(
        "<html><head><script>\nvar a = 1;\nwindow.__SSR_HYDRATED_CONTEXT__ = ", state,
        ';window.other = {"reduxInitialState":{}};</script></head></html>',
    )
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("unit"),
        _null("string").alias("request_id"),
        F.col("p_size").alias("page"),
        F.when(F.col("p_type") == "STANDARD", 403).otherwise(200).alias("status_code"),
        F.when(F.col("p_type") == "ECONOMY", "<html>no state</html>").otherwise(page).alias("body"),
    )


@query(
    """SELECT p_brand AS unit, p_size AS page, p_size % 7 AS total, p_partkey::VARCHAR AS listing_id,
      p_size::BIGINT AS price FROM part WHERE p_type <> 'ECONOMY'
    UNION ALL SELECT p_brand, p_size, 0, NULL, NULL FROM part WHERE p_type = 'ECONOMY'""".replace(
        "p_size % 7 AS total", "(p_size % 7)::BIGINT AS total"
    )
)
def scan_embedded_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = listings.scan_embedded_state(_listing_pages(spark, sf_dir))
    rows = scanned.select("unit", "page", "total", F.explode_outer("poi").alias("listing"))
    return rows.select(
        "unit", "page", "total",
        F.col("listing.id").alias("listing_id"),
        F.variant_get("listing.price", "$", "bigint").alias("price"),
    )


@query(
    """SELECT p_partkey::VARCHAR AS listing_id, 'https://www.madlan.co.il/listing/' || p_partkey
      AS listing_url, p_name || ' {street}' AS address, p_brand AS city, p_type AS neighbourhood,
      CASE WHEN p_type <> 'PROMO' THEN p_size + 0.5 END::DOUBLE AS lat,
      CASE WHEN p_type <> 'PROMO' THEN p_size * 2 + 0.25 END::DOUBLE AS lng,
      p_size::BIGINT AS price, 'https://images2.madlan.co.il/' || p_brand AS image_urls,
      p_brand AS city_slug, 25 AS n_columns FROM part WHERE p_type <> 'ECONOMY'"""
)
def flatten_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = listings.scan_embedded_state(_listing_pages(spark, sf_dir))
    rows = scanned.select("unit", F.explode("poi").alias("listing"))
    flat = rows.select(*listings.flatten_listing(F.col("listing"), F.col("unit"), _null("string")))
    return listings.typed_listing(flat).select(
        "listing_id", "listing_url", "address", "city", "neighbourhood", "lat", "lng", "price",
        F.array_join("image_urls", " ").alias("image_urls"),
        "city_slug",
        F.lit(len(flat.columns)).alias("n_columns"),
    )


@query(
    f"""WITH rows AS (SELECT *, p_type NOT IN ('ECONOMY', 'STANDARD') AS present FROM part),
    pages AS (SELECT p_brand, p_size, count(*) FILTER (present) AS n,
      max(CASE WHEN present THEN p_size % 7 ELSE 0 END) AS total FROM rows GROUP BY 1, 2),
    counted AS (SELECT *, sum(n) OVER (PARTITION BY p_brand ORDER BY p_size) AS so_far FROM pages),
    ends AS (SELECT p_brand, min(p_size) AS last_page FROM counted
      WHERE n < {LISTINGS_PAGE_SIZE} OR (total > 0 AND so_far >= total) GROUP BY 1)
    SELECT p_brand AS unit, p_size::BIGINT AS page, p_partkey::VARCHAR AS listing_id,
      sha256('{{"address": "' || p_name || ' {{street}}", "listing_id": "' || p_partkey ||
        '", "price": ' || p_size || '}}') AS content_hash
    FROM rows LEFT JOIN ends USING (p_brand) WHERE present AND (last_page IS NULL OR p_size <= last_page)"""
)
def collect_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of the pages each city's sequence reaches, with the hash of their version."""
    rows = materialize(listings.scan_listing_rows(_listing_pages(spark, sf_dir)), "listings")
    collected = listings.collect_listings(rows, _null("string"))
    return collected.select("unit", "page", "listing_id", "content_hash")


@query(
    """SELECT p_partkey, p_partkey::VARCHAR AS listing_id, 'https://example.org/listing/' || p_partkey
      AS listing_url, (p_size * 1000 + 7)::BIGINT AS price, p_name AS address, p_size + 0.5 AS rooms,
      p_size::BIGINT AS area_sqm, CASE WHEN p_type = 'PROMO' THEN 0 ELSE p_size END::BIGINT AS floor,
      p_type AS property_type, CASE WHEN p_type = 'ECONOMY' THEN NULL ELSE p_brand || ' & co' END
      AS neighborhood FROM part""".replace("p_size + 0.5 AS", "(p_size + 0.5)::DOUBLE AS")
)
def scan_listing_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards with plain, nested and missing elements."""
    size, kind = F.col("p_size"), F.col("p_type")
    price = text("₪", size, ",007")
    card = text(
        '<div data-testid="feed-item"><a class="c" href="https://example.org/listing/', F.col("p_partkey"),
        '">', F.col("p_name"), "</a>",
        F.when(kind == "STANDARD", text("<div data-testid='price'><div><b>", price, "</b></div></div>"))
        .otherwise(text('<div class="p" data-testid="price"> ', price, " </div>")),
        '<span data-testid="address">', F.col("p_name"), '</span><span data-testid="rooms">', size,
        ',5 חדרים</span><span data-testid="floor-size">', size, ' מ"ר</span><span data-testid="floor">',
        F.when(kind == "PROMO", "קרקע").otherwise(text("קומה ", size)),
        '</span><p data-testid="asset-classification">', kind, "</p>",
        F.when(kind == "ECONOMY", "").otherwise(
            text('<p data-testid="neighborhood">', F.col("p_brand"), " &amp; co</p>")
        ),
        "</div>",
    )
    cards = spread(table(spark, sf_dir, "part")).select("p_partkey", card.alias("html"))
    return listings.scan_listing_cards(cards)


@query(
    """SELECT c_custkey, c_mktsegment || ' <quiet>' AS description, c_name AS agent_name,
      NULL::VARCHAR AS agent_phone, '2024-01-01' AS listing_date, (c_custkey % 40)::BIGINT AS total_floors,
      CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE 'a' || c_custkey || '.jpg b.jpg' END AS image_urls
    FROM customer"""
)
def scan_listing_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    gallery = text(
        '<div data-testid="image-gallery"><p><img src="a', key, '.jpg"><img src=""><img>',
        '<p><img src="b.jpg"/></div><img src="elsewhere.jpg">',
    )
    page = text(
        '<!DOCTYPE html><html><head><script>var t = "<p data-testid=\'description\'>no</p>";</script></head>',
        '<body><!-- <p data-testid="agent-name">no</p> --><p data-testid="description">',
        F.col("c_mktsegment"), ' &lt;quiet&gt;</p><b data-testid="agent-name">', F.col("c_name"),
        '</b><i data-testid="agent-phone"> </i><i data-testid="listing-date">2024-01-01</i>',
        '<i data-testid="total-floors">קומות ', key % 40, "</i>",
        F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(gallery), "</body></html>",
    )
    pages = spread(table(spark, sf_dir, "customer")).select("c_custkey", page.alias("html"))
    details = listings.scan_listing_details(pages)
    return details.withColumn("image_urls", F.array_join("image_urls", " "))
