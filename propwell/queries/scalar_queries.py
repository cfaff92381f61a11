"""Scalar functions over whole columns of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propwell.functions import canonical, markup, scalars
from propwell.queries.base import query, table
from propwell.queries.views import text


@query(
    r"""SELECT p_partkey, try_cast(nullif(regexp_replace(label, '\D', '', 'g'), '') AS BIGINT) AS price
    FROM (SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN '₪' || p_partkey || ',' || p_size
      WHEN 'PROMO' THEN '1.5M' WHEN 'STANDARD' THEN 'abc' ELSE p_name || p_size END AS label FROM part)"""
)
def normalize_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_type")
    label = (
        F.when(kind == "ECONOMY", text("₪", F.col("p_partkey"), ",", F.col("p_size")))
        .when(kind == "PROMO", "1.5M")
        .when(kind == "STANDARD", "abc")
        .otherwise(text(F.col("p_name"), F.col("p_size")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", scalars.normalize_price(label).alias("price"))


@query(
    r"""SELECT p_partkey, try_cast(replace(nullif(regexp_extract(label, '(\d+(?:[.,]\d+)?)', 1), ''),
      ',', '.') AS DOUBLE) AS rooms
    FROM (SELECT p_partkey, CASE WHEN p_size < 10 THEN 'סטודיו' WHEN p_size < 30 THEN
      p_size || ',5 חדרים' ELSE 'כ ' || p_size || '.25.' END AS label FROM part)"""
)
def normalize_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    label = (
        F.when(size < 10, "סטודיו")
        .when(size < 30, text(size, ",5 חדרים"))
        .otherwise(text("כ ", size, ".25."))
    )
    return table(spark, sf_dir, "part").select("p_partkey", scalars.normalize_rooms(label).alias("rooms"))


@query(
    r"""SELECT p_partkey, try_cast(nullif(regexp_extract(p_brand || ' ' || p_size || ',250 מ"ר',
      '(\d+)', 1), '') AS BIGINT) AS area_sqm FROM part"""
)
def normalize_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = text(F.col("p_brand"), " ", F.col("p_size"), ',250 מ"ר')
    return table(spark, sf_dir, "part").select("p_partkey", scalars.normalize_area(label).alias("area_sqm"))


@query(
    """SELECT p_partkey, CASE WHEN p_size < 5 THEN 0 WHEN p_size < 10 THEN -1
      WHEN p_size < 20 THEN NULL WHEN p_size < 30 THEN -p_size ELSE p_size END::BIGINT AS floor FROM part"""
)
def normalize_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    label = (
        F.when(size < 5, text("קומת קרקע ", size))
        .when(size < 10, text("מרתף ", size))
        .when(size < 20, "לא ידוע")
        .when(size < 30, text("קומה -", size))
        .otherwise(text("קומה ", size, " מתוך 60"))
    )
    return table(spark, sf_dir, "part").select("p_partkey", scalars.normalize_floor(label).alias("floor"))


@query(
    r"""SELECT page_id, nullif(regexp_extract(CASE WHEN url LIKE 'https%' THEN
      'https://' || page_id || '/listing/' || page_id || '?x=1' ELSE url END, '/listing/(\d+)', 1), '')
      AS listing_id FROM pages"""
)
def listing_id_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    url = F.when(
        F.col("url").startswith("https"), text("https://", page, "/listing/", page, "?x=1")
    ).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", scalars.listing_id_from_url(url).alias("listing_id"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN
      'https://www.madlan.co.il/listing/' || o_orderkey END AS listing_url FROM orders"""
)
def listing_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing_id = F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.listing_url(listing_id).alias("listing_url"))


@query(
    """SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN '' ELSE
      'https://images2.madlan.co.il/' || p_name || ' ' || 'https://images2.madlan.co.il/' || p_brand
      END AS images FROM part"""
)
def image_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = F.array("p_name", F.lit(""), F.lit(None).cast("string"), "p_brand")
    images = F.when(F.col("p_type") != "PROMO", paths)
    joined = F.array_join(scalars.image_urls(images), " ")
    return table(spark, sf_dir, "part").select("p_partkey", joined.alias("images"))


_ENTITIES_SQL = "{}"
for _entity, _sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("amp", "&")):
    _ENTITIES_SQL = f"replace({_ENTITIES_SQL}, '&{_entity};', '{_sign}')"


def _element_sql(tag: str) -> str:
    return _ENTITIES_SQL.format(f"trim(regexp_extract(html, '<{tag}>([^<]*)</{tag}>', 1))")


@query(f"SELECT page_id, {_element_sql('title')} AS title, {_element_sql('h1')} AS h1 FROM pages")
def element_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    found = markup.element_text(pages, "html", "title", "h1")
    return found.select("page_id", "elements.title", "elements.h1")


@query(
    r"""SELECT event_id, regexp_replace(regexp_replace(regexp_replace(
      regexp_replace(body, ';+$', ''), '\bundefined\b', 'null', 'g'), '\bInfinity\b', '999999999', 'g'),
      '\bNaN\b', 'null', 'g') AS cleaned
    FROM (SELECT event_id, '{"a":undefined,"b":[' || props || ',Infinity],"c":NaN,"d":"NaNs ' ||
      event_type || ' undefined"};;' AS body FROM events)"""
)
def clean_js_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = text(
        '{"a":undefined,"b":[', F.col("props"), ',Infinity],"c":NaN,"d":"NaNs ',
        F.col("event_type"), ' undefined"};;',
    )
    return table(spark, sf_dir, "events").select("event_id", scalars.clean_js_literals(body).alias("cleaned"))


@query(
    """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 180000.0 + c_custkey
      WHEN 'MACHINERY' THEN 5.0 WHEN 'HOUSEHOLD' THEN c_custkey * 2.0 + 1 END::DOUBLE AS lon,
      CASE c_mktsegment WHEN 'BUILDING' THEN 665000.5 WHEN 'MACHINERY' THEN 7.25
      WHEN 'HOUSEHOLD' THEN 3 END::DOUBLE AS lat FROM customer"""
)
def parse_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape text; x absent so lon; broken shape with x; nothing usable."""
    segment, key = F.col("c_mktsegment"), F.col("c_custkey")
    shape = (
        F.when(segment == "BUILDING", text("POINT(", key + 180000, "  665000.5)"))
        .when(segment == "MACHINERY", "")
        .when(segment == "HOUSEHOLD", "POINT(1 2 3)")
        .otherwise("POINT(x y)")
    )
    x = F.when(segment == "MACHINERY", "0").when(segment == "HOUSEHOLD", (key * 2 + 1).cast("string"))
    lon = F.when(segment == "MACHINERY", "5")
    y = F.when(segment == "MACHINERY", "7.25").when(segment == "HOUSEHOLD", "0").otherwise("9")
    lat = F.when(segment == "HOUSEHOLD", "3")
    point = scalars.parse_point(shape, x, lon, y, lat).alias("point")
    return table(spark, sf_dir, "customer").select("c_custkey", point).select(
        "c_custkey", "point.lon", "point.lat"
    )


@query(
    """SELECT c_custkey, coalesce(nullif(concat_ws(', ', nullif(c_name, ''),
      CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END, n_name, r_name), ''),
      'Unknown') AS address
    FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3
    LEFT JOIN region ON r_regionkey = n_regionkey"""
)
def format_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").filter("n_regionkey < 3")
    regions = table(spark, sf_dir, "region")
    places = nations.join(regions, nations.n_regionkey == regions.r_regionkey, "left")
    customers = table(spark, sf_dir, "customer")
    joined = customers.join(places, customers.c_nationkey == places.n_nationkey, "left")
    segment = F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment"))
    none = F.lit(None).cast("string")
    address = scalars.format_address(F.col("c_name"), none, segment, none, F.col("n_name"), F.col("r_name"))
    return joined.select("c_custkey", address.alias("address"))


@query(
    """SELECT p_partkey, p_partkey || '|' || p_size || '|' || trim(p_brand) AS ids, 3 AS n_ids FROM part"""
)
def split_id_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = text(F.col("p_partkey"), ", ,", F.col("p_size"), " ,,", F.col("p_brand"), "  ,")
    ids = scalars.split_id_list(raw)
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(ids, "|").alias("ids"), F.array_size(ids).alias("n_ids")
    )


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority
      ELSE 'P' || o_custkey END AS polygon_id FROM orders"""
)
def polygon_id_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    own = F.when(status == "F", F.col("o_orderpriority")).when(status == "O", "")
    chosen = scalars.polygon_id_default(own, text("P", F.col("o_custkey")))
    return table(spark, sf_dir, "orders").select("o_orderkey", chosen.alias("polygon_id"))


@query(
    """SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN
      json_extract(props, '$.k')::BIGINT END AS inner_value FROM events"""
)
def null_object_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing nested object, and a null one, have NULL fields."""
    body = (
        F.when(F.col("event_type").isin("click", "view"), text('{"base":', F.col("props"), "}"))
        .when(F.col("event_type") == "error", '{"base":null}')
        .otherwise("{}")
    )
    value = F.from_json(body, "base STRUCT<k: BIGINT>").getField("base").getField("k")
    return table(spark, sf_dir, "events").select("event_id", value.alias("inner_value"))


@query(
    """SELECT event_id, event_id AS price, CASE event_type WHEN 'click' THEN NULL WHEN 'view' THEN 'last'
      ELSE event_type END AS property_type, json_extract(props, '$.k')::BIGINT AS k,
      3 AS n_keys FROM events"""
)
def canonical_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two aliases of one name: the later key wins, also when it holds null."""
    kind = F.col("event_type")
    tail = (
        F.when(kind == "click", ',"dealNatureDescription":null')
        .when(kind == "view", ',"dealNatureDescription":"last"')
        .otherwise("")
    )
    body = text(
        '{"DEALAMOUNT":', F.col("event_id"), ',"propertyTypeDescription":"', kind, '"', tail,
        ',"k":', F.get_json_object("props", "$.k"), "}",
    )
    payload = canonical.canonical_rename(canonical.open_payload(body)).alias("payload")
    renamed = table(spark, sf_dir, "events").select("event_id", payload)

    def read(key: str, dtype: str):
        return F.variant_get(F.col("payload")[key], "$", dtype).alias(key)

    return renamed.select(
        "event_id", read("price", "bigint"), read("property_type", "string"), read("k", "bigint"),
        F.size("payload").alias("n_keys"),
    )


@query(
    """SELECT l_orderkey AS "type", l_quantity AS price, l_returnflag AS rooms, l_partkey, count(*) AS n
    FROM lineitem GROUP BY ALL"""
)
def canonical_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed form of the rename: of two columns with one target the last stays."""
    sheet = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("TYPE"),
        F.col("l_tax").alias("DEALAMOUNT"),
        F.col("l_returnflag").alias("ASSETROOMNUM"),
        F.col("l_quantity").alias("dealAmount"),
        "l_partkey",
    )
    renamed = canonical.canonical_columns(sheet)
    return renamed.groupBy(*renamed.columns).agg(F.count("*").alias("n"))
