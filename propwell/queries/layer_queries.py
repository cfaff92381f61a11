"""Map-layer queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propwell.functions import geometry as geo
from propwell.operators import box_join, layers, sinks
from propwell.queries.base import query, table
from propwell.queries.views import PLACED_SQL, placed_customers, text
from propwell.session import scratch_path
from propwell.sources import store

_BOX = geo.BBox(min_lat=31.5, max_lat=32.5, min_lng=34.5, max_lng=35.0)
_INSIDE = "lng BETWEEN 34.5 AND 35.0 AND lat BETWEEN 31.5 AND 32.5"


# layer configuration

_LAYER_COLUMNS = """lower(r_name) AS id, r_name AS name, 'line' AS type, '#000000' AS color,
    lower(r_name) AS source, NULL::DOUBLE AS min_zoom, 12::DOUBLE AS max_zoom, 0.5::DOUBLE AS opacity"""


def _region_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("r_name")
    return table(spark, sf_dir, "region").select(
        F.lower(name).alias("id"), name.alias("name"), F.lit("line").alias("type"),
        F.lit("#000000").alias("color"), F.lower(name).alias("source"),
        F.lit(None).cast("double").alias("min_zoom"), F.lit(12.0).alias("max_zoom"),
        F.lit(0.5).alias("opacity"),
    )


@query(
    f"""SELECT 'configured' AS branch, {_LAYER_COLUMNS} FROM region
    UNION ALL VALUES
      ('empty', 'properties', 'Properties', 'fill', '#3388ff', 'properties', NULL, NULL, 0.7),
      ('empty', 'districts', 'Districts', 'line', '#ff6b6b', 'districts', NULL, NULL, 0.9)"""
)
def scan_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both branches: configured layers, and the defaults where the table is empty."""
    configs, defaults = _region_layers(spark, sf_dir), layers.default_layers(spark)
    none = configs.filter("id = 'atlantis'")
    configured = layers.scan_layers(configs, defaults).withColumn("branch", F.lit("configured"))
    empty = layers.scan_layers(none, defaults).withColumn("branch", F.lit("empty"))
    return configured.unionByName(empty)


@query(
    """SELECT count(DISTINCT c_mktsegment) AS n_layers,
      bool_or(c_mktsegment = 'BUILDING') AS properties_ready FROM customer"""
)
def layer_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One layer per market segment, one of them named like the property layer."""
    segment = F.col("c_mktsegment")
    layer_id = F.when(segment == "BUILDING", "properties").otherwise(F.lower(segment))
    return layers.layer_kpis(table(spark, sf_dir, "customer").select(layer_id.alias("id")).distinct())


@query(
    """SELECT c_custkey, lower(c_mktsegment) AS layer_id FROM customer
    WHERE c_mktsegment IN (SELECT upper(CASE r_name WHEN 'ASIA' THEN 'building'
      WHEN 'AFRICA' THEN 'machinery' ELSE r_name END) FROM region)"""
)
def layer_exists_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.when(F.col("name") == "ASIA", "building").when(F.col("name") == "AFRICA", "machinery")
    configured = _region_layers(spark, sf_dir).withColumn("id", F.coalesce(named, "id"))
    requests = table(spark, sf_dir, "customer").select(
        "c_custkey", F.lower("c_mktsegment").alias("layer_id")
    )
    return layers.layer_exists_semijoin(requests, configured)


@query(f"SELECT c_custkey, lng, lat FROM {PLACED_SQL} WHERE {_INSIDE}")
def scan_layer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the property layer sorted by place, find it through the default layers, box it."""
    root = scratch_path(spark, "layers")
    placed = placed_customers(spark, sf_dir).select("c_custkey", "lng", "lat")
    sinks.save_layer(placed, f"{root}/properties")
    offered = layers.default_layers(spark)
    features = store.scan_layer_features(spark, offered, "properties", root)
    return layers.bbox_filter(features, _BOX)


@query("SELECT n_name, n_regionkey FROM nation")
def drop_internal_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "_id")
    return layers.drop_internal_id(stored)


# boxes


@query(f"SELECT c_custkey, lng, lat FROM {PLACED_SQL} WHERE {_INSIDE}")
def bbox_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.bbox_filter(placed_customers(spark, sf_dir), _BOX).select("c_custkey", "lng", "lat")


@query(f"SELECT c_custkey, lng, lat FROM {PLACED_SQL} WHERE {_INSIDE} ORDER BY c_custkey LIMIT 100")
def bbox_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = layers.bbox_filter(placed_customers(spark, sf_dir), _BOX)
    return layers.bbox_limit(inside.select("c_custkey", "lng", "lat"), ["c_custkey"], 100)


@query(
    f"""SELECT c_custkey, lng - 0.1 AS min_lng, lng + 0.1 AS max_lng, lat - 0.1 AS min_lat,
      lat AS max_lat FROM {PLACED_SQL}
    WHERE lng - 0.1 >= 34.5 AND lng + 0.1 <= 35.0 AND lat - 0.1 >= 31.5 AND lat <= 32.5"""
)
def bbox_filter_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles around each place, inside with every corner."""
    lng, lat = F.col("lng"), F.col("lat")
    corners = F.array(
        F.array(
            F.array(lng - 0.1, lat), F.array(lng + 0.1, lat), F.array(lng, lat - 0.1), F.array(lng - 0.1, lat)
        )
    )
    shape = F.struct(F.lit("Polygon").alias("type"), F.to_variant_object(corners).alias("coordinates"))
    shapes = placed_customers(spark, sf_dir).select("c_custkey", shape.alias("geometry"))
    bounded = layers.with_bounds(shapes).drop("geometry")
    return layers.bbox_filter_bounds(bounded, _BOX)


# of every size from a street to the whole map, some empty, some a single place
_BOXES_SQL = """(SELECT s_suppkey, lng AS min_lng, lat AS min_lat, lng + wide AS max_lng, lat + high AS max_lat
  FROM (SELECT s_suppkey, 34 + (s_suppkey * 7 % 180)::DOUBLE / 100 AS lng,
    31 + (s_suppkey * 11 % 280)::DOUBLE / 100 AS lat, (s_suppkey % 23 - 1)::DOUBLE / 50 AS wide,
    (s_suppkey % 29)::DOUBLE / 40 AS high FROM supplier)
  UNION ALL SELECT -1, -180, -90, 180, 90)"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    lng = F.lit(34) + (key * 7 % 180).cast("double") / 100
    lat = F.lit(31) + (key * 11 % 280).cast("double") / 100
    boxes = table(spark, sf_dir, "supplier").select(
        "s_suppkey", lng.alias("min_lng"), lat.alias("min_lat"),
        (lng + (key % 23 - 1).cast("double") / 50).alias("max_lng"),
        (lat + (key % 29).cast("double") / 40).alias("max_lat"),
    )
    globe = spark.range(1).selectExpr("-1 s_suppkey", "-180d min_lng", "-90d min_lat", "180d max_lng", "90d max_lat")
    return boxes.unionByName(globe)


@query(
    f"""SELECT s_suppkey, c_custkey FROM {_BOXES_SQL} JOIN {PLACED_SQL}
      ON lng BETWEEN min_lng AND max_lng AND lat BETWEEN min_lat AND max_lat"""
)
def bbox_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier's box, and the whole map, against every customer's place."""
    places = placed_customers(spark, sf_dir).select("c_custkey", "lng", "lat")
    return box_join.bbox_join(places, _boxes(spark, sf_dir)).select("s_suppkey", "c_custkey")


@query(
    """SELECT c_custkey, CASE WHEN a NOT BETWEEN -90 AND 90 THEN 'min_lat'
      WHEN b NOT BETWEEN -90 AND 90 THEN 'max_lat' WHEN c NOT BETWEEN -180 AND 180 THEN 'min_lng'
      WHEN d NOT BETWEEN -180 AND 180 THEN 'max_lng' WHEN b < a THEN 'max_lat' WHEN d < c THEN 'max_lng'
      WHEN c_mktsegment = 'BUILDING' THEN 'layer_id' ELSE 'ok' END AS verdict
    FROM (SELECT *, c_custkey % 211 - 100 AS a, c_custkey % 203 - 100 AS b, c_custkey % 389 - 180 AS c,
      c_custkey % 397 - 180 AS d FROM customer)"""
)
def validate_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")

    def axis(spread: int, lowest: int) -> Column:
        return (key % spread - lowest).cast("double")

    layer_id = F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment"))
    verdict = geo.bbox_verdict(axis(211, 100), axis(203, 100), axis(389, 180), axis(397, 180), layer_id)
    return table(spark, sf_dir, "customer").select("c_custkey", verdict.alias("verdict"))


_KINDS = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "Circle")


@query(
    """SELECT p_partkey, (p_size % 7 = 0 AND p_size % 3 = 0) OR (p_size % 7 = 1 AND p_size % 3 = 1)
      OR (p_size % 7 = 2 AND p_size % 3 = 2) OR (p_size % 7 = 3 AND p_size % 3 = 1)
      OR (p_size % 7 = 4 AND p_size % 3 = 2) OR p_size = 50 AS valid FROM part"""
)
def geometry_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind meets coordinates of its own and of other depths."""
    size = F.col("p_size")
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (size % 7 + 1).cast("int"))
    position = text("[", size, ", 31.5]")
    coordinates = (
        F.when(size % 3 == 0, position)
        .when(size % 3 == 1, text("[", position, ", [1, 2]]"))
        .otherwise(text("[[", position, ", [1, 2]], []]"))
    )
    shape = F.struct(kind.alias("type"), F.parse_json(coordinates).alias("coordinates"))
    geometry = F.when(size != 50, shape)
    return table(spark, sf_dir, "part").select("p_partkey", geo.geometry_validity(geometry).alias("valid"))


# features


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = placed_customers(spark, sf_dir)
    point = geo.point(F.col("lng"), F.col("lat")).alias("geometry")
    return placed.select(F.lit(0).alias("_id"), "c_custkey", "c_mktsegment", point)


@query(
    f"""SELECT c_custkey, 'Feature' AS type, 'Point' AS kind, lng, lat, c_mktsegment, 2 AS n_properties,
      NULL::VARCHAR AS id FROM {PLACED_SQL}"""
)
def feature_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = layers.feature_projection(_located(spark, sf_dir))
    n_properties = len(features.schema["properties"].dataType.fields)
    return features.select(
        "properties.c_custkey",
        "type",
        F.col("geometry.type").alias("kind"),
        F.variant_get("geometry.coordinates", "$[0]", "double").alias("lng"),
        F.variant_get("geometry.coordinates", "$[1]", "double").alias("lat"),
        "properties.c_mktsegment",
        F.lit(n_properties).alias("n_properties"),
        "id",
    )


@query(f"SELECT 'Feature' AS type, lng, lat, c_custkey, c_mktsegment, true AS has_id FROM {PLACED_SQL}")
def export_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write one feature per line, then read the lines back."""
    path = scratch_path(spark, "features")
    layers.export_features(layers.feature_projection(_located(spark, sf_dir)), path)
    feature = F.parse_json("value")

    def read(where: str, dtype: str, name: str) -> Column:
        return F.variant_get("feature", where, dtype).alias(name)

    return spark.read.text(path).select(feature.alias("feature"), "value").select(
        read("$.type", "string", "type"),
        read("$.geometry.coordinates[0]", "double", "lng"),
        read("$.geometry.coordinates[1]", "double", "lat"),
        read("$.properties.c_custkey", "bigint", "c_custkey"),
        read("$.properties.c_mktsegment", "string", "c_mktsegment"),
        F.col("value").contains('"id":null').alias("has_id"),
    )
