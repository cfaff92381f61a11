"""Map layers: configuration, bounding-box selection and GeoJSON features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propwell import fixed, schema
from propwell.functions.geometry import BBox, bounds, geometry_validity, point


def default_layers(spark: SparkSession) -> DataFrame:
    """The layers offered when none is configured."""
    return spark.createDataFrame(list(fixed.DEFAULT_LAYERS), schema.LAYERS)


def scan_layers(configs: DataFrame, defaults: DataFrame) -> DataFrame:
    """Configured layers, or the defaults when there are none."""
    return configs.unionByName(defaults.filter(~configs.select("id").limit(1).exists()))


def layer_exists_semijoin(requests: DataFrame, layers: DataFrame, layer_id: str = "layer_id") -> DataFrame:
    """Requests that name a configured layer."""
    return requests.join(layers.select(F.col("id").alias(layer_id)), layer_id, "left_semi")


def layer_kpis(layers: DataFrame) -> DataFrame:
    """One row: number of layers and whether the property layer is among them."""
    return layers.agg(
        F.count("*").alias("n_layers"),
        F.coalesce(F.bool_or(F.col("id") == "properties"), F.lit(False)).alias("properties_ready"),
    )


def drop_internal_id(df: DataFrame) -> DataFrame:
    """Everything but the store's own row id."""
    return df.drop("_id")


def bbox_filter(features: DataFrame, box: BBox, lng: str = "lng", lat: str = "lat") -> DataFrame:
    """Points inside the closed box. Plain comparisons, so row groups are skipped."""
    return features.filter(
        F.col(lng).between(box.min_lng, box.max_lng) & F.col(lat).between(box.min_lat, box.max_lat)
    )


#: Columns of a feature's bounds.
EDGES = ("min_lng", "min_lat", "max_lng", "max_lat")


def with_bounds(features: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Adds min_lng, min_lat, max_lng, max_lat; written with the layer, they prune its scan."""
    marked = features.withColumn("_bounds", bounds(F.col(geometry)))
    return marked.select("*", "_bounds.*").drop("_bounds")


def bbox_filter_bounds(features: DataFrame, box: BBox) -> DataFrame:
    """Geometries of any kind with every vertex inside the closed box."""
    return features.filter(
        (F.col("min_lng") >= box.min_lng)
        & (F.col("max_lng") <= box.max_lng)
        & (F.col("min_lat") >= box.min_lat)
        & (F.col("max_lat") <= box.max_lat)
    )


def bbox_limit(features: DataFrame, key: Sequence[str | Column], most: int | None = None) -> DataFrame:
    """Features by key, at most `most` where that is given; the key should tell features apart."""
    ordered = features.orderBy(*key)
    return ordered if most is None else ordered.limit(most)


def split_valid(features: DataFrame, geometry: str = "geometry") -> tuple[DataFrame, DataFrame]:
    """(features with a valid geometry, rejects)."""
    valid = geometry_validity(F.col(geometry))
    return features.filter(valid), features.filter(~valid)


def feature_projection(
    rows: DataFrame, geometry: str = "geometry", hidden: Sequence[str] = ("_id",)
) -> DataFrame:
    """(type, geometry, properties, id): all other columns become properties, id is NULL."""
    others = [name for name in rows.columns if name != geometry and name not in hidden]
    properties = F.struct(*others) if others else F.create_map().cast("map<string,string>")
    return rows.select(
        F.lit("Feature").alias("type"),
        F.col(geometry).alias("geometry"),
        properties.alias("properties"),
        F.lit(None).cast("string").alias("id"),
    )


def feature_json(features: DataFrame) -> Column:
    """One feature as JSON text, nulls written."""
    return F.to_json(F.struct(*features.columns), {"ignoreNullFields": "false"})


def export_features(features: DataFrame, path: str) -> None:
    """Write features as text, one per line, from all tasks."""
    features.select(feature_json(features).alias("value")).write.mode("overwrite").text(path)


def feature_collection(features: DataFrame, most: int) -> DataFrame:
    """One FeatureCollection document of at most `most` features: those with a geometry, by
    their text, then the others.

    A document is one value in one task, so it must be bounded; `export_features` writes any
    number of features.
    """
    placed = F.struct(F.col("geometry").isNull().alias("absent"), feature_json(features).alias("text"))
    first = features.select(placed.alias("_placed")).orderBy("_placed").limit(most)
    listed = F.array_sort(F.collect_list("_placed"))
    texts = first.agg(F.array_join(F.transform(listed, lambda f: f["text"]), ",").alias("_features"))
    return texts.select(
        F.concat(
            F.lit('{"type":"FeatureCollection","features":['), F.col("_features"), F.lit("]}")
        ).alias("document")
    )


def listings_as_properties(listings: DataFrame) -> DataFrame:
    """Flat listings as rows of the property layer. An addition: nothing else fills it."""
    return listings.withColumn("geometry", point(F.col("lng"), F.col("lat")))
