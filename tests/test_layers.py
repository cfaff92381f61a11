"""Boxes, geometries and features."""

import json

import pytest
from pyspark.sql import functions as F

from propwell.functions.geometry import BBox, bounds, geometry_validity, place_order, point
from propwell.operators import box_join, layers, sinks


@pytest.mark.parametrize(
    "box",
    [(32, 31, 34, 35), (31, 32, 35, 34), (-91, 32, 34, 35), (31, 91, 34, 35), (31, 32, -181, 35), (31, 32, 34, 181)],
)
def test_bad_boxes(box):
    with pytest.raises(ValueError):
        BBox(*box)


def test_flat_box_is_allowed():
    assert BBox(31, 31, 34, 34).max_lat == 31


SHAPES = [
    ("Point", [1, 2], True),
    ("Point", [1, 2, 3], False),
    ("Point", [1, None], False),
    ("Point", [[1, 2]], False),
    ("LineString", [[1, 2]], False),
    ("LineString", [[1, 2], [3, 4]], True),
    ("LineString", [[1, 2], [3]], False),
    ("Polygon", [], False),
    ("Polygon", [[[0, 0], [1, 0], [1, 1]]], True),  # rings need not be closed
    ("Polygon", [[]], True),
    ("MultiPoint", [], False),
    ("MultiPoint", [[1, 2]], True),
    ("MultiLineString", [[[1, 2]]], True),
    ("MultiPolygon", [[[[1, 2]], []]], True),
    ("MultiPolygon", [[[1, 2]]], False),
    ("GeometryCollection", [1, 2], False),
    ("Point", "far", False),
]


def shapes(spark, rows):
    frame = spark.createDataFrame([(i, k, json.dumps(c)) for i, (k, c) in enumerate(rows)], "i INT, k STRING, c STRING")
    shape = F.struct(F.col("k").alias("type"), F.parse_json("c").alias("coordinates"))
    return frame.select("i", F.when(F.col("k").isNotNull(), shape).alias("geometry"))


def test_validity(spark):
    frame = shapes(spark, [(k, c) for k, c, _ in SHAPES])
    found = frame.select("i", geometry_validity(F.col("geometry")).alias("ok")).orderBy("i").collect()
    assert [r.ok for r in found] == [ok for _, _, ok in SHAPES]
    missing = shapes(spark, [(None, [1])])
    assert missing.select(geometry_validity(F.col("geometry")).alias("ok")).head().ok
    good, bad = layers.split_valid(frame)
    assert good.count() + bad.count() == len(SHAPES)


def test_bounds(spark):
    frame = shapes(spark, [("MultiPolygon", [[[[1, 9], [5, 2]]], [[[3, 4]]]]), ("Point", [7, 8]), ("Polygon", [[]]), (None, 1)])
    found = [r.b for r in frame.select(bounds(F.col("geometry")).alias("b"), "i").orderBy("i").collect()]
    assert [tuple(b) if b else None for b in found] == [(1, 2, 5, 9), (7, 8, 7, 8), None, None]


def test_missing_geometry_is_in_no_box(spark):
    frame = layers.with_bounds(shapes(spark, [(None, 1), ("Point", [34.5, 31.5])]))
    assert [r.i for r in layers.bbox_filter_bounds(frame, BBox(31.5, 31.5, 34.5, 34.5)).collect()] == [1]


def test_collection_document(spark):
    rows = spark.createDataFrame([(7, "a", 34.5, 31.5), (8, None, None, 31.0)], "_id INT, name STRING, lng DOUBLE, lat DOUBLE")
    located = rows.select("_id", "name", point(F.col("lng"), F.col("lat")).alias("geometry"))
    document = layers.feature_collection(layers.feature_projection(located), 100).head().document
    assert json.loads(document) == {
        "type": "FeatureCollection",
        "features": [
            {"type": "Feature", "geometry": {"type": "Point", "coordinates": [34.5, 31.5]}, "properties": {"name": "a"}, "id": None},
            {"type": "Feature", "geometry": None, "properties": {"name": None}, "id": None},
        ],
    }
    empty = layers.feature_collection(layers.feature_projection(located.filter("_id > 8")), 100)
    assert json.loads(empty.head().document)["features"] == []


def test_layer_files_cover_small_boxes(spark, tmp_path):
    """Files of a layer overlap little on either axis."""
    path, n = str(tmp_path / "layer"), 64
    grid = spark.range(n * n).select(
        (F.col("id") % n * 4 - 128).cast("double").alias("lng"),
        (F.floor(F.col("id") / n) * 2 - 64).cast("double").alias("lat"),
    )
    grid.write.parquet(str(tmp_path / "raw"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.save_layer(spark.read.parquet(str(tmp_path / "raw")), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spans = (
        spark.read.parquet(path)
        .groupBy(F.input_file_name())
        .agg((F.max("lng") - F.min("lng")).alias("w"), (F.max("lat") - F.min("lat")).alias("h"))
        .agg(F.count("*").alias("files"), F.avg("w").alias("w"), F.avg("h").alias("h"))
        .head()
    )
    assert spans.files == 8 and spans.w < 256 * 0.6 and spans.h < 128 * 0.6


def test_one_hot_place_fills_several_files(spark, tmp_path):
    path = str(tmp_path / "layer")
    spark.range(40_000).select(F.lit(34.5).alias("lng"), F.lit(31.5).alias("lat"), "id").write.parquet(str(tmp_path / "raw"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.save_layer(spark.read.parquet(str(tmp_path / "raw")), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 10_000 and sum(sizes) == 40_000


def test_place_order_interleaves(spark):
    frame = spark.createDataFrame([(-180.0, -90.0), (180.0, 90.0), (180.0, -90.0), (500.0, 0.0)], "x DOUBLE, y DOUBLE")
    found = [r.z for r in frame.select(place_order(F.col("x"), F.col("y"), 2).alias("z")).collect()]
    assert found == [0, 15, 5, 7]


def test_box_join_against_brute_force(spark):
    """Boxes of all sizes, points on edges, at the poles and without a place, one very frequent place."""
    from random import Random

    dice = Random(5)
    places = [(dice.uniform(-180, 180), dice.uniform(-90, 90)) for _ in range(300)]
    places += [(180.0, 90.0), (-180.0, -90.0), (None, 1.0), (float("nan"), 1.0)] + [(34.8, 32.1)] * 300
    boxes = []
    for i in range(120):
        lng, lat = dice.choice(places[:300])
        side = 10 ** dice.uniform(-6, 2.5)
        boxes.append((lng, lat, min(180.0, lng + side), min(90.0, lat + side / 2)))
    boxes += [(34.8, 32.1, 34.8, 32.1), (-180.0, -90.0, 180.0, 90.0), (2.0, 2.0, 1.0, 3.0), (None, 0.0, 1.0, 1.0)]
    features = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "f INT, lng DOUBLE, lat DOUBLE").repartition(8)
    frame = spark.createDataFrame([(i, *b) for i, b in enumerate(boxes)], "b INT, min_lng DOUBLE, min_lat DOUBLE, max_lng DOUBLE, max_lat DOUBLE")
    assert box_join.box_cells(frame.filter("min_lng <= max_lng")).groupBy("b").count().agg(F.max("count")).head()[0] <= 25
    want = {
        (b, f)
        for b, (x0, y0, x1, y1) in enumerate(boxes)
        for f, (lng, lat) in enumerate(places)
        if None not in (x0, lng) and x0 <= lng <= x1 and y0 <= lat <= y1
    }
    found = [tuple(r) for r in box_join.bbox_join(features, frame).select("b", "f").collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert box_join.bbox_join(features, frame.limit(0)).count() == 0
    shapes_ = features.filter("lng IS NOT NULL AND NOT isnan(lng)").selectExpr(
        "f", "lng AS min_lng", "lat AS min_lat", "lng + 0.5 AS max_lng", "lat + 0.25 AS max_lat"
    )
    want = {(b, f) for b, f in want if places[f][0] + 0.5 <= boxes[b][2] and places[f][1] + 0.25 <= boxes[b][3]}
    assert {tuple(r) for r in box_join.bbox_join(shapes_, frame).select("b", "f").collect()} == want


def test_box_join_deals_the_pairs_of_one_cell(spark, monkeypatch):
    """One place with many features in many boxes: its pairs come from many tasks, each pair once."""
    monkeypatch.setattr(box_join, "LOT", 16)
    features = spark.range(0, 200, 1, 1).selectExpr("id AS f", "34.8d AS lng", "32.1d AS lat")
    features = features.unionByName(features.limit(5))
    boxes = spark.range(0, 90, 1, 1).selectExpr(
        "id AS b", "34.7d AS min_lng", "32.0d AS min_lat", "34.9d AS max_lng", "32.2d AS max_lat"
    )
    pairs = box_join.bbox_join(features, boxes).select("b", "f", F.spark_partition_id().alias("task"))
    found = [tuple(r) for r in pairs.collect()]
    assert len(found) == 205 * 90 and len({r[:2] for r in found}) == 200 * 90
    sizes = {t: sum(r[2] == t for r in found) for t in {r[2] for r in found}}
    assert len(sizes) >= 4 and max(sizes.values()) < 205 * 90 / 2
