"""Golden cases of the scalar functions, with their odd ones."""

import pytest
from pyspark.sql import functions as F

from propwell.functions import scalars
from propwell.functions.canonical import canonical_rename, json_map, open_payload
from pyspark.sql import types as T


def one(spark, function, *values, types=None):
    types = types or ["string"] * len(values)
    row = spark.range(1).select(*[F.lit(v).cast(t).alias(f"c{i}") for i, (v, t) in enumerate(zip(values, types))])
    return row.select(function(*[F.col(f"c{i}") for i in range(len(values))]).alias("r")).head().r


@pytest.mark.parametrize(
    ("function", "label", "expected"),
    [
        (scalars.normalize_price, "₪1,250,000", 1250000),
        (scalars.normalize_price, "1.5M", 15),
        (scalars.normalize_price, "", None),
        (scalars.normalize_price, "abc", None),
        (scalars.normalize_price, None, None),
        (scalars.normalize_price, "9" * 30, None),
        (scalars.normalize_rooms, "3.5 חדרים", 3.5),
        (scalars.normalize_rooms, "3,5", 3.5),
        (scalars.normalize_rooms, "סטודיו", None),
        (scalars.normalize_area, '85 מ"ר', 85),
        (scalars.normalize_area, "1,250", 1),
        (scalars.normalize_floor, "קומה 4 מתוך 8", 4),
        (scalars.normalize_floor, "קרקע", 0),
        (scalars.normalize_floor, "מרתף", -1),
        (scalars.normalize_floor, "4", 4),
        (scalars.normalize_floor, "-2", -2),
        (scalars.normalize_floor, "", None),
        (scalars.listing_id_from_url, "https://www.madlan.co.il/listing/123456789", "123456789"),
        (scalars.listing_id_from_url, "https://example.org/x/1", None),
        (scalars.listing_url, "7", "https://www.madlan.co.il/listing/7"),
        (scalars.listing_url, "", None),
        (scalars.clean_js_literals, '{"a":undefined,"b":Infinity,"c":NaN};', '{"a":null,"b":999999999,"c":null}'),
        (scalars.clean_js_literals, '{"a":"NaNs","b":"is NaN"}', '{"a":"NaNs","b":"is null"}'),
        (scalars.normalize_source_name, "cbs-housing", "cbs_housing"),
        (scalars.split_id_list, " 40010, ,70000,\t1 ,", ["40010", "70000", "1"]),
    ],
)
def test_label(spark, function, label, expected):
    assert one(spark, function, label) == expected


@pytest.mark.parametrize(
    ("fields", "expected"),
    [
        (("POINT(180000 665000)", None, None, None, None), (180000.0, 665000.0)),
        (("", "0", "5", "7", None), (5.0, 7.0)),
        (("POINT(1 2 3)", "4", None, "5", None), (4.0, 5.0)),
        (("POINT(a b)", None, "4", None, "5"), (4.0, 5.0)),
        (("LINE(1 2)", None, None, "5", None), None),
        ((None, "0", None, "5", None), None),
    ],
)
def test_parse_point(spark, fields, expected):
    point = one(spark, scalars.parse_point, *fields)
    assert (None if point is None else tuple(point)) == expected


def test_format_address(spark):
    assert one(spark, scalars.format_address, "A", None, "C") == "A, C"
    assert one(spark, scalars.format_address, None, "", None) == "Unknown"


def test_image_urls(spark):
    array = ["array<string>"]
    assert one(spark, scalars.image_urls, None, types=array) == []
    row = spark.sql("SELECT array('a.jpg', '', NULL, 'b.jpg') AS i").select(scalars.image_urls(F.col("i")).alias("r"))
    assert row.head().r == ["https://images2.madlan.co.il/a.jpg", "https://images2.madlan.co.il/b.jpg"]


def renamed(spark, text):
    frame = spark.createDataFrame([(text,)], "j STRING")
    return frame.select(json_map(canonical_rename(open_payload(F.col("j"))), T.VariantType()).alias("r")).head().r


def test_last_alias_wins_also_with_null(spark):
    payload = '{"propertyTypeDescription": "a", "x": 1, "dealNatureDescription": null}'
    assert renamed(spark, payload) == '{"property_type": null, "x": 1}'
    payload = '{"dealNatureDescription": null, "DEALNATUREDESCRIPTION": "z"}'
    assert renamed(spark, payload) == '{"property_type": "z"}'


def test_canonical_text(spark):
    payload = '{"b": "\\"q\\" א\\n", "a": [1, {"z": null, "y": true}], "price": 1250000, "r": 3.5}'
    expected = '{"a": [1,{"y":true,"z":null}], "b": "\\"q\\" א\\n", "price": 1250000, "r": 3.5}'
    assert renamed(spark, payload) == expected
    assert renamed(spark, "{}") == "{}"
