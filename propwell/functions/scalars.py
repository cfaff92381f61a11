"""Scalar clean-up of listing, deal and place fields, as native column expressions.

Digits are ASCII digits; numbers beyond BIGINT become NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from propwell import fixed


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, NULL (not '') when nothing matches."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def stripped(text: Column) -> Column:
    """White space cut from both ends, of any script."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_price(text: Column) -> Column:
    """Every digit of the label as one integer: '₪1,250,000' -> 1250000, '1.5M' -> 15."""
    digits = F.regexp_replace(text, r"\D", "")
    return F.nullif(digits, F.lit("")).try_cast("bigint")


def normalize_rooms(text: Column) -> Column:
    """First number, comma or dot as decimal mark."""
    number = _found(text, r"(\d+(?:[.,]\d+)?)")
    return F.replace(number, F.lit(","), F.lit(".")).try_cast("double")


def normalize_area(text: Column) -> Column:
    """First run of digits."""
    return _found(text, r"(\d+)").try_cast("bigint")


def normalize_floor(text: Column) -> Column:
    """Ground floor -> 0, basement -> -1, else the first signed integer."""
    return (
        F.when(text.contains(fixed.GROUND_FLOOR_WORD), F.lit(0).cast("bigint"))
        .when(text.contains(fixed.BASEMENT_WORD), F.lit(-1).cast("bigint"))
        .otherwise(_found(text, r"(-?\d+)").try_cast("bigint"))
    )


def listing_id_from_url(url: Column) -> Column:
    """The digits after '/listing/', kept as text."""
    return _found(url, fixed.LISTING_HREF + r"(\d+)")


def listing_url(listing_id: Column) -> Column:
    """Page address of a listing; NULL without an id."""
    return F.concat(F.lit(fixed.LISTING_URL_PREFIX), F.nullif(listing_id, F.lit("")))


def image_urls(images: Column) -> Column:
    """Full addresses of an array of image paths; empty ones dropped, order kept."""
    present = F.filter(images, lambda path: path != "")
    full = F.transform(present, lambda path: F.concat(F.lit(fixed.IMAGE_URL_PREFIX), path))
    return F.coalesce(full, F.array().cast("array<string>"))


def clean_js_literals(text: Column) -> Column:
    """Script-only literals -> JSON, as whole words, inside strings too; trailing ';' cut."""
    cleaned = F.regexp_replace(text, ";+$", "")
    for literal, json_form in fixed.JS_LITERALS:
        cleaned = F.regexp_replace(cleaned, rf"(?U)\b{literal}\b", json_form)
    return cleaned


def _nonzero(text: Column) -> Column:
    """Number in a text, NULL where the text is empty or zero."""
    return F.nullif(text.try_cast("double"), F.lit(0.0))


def parse_point(shape: Column, x: Column, lon: Column, y: Column, lat: Column) -> Column:
    """STRUCT(lon, lat) of 'POINT(lon lat)', else of x|lon and y|lat; both axes or NULL.

    The closing mark of the shape text is not looked at; zero counts as missing in the
    fallback only.
    """
    pattern = r"(?s)^POINT\(\s*(\S+)\s+(\S+)\s*.$"
    first = _found(shape, pattern, 1).try_cast("double")
    second = _found(shape, pattern, 2).try_cast("double")
    easting = F.coalesce(_nonzero(x), _nonzero(lon))
    northing = F.coalesce(_nonzero(y), _nonzero(lat))
    return (
        F.when(
            first.isNotNull() & second.isNotNull(),
            F.struct(first.alias("lon"), second.alias("lat")),
        )
        .when(
            easting.isNotNull() & northing.isNotNull(),
            F.struct(easting.alias("lon"), northing.alias("lat")),
        )
    )


def format_address(*parts: Column) -> Column:
    """Non-empty parts joined by ', '; 'Unknown' when there is none."""
    joined = F.concat_ws(", ", *[F.nullif(part, F.lit("")) for part in parts])
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("Unknown"))


def normalize_source_name(name: Column) -> Column:
    """Hyphenated source names mean the underscored ones."""
    return F.replace(name, F.lit("-"), F.lit("_"))


def split_id_list(text: Column) -> Column:
    """Comma-separated ids, blanks trimmed and dropped."""
    trimmed = F.transform(F.split(text, ","), stripped)
    return F.filter(trimmed, lambda part: part != "")


def polygon_id_default(own: Column, requested: Column) -> Column:
    """The payload's polygon id unless it is missing or empty, else the requested one."""
    return F.coalesce(F.nullif(own, F.lit("")), requested)
