"""GeoJSON geometries as plain columns: validity, bounds and boxes.

A geometry is STRUCT<type, coordinates VARIANT>; a position is exactly [lng, lat].
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_POSITION = "array<double>"
_LINE = "array<array<double>>"
_RINGS = "array<array<array<double>>>"
_SURFACES = "array<array<array<array<double>>>>"


def _is_position(position: Column) -> Column:
    return (F.array_size(position) == 2) & F.forall(position, lambda axis: axis.isNotNull())


def _positions_ok(line: Column) -> Column:
    return F.forall(line, _is_position)


def _lines_ok(lines: Column) -> Column:
    return F.forall(lines, _positions_ok)


def geometry_validity(geometry: Column) -> Column:
    """Does the geometry obey the arity and minimum-length rules of its kind?

    A missing geometry is allowed; ring closure is not asked for.
    """
    kind = geometry.getField("type")
    coordinates = geometry.getField("coordinates")

    def read(dtype: str) -> Column:
        return F.try_variant_get(coordinates, "$", dtype)

    line, rings, surfaces = read(_LINE), read(_RINGS), read(_SURFACES)
    verdict = (
        F.when(kind == "Point", _is_position(read(_POSITION)))
        .when(kind == "LineString", (F.array_size(line) >= 2) & _positions_ok(line))
        .when(kind == "MultiPoint", (F.array_size(line) >= 1) & _positions_ok(line))
        .when(kind.isin("Polygon", "MultiLineString"), (F.array_size(rings) >= 1) & _lines_ok(rings))
        .when(
            kind == "MultiPolygon",
            (F.array_size(surfaces) >= 1) & F.forall(surfaces, _lines_ok),
        )
    )
    return geometry.isNull() | F.coalesce(verdict, F.lit(False))


def positions(geometry: Column) -> Column:
    """Every vertex of a geometry as ARRAY<ARRAY<DOUBLE>>."""
    kind = geometry.getField("type")
    coordinates = geometry.getField("coordinates")

    def read(dtype: str) -> Column:
        return F.try_variant_get(coordinates, "$", dtype)

    return (
        F.when(kind == "Point", F.array(read(_POSITION)))
        .when(kind.isin("LineString", "MultiPoint"), read(_LINE))
        .when(kind.isin("Polygon", "MultiLineString"), F.flatten(read(_RINGS)))
        .when(kind == "MultiPolygon", F.flatten(F.flatten(read(_SURFACES))))
    )


def bounds(geometry: Column) -> Column:
    """STRUCT<min_lng, min_lat, max_lng, max_lat> over every vertex, NULL without one."""
    vertices = positions(geometry)
    lngs = F.transform(vertices, lambda position: F.get(position, F.lit(0)))
    lats = F.transform(vertices, lambda position: F.get(position, F.lit(1)))
    return F.when(
        F.array_size(vertices) > 0,
        F.struct(
            F.array_min(lngs).alias("min_lng"),
            F.array_min(lats).alias("min_lat"),
            F.array_max(lngs).alias("max_lng"),
            F.array_max(lats).alias("max_lat"),
        ),
    )


def point(lng: Column, lat: Column) -> Column:
    """A Point geometry; NULL unless both axes are there."""
    coordinates = F.to_variant_object(F.array(lng, lat))
    return F.when(
        lng.isNotNull() & lat.isNotNull(),
        F.struct(F.lit("Point").alias("type"), coordinates.alias("coordinates")),
    )


#: Cells per axis of the map grid, as a power of two.
GRID_BITS = 16


def grid_cell(degrees: Column, lowest: int, span: int, bits: int = GRID_BITS) -> Column:
    """The cell of one axis a coordinate lies in; it never falls as the coordinate rises."""
    scaled = F.floor((degrees - lowest) / span * (2**bits - 1)).cast("bigint")
    return F.least(F.greatest(scaled, F.lit(0)), F.lit(2**bits - 1))


def grid_x(lng: Column, bits: int = GRID_BITS) -> Column:
    return grid_cell(lng, -180, 360, bits)


def grid_y(lat: Column, bits: int = GRID_BITS) -> Column:
    return grid_cell(lat, -90, 180, bits)


def interleave(x: Column, y: Column, bits: int = GRID_BITS) -> Column:
    """The place of a cell on the Z-shaped curve: bits of both axes in turn."""

    def spread(value: Column, bit: int, shift: int) -> Column:
        return F.shiftleft(F.shiftright(value, bit).bitwiseAND(F.lit(1)), 2 * bit + shift)

    code = F.lit(0).cast("bigint")
    for bit in range(bits):
        code = code.bitwiseOR(spread(x, bit, 0)).bitwiseOR(spread(y, bit, 1))
    return code


def place_order(lng: Column, lat: Column, bits: int = GRID_BITS) -> Column:
    """Position on a Z-shaped curve over the globe: rows near it are near on both axes.

    Sorted by it, every file and row group covers a small box, so that a bounding box
    skips most of them whichever axis it is narrow on.
    """
    return interleave(grid_x(lng, bits), grid_y(lat, bits), bits)


def bbox_verdict(
    min_lat: Column, max_lat: Column, min_lng: Column, max_lng: Column, layer_id: Column
) -> Column:
    """'ok' or the first rule a box request breaks; touching bounds are allowed."""
    return F.coalesce(
        F.when(~F.coalesce(min_lat.between(-90, 90), F.lit(False)), "min_lat")
        .when(~F.coalesce(max_lat.between(-90, 90), F.lit(False)), "max_lat")
        .when(~F.coalesce(min_lng.between(-180, 180), F.lit(False)), "min_lng")
        .when(~F.coalesce(max_lng.between(-180, 180), F.lit(False)), "max_lng")
        .when(max_lat < min_lat, "max_lat")
        .when(max_lng < min_lng, "max_lng")
        .when(F.coalesce(F.length(layer_id), F.lit(0)) < 1, "layer_id"),
        F.lit("ok"),
    )


@dataclass(frozen=True)
class BBox:
    """One checked bounding box."""

    min_lat: float
    max_lat: float
    min_lng: float
    max_lng: float

    def __post_init__(self) -> None:
        if not (-90 <= self.min_lat <= 90 and -90 <= self.max_lat <= 90):
            raise ValueError("latitude must be within [-90, 90]")
        if not (-180 <= self.min_lng <= 180 and -180 <= self.max_lng <= 180):
            raise ValueError("longitude must be within [-180, 180]")
        if self.max_lat < self.min_lat:
            raise ValueError("max_lat must be >= min_lat")
        if self.max_lng < self.min_lng:
            raise ValueError("max_lng must be >= min_lng")
