"""Coordinate validity, reprojection and map cells."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollatlas.functions.numbers import parse_float
from rollatlas.functions.text import col

EARTH_RADIUS = 6378137.0
MAX_LATITUDE = 85.0511287798
TILE_PIXELS = 256


def in_bounds(lat: Column, lon: Column, allow_zero: bool = True) -> Column:
    """Bounds check on numbers; null or NaN is not valid."""
    ok = lat.between(-90, 90) & lon.between(-180, 180)
    if not allow_zero:
        ok = ok & (lat != 0) & (lon != 0)
    return F.coalesce(ok, F.lit(False))


def valid_for_ingest(lat: Column | str, lon: Column | str) -> Column:
    """Strict rule of the batch build: a zero coordinate is not valid."""
    return in_bounds(parse_float(lat), parse_float(lon), allow_zero=False)


def valid_for_display(lat: Column | str, lon: Column | str) -> Column:
    """Display rule: zero is valid, text mentioning a redaction is not."""
    hidden = F.lower(col(lat)).contains("redacted") | F.lower(col(lon)).contains("redacted")
    return in_bounds(parse_float(lat), parse_float(lon)) & ~F.coalesce(hidden, F.lit(False))


def valid_for_map(lat: Column | str, lon: Column | str) -> Column:
    """Map rule: parse and bounds only (F8)."""
    return in_bounds(parse_float(lat), parse_float(lon))


def mercator_lon(x: Column) -> Column:
    """Longitude of a web-mercator x, wrapped once into [-180, 180]."""
    turn = x / F.lit(EARTH_RADIUS)
    wrapped = F.when(F.abs(turn) <= math.pi, turn).otherwise(turn - F.signum(turn) * 2 * math.pi)
    return F.degrees(wrapped)


def mercator_lat(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / F.lit(EARTH_RADIUS))) - F.lit(math.pi / 2))


def reproject_point(point: Column) -> Column:
    """(x, y, ...) in metres to (lon, lat, ...); a point without numbers stays as it is."""
    x, y = F.get(point, F.lit(0)), F.get(point, F.lit(1))
    moved = F.concat(
        F.array(mercator_lon(x), mercator_lat(y)),
        F.slice(point, F.lit(3), F.greatest(F.size(point) - 2, F.lit(0))),
    )
    return F.when(x.isNotNull() & y.isNotNull(), moved).otherwise(point)


def reproject_polygons(polygons: Column | str) -> Column:
    """Reproject polygon > ring > point arrays."""
    return F.transform(
        col(polygons),
        lambda polygon: F.transform(
            polygon, lambda ring: F.transform(ring, lambda point: reproject_point(point))
        ),
    )


def cell_x(lon: Column, zoom: Column | int, cell_pixels: int) -> Column:
    width = F.lit(float(TILE_PIXELS)) * F.pow(F.lit(2.0), F.lit(zoom) if isinstance(zoom, int) else zoom)
    return F.floor((lon + 180.0) / 360.0 * width / F.lit(float(cell_pixels)))


def cell_y(lat: Column, zoom: Column | int, cell_pixels: int) -> Column:
    width = F.lit(float(TILE_PIXELS)) * F.pow(F.lit(2.0), F.lit(zoom) if isinstance(zoom, int) else zoom)
    kept = F.greatest(F.least(lat, F.lit(MAX_LATITUDE)), F.lit(-MAX_LATITUDE))
    sin = F.sin(F.radians(kept))
    share = F.lit(0.5) - F.log((F.lit(1.0) + sin) / (F.lit(1.0) - sin)) / F.lit(4.0 * math.pi)
    return F.floor(share * width / F.lit(float(cell_pixels)))
