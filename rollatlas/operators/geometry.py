"""Boundary features: parsing, reprojection, extents, map cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollatlas.functions.coordinates import cell_x, cell_y, reproject_polygons
from rollatlas.functions.numbers import avg_of_sums, fixed_point
from rollatlas.functions.text import col, present, sanitize_key
from rollatlas.operators.ranking import last_per_key

ID_PROPERTY = "CDSCode"
AREA_TYPES = ("Polygon", "MultiPolygon")
# Nesting depth of the coordinates of each geometry type.
DEPTH = {
    "Point": 1, "LineString": 2, "MultiPoint": 2, "Polygon": 3, "MultiLineString": 3,
    "MultiPolygon": 4,
}
BOX_FIELDS = ["min_lat", "min_lon", "max_lat", "max_lon"]
CELL_PIXELS = 80


def _nested(depth: int) -> str:
    return "array<" * depth + "double" + ">" * depth


def lift_coordinates(geom_type: Column | str, coordinates: Column | str) -> Column:
    """Coordinates JSON of any type as polygon > ring > point arrays."""
    geom_type, text = col(geom_type), col(coordinates)
    out = F.lit(None).cast(_nested(4))
    for name, depth in DEPTH.items():
        value = F.from_json(text, _nested(depth))
        for _ in range(4 - depth):
            value = F.array(value)
        out = F.when(geom_type == name, value).otherwise(out)
    return out


def parse_features(features: DataFrame, feature: str = "feature", id_property: str = ID_PROPERTY) -> DataFrame:
    """Feature JSON text to columns (X27). ``pos`` must order the features."""
    text = F.col(feature)
    return features.select(
        "pos",
        F.get_json_object(text, f"$.properties.{id_property}").alias("boundary_id"),
        F.get_json_object(text, "$.geometry.type").alias("geom_type"),
        F.get_json_object(text, "$.geometry.coordinates").alias("_coordinates"),
        F.get_json_object(text, "$.properties").alias("properties"),
        F.get_json_object(text, "$.geometry").alias("geometry"),
    ).select(
        "pos", "boundary_id", "geom_type", "properties", "geometry",
        lift_coordinates("geom_type", "_coordinates").alias("polygons"),
    )


def boundary_rows(features: DataFrame, keep_unsupported: bool = True) -> DataFrame:
    """Features with an id, last one per file key, in degrees.

    Types other than polygons are flagged; they keep their coordinates, or lose them
    when ``keep_unsupported`` is off. Their geometry text is kept as it was read.
    """
    keyed = features.filter(present("boundary_id")).withColumn(
        "boundary_key", sanitize_key("boundary_id")
    )
    kept = last_per_key(keyed, ["boundary_key"], ["pos"])
    area = F.coalesce(F.col("geom_type").isin(*AREA_TYPES), F.lit(False))
    other = F.when(F.lit(keep_unsupported), F.col("polygons"))
    return kept.withColumns(
        {
            "reprojected": area,
            "polygons": F.when(area, reproject_polygons("polygons")).otherwise(other),
            "geometry": F.when(~area, F.col("geometry")),
        }
    )


def extent(polygons: Column | str) -> Column:
    """Bounding box of all vertices; null without vertices (A6). Stays within the row."""
    points = F.flatten(F.flatten(col(polygons)))
    lon = F.transform(points, lambda p: F.get(p, F.lit(0)))
    lat = F.transform(points, lambda p: F.get(p, F.lit(1)))
    box = F.struct(
        F.array_min(lat).alias("min_lat"), F.array_min(lon).alias("min_lon"),
        F.array_max(lat).alias("max_lat"), F.array_max(lon).alias("max_lon"),
    )
    return F.when(F.array_min(lat).isNotNull(), box)


def vertex_count(polygons: Column | str) -> Column:
    return F.greatest(F.size(F.flatten(F.flatten(col(polygons)))), F.lit(0))


def point_box(lat: Column | str, lon: Column | str) -> Column:
    lat, lon = col(lat), col(lon)
    box = F.struct(lat.alias("min_lat"), lon.alias("min_lon"), lat.alias("max_lat"), lon.alias("max_lon"))
    return F.when(lat.isNotNull() & lon.isNotNull(), box)


def grow_box(*boxes: Column | str) -> Column:
    """Smallest box around the given boxes; nulls are skipped."""
    boxes = [col(b) for b in boxes]

    def over(field: str) -> Column:
        values = [b[field] for b in boxes]
        if len(values) == 1:
            return values[0]
        return F.least(*values) if field.startswith("min") else F.greatest(*values)

    any_box = reduce(lambda a, b: a | b, [b.isNotNull() for b in boxes])
    return F.when(any_box, F.struct(*[over(f).alias(f) for f in BOX_FIELDS]))


def points_extent(points: DataFrame, keys: list[str]) -> DataFrame:
    """Box and number of points per key; min and max combine before the shuffle."""
    return points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("markers"),
        F.min("lat").alias("min_lat"), F.min("lon").alias("min_lon"),
        F.max("lat").alias("max_lat"), F.max("lon").alias("max_lon"),
    ).select(*keys, "markers", F.struct(*BOX_FIELDS).alias("box"))


def cluster_points(
    points: DataFrame, keys: list[str], zooms: list[int], cell_pixels: int = CELL_PIXELS
) -> DataFrame:
    """Points per map cell and zoom, with their centre.

    A pyramid: points are read once and summed into the cells of the finest zoom. One zoom less
    halves a cell's numbers, so coarser cells are sums of finer cells. Sums are whole numbers and
    come out the same from any level.
    """
    finest = max(zooms)
    cells = points.groupBy(
        *keys, cell_x(F.col("lon"), finest, cell_pixels).alias("_x"), cell_y(F.col("lat"), finest, cell_pixels).alias("_y")
    ).agg(
        F.count(F.lit(1)).alias("_points"), F.count("lat").alias("_lats"), F.count("lon").alias("_lons"),
        F.sum(fixed_point("lat")).alias("_lat"), F.sum(fixed_point("lon")).alias("_lon"),
    )
    zoomed = cells.withColumn("zoom", F.explode(F.array(*[F.lit(z) for z in sorted(set(zooms))])))
    up = f"shiftright({{}}, {finest} - zoom)"
    rolled = zoomed.groupBy(*keys, "zoom", F.expr(up.format("_x")).alias("cell_x"), F.expr(up.format("_y")).alias("cell_y"))
    return rolled.agg(
        F.sum("_points").alias("points"),
        avg_of_sums(F.sum("_lat"), F.sum("_lats")).alias("lat"),
        avg_of_sums(F.sum("_lon"), F.sum("_lons")).alias("lon"),
    )
