"""Map layers and map views, for all districts at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollatlas.functions import display as D
from rollatlas.functions.coordinates import in_bounds
from rollatlas.functions.text import or_default, sanitize_key
from rollatlas.operators.cleaning import is_page_school
from rollatlas.operators.geocode import fill_from_address
from rollatlas.operators.geometry import (
    BOX_FIELDS,
    CELL_PIXELS,
    cluster_points,
    extent,
    grow_box,
    point_box,
    points_extent,
)
from rollatlas.plans.pages import STREET

# View used when nothing can be shown, and zooms on a single place.
DEFAULT_CENTRE = (36.7783, -119.4179)
DEFAULT_ZOOM = 6
CARD_POINT_ZOOM = 13
CARD_ADDRESS_ZOOM = 15
NAME_ZOOM = 10


def district_markers(districts: DataFrame, base: str = "/") -> DataFrame:
    """Districts that can be placed on the index map, with their link."""
    placed = districts.filter(in_bounds(F.col("lat"), F.col("lon")))
    linked = placed.withColumn("link", D.marker_link("slug", "cds_code", base))
    return linked.select("cds_code", "district", "lat", "lon", "link", D.district_popup("district", "link").alias("popup"))


def unplaced_districts(districts: DataFrame) -> DataFrame:
    """Districts left off the index map (anti side of F13)."""
    return districts.filter(~in_bounds(F.col("lat"), F.col("lon"))).select("cds_code", "district")


def district_marker_layer(
    districts: DataFrame, zooms: list[int], base: str = "/", cell_pixels: int = CELL_PIXELS
) -> DataFrame:
    """Clustered district markers per zoom."""
    return cluster_points(district_markers(districts, base), [], zooms, cell_pixels)


def school_markers(linked: DataFrame) -> DataFrame:
    """Page schools that can be placed, with popup text."""
    placed = linked.filter(is_page_school() & in_bounds(F.col("lat"), F.col("lon")))
    name = or_default("school", "Unknown School")
    popup = F.concat_ws(
        "<br>",
        F.concat(F.lit("<b>"), name, F.lit("</b>")),
        D.address_for_map(*STREET),
        D.grade_span("low_grade", "high_grade", "popup"),
    )
    return placed.select("district_cds", "ord", "cds_code", "lat", "lon", popup.alias("popup"))


def school_marker_layer(
    linked: DataFrame, zooms: list[int], cell_pixels: int = CELL_PIXELS
) -> DataFrame:
    """Clustered school markers per district and zoom."""
    return cluster_points(school_markers(linked), ["district_cds"], zooms, cell_pixels)


def district_offices(
    districts: DataFrame, gazetteer: DataFrame
) -> DataFrame:
    """Office point per district: its own coordinates, else the address looked up."""
    own = in_bounds(F.col("lat"), F.col("lon"))
    located = districts.select(
        "ord",
        "cds_code",
        "district",
        D.address_for_map(*STREET).alias("address"),
        F.when(own, F.col("lat")).alias("lat"),
        F.when(own, F.col("lon")).alias("lon"),
    )
    # The stand-in text for a missing address is never looked up.
    known = gazetteer.filter(F.col("query") != D.NO_ADDRESS)
    return fill_from_address(located, known, "address")


def office_markers(districts: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """District offices that have a point, with popup text."""
    placed = district_offices(districts, gazetteer).filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return placed.select("cds_code", "lat", "lon", D.office_popup("district", "address").alias("popup"))


def district_map_view(
    districts: DataFrame,
    linked: DataFrame,
    boundaries: DataFrame,
    gazetteer: DataFrame,
) -> DataFrame:
    """What each district's map shows at first.

    The box is that of the boundary and the office; schools extend it only once it
    is there. Without it the schools' own box is fitted, else the default view.
    School boxes are reduced per district before the join.
    """
    offices = district_offices(districts, gazetteer).select(
        "cds_code", "district", point_box("lat", "lon").alias("office")
    )
    shapes = boundaries.select("boundary_key", extent("polygons").alias("shape"))
    markers = points_extent(school_markers(linked), ["district_cds"]).select(
        F.col("district_cds").alias("cds_code"), "markers", F.col("box").alias("school_box")
    )
    joined = (
        offices.withColumn("boundary_key", sanitize_key("cds_code"))
        .join(shapes, "boundary_key", "left")
        .join(markers, "cds_code", "left")
    )
    own = grow_box("shape", "office")
    grown = F.when(own.isNotNull(), grow_box("shape", "office", "school_box"))
    boxed = joined.withColumn("_box", F.coalesce(grown, F.col("school_box")))
    fitted = F.col("_box").isNotNull()
    mode = (
        F.when(grown.isNotNull(), "bounds").when(fitted, "schools").otherwise("default")
    )
    return boxed.select(
        "cds_code",
        "district",
        mode.alias("view"),
        F.col("shape").isNotNull().alias("has_boundary"),
        F.col("office").isNotNull().alias("has_office"),
        F.coalesce("markers", F.lit(0)).alias("school_markers"),
        "_box.min_lat", "_box.min_lon", "_box.max_lat", "_box.max_lon",
        F.when(~fitted, F.lit(DEFAULT_CENTRE[0])).alias("centre_lat"),
        F.when(~fitted, F.lit(DEFAULT_CENTRE[1])).alias("centre_lon"),
        F.when(~fitted, F.lit(DEFAULT_ZOOM)).alias("zoom"),
    )


def _no_box() -> list:
    return [F.lit(None).cast("double").alias(f) for f in BOX_FIELDS]


def card_map_view(
    districts: DataFrame, boundaries: DataFrame, gazetteer: DataFrame
) -> DataFrame:
    """View of the older card: the boundary alone, else the district's point, else its address.

    Only polygons count as a boundary here, and the point is not checked for bounds.
    """
    shapes = boundaries.filter("reprojected").select("boundary_key", extent("polygons").alias("_box"))
    joined = districts.select(
        "ord", "cds_code", "district", "lat", "lon", D.address_flat(*STREET).alias("address"),
        sanitize_key("cds_code").alias("boundary_key"),
    ).join(shapes, "boundary_key", "left")
    shown = joined.filter(F.col("_box").isNotNull()).select(
        "cds_code", "district", F.lit("boundary").alias("view"), "_box.*",
        F.lit(None).cast("double").alias("centre_lat"), F.lit(None).cast("double").alias("centre_lon"),
        F.lit(None).cast("int").alias("zoom"),
    )
    rest = joined.filter(F.col("_box").isNull()).withColumn("_own", F.col("lat").isNotNull() & F.col("lon").isNotNull())
    found = fill_from_address(rest, gazetteer.filter("query <> ''"), "address")
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    points = found.select(
        "cds_code", "district",
        F.when(F.col("_own"), "point").when(located, "address").otherwise("none").alias("view"),
        *_no_box(),
        F.col("lat").alias("centre_lat"), F.col("lon").alias("centre_lon"),
        F.when(F.col("_own"), CARD_POINT_ZOOM).when(located, CARD_ADDRESS_ZOOM).alias("zoom"),
    )
    return shown.unionByName(points)


def overview_map_view(
    districts: DataFrame,
    linked: DataFrame,
    boundaries: DataFrame,
    gazetteer: DataFrame,
) -> DataFrame:
    """View of the older overview: all layers together, else the district's name looked up."""
    own = in_bounds(F.col("lat"), F.col("lon"))
    shapes = boundaries.select("boundary_key", extent("polygons").alias("shape"))
    markers = points_extent(school_markers(linked), ["district_cds"]).select(
        F.col("district_cds").alias("cds_code"), F.col("box").alias("school_box")
    )
    joined = (
        districts.select(
            "ord", "cds_code", "district", F.when(own, point_box("lat", "lon")).alias("office"),
            sanitize_key("cds_code").alias("boundary_key"),
        )
        .join(shapes, "boundary_key", "left")
        .join(markers, "cds_code", "left")
        .withColumn("_box", grow_box("shape", "office", "school_box"))
    )
    shown = joined.filter(F.col("_box").isNotNull()).select(
        "cds_code", "district", F.lit("bounds").alias("view"), "_box.*",
        F.lit(None).cast("double").alias("centre_lat"), F.lit(None).cast("double").alias("centre_lon"),
        F.lit(None).cast("int").alias("zoom"),
    )
    rest = joined.filter(F.col("_box").isNull()).select(
        "ord", "cds_code", "district",
        F.concat(F.col("district"), F.lit(", California")).alias("address"),
        F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"),
    )
    found = fill_from_address(rest, gazetteer, "address")
    located = F.col("lat").isNotNull()
    points = found.select(
        "cds_code", "district", F.when(located, "name").otherwise("default").alias("view"),
        *_no_box(),
        F.coalesce("lat", F.lit(DEFAULT_CENTRE[0])).alias("centre_lat"),
        F.coalesce("lon", F.lit(DEFAULT_CENTRE[1])).alias("centre_lon"),
        F.when(located, NAME_ZOOM).otherwise(DEFAULT_ZOOM).alias("zoom"),
    )
    return shown.unionByName(points)
