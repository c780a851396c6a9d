"""Directory and boundary builds.

Each stage is written to the output folder and read back, so a lost executor
never sends a job back to the CSV, and later stages scan only the columns they
need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rollatlas.operators.cleaning import district_rows, school_rows
from rollatlas.operators.geocode import GEOCODE_FLAGS, geocode, records_of_kinds, resolve_records
from rollatlas.operators.geometry import boundary_rows, parse_features
from rollatlas.operators.linking import link_status
from rollatlas.sources.assets import (
    boundary_features,
    district_map,
    outputs_complete,
    page_params,
    schools_by_district,
    write_by_key,
    write_finished,
    write_table,
)
from rollatlas.sources.manifest import write_manifest


def _stage(df: DataFrame, path: str) -> DataFrame:
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def build_directory(
    raw: DataFrame,
    gazetteer: DataFrame,
    out: str,
    json_assets: bool = True,
) -> bool:
    """Raw records to districts, linked schools and page parameters under ``out``.

    Returns False without work when all outputs are already there. ``out`` must be
    a folder every executor can reach.
    """
    spark = raw.sparkSession
    finished = [f"{out}/districts", f"{out}/schools", f"{out}/page_params"]
    if outputs_complete(spark, finished):
        return False

    raw = _stage(raw, f"{out}/stage/raw")
    districts = _stage(district_rows(raw), f"{out}/stage/districts")
    schools = _stage(school_rows(raw), f"{out}/stage/schools")
    resolved = _stage(resolve_records([districts, schools], gazetteer), f"{out}/stage/addresses")
    districts = _stage(geocode(districts, gazetteer, resolved), f"{out}/districts")
    write_manifest(spark, f"{out}/districts")
    schools = _stage(geocode(schools, gazetteer, resolved), f"{out}/stage/schools_geocoded")
    status = _stage(link_status(schools, districts), f"{out}/stage/school_links")
    linked = status.filter("link_status = 'linked'").drop("link_status")
    write_finished(linked, f"{out}/schools")
    if json_assets:
        write_table(district_map(districts), f"{out}/districts_json", "json")
        write_table(schools_by_district(linked), f"{out}/schools_by_district_json", "json")
    write_finished(page_params(districts), f"{out}/page_params", "json")
    return True


def build_boundaries(features: DataFrame, out: str, buckets: int = 256) -> None:
    """Boundary features to one reprojected feature per key, plus JSON features."""
    rows = _stage(boundary_rows(parse_features(features)), f"{out}/stage/boundaries")
    write_by_key(rows, f"{out}/boundaries", "boundary_key", buckets)
    write_by_key(boundary_features(rows), f"{out}/boundary_features", "boundary_key", buckets, "json")


def load_build(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """Stage tables of a finished build, for reports."""
    names = {
        "raw": "stage/raw", "districts": "districts", "schools": "stage/schools_geocoded",
        "links": "stage/school_links", "linked": "schools",
    }
    found = {name: spark.read.parquet(f"{out}/{path}") for name, path in names.items()}
    columns = ["slug", "lat", "lon", *GEOCODE_FLAGS]
    return found | {"placed": records_of_kinds(columns, districts=found["districts"], schools=found["schools"])}
