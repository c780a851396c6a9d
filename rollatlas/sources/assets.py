"""Output tables of the builds: writers, write-once guard, checked readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollatlas.functions.text import or_sentinel, present
from rollatlas.operators.linking import CHUNK_ROWS, chunk_by_key
from rollatlas.schema import DISTRICT_COLUMNS, HEADER_OF, SCHOOL_COLUMNS
from rollatlas.sources.manifest import has_manifest, write_manifest


def outputs_complete(spark: SparkSession, paths: list[str]) -> bool:
    """Write-once guard: true only when every output is finished, that is, has its manifest."""
    return all(has_manifest(spark, p) for p in paths)


def with_headers(df: DataFrame, columns: list[str], extra: list[str] = ()) -> list[Column]:
    """Columns under the export's own headers, sentinel for nulls."""
    return [or_sentinel(c).alias(HEADER_OF[c]) for c in columns] + [F.col(c) for c in extra]


def district_map(districts: DataFrame) -> DataFrame:
    """One row per district under the export's headers, key and source order kept."""
    named = with_headers(districts, DISTRICT_COLUMNS, ["slug"])
    return districts.select(F.col("cds_code").alias("key"), "ord", *named)


def schools_by_district(linked: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """School arrays per district in source order, in bounded chunks."""
    named = [or_sentinel(c).alias(HEADER_OF[c]) for c in SCHOOL_COLUMNS]
    renamed = linked.select("district_cds", "ord", *named)
    columns = [HEADER_OF[c] for c in SCHOOL_COLUMNS]
    return chunk_by_key(renamed, "district_cds", columns, "schools", rows)


def page_params(districts: DataFrame) -> DataFrame:
    """Slug of every page to build."""
    return districts.filter(present("slug")).select(F.col("slug").alias("districtSlug"))


def boundary_features(boundaries: DataFrame) -> DataFrame:
    """One standalone feature per boundary key, as compact JSON text."""
    polygons = F.col("polygons")
    coordinates = F.when(F.col("geom_type") == "MultiPolygon", F.to_json(polygons)).otherwise(
        F.to_json(F.get(polygons, F.lit(0)))
    )
    drawn = F.concat(
        F.lit('{"type":"'), F.col("geom_type"), F.lit('","coordinates":'), coordinates, F.lit("}")
    )
    # Other types go out as they came in.
    geometry = F.when(F.col("reprojected"), drawn).otherwise(F.col("geometry"))
    feature = F.concat(
        F.lit('{"type":"Feature","properties":'),
        F.coalesce("properties", F.lit("null")),
        F.lit(',"geometry":'),
        F.coalesce(geometry, F.lit("null")),
        F.lit("}"),
    )
    return boundaries.select("boundary_key", feature.alias("feature"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", **options: str) -> None:
    df.write.format(fmt).mode(mode).options(**options).save(path)


def write_finished(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a table, and its manifest after it."""
    write_table(df, path, fmt)
    write_manifest(df.sparkSession, path, fmt)


def write_by_key(df: DataFrame, path: str, key: str, buckets: int = 256, fmt: str = "parquet") -> None:
    """Files grouped by a hash bucket of the key, sorted by key inside.

    A reader of one key opens one bucket directory and, with Parquet statistics,
    few row groups; a directory per key would mean millions of tiny files. The number of
    buckets is kept with the table, as the outer directory.
    """
    bucketed = df.withColumn("buckets", F.lit(buckets)).withColumn("bucket", key_bucket(key, F.lit(buckets)))
    # Ranges, not one task per bucket: a bucket may span many tasks.
    sorted_rows = bucketed.repartitionByRange("bucket", key).sortWithinPartitions("bucket", key)
    sorted_rows.write.format(fmt).mode("overwrite").partitionBy("buckets", "bucket").save(path)


def key_bucket(key: str | Column, buckets: Column) -> Column:
    return F.pmod(F.xxhash64(key), buckets).cast("int")


def read_one_key(spark: SparkSession, path: str, key: str, value: str, fmt: str = "parquet") -> DataFrame:
    """Rows of one key of a ``write_by_key`` table; partition pruning leaves one bucket."""
    table = spark.read.format(fmt).load(path)
    own = F.col("bucket") == key_bucket(F.lit(value), F.col("buckets"))
    return table.filter(own & (F.col(key) == value)).drop("buckets", "bucket")


def read_checked(spark: SparkSession, path: str, needed: dict[str, str | None], fmt: str = "parquet") -> DataFrame:
    """Load a table and reject one that lacks a needed column or has it in another type.

    ``needed`` gives each column's type, null for any. Types of formats that store them are
    compared before a job reads rows. Text formats are read by the given types, none of which may
    be open, and the first row that does not fit them stops the job.
    """
    if fmt != "parquet":
        untyped = [c for c, t in needed.items() if t is None]
        if untyped:
            raise ValueError(f"a type is needed for {', '.join(untyped)} to read {fmt}")
        schema = ", ".join(f"`{c}` {t}" for c, t in needed.items())
        return spark.read.schema(schema).option("mode", "FAILFAST").format(fmt).load(path)
    table = spark.read.format(fmt).load(path)
    types = {f.name: f.dataType.simpleString() for f in table.schema.fields}
    missing = [c for c in needed if c not in types]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    wrong = [f"{c} is {types[c]}, not {t}" for c, t in needed.items() if t and types[c] != t]
    if wrong:
        raise ValueError(f"{path}: {', '.join(wrong)}")
    return table


def _texts(columns: list[str]) -> dict[str, str | None]:
    return dict.fromkeys(columns, "string")


def read_districts(spark: SparkSession, path: str) -> DataFrame:
    return read_checked(spark, path, {"ord": None, **_texts([*DISTRICT_COLUMNS, "slug"])})


def read_schools(spark: SparkSession, path: str) -> DataFrame:
    return read_checked(spark, path, {"ord": None, **_texts(["district_cds", *SCHOOL_COLUMNS])})


def read_page_params(spark: SparkSession, path: str) -> DataFrame:
    """Page parameters written by ``page_params``."""
    return spark.read.schema("districtSlug string").option("mode", "FAILFAST").json(path)
