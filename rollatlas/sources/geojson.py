"""GeoJSON readers: features(pos, feature) with the feature as JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollatlas.operators.arrays import posexplode_costly
from rollatlas.sources.directory import read_lines


def explode_collections(documents: DataFrame, text: str = "document") -> DataFrame:
    """FeatureCollection documents to features.

    Stops the job on a document of another type or without a feature list.
    ``documents`` has ``ord`` and the document text.
    """
    document = F.from_json(F.col(text), "type string, features array<string>")
    read = documents.select("ord", document.alias("_document"))
    wrong = F.lit("not a GeoJSON FeatureCollection")
    valid = F.coalesce(F.col("_document.type") == "FeatureCollection", F.lit(False)) & F.col(
        "_document.features"
    ).isNotNull()
    features = F.when(valid, F.col("_document.features")).otherwise(
        F.raise_error(wrong).cast("array<string>")
    )
    listed = posexplode_costly(read, ["ord"], features, "_index", "feature")
    return listed.select(F.struct("ord", "_index").alias("pos"), "feature")


def read_collections(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Whole FeatureCollection files. One task reads one file; fit for files of moderate size."""
    documents = spark.read.text(path, wholetext=True).select(
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.lit(0).cast("bigint").alias("block"),
            F.lit(0).cast("bigint").alias("row"),
        ).alias("ord"),
        F.col("value").alias("document"),
    )
    return explode_collections(documents)


def read_feature_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One feature per line, the splittable form for large boundary sets.

    Also takes a FeatureCollection written with one feature per line: its frame
    lines are dropped and the comma after a feature is cut off.
    """
    lines = read_lines(spark, path)
    text = F.regexp_replace(F.trim("line"), r",\s*\z", "")
    return (
        lines.select(F.struct("ord", F.lit(0).alias("_index")).alias("pos"), text.alias("feature"))
        .filter(F.get_json_object("feature", "$.type") == "Feature")
    )
