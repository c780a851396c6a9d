"""Manifests: what a finished table holds, file by file, and tables kept district by district.

A manifest lists the committed files of a table with their rows and a checksum. It is written last
and lies in ``_manifest`` below the table, where table readers do not look; overwriting the table
removes it. So a table with a manifest is complete, and ``read_listed`` refuses files that none
lists or that are gone.

A file's checksum is the sum of 31 bits of each row's hash, so checksums of files add up: those of
a partition's files tell whether its rows are the same as others, without reading them. Columns
that are folders (``keys``) are not part of it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollatlas.functions.text import sanitize_key

FOLDER = "_manifest"
_SCHEMA = "version long, file string, rows long, checksum long, bytes long"
# The end of a path: its folders named after values, and the file.
_INSIDE = r"((?:[^/=]*=[^/]*/)*[^/]*)$"


def _checksum(columns: list[str]) -> list[Column]:
    bits = F.shiftright(F.xxhash64(*sorted(columns)), 33)
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(bits), F.lit(0)).alias("checksum")]


def _with_files(table: DataFrame) -> DataFrame:
    name = F.regexp_extract("_metadata.file_path", _INSIDE, 1)
    return table.select("*", name.alias("file"), F.col("_metadata.file_size").alias("_size"))


def _listing(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(file, rows, checksum, bytes) of rows with their file."""
    columns = [c for c in rows.columns if c not in ("file", "_size", *keys)]
    return rows.groupBy("file").agg(*_checksum(columns), F.max("_size").alias("bytes"))


def _files(table: DataFrame) -> set[str]:
    """Files of a table as Spark's reader has listed them on the driver, also those without rows."""
    return {re.search(_INSIDE, name)[1] for name in table.inputFiles()}


def _whole_listing(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    every = table.sparkSession.createDataFrame([(f,) for f in _files(table)], "file string")
    counted = every.join(_listing(_with_files(table), keys), "file", "left")
    return counted.fillna(0, ["rows", "checksum", "bytes"])


def write_manifest(spark: SparkSession, path: str, fmt: str = "parquet", keys: Sequence[str] = ()) -> None:
    """List the files that are committed under ``path``."""
    _append(_whole_listing(spark.read.format(fmt).load(path), keys), path, _version(spark, path) + 1)


def _append(listing: DataFrame, path: str, version: int) -> None:
    """Add a version; its mark, a row without a file, is there for an empty table too."""
    numbered = listing.select(F.lit(version).cast("long").alias("version"), "file", "rows", "checksum", "bytes")
    mark = listing.sparkSession.createDataFrame([(version, None, 0, 0, 0)], _SCHEMA)
    numbered.unionByName(mark).write.mode("append").parquet(f"{path}/{FOLDER}")


def _version(spark: SparkSession, path: str) -> int:
    try:
        found = spark.read.schema(_SCHEMA).parquet(f"{path}/{FOLDER}").agg(F.max("version")).first()[0]
    except AnalysisException:
        return 0
    return found or 0


def has_manifest(spark: SparkSession, path: str) -> bool:
    return _version(spark, path) > 0


def _of_version(spark: SparkSession, path: str, version: int) -> DataFrame:
    listed = spark.read.schema(_SCHEMA).parquet(f"{path}/{FOLDER}")
    return listed.filter((F.col("version") == version) & F.col("file").isNotNull()).drop("version")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows, checksum, bytes) of the last manifest of a table."""
    version = _version(spark, path)
    if not version:
        raise ValueError(f"{path} has no manifest: it was not finished")
    return _of_version(spark, path, version)


def differences(spark: SparkSession, path: str, fmt: str = "parquet", keys: Sequence[str] = ()) -> DataFrame:
    """(file, problem) of the files that are not as the manifest lists them: added, gone, changed."""
    now = _whole_listing(spark.read.format(fmt).load(path), keys).drop("bytes")
    listed = manifest(spark, path).select("file", F.col("rows").alias("_rows"), F.col("checksum").alias("_checksum"))
    joined = now.join(listed, "file", "full")
    same = (F.col("rows") == F.col("_rows")) & (F.col("checksum") == F.col("_checksum"))
    problem = F.when(F.col("_rows").isNull(), "added").when(F.col("rows").isNull(), "gone").when(~same, "changed")
    return joined.select("file", problem.alias("problem")).filter("problem IS NOT NULL")


def read_listed(
    spark: SparkSession, path: str, fmt: str = "parquet", folder: str = "", schema: T.StructType | str | None = None
) -> DataFrame:
    """A table, or what lies in one ``folder`` of it, whose files are just those of its manifest.

    Names alone are compared; ``differences`` compares rows.
    """
    listed = manifest(spark, path)
    if folder:
        listed = listed.filter(F.startswith("file", F.lit(folder + "/")))
    want = {r[0] for r in listed.select("file").collect()}
    if folder and not want:
        raise ValueError(f"{path} holds no {folder}")
    reader = spark.read.format(fmt)
    table = (reader.schema(schema) if schema else reader).load(f"{path}/{folder}" if folder else path)
    found = _files(table)
    if found != want:
        odd = sorted(found ^ want)
        raise ValueError(f"{path}: {len(odd)} files are not as its manifest lists them, first {odd[0]}")
    return table


def write_districts(df: DataFrame, path: str, key: str) -> int:
    """Store rows by district, only the districts whose rows have changed; how many those are.

    Each district is a folder, so one district loads alone. A district's rows are compared with the
    stored ones by their number and checksum. Other districts keep their files, also those that
    ``df`` does not hold. Keys become names of folders and must be fit for that. ``df`` must give
    the same rows each time it is read.
    """
    spark = df.sparkSession
    columns = [c for c in df.columns if c != key]
    version = _version(spark, path)
    folder = F.regexp_extract("file", f"^{key}=([^/]*)/", 1)
    if version:
        stored = _of_version(spark, path, version).groupBy(folder.alias(key)).agg(
            F.sum("rows").alias("_rows"), F.sum("checksum").alias("_checksum")
        )
    else:
        stored = spark.createDataFrame([], f"{key} string, _rows long, _checksum long")
    compared = df.groupBy(key).agg(*_checksum(columns)).join(stored, key, "left")
    same = (F.col("rows") == F.col("_rows")) & (F.col("checksum") == F.col("_checksum"))
    changed = compared.filter(~F.coalesce(same, F.lit(False))).select(key)
    unfit = F.col(key).isNull() | (F.col(key) == "") | (sanitize_key(key) != F.col(key))
    todo = changed.agg(F.count(F.lit(1)).alias("n"), F.count_if(unfit).alias("unfit")).first()
    if todo["unfit"]:
        raise ValueError(f"{key} holds values that cannot name a folder")
    if not todo["n"]:
        return 0
    # By ranges of rows too, so that a district with many is written by many tasks.
    rows = df.join(changed, key, "left_semi")
    spread = rows.repartitionByRange(key, F.xxhash64(*columns)).sortWithinPartitions(key)
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
    written = _with_files(spark.read.schema(df.schema).parquet(path)).join(changed, key, "left_semi")
    listing = _listing(written, [key])
    if version:
        kept = _of_version(spark, path, version).withColumn("_key", folder)
        listing = kept.join(changed, F.col("_key") == F.col(key), "left_anti").drop("_key").unionByName(listing)
    _append(listing, path, version + 1)
    return todo["n"]


def read_district(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """One district of a table written by ``write_districts``: only its folder is opened."""
    return read_listed(spark, path, folder=f"{key}={value}").withColumn(key, F.lit(value))
