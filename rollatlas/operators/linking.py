"""Schools and their districts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollatlas.functions.text import district_key, district_prefix
from rollatlas.operators.cleaning import is_page_school, is_strict_school
from rollatlas.operators.search import locale_key

CHUNK_ROWS = 4096


def link_status(schools: DataFrame, districts: DataFrame) -> DataFrame:
    """Every school with its district key and linked / bad_prefix / no_district.

    One join gives both the linked schools and the orphans.
    """
    keyed = schools.withColumn("district_cds", district_key("cds_code"))
    known = districts.select(F.col("cds_code").alias("district_cds"), F.lit(True).alias("_known"))
    joined = keyed.join(known, ["district_cds"], "left")
    status = (
        F.when(F.length(district_prefix("cds_code")) != 7, "bad_prefix")
        .when(F.col("_known").isNull(), "no_district")
        .otherwise("linked")
    )
    return joined.withColumn("link_status", status).drop("_known")


def linked_schools(schools: DataFrame, districts: DataFrame) -> DataFrame:
    """Schools whose district exists."""
    linked = link_status(schools, districts)
    return linked.filter(F.col("link_status") == "linked").drop("link_status")


def orphan_schools(schools: DataFrame, districts: DataFrame) -> DataFrame:
    """Schools without a district, with the reason."""
    linked = link_status(schools, districts)
    return linked.filter(F.col("link_status") != "linked")


def school_counts(schools: DataFrame, districts: DataFrame) -> DataFrame:
    """Public active schools per district, zero included.

    Counted per key before the join, so the join sees one row per district.
    """
    counts = (
        schools.filter(is_page_school() & (F.length(district_prefix("cds_code")) == 7))
        .groupBy(district_key("cds_code").alias("cds_code"))
        .agg(F.count(F.lit(1)).alias("school_count"))
    )
    joined = districts.join(counts, "cds_code", "left")
    return joined.withColumn("school_count", F.coalesce("school_count", F.lit(0)))


def position_block(df: DataFrame, rows: int, ord_col: str = "ord") -> Column:
    """Sortable block of source positions holding at most ``rows`` rows."""
    position = F.col(ord_col)
    if isinstance(df.schema[ord_col].dataType, T.StructType):
        return F.struct(
            position["file"].alias("file"),
            position["block"].alias("block"),
            F.floor(position["row"] / rows).alias("part"),
        )
    return F.floor(position / rows)


def number_in_key(df: DataFrame, key: str, name: str, ord_col: str = "ord", block_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows with their place (from 0) among the rows of their key in source order, nulls a key too.

    Prefix sums instead of one window over the key: rows are counted for each key and block of
    source positions, the counts are summed along the blocks, and rows are numbered inside a
    block. The only thing that meets in one task is a key's counts, one for each block.
    """
    blocked = df.withColumn("_block", position_block(df, block_rows, ord_col))
    counts = blocked.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(
        F.col(key).alias("_key"), F.col("_block").alias("_of"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(key, "_block").orderBy(ord_col)
    placed = blocked.withColumn("_inside", F.row_number().over(inside))
    joined = placed.join(before, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_of")))
    return joined.withColumn(name, F.col("_before") + F.col("_inside") - 1).select(*df.columns, name)


def chunk_by_key(
    df: DataFrame, key: str, columns: list[str], name: str, rows: int = CHUNK_ROWS
) -> DataFrame:
    """Rows per key as arrays in source order (A1): one array up to ``rows`` rows, beyond that
    full arrays numbered 0, 1, ... and one with the rest.

    No task holds more than ``rows`` rows of a key, however many the key has.
    """
    numbered = number_in_key(df, key, "_place")
    item = F.struct("_place", *columns)
    packed = numbered.groupBy(key, F.floor(F.col("_place") / rows).alias("chunk")).agg(
        F.sort_array(F.collect_list(item)).alias(name)
    )
    plain = F.transform(name, lambda s: F.struct(*[s[c].alias(c) for c in columns]))
    return packed.withColumn("n", F.size(name)).withColumn(name, plain)


def strict_school_list(linked: DataFrame) -> DataFrame:
    """Strict school list, districts together, names in locale order.

    A global sort: the range partitioning splits a large district by name.
    """
    kept = linked.filter(is_strict_school())
    return kept.orderBy("district_cds", locale_key("school"), "ord")
