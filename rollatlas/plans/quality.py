"""Counts a build reports (P10)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollatlas.functions.coordinates import in_bounds
from rollatlas.functions.text import present
from rollatlas.operators.cleaning import reject_report


def _metrics(df: DataFrame, section: str) -> DataFrame:
    """A one-row table of counts as (section, metric, value) rows."""
    pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("bigint").alias("value")) for c in df.columns]
    return df.select(F.explode(F.array(*pairs)).alias("_pair")).select(
        F.lit(section).alias("section"), "_pair.metric", "_pair.value"
    )


KINDS = ["districts", "schools"]


def geocode_totals(placed: DataFrame) -> DataFrame:
    """Geocode outcomes of districts and schools, and districts, pages and markers (A3, A5), of
    geocoded records with their ``kind``, counted in one pass."""
    district = F.col("kind") == KINDS[0]
    flags = {"tried": "geocode_tried", "successes": "geocode_ok", "fallback_successes": "geocode_fallback"}
    counts = {(f"geocode_{k}", n): F.count_if((F.col("kind") == k) & F.col(c)) for k in KINDS for n, c in flags.items()}
    counts[("totals", "districts")] = F.count_if(district)
    counts[("totals", "slugs")] = F.count_if(district & present("slug"))
    counts[("totals", "valid_markers")] = F.count_if(district & in_bounds(F.col("lat"), F.col("lon")))
    listed = [
        F.struct(F.lit(s).alias("section"), F.lit(m).alias("metric"), c.cast("bigint").alias("value")) for (s, m), c in counts.items()
    ]
    return placed.agg(F.array(*listed).alias("_all")).select(F.inline("_all"))


def totals(read: DataFrame, links: DataFrame) -> DataFrame:
    """Records read, linked and orphan schools (A5); ``read`` holds reject counts."""
    read = _metrics(read.agg(F.sum("value").alias("records")).fillna(0), "totals")
    school = _metrics(
        links.agg(
            F.count(F.lit(1)).alias("schools"),
            F.count_if(F.col("link_status") == "linked").alias("linked_schools"),
            F.count_if(F.col("link_status") == "bad_prefix").alias("bad_prefix"),
            F.count_if(F.col("link_status") == "no_district").alias("no_district"),
        ),
        "totals",
    )
    return read.unionByName(school)


def boundary_totals(features: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Features read, features without an id, features written (A5)."""
    read = features.agg(
        F.count(F.lit(1)).alias("features"),
        F.count_if(~F.coalesce(present("boundary_id"), F.lit(False))).alias("without_id"),
    )
    written = boundaries.agg(
        F.count(F.lit(1)).alias("boundaries"),
        F.count_if(~F.col("reprojected")).alias("not_reprojected"),
    )
    return _metrics(read, "boundaries").unionByName(_metrics(written, "boundaries"))


def quality_report(raw: DataFrame, placed: DataFrame, links: DataFrame) -> DataFrame:
    """All counts of a directory build as (section, metric, value) (P10).

    ``placed`` holds geocoded districts and schools with their ``kind``. Each table is counted in
    one pass, however many counts it gives.
    """
    rejects = reject_report(raw).select(
        F.lit("rejects").alias("section"),
        F.col("reject_reason").alias("metric"),
        F.col("records").alias("value"),
    )
    return reduce(DataFrame.unionByName, [rejects, geocode_totals(placed), totals(rejects, links)])
