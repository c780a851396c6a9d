"""District pages: one row per page, and the schools shown on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollatlas.functions import display as D
from rollatlas.functions.text import district_key, or_default, present
from rollatlas.operators.arrays import posexplode_costly
from rollatlas.operators.cleaning import is_page_school
from rollatlas.operators.linking import CHUNK_ROWS, chunk_by_key
from rollatlas.operators.ranking import first_per_key
from rollatlas.schema import NO_DATA

STREET = ["street_address", "street_city", "street_state", "street_zip"]


def page_districts(params: DataFrame, districts: DataFrame) -> DataFrame:
    """District of every page parameter: the first with the slug."""
    named = first_per_key(districts.filter(present("slug")), ["slug"], ["ord"])
    wanted = params.filter(present("districtSlug")).select(F.col("districtSlug").alias("slug"))
    return wanted.join(named, "slug", "inner")


def district_pages(params: DataFrame, districts: DataFrame, linked: DataFrame) -> DataFrame:
    """One row per page with everything its card shows."""
    pages = page_districts(params, districts)
    # Pre-counted: the join meets one row per district.
    counts = (
        linked.filter(is_page_school())
        .groupBy(F.col("district_cds").alias("cds_code"))
        .agg(F.count(F.lit(1)).alias("school_count"))
    )
    shown = pages.join(counts, "cds_code", "left")
    site = F.when(F.col("website") != NO_DATA, D.website_href("website"))
    return shown.select(
        "slug",
        "cds_code",
        D.page_title("district").alias("title"),
        D.page_description("district", "county").alias("description"),
        or_default("district", "Unknown District").alias("name"),
        or_default("status", "N/A").alias("status"),
        or_default("entity_type", "N/A").alias("entity_type"),
        D.grade_span("low_grade", "high_grade").alias("grades"),
        D.address_line(*STREET).alias("address"),
        or_default("phone", "N/A").alias("phone"),
        F.coalesce(site, F.lit(D.NO_WEBSITE)).alias("website"),
        D.district_dashboard("cds_code").alias("dashboard_url"),
        D.directory_profile("cds_code").alias("profile_url"),
        F.coalesce("school_count", F.lit(0)).alias("school_count"),
        D.page_trail("district").alias("breadcrumbs"),
    )


def page_schools(
    params: DataFrame, districts: DataFrame, linked: DataFrame
) -> DataFrame:
    """Schools of every page, one row per school.

    The list order of a page is the order of ``ord``.
    """
    pages = page_districts(params, districts).select("slug", F.col("cds_code").alias("district_cds"))
    kept = linked.filter(is_page_school())
    shown = kept.join(pages, ["district_cds"], "inner")
    site = F.when(F.col("website") != NO_DATA, D.website_href("website"))
    return shown.select(
        "slug",
        "ord",
        "cds_code",
        or_default("school", "Unknown School").alias("name"),
        D.grade_span("low_grade", "high_grade", "school").alias("grades"),
        D.address_line(*STREET).alias("address"),
        F.coalesce(site, F.lit(D.NO_WEBSITE)).alias("website"),
        D.school_dashboard("cds_code").alias("dashboard_url"),
        D.directory_profile("cds_code").alias("profile_url"),
    )


def page_school_chunks(schools: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """School arrays per page in list order, in bounded chunks."""
    columns = ["cds_code", "name", "grades", "address", "website", "dashboard_url", "profile_url"]
    return chunk_by_key(schools, "slug", columns, "schools", rows)


def school_links(schools: DataFrame) -> DataFrame:
    """Link line of the strict list: usable website, report, directory entry."""
    line = D.join_links(
        D.website_usable("website"), D.year_report("cds_code"), D.directory_profile("cds_code")
    )
    return schools.select(
        "ord",
        "cds_code",
        district_key("cds_code").alias("district_cds"),
        "school",
        D.grade_span("low_grade", "high_grade", "list").alias("grades"),
        D.address_flat(*STREET).alias("address"),
        line.alias("links"),
    )


def district_details(districts: DataFrame) -> DataFrame:
    """Label and value rows of a district card, in card order."""
    grades = D.grade_span("low_grade", "high_grade")
    entries = D.detail_list(
        {
            "County": "county",
            "Type": "entity_type",
            "Status": "status",
            "Funding Type": "funding_type",
            "Address": D.address_flat(*STREET),
            "Grade Span": F.when(grades != "N/A", grades),
            "Phone": "phone",
            "Website": "website",
        }
    )
    listed = posexplode_costly(districts, ["cds_code"], entries, "position", "_entry")
    return listed.select("cds_code", "position", "_entry.label", "_entry.value")
