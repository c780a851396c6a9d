"""From raw directory records to district and school rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollatlas.functions.text import or_sentinel, present, slug, strip_www_for_hosts, trim_blanks
from rollatlas.operators.ranking import first_per_key
from rollatlas.schema import (
    ACTIVE,
    DISTRICT_COLUMNS,
    DISTRICT_TYPES,
    REDACTED,
    SCHOOL_COLUMNS,
    SCHOOL_TYPE,
)

# Hosts whose published addresses carry a www. prefix that does not resolve.
# Fixed value: hosts whose website only answers with www.
WWW_HOSTS = ("srvusd.net",)


def is_redacted(street: str = "street_address") -> Column:
    return F.coalesce(F.lower(F.col(street)).contains(REDACTED), F.lit(False))


def reject_reason() -> Column:
    """Why a record is left out; null when it is kept (A4). First matching rule wins."""
    return (
        F.when(~present("cds_code"), "missing_key")
        .when(~F.col("status").eqNullSafe(F.lit(ACTIVE)), "status")
        .when(is_redacted(), "redacted")
        .when(~F.coalesce(F.col("record_type").isin(*DISTRICT_TYPES, SCHOOL_TYPE), F.lit(False)), "record_type")
    )


def accepted(raw: DataFrame) -> DataFrame:
    """Key present, active, address not redacted (F1-F3). Plain predicates, so they reach the scan."""
    return raw.filter(F.col("cds_code") != "").filter(F.col("status") == ACTIVE).filter(~is_redacted())


def keep_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Kept columns with the sentinel for nulls (F5), source position first."""
    return df.select("ord", *[or_sentinel(c).alias(c) for c in columns])


def district_rows(raw: DataFrame) -> DataFrame:
    """Districts and county offices, first surviving row per code, with slug."""
    rows = accepted(raw).filter(F.col("record_type").isin(*DISTRICT_TYPES))
    kept = keep_columns(rows, DISTRICT_COLUMNS)
    unique = first_per_key(kept, ["cds_code"], ["ord"])
    return unique.withColumn("slug", slug("district", "cds_code"))


def school_rows(raw: DataFrame, www_hosts: tuple[str, ...] = WWW_HOSTS) -> DataFrame:
    """School rows, not de-duplicated, website prefix corrected."""
    rows = accepted(raw).filter(F.col("record_type") == SCHOOL_TYPE)
    kept = keep_columns(rows, SCHOOL_COLUMNS)
    return kept.withColumn("website", strip_www_for_hosts("website", www_hosts))


def is_page_school() -> Column:
    """Active and public, whatever the case and blanks of the flag."""
    return (F.col("status") == ACTIVE) & (F.upper(trim_blanks("public_yes_no")) == "Y")


def is_strict_school() -> Column:
    """Older, narrower rule: exact flag, no homeschools, no redacted address."""
    return (
        (F.col("status") == ACTIVE)
        & (F.col("public_yes_no") == "Y")
        & ~F.coalesce(F.lower("educational_program_type") == "homeschool", F.lit(False))
        & ~F.coalesce(F.lower("school") == "homeschool", F.lit(False))
        & ~F.coalesce(F.col("street_address") == "Information Redacted", F.lit(False))
    )


def reject_report(raw: DataFrame) -> DataFrame:
    """Number of records per outcome (A4)."""
    outcome = F.coalesce(reject_reason(), F.lit("kept"))
    return raw.groupBy(outcome.alias("reject_reason")).agg(F.count(F.lit(1)).alias("records"))
