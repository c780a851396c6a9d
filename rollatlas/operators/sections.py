"""Guides as a table of sections, each under a heading, with a stable id and its source address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollatlas.functions.text import col
from rollatlas.operators.arrays import posexplode_costly
from rollatlas.operators.outline import heading_pieces, heading_slug, heading_text, unique_anchors


def clean_text(text: Column | str) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(col(text), r"\s+", " "))


def guide_sections(guides: DataFrame, base: str = "", text: str = "text") -> DataFrame:
    """sections(doc_id, pos, section_id, title, body, source_url) of every guide.

    The id is the guide's with the heading's anchor: it stays when other sections come or go. The
    address leads to the heading on the guide's page below ``base``. Text before the first heading
    is no section. All within the row.
    """
    found = guides.select("doc_id", F.transform(heading_pieces(text), _section).alias("_sections"))
    slugs = found.withColumn("_anchors", unique_anchors(F.transform("_sections", lambda s: heading_slug(s["title"]))))
    joined = F.zip_with("_sections", "_anchors", lambda s, a: s.withField("anchor", a))
    listed = posexplode_costly(slugs, ["doc_id"], joined, "pos", "_section")
    page = F.concat(F.lit(f"{base}/guides/"), F.col("doc_id").cast("string"), F.lit("#"), F.url_encode("_section.anchor"))
    return listed.select(
        "doc_id", "pos", F.concat_ws("#", F.col("doc_id").cast("string"), F.col("_section.anchor")).alias("section_id"),
        F.col("_section.title").alias("title"), F.col("_section.body").alias("body"), page.alias("source_url"),
    )


def _section(piece: Column) -> Column:
    body = F.regexp_replace(piece, r"\A[^\n]*", "")
    return F.struct(heading_text(piece).alias("title"), clean_text(body).alias("body"))
