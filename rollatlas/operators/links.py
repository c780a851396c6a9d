"""Links between pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollatlas.functions.text import col
from rollatlas.functions.urls import (
    normalize_url,
    page_base,
    resolve_url,
    strip_fragment,
)
from rollatlas.operators.arrays import explode_costly

_ANCHOR = r"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)"

# Character references that occur in link targets.
_REFERENCES = {"&quot;": '"', "&#39;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}


def anchor_hrefs(html: Column | str) -> Column:
    """href of every anchor of a page, in order."""
    found = F.regexp_extract_all(col(html), F.lit(_ANCHOR), F.lit(1))

    def clean(value: Column) -> Column:
        out = F.regexp_replace(value, "^[\"']|[\"']$", "")
        for reference, plain in _REFERENCES.items():
            out = F.replace(out, F.lit(reference), F.lit(plain))
        return out

    return F.transform(found, clean)


def _own_links(pages: DataFrame, base_origin: str | None) -> DataFrame:
    """Pages with the array of their distinct same-origin links.

    Duplicates go inside the row, before any explode, so nothing is shuffled.
    """
    based = pages.select("page_id", page_base("url").alias("_base"), anchor_hrefs("html").alias("_hrefs"))
    home = F.lit(base_origin) if base_origin else F.col("_base.origin")
    absolute = F.transform("_hrefs", lambda href: resolve_url(href, "_base"))
    located = based.select("page_id", home.alias("_home"), absolute.alias("_links"))
    # Resolved links start with their normalized origin.
    own = F.filter("_links", lambda link: F.regexp_extract(link, "^(https?://[^/]*)", 1) == F.col("_home"))
    return located.select("page_id", F.array_distinct(own).alias("links"))


def internal_links(pages: DataFrame, base_origin: str | None = None) -> DataFrame:
    """Distinct same-origin links of each page.

    Same origin means the page's own, or ``base_origin`` when given.
    """
    return explode_costly(_own_links(pages, base_origin), ["page_id"], "links", "link")


def page_link_counts(pages: DataFrame, base_origin: str | None = None) -> DataFrame:
    """Number of distinct internal links per page, and whether there is at least one."""
    counted = _own_links(pages, base_origin).select("page_id", F.size("links").alias("internal_links"))
    return counted.withColumn("has_link", F.col("internal_links") > 0)


def broken_links(links: DataFrame, known: DataFrame) -> DataFrame:
    """Links whose target is not among the known page addresses."""
    targets = links.withColumn("_target", strip_fragment("link"))
    urls = known.select(normalize_url(strip_fragment("url")).alias("_target")).distinct()
    broken = targets.join(urls, ["_target"], "left_anti")
    return broken.drop("_target")


def broken_targets(links: DataFrame, known: DataFrame) -> DataFrame:
    """Missing targets with the number of pages that link to them.

    Counted per target first, so the anti-join sees each target once.
    """
    counted = links.groupBy(strip_fragment("link").alias("target")).agg(
        F.count_distinct("page_id").alias("pages")
    )
    urls = known.select(normalize_url(strip_fragment("url")).alias("target"))
    return counted.join(urls, "target", "left_anti")
