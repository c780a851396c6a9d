"""Fields shown on pages, maps and lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollatlas.functions.text import col, has_value, join_values, or_default, present, trim_blanks

# Texts that stand in for missing fields.
NO_ADDRESS = "Address Not Available"
NO_WEBSITE = "Website Not Available"
UNKNOWN_DISTRICT = "Unknown District"
NO_VALUE = "N/A"
# Texts around names in titles and descriptions.
TITLE_END = " - District Details"
ABOUT = "Information and schools for "
HOME_STATE_NAME = "California"
ABOUT_END = ". View address, website, grades, and map."

# Addresses of the public profile pages, keyed by code.
DISTRICT_DASHBOARD = "https://www.caschooldashboard.org/reports/gissearch/districts/"
SCHOOL_DASHBOARD = "https://www.caschooldashboard.org/reports/gissearch/schools/"
DIRECTORY_PROFILE = "https://www.cde.ca.gov/schooldirectory/details?cdscode="
YEAR_REPORT = "https://www.caschooldashboard.org/reports/"
REPORT_YEAR = "2024"

# Texts of the popups of districts and offices.
DETAILS_LINK = '">View Details</a>'
OFFICE_MARK = " Office</b><br>"


def _stated(c: Column | str) -> Column:
    """Trimmed text, or null when blank or the sentinel in any case."""
    text = trim_blanks(c)
    return F.when((text != "") & (F.lower(col(c)) != "no data"), text)


def address_line(street, city, state, zip_code) -> Column:
    """Canonical address: the zip follows its state, else stands alone."""
    state, zip_code = _stated(state), _stated(zip_code)
    region = F.concat_ws(" ", state, zip_code)
    line = F.concat_ws(", ", _stated(street), _stated(city), F.nullif(region, F.lit("")))
    return or_default(line, NO_ADDRESS)


def address_for_map(street, city, state, zip_code) -> Column:
    """Map address: third and fourth stated parts are joined by a space."""
    parts = F.filter(F.array(*[col(c) for c in (street, city, state, zip_code)]), has_value)
    n = F.size(parts)
    tail = F.concat_ws(" ", F.slice(parts, 3, 2))
    long_form = trim_blanks(F.concat_ws(", ", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), tail))
    return (
        F.when(n >= 3, long_form)
        .when(n >= 1, F.concat_ws(", ", parts))
        .otherwise(F.lit(NO_ADDRESS))
    )


def address_flat(street, city, state, zip_code) -> Column:
    """All stated parts in a row; empty when there is none."""
    return join_values(street, city, state, zip_code)


def website_href(url: Column | str) -> Column:
    """Link target of a website field (X11)."""
    href = trim_blanks(url)
    bare = href.contains(".") & ~href.startswith("http") & ~href.startswith("//")
    return (
        F.when(~has_value(url), F.lit(NO_WEBSITE))
        .when(bare, F.concat(F.lit("//"), href))
        .otherwise(href)
    )


def website_usable(url: Column | str) -> Column:
    """Link target when it can be followed, else null."""
    href = website_href(url)
    return F.when(has_value(url) & (href.startswith("http") | href.startswith("//")), href)


def grade_span(low: Column | str, high: Column | str, style: str = "district") -> Column:
    """Grade range (X14). Styles: district, school, popup, list."""
    low, high = col(low), col(high)
    both = has_value(low) & has_value(high)
    span = F.concat_ws(" - ", low, high)
    if style == "district":
        return F.when(both, span).otherwise(NO_VALUE)
    if style == "school":
        return F.when(both, F.format_string("(%s)", span)).otherwise("")
    if style == "list":
        return F.when(both, F.format_string("(Grades: %s)", span)).otherwise("")
    if style == "popup":
        capital = [F.when(F.upper(g) == "K", F.lit("K")).otherwise(g) for g in (low, high)]
        return F.when(
            both, F.concat(F.lit("Grades: "), F.concat_ws(" - ", *capital))
        ).otherwise("Grades: N/A")
    raise ValueError(f"unknown grade span style: {style}")


def district_dashboard(code) -> Column:
    return F.concat(F.lit(DISTRICT_DASHBOARD), col(code))


def school_dashboard(code) -> Column:
    return F.concat(F.lit(SCHOOL_DASHBOARD), col(code))


def directory_profile(code) -> Column:
    return F.concat(F.lit(DIRECTORY_PROFILE), col(code))


def year_report(code, year: str = REPORT_YEAR) -> Column:
    return F.concat(F.lit(YEAR_REPORT), col(code), F.lit(f"/{year}"))


def page_path(slug: Column | str, base: str = "/") -> Column:
    """Path of a district page; null without a slug."""
    root = base[:-1] if base.endswith("/") else base
    return F.when(present(slug), F.concat(F.lit(root + "/districts/"), col(slug)))


def marker_link(slug: Column | str, code: Column | str, base: str = "/") -> Column:
    """Link in a district marker; the code stands in for a missing slug."""
    target = F.coalesce(F.nullif(col(slug), F.lit("")), col(code))
    return F.concat(F.lit(base + "districts/"), target, F.lit("/"))


def district_popup(name: Column | str, link: Column | str) -> Column:
    """Popup of a district's marker on the index map."""
    return F.concat(F.lit("<b>"), col(name), F.lit('</b><br><a href="'), col(link), F.lit(DETAILS_LINK))


def office_popup(name: Column | str, address: Column | str) -> Column:
    """Popup of a district office's marker."""
    return F.concat(F.lit("<b>"), col(name), F.lit(OFFICE_MARK), col(address))


def page_title(name: Column | str) -> Column:
    return F.concat(or_default(name, UNKNOWN_DISTRICT), F.lit(TITLE_END))


def page_description(name: Column | str, county: Column | str) -> Column:
    return F.concat(
        F.lit(ABOUT),
        or_default(name, UNKNOWN_DISTRICT),
        F.lit(" in "),
        or_default(county, HOME_STATE_NAME),
        F.lit(ABOUT_END),
    )


def join_links(*links: Column | str) -> Column:
    """Join the links that are there by space-pipe-space."""
    return F.concat_ws(" | ", *[F.nullif(col(link), F.lit("")) for link in links])


def page_trail(name: Column | str) -> Column:
    """Trail of a district page: home, then the page itself without a link."""
    return F.array(
        F.struct(F.lit("Home").alias("text"), F.lit("/").alias("href")),
        F.struct(
            or_default(name, UNKNOWN_DISTRICT).alias("text"),
            F.lit(None).cast("string").alias("href"),
        ),
    )


def breadcrumbs(trail: Column | str, base: str = "/") -> Column:
    """Root-relative links get the base prefix; the last entry has no link."""
    trail = col(trail)
    root = base if base.endswith("/") else base + "/"

    def link(crumb: Column, index: Column) -> Column:
        href = F.nullif(crumb["href"], F.lit(""))
        if base and base != "/":
            local = href.startswith("/") & ~href.startswith("//")
            href = F.when(local, F.concat(F.lit(root), F.substr(href, F.lit(2)))).otherwise(href)
        shown = F.when(index < F.size(trail) - 1, href)
        return F.struct(crumb["text"].alias("text"), shown.alias("href"))

    return F.transform(trail, link)


def page_metadata(
    front_matter: Column | str,
    title: Column | str,
    description: Column | str,
    site_title: str,
    site_description: str,
) -> Column:
    """Title and description: front matter as a whole when there, else the page's own."""
    front, own_title, own_text = col(front_matter), col(title), col(description)
    chosen_title = F.when(front.isNotNull(), front["title"]).otherwise(own_title)
    chosen_text = F.when(front.isNotNull(), front["description"]).otherwise(own_text)
    return F.struct(
        or_default(chosen_title, site_title).alias("title"),
        or_default(chosen_text, site_description).alias("description"),
    )


def detail_list(record: dict[str, Column | str]) -> Column:
    """(label, value) entries in the given order, missing values dropped."""
    entries = F.array(
        *[F.struct(F.lit(label).alias("label"), col(c).alias("value")) for label, c in record.items()]
    )
    return F.filter(entries, lambda e: has_value(e["value"]))
