"""Text rules of the directory: trimming, sentinels, slugs, keys, street names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollatlas.schema import NO_DATA

# The white space a browser strips. Java's \s covers ASCII only and
# its Unicode mode differs on U+0085 and U+FEFF, so the set is spelled out.
BLANKS = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
BLANK_CLASS = (
    r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
)

# Ordinal words written as numerals in street names.
ORDINALS = {
    "first": "1st", "second": "2nd", "third": "3rd", "fourth": "4th", "fifth": "5th",
    "sixth": "6th", "seventh": "7th", "eighth": "8th", "ninth": "9th", "tenth": "10th",
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_blanks(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(BLANKS))


def has_value(c: Column | str) -> Column:
    """True for text that is neither empty nor the missing-data sentinel."""
    c = col(c)
    return c.isNotNull() & (c != "") & (c != NO_DATA)


def present(c: Column | str) -> Column:
    """True for non-empty text (the sentinel counts as text)."""
    c = col(c)
    return c.isNotNull() & (c != "")


def or_default(c: Column | str, default: str) -> Column:
    """The text, or ``default`` when it is null or empty."""
    return F.coalesce(F.nullif(col(c), F.lit("")), F.lit(default))


def or_sentinel(c: Column | str) -> Column:
    """The text, or the sentinel when null; empty text stays empty."""
    return F.coalesce(col(c), F.lit(NO_DATA))


def join_values(*parts: Column | str, sep: str = ", ") -> Column:
    """Join the parts that have a value."""
    return F.concat_ws(sep, *[F.when(has_value(p), col(p)) for p in parts])


def count_values(*parts: Column | str) -> Column:
    total = F.lit(0)
    for part in parts:
        total = total + has_value(part).cast("int")
    return total


def slug(name: Column | str, code: Column | str) -> Column:
    """URL slug: cleaned name, hyphen, code; the code alone without a usable name."""
    name, code = col(name), col(code)
    words = F.regexp_replace(F.lower(name), BLANK_CLASS + "+", "-")
    plain = F.regexp_replace(words, "[^-a-z0-9]", "")
    single = F.regexp_replace(plain, "-+", "-")
    clean = F.regexp_replace(single, r"^-|-\z", "")
    usable = has_value(name) & present(code) & (clean != "")
    return F.when(usable, F.concat_ws("-", clean, code)).otherwise(code)


def district_prefix(code: Column | str) -> Column:
    return F.substring(col(code), 1, 7)


def district_key(code: Column | str) -> Column:
    """Code of the district a 14-digit code belongs to."""
    return F.concat(district_prefix(code), F.lit("0000000"))


def sanitize_key(key: Column | str) -> Column:
    """Replace everything outside letters, digits, underscore and hyphen."""
    return F.regexp_replace(col(key), "[^a-zA-Z0-9_-]", "_")


def normalize_street(street: Column | str) -> Column:
    """Trim and write First..Tenth as numerals; null for empty input."""
    out = trim_blanks(street)
    # Explicit ASCII word edges: Java's \b treats accented letters as word
    # characters, the source rule does not.
    for word, numeral in ORDINALS.items():
        out = F.regexp_replace(out, f"(?i)(?<![A-Za-z0-9_]){word}(?![A-Za-z0-9_])", numeral)
    return F.when(present(street), out)


def street_only(normalized: Column | str) -> Column:
    """Street without its leading house number."""
    return trim_blanks(F.regexp_replace(col(normalized), rf"^[0-9]+{BLANK_CLASS}+", ""))


def strip_www_for_hosts(website: Column | str, hosts: tuple[str, ...]) -> Column:
    """Trim; drop a leading ``www.`` on the listed hosts."""
    site = trim_blanks(website)
    low = F.lower(site)
    listed = F.lit(False)
    for host in hosts:
        listed = listed | low.contains(host)
    fixed = F.when(listed & low.startswith("www."), F.substr(site, F.lit(5))).otherwise(site)
    return F.when(has_value(website), fixed).otherwise(col(website))
