"""Absolute links from an href and the page it stands on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollatlas.functions.binding import let
from rollatlas.functions.text import col, trim_blanks

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
# Characters that the URL standard has encoded besides blanks, controls and
# non-ASCII, as classes of regular expressions.
UNSAFE_PATH = '"<>`{}'
UNSAFE_QUERY = "\"<>'"
UNSAFE_FRAGMENT = '"<>`'
_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)"


def url_scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(url), _SCHEME, 1))


def url_origin(url: Column | str) -> Column:
    """scheme://host[:port] of a web address; null for anything else.

    Lower case, without credentials and without the scheme's default port.
    """
    url = col(url)

    def assemble(parts: Column) -> Column:
        scheme, host = parts["scheme"], parts["host"]
        default = F.when(scheme == "http", F.lit(":80")).otherwise(F.lit(":443"))
        plain = F.when(
            host.endswith(default), F.substr(host, F.lit(1), F.length(host) - F.length(default))
        ).otherwise(host)
        web = scheme.isin("http", "https") & (plain != "")
        return F.when(web, F.concat(scheme, F.lit("://"), plain))

    authority = F.regexp_extract(url, _AUTHORITY, 1)
    host = F.lower(F.regexp_replace(authority, "^.*@", ""))
    return let(F.struct(url_scheme(url).alias("scheme"), host.alias("host")), assemble)


def strip_fragment(url: Column | str) -> Column:
    return F.substring_index(col(url), "#", 1)


def or_root(path: Column) -> Column:
    return F.when(path == "", F.lit("/")).otherwise(path)


def _fold_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))
        return (
            F.when(part == ".", done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))
        )

    parts = F.split(F.substr(path, F.lit(2)), "/")
    folded = F.array_join(F.aggregate(parts, F.array(F.lit("")), step), "/")
    # A trailing dot segment leaves a trailing slash.
    closed = F.when(path.rlike(r"/\.\.?$"), F.concat(folded, F.lit("/"))).otherwise(folded)
    return F.when(path.contains("/."), closed).otherwise(path)


def _encoded(text: Column, unsafe: str) -> Column:
    """Percent-encode blanks, controls, non-ASCII and the characters of ``unsafe``."""
    odd = f"[^!-~]|[{unsafe}]"

    def one(c: Column) -> Column:
        return F.when(c.rlike(odd), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c)

    letters = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), one)
    return F.when(text.rlike(odd), F.array_join(letters, "")).otherwise(text)


def normalize_url(url: Column | str) -> Column:
    """Lower-case scheme and host, fold dots, give an empty path its slash, percent-encode; null
    off the web."""

    def assemble(parts: Column) -> Column:
        path = F.regexp_extract(parts["rest"], r"^([^?#]*)", 1)
        query = F.regexp_extract(parts["rest"], r"^[^?#]*(\?[^#]*)", 1)
        fragment = F.substr(parts["rest"], F.length(path) + F.length(query) + 1)
        folded = let(or_root(path), _fold_dots)
        return F.concat(
            parts["origin"], let(folded, lambda p: _encoded(p, UNSAFE_PATH)),
            let(query, lambda q: _encoded(q, UNSAFE_QUERY)), let(fragment, lambda f: _encoded(f, UNSAFE_FRAGMENT)),
        )

    def read(address: Column) -> Column:
        rest = F.regexp_replace(address, _AUTHORITY, "")
        return let(F.struct(url_origin(address).alias("origin"), rest.alias("rest")), assemble)

    return let(col(url), read)


def page_base(page_url: Column | str) -> Column:
    """What links of a page are resolved against, worked out once per page."""

    def describe(page: Column) -> Column:
        bare = F.substring_index(page, "?", 1)
        folder = F.regexp_replace(F.regexp_replace(bare, _AUTHORITY, ""), r"[^/]*$", "")
        return F.struct(
            page.alias("page"),
            bare.alias("bare"),
            url_scheme(page).alias("scheme"),
            url_origin(page).alias("origin"),
            or_root(folder).alias("folder"),
        )

    return let(strip_fragment(page_url), describe)


def resolve_url(href: Column | str, base: Column | str) -> Column:
    """Absolute form of ``href`` on the page of ``base``; null when it is not a web address."""
    base = col(base)

    def absolute(link: Column) -> Column:
        return (
            F.when(link.startswith("//"), F.concat(base["scheme"], F.lit(":"), link))
            .when(link.startswith("/"), F.concat(base["origin"], link))
            .when(link == "", base["page"])
            .when(link.startswith("#"), F.concat(base["page"], link))
            .when(link.startswith("?"), F.concat(base["bare"], link))
            .when(link.rlike(_SCHEME), link)
            .otherwise(F.concat(base["origin"], base["folder"], link))
        )

    return normalize_url(let(trim_blanks(href), absolute))
