from __future__ import annotations

import pytest
from helpers import evaluate

from rollatlas.functions.urls import normalize_url, page_base, resolve_url, url_origin
from rollatlas.operators import links as L

PAGE = "https://Site.org:443/a/b.html?q=1#top"


@pytest.mark.parametrize(
    "href, want",
    [
        ("/x", "https://site.org/x"), ("c.html", "https://site.org/a/c.html"), ("../c", "https://site.org/c"),
        ("./c/./d/../e", "https://site.org/a/c/e"), ("#s", "https://site.org/a/b.html?q=1#s"),
        ("?z=2", "https://site.org/a/b.html?z=2"), ("", "https://site.org/a/b.html?q=1"),
        ("//other.org/y", "https://other.org/y"), ("http://Other.org:80", "http://other.org/"),
        ("  /pad ", "https://site.org/pad"), ("mailto:a@b.c", None), ("tel:+1", None), ("javascript:void(0)", None),
        ("https://user:pw@site.org/p", "https://site.org/p"), ("../../../up", "https://site.org/up"),
        ("d/..", "https://site.org/a/"), ("https://", None), ("http://site.org:8080/x", "http://site.org:8080/x"),
    ],
)
def test_resolve(spark, href, want):
    assert evaluate(spark, [(href,)], "h string", v=resolve_url("h", page_base(F_lit(PAGE)))) == [want]


def F_lit(value):
    from pyspark.sql import functions as F

    return F.lit(value)


def test_origin_and_normalize(spark):
    rows = [("HTTP://A.b:80/x?y#z",), ("ftp://a/b",), ("/x",), ("https://a",)]
    got = evaluate(spark, rows, "u string", o=url_origin("u"), n=normalize_url("u"))
    assert got == [("http://a.b", "http://a.b/x?y#z"), (None, None), (None, None), ("https://a", "https://a/")]


HTML = """<nav><A class="x" HREF='/one'>1</A><a href="/one">again</a><a href=two.html>2</a>
<a
 href="https://site.org/three?a=1&amp;b=2#f">3</a><a href="mailto:x@y.z">m</a><a name="n">n</a>
<a href="http://site.org/plain">other origin</a><abbr href="/no">no</abbr><a data-href="/no2">no</a></nav>"""


def pages(spark):
    rows = [
        (1, "https://site.org/a/", HTML), (2, "https://site.org/one", "<p>none</p>"),
        (3, "https://SITE.org/a/two.html#x", '<a href="/missing">x</a><a href="/missing#y">y</a><a href="/one">1</a>'),
    ]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_audit(spark):
    p = pages(spark)
    found = L.internal_links(p)
    assert sorted(map(tuple, found.collect())) == [
        (1, "https://site.org/a/two.html"), (1, "https://site.org/one"),
        (1, "https://site.org/three?a=1&b=2#f"),
        (3, "https://site.org/missing"), (3, "https://site.org/missing#y"), (3, "https://site.org/one"),
    ]
    want = [(1, "https://site.org/three?a=1&b=2#f"), (3, "https://site.org/missing"), (3, "https://site.org/missing#y")]
    assert sorted(map(tuple, L.broken_links(found, p).collect())) == want
    assert sorted(map(tuple, L.broken_targets(found, p).collect())) == [
        ("https://site.org/missing", 1), ("https://site.org/three?a=1&b=2", 1)
    ]
    counts = {r["page_id"]: (r["internal_links"], r["has_link"]) for r in L.page_link_counts(p).collect()}
    assert counts == {1: (3, True), 2: (0, False), 3: (3, True)}
    assert L.internal_links(p, "http://site.org").collect() == [(1, "http://site.org/plain")]


def test_links_are_percent_encoded(spark):
    from pyspark.sql import functions as F

    from rollatlas.functions.urls import normalize_url

    cases = {
        "http://a/f\u00fcr x": "http://a/f%C3%BCr%20x", "http://a/f%C3%BCr%20x": "http://a/f%C3%BCr%20x",
        "http://a/\U0001f600/{b}?q='a b'\u00e9#`c`": "http://a/%F0%9F%98%80/%7Bb%7D?q=%27a%20b%27%C3%A9#%60c%60",
        "http://a/plain?x=1&y={2}#z": "http://a/plain?x=1&y={2}#z", "http://a": "http://a/",
    }
    got = spark.createDataFrame([(c,) for c in cases], "u string").select("u", normalize_url(F.col("u")).alias("n")).collect()
    assert {r["u"]: r["n"] for r in got} == cases
