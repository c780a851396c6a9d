from __future__ import annotations

import pytest
from helpers import evaluate
from pyspark.sql import functions as F

from rollatlas.functions import coordinates as K
from rollatlas.functions import display as D
from rollatlas.functions import text as X
from rollatlas.functions.numbers import parse_float


def test_parse_float(spark):
    texts = ["37.5abc", "No Data", "", "-.5", "12e", " 7 ", "1e2x", " 8.5", "+3", "5.", None, ".", "-Infinity"]
    got = evaluate(spark, [(t,) for t in texts], "t string", v=parse_float("t"))
    assert got == [37.5, None, None, -0.5, 12.0, 7.0, 100.0, 8.5, 3.0, 5.0, None, None, float("-inf")]


DISPLAY = [
    ("34.0522", "-118.2437", True), ("0", "0", True), ("90", "180", True), ("-90", "-180", True),
    (None, "1", False), ("1", None, False), ("90.1", "0", False), ("-90.1", "0", False),
    ("0", "180.1", False), ("0", "-180.1", False), ("abc", "-118.2437", False),
    ("34.0522", "xyz", False), ("34.0522", "NO DATA", False), ("No Data", "-118.2437", False),
    ("REDACTED", "123", False), ("123", "Redacted (Latitude)", False), ("12 redacted", "12", False),
]


def test_display_coordinates(spark):
    got = evaluate(spark, [r[:2] for r in DISPLAY], "a string, b string", v=K.valid_for_display("a", "b"))
    assert got == [r[2] for r in DISPLAY]


def test_ingest_and_map_coordinates(spark):
    rows = [("0", "0"), ("37.5abc", "-120"), ("", "-120"), ("10", "0"), ("12 redacted", "12"), (None, None)]
    got = evaluate(
        spark, rows, "a string, b string", i=K.valid_for_ingest("a", "b"), m=K.valid_for_map("a", "b")
    )
    assert got == [
        (False, True), (True, True), (False, False), (False, True), (True, True), (False, False),
    ]


ADDRESSES = [
    (("123 Main St", "Anytown", "CA", "90210"), "123 Main St, Anytown, CA 90210"),
    (("456 Oak Ave", "Somecity", "NV", ""), "456 Oak Ave, Somecity, NV"),
    (("456 Oak Ave", "Somecity", "NV", None), "456 Oak Ave, Somecity, NV"),
    (("789 Pine Ln", "Villagetown", "", ""), "789 Pine Ln, Villagetown"),
    (("222 Hilltop Dr", "", "", ""), "222 Hilltop Dr"),
    (("", "", "", ""), "Address Not Available"),
    (("No Data", "No Data", "No Data", "No Data"), "Address Not Available"),
    (("123 Main St", "Anytown", "No Data", "90210"), "123 Main St, Anytown, 90210"),
    (("No Data", "Anytown", "CA", "90210"), "Anytown, CA 90210"),
    (("", "", "", "90210"), "90210"),
    (("", "", "CA", "90210"), "CA 90210"),
]


def test_canonical_address(spark):
    got = evaluate(
        spark, [a for a, _ in ADDRESSES], "s string, c string, t string, z string",
        v=D.address_line("s", "c", "t", "z"),
    )
    assert got == [want for _, want in ADDRESSES]


def test_map_and_flat_address(spark):
    rows = [
        ("1 A St", "B", "CA", "9"), ("1 A St", "B", "CA", ""), ("1 A St", "No Data", "", "9"),
        ("", "B", "", ""), ("", "No Data", None, ""), ("1 A St", "B", "No Data", "9"),
    ]
    got = evaluate(
        spark, rows, "s string, c string, t string, z string",
        m=D.address_for_map("s", "c", "t", "z"), f=D.address_flat("s", "c", "t", "z"),
    )
    assert got == [
        ("1 A St, B, CA 9", "1 A St, B, CA, 9"), ("1 A St, B, CA", "1 A St, B, CA"),
        ("1 A St, 9", "1 A St, 9"), ("B", "B"), ("Address Not Available", ""),
        ("1 A St, B, 9", "1 A St, B, 9"),
    ]


WEBSITES = [
    ("", "Website Not Available", None), (None, "Website Not Available", None),
    ("No Data", "Website Not Available", None),
    ("www.example.com", "//www.example.com", "//www.example.com"),
    ("example.com", "//example.com", "//example.com"),
    ("http://example.com", "http://example.com", "http://example.com"),
    ("https://example.com", "https://example.com", "https://example.com"),
    ("//example.com", "//example.com", "//example.com"),
    ("  www.example.com  ", "//www.example.com", "//www.example.com"),
    ("  http://example.com  ", "http://example.com", "http://example.com"),
    ("/path/to/page", "/path/to/page", None), ("internalpage", "internalpage", None),
]


def test_websites(spark):
    got = evaluate(
        spark, [(w[0],) for w in WEBSITES], "u string", h=D.website_href("u"), s=D.website_usable("u")
    )
    assert got == [w[1:] for w in WEBSITES]


@pytest.mark.parametrize(
    "name, code, want",
    [
        ("Alameda Unified", "01611190000000", "alameda-unified-01611190000000"),
        ("Yuba County Office of Education", "58105870000000", "yuba-county-office-of-education-58105870000000"),
        ("  A  B--C!  ", "1", "a-b-c-1"), ("***", "7", "7"), ("No Data", "7", "7"), ("", "7", "7"),
        (None, "7", "7"), ("École", "7", "cole-7"), ("Name", "", ""),
    ],
)
def test_slug(spark, name, code, want):
    assert evaluate(spark, [(name, code)], "n string, c string", v=X.slug("n", "c")) == [want]


def test_streets(spark):
    rows = [
        (" 12 First Street ",), ("Twenty-first Ave",), ("5 SEVENTH st",), ("Firstview Rd",), ("",), (None,),
        ("éfirst Éfirst",), ("12  Tenth",),
    ]
    norm = X.normalize_street("s")
    got = evaluate(spark, rows, "s string", n=norm, o=X.street_only(norm))
    assert got == [
        ("12 1st Street", "1st Street"), ("Twenty-1st Ave", "Twenty-1st Ave"), ("5 7th st", "7th st"),
        ("Firstview Rd", "Firstview Rd"), (None, None), (None, None),
        ("é1st É1st", "é1st É1st"), ("12  10th", "10th"),
    ]


def test_keys_and_prefix(spark):
    got = evaluate(
        spark, [("01611190130229", "a/b c.d"), ("123", "ok_-9")], "c string, k string",
        d=X.district_key("c"), s=X.sanitize_key("k"),
    )
    assert got == [("01611190000000", "a_b_c_d"), ("1230000000", "ok_-9")]


def test_www_prefix(spark):
    rows = [("www.srvusd.net/a",), (" WWW.SRVUSD.NET ",), ("www.other.net",), ("http://www.srvusd.net",), ("",), ("No Data",), (" x.org ",)]
    got = evaluate(spark, rows, "w string", v=X.strip_www_for_hosts("w", ("srvusd.net",)))
    assert got == ["srvusd.net/a", "SRVUSD.NET", "www.other.net", "http://www.srvusd.net", "", "No Data", "x.org"]


def test_grade_spans(spark):
    rows = [("K", "12"), ("k", "k"), ("", "12"), ("9", "No Data"), (None, "3")]
    styles = {s: D.grade_span("a", "b", s) for s in ("district", "school", "popup", "list")}
    assert evaluate(spark, rows, "a string, b string", **styles) == [
        ("K - 12", "(K - 12)", "Grades: K - 12", "(Grades: K - 12)"),
        ("k - k", "(k - k)", "Grades: K - K", "(Grades: k - k)"),
        *[("N/A", "", "Grades: N/A", "")] * 3,
    ]
    with pytest.raises(ValueError):
        D.grade_span("a", "b", "other")


def test_paths_and_links(spark):
    rows = [("test-uni", "1"), ("", "2"), (None, "3")]
    got = evaluate(
        spark, rows, "s string, c string",
        a=D.page_path("s", "/my-base/"), b=D.page_path("s", "/"), m=D.marker_link("s", "c", "/b/"),
    )
    assert got == [
        ("/my-base/districts/test-uni", "/districts/test-uni", "/b/districts/test-uni/"),
        (None, None, "/b/districts/2/"), (None, None, "/b/districts/3/"),
    ]


def test_titles_links_and_metadata(spark):
    got = evaluate(
        spark, [("", ""), ("A", "Kern")], "n string, c string",
        t=D.page_title("n"), d=D.page_description("n", "c"),
    )
    assert got[0] == (
        "Unknown District - District Details",
        "Information and schools for Unknown District in California. View address, website, grades, and map.",
    )
    assert got[1][0] == "A - District Details"
    assert evaluate(spark, [("x", "", None)], "a string, b string, c string", v=D.join_links("a", "b", "c", F.lit("y"))) == ["x | y"]
    front = F.when(F.col("f"), F.struct(F.col("t").alias("title"), F.lit("").alias("description")))
    meta = D.page_metadata(front, F.lit("own"), F.lit("own text"), "Site", "Site text")
    got = evaluate(spark, [(True, "front"), (True, None), (False, "front")], "f boolean, t string", v=meta)
    assert [tuple(r) for r in got] == [("front", "Site text"), ("Site", "Site text"), ("own", "own text")]


def test_breadcrumbs(spark):
    trail = F.array(
        *[F.struct(F.lit(t).alias("text"), F.lit(h).alias("href")) for t, h in
          [("Home", "/"), ("Guides", "/guides/"), ("Ext", "//x.org/"), ("None", ""), ("Last", "/last")]]
    )
    def links(base):
        row = evaluate(spark, [(1,)], "x int", v=D.breadcrumbs(trail, base))[0]
        return [c["href"] for c in row]

    assert links("/b") == ["/b/", "/b/guides/", "//x.org/", None, None]
    assert links("/") == ["/", "/guides/", "//x.org/", None, None]


def test_detail_list(spark):
    entries = D.detail_list({"A": "a", "B": "b", "C": "c"})
    got = evaluate(spark, [("1", "No Data", ""), ("1", None, "3")], "a string, b string, c string", v=entries)
    assert [[tuple(e) for e in row] for row in got] == [[("A", "1")], [("A", "1"), ("C", "3")]]
