from __future__ import annotations

from helpers import candidate, district_table, gazetteer_table, school_table
from pyspark.sql import functions as F

from rollatlas.operators import linking
from rollatlas.plans import maps, pages
from rollatlas.sources import assets

D1, D2, D3 = "01000010000000", "01000020000000", "01000030000000"


def districts(spark):
    base = {"status": "Active", "county": "Kern", "street_city": "Napa", "street_state": "CA"}
    return district_table(
        spark,
        [
            {**base, "cds_code": D1, "district": "One", "slug": "one", "website": "www.one.org", "low_grade": "K", "high_grade": "12", "lat": 38.0, "lon": -122.0},
            {**base, "cds_code": D2, "district": "", "slug": "two", "website": "No Data", "status": "", "street_address": "5 Elm St", "street_zip": "9"},
            {**base, "cds_code": D3, "district": "Dup", "slug": "one", "website": "", "street_city": "", "street_state": ""},
        ],
    )


def schools(spark):
    base = {"status": "Active", "public_yes_no": "Y", "street_city": "Napa"}
    return school_table(
        spark,
        [
            {**base, "cds_code": "01000010000009", "school": "Beta", "district_cds": D1, "lat": 39.0, "lon": -121.0},
            {**base, "cds_code": "01000010000008", "school": "alpha", "district_cds": D1, "public_yes_no": " y", "website": "x.org", "low_grade": "k", "high_grade": "5"},
            {**base, "cds_code": "01000010000007", "school": "Hidden", "district_cds": D1, "public_yes_no": "N", "lat": 1.0, "lon": 1.0},
            {**base, "cds_code": "01000020000006", "school": "", "district_cds": D2, "lat": 0.0, "lon": 0.0, "low_grade": "k", "high_grade": "8"},
            {**base, "cds_code": "01000030000005", "school": "Three", "district_cds": D3, "lat": 10.0, "lon": 20.0},
        ],
    )


def test_pages(spark):
    params = spark.createDataFrame([("one",), ("two",), ("gone",), ("",), (None,)], "districtSlug string")
    got = {r["slug"]: r for r in pages.district_pages(params, districts(spark), schools(spark)).collect()}
    assert sorted(got) == ["one", "two"]
    one, two = got["one"], got["two"]
    # The first district with a slug owns the page.
    assert (one["cds_code"], one["title"], one["school_count"]) == (D1, "One - District Details", 2)
    assert (one["website"], one["grades"], one["phone"]) == ("//www.one.org", "K - 12", "N/A")
    assert one["dashboard_url"].endswith("/districts/" + D1)
    assert (two["name"], two["status"], two["website"]) == ("Unknown District", "N/A", "Website Not Available")
    assert two["address"] == "5 Elm St, Napa, CA 9"
    assert [tuple(b) for b in one["breadcrumbs"]] == [("Home", "/"), ("One", None)]

    listed = pages.page_schools(params, districts(spark), schools(spark))
    rows = [(r["slug"], r["name"], r["grades"], r["website"]) for r in listed.orderBy("slug", "ord").collect()]
    assert rows == [
        ("one", "Beta", "", "Website Not Available"), ("one", "alpha", "(k - 5)", "//x.org"),
        ("two", "Unknown School", "(k - 8)", "Website Not Available"),
    ]
    chunks = pages.page_school_chunks(listed, rows=1).orderBy("slug", "chunk").collect()
    assert [(c["slug"], c["n"], c["schools"][0]["name"]) for c in chunks] == [
        ("one", 1, "Beta"), ("one", 1, "alpha"), ("two", 1, "Unknown School")
    ]


def test_linking(spark):
    raw = schools(spark).drop("district_cds", "lat", "lon")
    extra = raw.limit(1).withColumn("cds_code", F.lit("123")).withColumn("ord", F.lit(90).cast("bigint"))
    lost = raw.limit(1).withColumn("cds_code", F.lit("99999990000001")).withColumn("ord", F.lit(91).cast("bigint"))
    mixed = raw.unionByName(extra).unionByName(lost)
    status = {r["ord"]: r["link_status"] for r in linking.link_status(mixed, districts(spark)).collect()}
    assert status == {**{i: "linked" for i in range(5)}, 90: "bad_prefix", 91: "no_district"}
    assert linking.linked_schools(mixed, districts(spark)).count() == 5
    assert sorted(r["ord"] for r in linking.orphan_schools(mixed, districts(spark)).collect()) == [90, 91]
    counts = {r["cds_code"]: r["school_count"] for r in linking.school_counts(mixed, districts(spark)).collect()}
    assert counts == {D1: 2, D2: 1, D3: 1}
    names = [r["school"] for r in linking.strict_school_list(schools(spark)).collect()]
    assert names == ["Beta", "", "Three"]


def test_compat_outputs(spark):
    rows = assets.district_map(districts(spark)).orderBy("ord").collect()
    assert rows[0]["key"] == D1 and rows[0]["Street City"] == "Napa" and rows[0]["slug"] == "one"
    chunks = {r["district_cds"]: r for r in assets.schools_by_district(schools(spark)).collect()}
    assert [s["School"] for s in chunks[D1]["schools"]] == ["Beta", "alpha", "Hidden"]
    assert [r[0] for r in assets.page_params(districts(spark).orderBy("ord")).collect()] == ["one", "two", "one"]


def test_details_and_links(spark):
    rows = pages.district_details(districts(spark)).filter(F.col("cds_code") == D1).orderBy("position").collect()
    assert [(r["label"], r["value"]) for r in rows] == [
        ("County", "Kern"), ("Status", "Active"), ("Address", "Napa, CA"), ("Grade Span", "K - 12"), ("Website", "www.one.org")
    ]
    links = {r["school"]: r["links"] for r in pages.school_links(schools(spark)).collect()}
    assert links["alpha"].startswith("//x.org | https://") and links["Beta"].count(" | ") == 1


def test_markers(spark):
    placed = maps.district_markers(districts(spark), "/b/").collect()
    assert [(r["cds_code"], r["link"]) for r in placed] == [(D1, "/b/districts/one/")]
    assert sorted(r["cds_code"] for r in maps.unplaced_districts(districts(spark)).collect()) == [D2, D3]
    popups = {r["cds_code"]: r["popup"] for r in maps.school_markers(schools(spark)).collect()}
    assert popups == {
        "01000010000009": "<b>Beta</b><br>Napa<br>Grades: N/A",
        "01000020000006": "<b>Unknown School</b><br>Napa<br>Grades: K - 8",
        "01000030000005": "<b>Three</b><br>Napa<br>Grades: N/A",
    }
    cells = maps.school_marker_layer(schools(spark), [3]).collect()
    assert sum(r["points"] for r in cells) == 3


def test_map_views(spark):
    ring = [[[[-123.0, 37.0], [-122.5, 37.5]]]]
    d4 = "01000040000000"
    four = district_table(spark, [{"ord": 9, "cds_code": d4, "district": "Four"}])
    boundaries = spark.createDataFrame([(D1, ring), ("other", ring)], "boundary_key string, polygons array<array<array<array<double>>>>")
    gaz = gazetteer_table(spark, [candidate("5 Elm St, Napa, CA 9", 1, "38.5", "-122.5"), candidate("Address Not Available", 1)])
    view = maps.district_map_view(districts(spark).unionByName(four), schools(spark), boundaries, gaz)
    got = {r["cds_code"]: r for r in view.collect()}

    def box(r):
        return tuple(r[c] for c in ("min_lat", "min_lon", "max_lat", "max_lon"))

    # Boundary, office and school together.
    assert got[D1]["view"] == "bounds" and box(got[D1]) == (37.0, -123.0, 39.0, -121.0)
    # Looked-up office, then the school extends it.
    assert got[D2]["view"] == "bounds" and box(got[D2]) == (0.0, -122.5, 38.5, 0.0) and got[D2]["has_office"]
    # Neither boundary nor office: the schools' own box.
    assert got[D3]["view"] == "schools" and box(got[D3]) == (10.0, 20.0, 10.0, 20.0)
    assert got[d4]["view"] == "default" and (got[d4]["centre_lat"], got[d4]["zoom"]) == (36.7783, 6)
    assert [got[c]["school_markers"] for c in (D1, D2, D3, d4)] == [1, 1, 1, 0]


def test_older_map_views(spark):
    ring = [[[[-123.0, 37.0], [-122.5, 37.5]]]]
    d4, d5 = "01000040000000", "01000050000000"
    more = district_table(
        spark,
        [{"ord": 8, "cds_code": d4, "district": "Four"}, {"ord": 9, "cds_code": d5, "district": "Five", "lat": 95.0, "lon": 1.0}],
    )
    all_districts = districts(spark).unionByName(more)
    boundaries = spark.createDataFrame(
        [(D1, ring, True), (d4, ring, False)], "boundary_key string, polygons array<array<array<array<double>>>>, reprojected boolean"
    )
    gaz = gazetteer_table(
        spark, [candidate("5 Elm St, Napa, CA, 9", 1, "38.5", "-122.5"), candidate("Five, California", 1, "30", "-120"), candidate("", 1)]
    )
    card = {r["cds_code"]: r for r in maps.card_map_view(all_districts, boundaries, gaz).collect()}
    assert {c: (r["view"], r["zoom"], r["centre_lat"]) for c, r in card.items()} == {
        D1: ("boundary", None, None), D2: ("address", 15, 38.5), D3: ("none", None, None), d4: ("none", None, None), d5: ("point", 13, 95.0)
    }
    assert (card[D1]["min_lat"], card[D1]["max_lon"]) == (37.0, -122.5)
    wide = {r["cds_code"]: r for r in maps.overview_map_view(all_districts, schools(spark), boundaries, gaz).collect()}
    assert {c: (r["view"], r["zoom"]) for c, r in wide.items()} == {
        D1: ("bounds", None), D2: ("bounds", None), D3: ("bounds", None), d4: ("bounds", None), d5: ("name", 10)
    }
    assert (wide[D1]["max_lat"], wide[D2]["min_lat"], wide[d5]["centre_lat"]) == (39.0, 0.0, 30.0)
