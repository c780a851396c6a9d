from __future__ import annotations

from helpers import candidate, gazetteer_table, school_table
from pyspark.sql import functions as F

from rollatlas.operators import geocode as G


def record(name, street="", city="Napa", state="CA", lat="", lon=""):
    return {"school": name, "street_address": street, "street_city": city, "street_state": state, "latitude": lat, "longitude": lon}


GAZETTEER = [
    candidate("1 Oak Rd, Napa, CA", 1, "38.1", "-122.1"),
    candidate("2 1st St, Napa, CA", 1, "38.2", "-122.2"),
    # Level 3: the road with the same name wins over an earlier place.
    candidate("Elm Ave, Napa, CA", 1, "1", "1", "Napa", "Elm", "place", "city"),
    candidate("Elm Ave, Napa, CA", 2, "38.3", "-122.3", "Elm Ave, Napa", "Elm Ave", "highway", "residential"),
    candidate("Elm Ave, Napa, CA", 3, "2", "2", "Elm Ave, Napa", "Elm Ave", "highway", "residential"),
    # All candidates above the limit: falls through to the town.
    candidate("Far Rd, Napa, CA", 1, "3", "3", "", "", "boundary", "administrative"),
    candidate("Far Rd, Napa, CA", 2, "4", "4", "", "", "place", "city"),
    # A single bad candidate is taken as it is.
    candidate("Lone Rd, Napa, CA", 1, "38.5", "-122.5", "", "", "boundary", "administrative"),
    # The winner has no coordinates: no second choice.
    candidate("Gap Rd, Napa, CA", 1, "", "-1", "", "Gap Rd", "highway", "road"),
    candidate("Gap Rd, Napa, CA", 2, "5", "5", "", "", "amenity", "school"),
    # The good one is beyond the cap of five.
    *[candidate("Cap Rd, Napa, CA", i, "6", "6", "", "", "place", "city") for i in range(1, 6)],
    candidate("Cap Rd, Napa, CA", 6, "7", "7", "", "Cap Rd", "highway", "road"),
    candidate("Napa, CA", 1, "38.29", "-122.28"),
    candidate("Reno", 1, "39.5", "-119.8"),
    candidate("9 X Rd, Zero, CA", 1, "text", "-1"),
]
RECORDS = [
    (record("valid", "1 Oak Rd", lat="37.5abc", lon="-120"), (0, 37.5, -120.0)),
    (record("raw", "1 Oak Rd", lat="0", lon="0"), (1, 38.1, -122.1)),
    (record("normal", "2 First St", lat="No Data"), (2, 38.2, -122.2)),
    (record("street", "77 Elm Ave"), (3, 38.3, -122.3)),
    (record("too bad", "8 Far Rd"), (4, 38.29, -122.28)),
    (record("single", "8 Lone Rd"), (3, 38.5, -122.5)),
    (record("gap", "8 Gap Rd"), (4, 38.29, -122.28)),
    (record("cap", "8 Cap Rd"), (4, 38.29, -122.28)),
    # Without a street levels 1 and 2 already ask for the town.
    (record("no street", ""), (1, 38.29, -122.28)),
    (record("sentinel street", "No Data"), (1, 38.29, -122.28)),
    # Street sentinel and no state: level 3 asks for the city alone.
    (record("city only", "No Data", "Reno", ""), (3, 39.5, -119.8)),
    (record("other state", "8 Far Rd", "Napa", "NV"), (0, None, None)),
    (record("not a number", "9 X Rd", "Zero"), (0, None, None)),
]


def test_cascade(spark):
    placed = G.geocode(
        school_table(spark, [r for r, _ in RECORDS]).drop("lat", "lon"), gazetteer_table(spark, GAZETTEER)
    )
    got = {r["school"]: r for r in placed.collect()}
    assert len(got) == len(RECORDS)
    for source, (level, lat, lon) in RECORDS:
        row = got[source["school"]]
        assert (row["geocode_level"], row["lat"], row["lon"]) == (level, lat, lon), source["school"]
        assert row["geocode_ok"] == (level > 0) and row["geocode_fallback"] == (level > 1)
    assert got["valid"]["latitude"] == "37.5abc" and not got["valid"]["geocode_tried"]
    assert got["other state"]["latitude"] == got["other state"]["longitude"] == "No Data"
    assert float(got["raw"]["latitude"]) == 38.1
    kinds = G.records_of_kinds(["slug", *G.GEOCODE_FLAGS], schools=placed.drop("slug"))
    report = G.geocode_report(kinds, ["districts", "schools"]).collect()
    assert [tuple(r) for r in report] == [("districts", 0, 0, 0), ("schools", 12, 10, 7)]


def test_attempt_texts(spark):
    rows = school_table(spark, [record("a", "12 First Street"), record("b", "No Data"), record("c", "No Data", "Reno", ""), record("d", "", "", "CA"), record("e", "5 Oak Rd", "No Data", "CA")])
    tried = G.attempts(rows.select(*G.ADDRESS).distinct()).collect()
    assert sorted((r["street_address"], r["level"], r["query"]) for r in tried) == [
        ("12 First Street", 1, "12 First Street, Napa, CA"),
        ("12 First Street", 2, "12 1st Street, Napa, CA"),
        ("12 First Street", 3, "1st Street, Napa, CA"),
        ("12 First Street", 4, "Napa, CA"),
        ("5 Oak Rd", 1, "5 Oak Rd, CA"),
        ("No Data", 1, "Napa, CA"),
        ("No Data", 3, "Reno"),
    ]


def test_scores(spark):
    columns = "class string, type string, name string, display_name string"
    rows = [
        ("highway", "road", "Elm Ave", "Elm Ave, Napa", 15), ("highway", "service", "", "", 100),
        ("place", "house", "Old ELM AVE East", "", 65), ("place", "city", None, "in napa county", 145),
        ("boundary", "x", "Elm", "", 150), ("", "", "", "", 100), (None, None, None, None, 100),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], columns)
    score = G.candidate_score(F.struct("class", "type", "name", "display_name"), F.lit("Elm Ave"), F.lit("Napa"))
    assert [r[0] for r in df.select(score).collect()] == [r[4] for r in rows]


def test_address_fallback(spark):
    points = spark.createDataFrame(
        [(1, "A", 1.0, 2.0), (2, "A", None, None), (3, "B", None, None), (4, "C", None, None)],
        "ord bigint, address string, lat double, lon double",
    )
    gaz = gazetteer_table(spark, [candidate("A", 1, "5", "6"), candidate("A", 2, "7", "8"), candidate("C", 1, "x", "6")])
    got = G.fill_from_address(points, gaz, "address").orderBy("ord").collect()
    assert [(r["lat"], r["lon"]) for r in got] == [(1.0, 2.0), (5.0, 6.0), (None, None), (None, None)]


def test_ranks_need_not_start_at_one(spark):
    points = spark.createDataFrame([(1, "A", None, None)], "ord bigint, address string, lat double, lon double")
    for ranks in ((0, 2), (7, 9)):
        gaz = gazetteer_table(spark, [candidate("A", ranks[1], "7", "8"), candidate("A", ranks[0], "5", "6")])
        assert [(r["lat"], r["lon"]) for r in G.fill_from_address(points, gaz, "address").collect()] == [(5.0, 6.0)]
        assert [c["lat"] for c in G.top_candidates(gaz, 1).collect()[0]["candidates"]] == ["5"]


def test_shared_resolution_reads_the_gazetteer_once(spark):
    one = school_table(spark, [record("a", "12 First Street"), record("b", "No Data")])
    two = school_table(spark, [record("c", "12 First Street"), record("d", "5 Oak Rd")])
    gaz = gazetteer_table(spark, [candidate("12 1st Street, Napa, CA", 1), candidate("Napa, CA", 1, "1", "2")])
    resolved = G.resolve_records([one, two], gaz)
    for table in (one, two):
        assert sorted(map(str, G.geocode(table, gaz, resolved).collect())) == sorted(map(str, G.geocode(table, gaz).collect()))
