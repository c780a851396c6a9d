from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from helpers import candidate, gazetteer_table
from test_directory import PREAMBLE, line

from rollatlas.plans.build import build_directory, load_build
from rollatlas.plans.quality import quality_report
from rollatlas.sources import assets, directory

ACTIVE = {"status": "Active", "street_city": "Napa", "street_state": "CA"}
ROWS = [
    {**ACTIVE, "record_type": "District", "cds_code": "01000010000000", "district": "One", "latitude": "38.5", "longitude": "-122"},
    {**ACTIVE, "record_type": "District", "cds_code": "01000010000000", "district": "One again"},
    {**ACTIVE, "record_type": "County Office", "cds_code": "01000020000000", "district": "Two"},
    {**ACTIVE, "record_type": "District", "cds_code": "01000030000000", "status": "Closed"},
    {**ACTIVE, "record_type": "School", "cds_code": "01000010000001", "school": "B", "public_yes_no": "Y"},
    {**ACTIVE, "record_type": "School", "cds_code": "01000010000002", "school": "A", "public_yes_no": "Y", "latitude": "1", "longitude": "2"},
    {**ACTIVE, "record_type": "School", "cds_code": "01000030000001", "school": "Lost", "street_city": "Reno"},
    {**ACTIVE, "record_type": "School", "cds_code": "123", "school": "Short", "street_address": "information redacted"},
]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("build")
    (folder / "in.csv").write_text("\n".join(PREAMBLE + [line(**r) for r in ROWS]) + "\n")
    raw = directory.read_directory(spark, str(folder / "in.csv"))
    gaz = gazetteer_table(spark, [candidate("Napa, CA", 1, "38.29", "-122.28")])
    out = str(folder / "out")
    assert build_directory(raw, gaz, out)
    return raw, gaz, out


def test_outputs(spark, built):
    _, _, out = built
    districts = assets.read_districts(spark, f"{out}/districts").orderBy("ord").collect()
    assert [(r["cds_code"], r["slug"], r["lat"], r["geocode_level"]) for r in districts] == [
        ("01000010000000", "one-01000010000000", 38.5, 0), ("01000020000000", "two-01000020000000", 38.29, 1)
    ]
    schools = assets.read_schools(spark, f"{out}/schools").orderBy("ord").collect()
    assert [(r["school"], r["latitude"]) for r in schools] == [("B", "38.29"), ("A", "1")]
    chunk = spark.read.json(f"{out}/schools_by_district_json").collect()[0]
    assert [s["School"] for s in chunk["schools"]] == ["B", "A"]
    assert spark.read.json(f"{out}/districts_json").count() == 2
    params = assets.read_page_params(spark, f"{out}/page_params")
    assert sorted(r[0] for r in params.collect()) == ["one-01000010000000", "two-01000020000000"]


def test_written_once(spark, built):
    raw, gaz, out = built
    assert not build_directory(raw, gaz, out)
    assert assets.outputs_complete(spark, [f"{out}/districts", f"{out}/page_params"])
    assert not assets.outputs_complete(spark, [f"{out}/districts", f"{out}/none"])


def test_shape_check(spark, built):
    _, _, out = built
    with pytest.raises(ValueError, match="district_cds"):
        assets.read_schools(spark, f"{out}/districts")


def test_wrong_types_are_rejected_before_a_job(spark, built, tmp_path):
    _, _, out = built
    path = str(tmp_path / "t")
    spark.read.parquet(f"{out}/districts").withColumn("phone", F.lit(5)).write.parquet(path)
    with pytest.raises(ValueError, match="phone is int, not string"):
        assets.read_districts(spark, path)
    assert assets.read_checked(spark, path, {"phone": None}).count() == 2
    spark.createDataFrame([("x", "7"), ("y", "z")], "a string, n string").write.json(f"{path}-json")
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        assets.read_checked(spark, f"{path}-json", {"a": "string", "n": "struct<v:int>"}, "json").collect()
    with pytest.raises(ValueError, match="type is needed"):
        assets.read_checked(spark, f"{path}-json", {"a": None}, "json")


def test_quality_report(spark, built):
    _, _, out = built
    t = load_build(spark, out)
    report = quality_report(t["raw"], t["placed"], t["links"])
    got = {(r["section"], r["metric"]): r["value"] for r in report.collect()}
    assert got == {
        ("rejects", "kept"): 6, ("rejects", "status"): 1, ("rejects", "redacted"): 1,
        ("geocode_districts", "tried"): 1, ("geocode_districts", "successes"): 1, ("geocode_districts", "fallback_successes"): 0,
        ("geocode_schools", "tried"): 2, ("geocode_schools", "successes"): 1, ("geocode_schools", "fallback_successes"): 0,
        ("totals", "records"): 8, ("totals", "districts"): 2, ("totals", "slugs"): 2, ("totals", "valid_markers"): 2,
        ("totals", "schools"): 3, ("totals", "linked_schools"): 2, ("totals", "bad_prefix"): 0, ("totals", "no_district"): 1,
    }
