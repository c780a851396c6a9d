from __future__ import annotations

import pytest
from helpers import plan_of, raw_records

from rollatlas.operators import cleaning
from rollatlas.schema import RAW_COLUMNS, RAW_HEADERS
from rollatlas.sources import directory


def line(**values: str) -> str:
    return ",".join(values.get(c, "") for c in RAW_COLUMNS)


PREAMBLE = [",".join(RAW_HEADERS), *[line(record_type="School", cds_code=f"meta{i}", status="Active") for i in range(2)], ""]


def test_read_csv(spark, tmp_path):
    rows = [
        line(record_type="District", cds_code=" 01 ", district='" Big, ""Q"" "'),
        "", ",".join([" "] * 41), line(record_type="School", cds_code="02"),
    ]
    (tmp_path / "School 100% Data.csv").write_text("\n".join(PREAMBLE + rows) + "\n")
    (tmp_path / "a.csv").write_text("\n".join(PREAMBLE + rows) + "\n")
    spaced = directory.read_directory(spark, str(tmp_path / "School 100% Data.csv"))
    assert spaced.count() == 2
    got = directory.read_directory(spark, str(tmp_path / "a.csv")).orderBy("ord").collect()
    assert [(r["record_type"], r["cds_code"], r["district"]) for r in got] == [
        ("District", "01", ' Big, "Q" '), ("School", "02", "")
    ]
    assert got[0]["website"] == ""
    everything = directory.read_directory(spark, str(tmp_path / "a.csv"), preamble=0)
    assert everything.count() == 5


def test_preamble_per_file_and_split(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        for name in ("b.csv", "a.csv"):
            rows = [line(record_type="School", cds_code=f"{name}{i:04d}") for i in range(300)]
            (tmp_path / name).write_text("\n".join(PREAMBLE + rows) + "\n")
        raw = directory.read_directory(spark, str(tmp_path))
        want = [f"{name}{i:04d}" for name in ("a.csv", "b.csv") for i in range(300)]
        assert [r[0] for r in raw.orderBy("ord").select("cds_code").collect()] == want
        lines = directory.read_lines(spark, str(tmp_path))
        many = directory.parse_lines(directory.skip_preamble(lines))
        assert [r[0] for r in many.orderBy("ord").select("cds_code").collect()] == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("text", ["a,b,c", ",".join(["x"] * 42)])
def test_ragged_line_stops_the_job(spark, tmp_path, text):
    (tmp_path / "a.csv").write_text(line(cds_code="1") + "\n" + text + "\n")
    with pytest.raises(Exception, match="MALFORMED_CSV_RECORD"):
        directory.read_directory(spark, str(tmp_path / "a.csv"), preamble=0).collect()


def test_multiline_fields(spark, tmp_path):
    rows = [line(cds_code="1", school='"two\nlines"'), line(cds_code="2")]
    (tmp_path / "a.csv").write_text("\n".join([PREAMBLE[0]] * 4 + rows) + "\n")
    got = directory.read_directory_multiline(spark, str(tmp_path / "a.csv")).orderBy("ord").collect()
    assert [(r["cds_code"], r["school"]) for r in got] == [("1", "two\nlines"), ("2", "")]


def records(spark):
    base = {"status": "Active", "record_type": "District"}
    return raw_records(
        spark,
        [
            {**base, "cds_code": "D1", "district": "Late", "status": "Closed"},
            {**base, "cds_code": "D1", "district": "First", "street_address": "1 A St"},
            {**base, "cds_code": "D1", "district": "Second"},
            {**base, "cds_code": ""},
            {**base, "cds_code": "D2", "street_address": "INFORMATION Redacted here"},
            {**base, "cds_code": "D3", "record_type": "County Office", "website": None},
            {**base, "cds_code": "D4", "record_type": "Other"},
            {**base, "cds_code": "D5", "status": "active"},
            {**base, "cds_code": "S1", "record_type": "School", "website": " www.srvusd.net/x "},
            {**base, "cds_code": "S1", "record_type": "School"},
        ],
    )


def test_districts(spark):
    got = cleaning.district_rows(records(spark)).orderBy("ord").collect()
    assert [(r["cds_code"], r["district"], r["slug"]) for r in got] == [
        ("D1", "First", "first-D1"), ("D3", "", "D3")
    ]
    assert got[1]["website"] == "No Data" and got[0]["website"] == ""


def test_schools_keep_duplicates(spark):
    got = cleaning.school_rows(records(spark)).orderBy("ord").collect()
    assert [(r["cds_code"], r["website"]) for r in got] == [("S1", "srvusd.net/x"), ("S1", "")]


def test_reject_report(spark):
    got = {r[0]: r[1] for r in cleaning.reject_report(records(spark)).collect()}
    assert got == {"status": 2, "missing_key": 1, "redacted": 1, "record_type": 1, "kept": 5}


def test_school_filters(spark):
    rows = [
        {"public_yes_no": " y ", "school": "A"}, {"public_yes_no": "Y", "school": "HomeSchool"},
        {"public_yes_no": "Y", "school": "B", "educational_program_type": "HOMESCHOOL"},
        {"public_yes_no": "Y", "school": "C", "street_address": "Information Redacted"},
        {"public_yes_no": "Y", "school": "D", "street_address": "information redacted"},
        {"public_yes_no": "N", "school": "E"}, {"public_yes_no": "Y", "school": "F", "status": "Closed"},
    ]
    df = raw_records(spark, [{"status": "Active", **r} for r in rows])
    def names(c):
        return sorted(r[0] for r in df.filter(c).select("school").collect())

    assert names(cleaning.is_page_school()) == ["A", "B", "C", "D", "HomeSchool"]
    assert names(cleaning.is_strict_school()) == ["D"]


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    records(spark).write.parquet(str(tmp_path / "raw"))
    stored = spark.read.parquet(str(tmp_path / "raw"))
    plan = plan_of(cleaning.district_rows(stored).select("cds_code", "slug"))
    assert "EqualTo(status,Active)" in plan and "In(record_type" in plan
    assert "administrator_name" not in plan
    # At most one row per key leaves each task.
    assert "row_number(), 1, Partial" in plan


def test_lines_without_values(spark):
    blank = ["", "   ", ",,,", ' "" , "  ",,"" ', "," * 100_000, '"",' * 50_000]
    filled = ['","', '""""', "a,,", '"",x', ', """", ', "0", '"a",""']
    df = spark.createDataFrame([(x,) for x in blank + filled], "line string")
    got = [r[0] for r in df.select(directory.no_values("line")).collect()]
    assert got == [True] * len(blank) + [False] * len(filled)


def test_preamble_of_many_files(spark, tmp_path):
    for i in range(70):
        (tmp_path / f"{i}.csv").write_text("\n".join([*PREAMBLE, line(record_type="School", cds_code=f"c{i}")]))
    got = directory.read_directory(spark, f"{tmp_path}/*.csv")
    assert sorted(r["cds_code"] for r in got.collect()) == sorted(f"c{i}" for i in range(70))


def test_preambles_of_many_files_in_one_scan(spark, tmp_path):
    """More files than partitions; files shorter than the preamble, empty ones, and split ones."""
    sizes = [0, 1, 3, 4, 5, 9] * 13 + [400]
    for i, n in enumerate(sizes):
        rows = (PREAMBLE + [line(record_type="School", cds_code=f"{i:03d}-{j:03d}") for j in range(n)])[: n if n < 4 else None]
        (tmp_path / f"{i:03d}.csv").write_text("".join(r + "\n" for r in rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    try:
        raw = directory.read_directory(spark, str(tmp_path))
        got = [r[0] for r in raw.orderBy("ord").select("cds_code").collect()]
        assert len(raw.inputFiles()) == 79 and raw.rdd.getNumPartitions() < 79
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [f"{i:03d}-{j:03d}" for i, n in enumerate(sizes) if n >= 4 for j in range(n)]
    plan = plan_of(raw)
    assert plan.count("Scan text") == 2 and "Exchange" not in plan and "Join" not in plan  # the tree and its detail
