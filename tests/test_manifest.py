from __future__ import annotations

import glob
import os

import pytest
from helpers import plan_of
from pyspark.sql import functions as F

from rollatlas.sources import manifest as M


def rows(spark, n=40, changed=()):
    text = F.when(F.col("id").isin(*changed), "new").otherwise("old") if changed else F.lit("old")
    key = F.lpad((F.col("id") % 4).cast("string"), 3, "0")
    return spark.range(n).select(key.alias("cds"), F.col("id").alias("n"), text.alias("text"))


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/cds=*/*.parquet")}


def test_only_changed_districts_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    assert M.write_districts(rows(spark), path, "cds") == 4
    before = files(path)
    assert M.write_districts(rows(spark).repartition(3), path, "cds") == 0
    assert files(path) == before
    assert M.write_districts(rows(spark, changed=(5, 9)), path, "cds") == 1
    after = files(path)
    assert {f for f in before if "cds=001" not in f} == {f for f in after if "cds=001" not in f}
    assert all(after[f] == before[f] for f in after if f in before)
    assert not any(f in before for f in after if "cds=001" in f)
    want = sorted(map(tuple, rows(spark, changed=(5, 9)).collect()))
    got = M.read_listed(spark, path, schema="n long, text string, cds string")
    assert sorted(map(tuple, got.select("cds", "n", "text").collect())) == want
    assert M.differences(spark, path, keys=["cds"]).collect() == []
    # A new district comes in, the others stay.
    more = spark.createDataFrame([("x-1", 7, "new")], "cds string, n long, text string")
    assert M.write_districts(more, path, "cds") == 1
    assert M.manifest(spark, path).agg(F.sum("rows")).first()[0] == 41


def test_one_district_is_read_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    M.write_districts(rows(spark), path, "cds")
    one = M.read_district(spark, path, "cds", "002")
    assert {r["cds"] for r in one.collect()} == {"002"} and one.count() == 10
    assert "cds=003" not in plan_of(one) and all("cds=002" in f for f in one.inputFiles())
    with pytest.raises(ValueError, match="holds no"):
        M.read_district(spark, path, "cds", "999")


def test_readers_refuse_what_is_not_listed(spark, tmp_path):
    path = str(tmp_path / "t")
    rows(spark).repartition(3).write.parquet(path)
    with pytest.raises(ValueError, match="not finished"):
        M.read_listed(spark, path)
    M.write_manifest(spark, path)
    assert M.read_listed(spark, path).count() == 40 and M.differences(spark, path).collect() == []
    listed = M.manifest(spark, path)
    assert listed.count() == 3 and listed.agg(F.sum("rows")).first()[0] == 40
    rows(spark, 3).coalesce(1).write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="1 files are not"):
        M.read_listed(spark, path)
    assert [r["problem"] for r in M.differences(spark, path).collect()] == ["added"]
    M.write_manifest(spark, path)
    assert M.read_listed(spark, path).count() == 43
    rows(spark, 3).write.mode("overwrite").parquet(path)
    assert not M.has_manifest(spark, path)


def test_empty_tables_and_unfit_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    rows(spark, 0).write.parquet(path)
    M.write_manifest(spark, path)
    assert M.has_manifest(spark, path) and M.read_listed(spark, path).count() == 0
    for bad in (None, "", "a/b", "a b"):
        odd = spark.createDataFrame([(bad, 1)], "cds string, n long")
        with pytest.raises(ValueError, match="folder"):
            M.write_districts(odd, str(tmp_path / "u"), "cds")
