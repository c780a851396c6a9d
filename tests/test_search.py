from __future__ import annotations

import random

import pytest
from helpers import F, district_table, plan_of

from rollatlas.operators import search
from rollatlas.operators.arrays import explode_costly
from rollatlas.operators.search import search_districts, search_many


def table(spark, names, status="Active"):
    rows = [n if isinstance(n, tuple) else (n, status) for n in names]
    return district_table(
        spark,
        [{"cds_code": str(i), "district": n, "status": s, "slug": f"s{i}"} for i, (n, s) in enumerate(rows)],
    )


NAMES = [
    ("Apple Valley Unified", "Active"), ("Banana Unified", "Active"), ("Cherry Intermediate", "Active"),
    ("Date Palm Elementary", "Inactive"), ("Apricot High", "Active"),
]


@pytest.mark.parametrize(
    "term, want",
    [("", []), ("Zebra", []), ("apple", ["Apple Valley Unified"]), ("APPLE", ["Apple Valley Unified"]),
     ("Date", []), ("unified", ["Apple Valley Unified", "Banana Unified"])],
)
def test_cases(spark, term, want):
    got = search_districts(table(spark, NAMES), term).collect()
    assert [r["district"] for r in got] == want


def test_order_limit_and_path(spark):
    names = ["Banana Unified School", "Apple Valley School", "Avocado Charter"]
    got = search_districts(table(spark, names), "a", base="/b/").collect()
    assert [r["district"] for r in got] == ["Apple Valley School", "Avocado Charter", "Banana Unified School"]
    assert got[0]["path"] == "/b/districts/s1"
    assert search_districts(table(spark, [f"District {i}" for i in range(15)]), "District").count() == 10
    accents = ["zebra a", "Éclair a", "apple a", "Apple a", "Banana a"]
    got = search_districts(table(spark, accents), "a").collect()
    assert [r["district"] for r in got] == ["apple a", "Apple a", "Banana a", "Éclair a", "zebra a"]
    assert "TakeOrderedAndProject" in plan_of(search_districts(table(spark, names), "a"))


def test_many_terms_by_brute_force(spark):
    rng = random.Random(5)
    names = ["".join(rng.choice("abc d") for _ in range(rng.randint(1, 12))).strip() or "x" for _ in range(150)]
    terms = sorted({n[i : i + k] for n in names[:25] for i in range(3) for k in (1, 2, 3, 5, 7)} | {"zz", "zzzz", "", "AB"})
    districts = table(spark, names)
    wanted = spark.createDataFrame([(t,) for t in terms], "term string")
    found: dict[str, list[str]] = {}
    for r in search_many(districts, wanted).collect():
        found.setdefault(r["term"], []).append(r["cds_code"])
    single = {t: [r["cds_code"] for r in search_districts(districts, t).collect()] for t in terms}
    assert {t: sorted(c) for t, c in found.items()} == {t: sorted(c) for t, c in single.items() if c}


def test_many_terms_use_no_cross_join(spark):
    plan = plan_of(search_many(table(spark, NAMES[:1]), spark.createDataFrame([("a",)], "term string")))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_ten_thousand_terms_on_one_piece(spark):
    """All names and terms share a piece, and most terms have no rarer one: still no product."""
    names = [f"{i:03d} unified" for i in range(900)] + ["unified " * 4 + str(i) for i in range(100)]
    terms = [f"unified {i}" for i in range(9_000)] + [f"{i:04d} unified" for i in range(1_000)] + ["UNIFIED", "nif", "unified unified 7"]
    districts = table(spark, names)
    got: dict[str, list[str]] = {}
    for r in search_many(districts, spark.createDataFrame([(t,) for t in terms], "term string")).collect():
        got.setdefault(r["term"], []).append(r["district"])
    want = {}
    for t in terms:
        hits = sorted((n, i) for i, n in enumerate(names) if t.lower() in n)[:10]
        if hits:
            want[t] = [n for n, _ in hits]
    assert {t: sorted(n) for t, n in got.items()} == {t: sorted(n) for t, n in want.items()}
    plan = plan_of(search_many(districts, spark.createDataFrame([("a",)], "term string")))
    assert "Contains" not in plan


def test_rows_of_one_name_cost_no_more_than_the_name(spark, monkeypatch):
    names = [f"{w} unified" for w in ("apple", "Éclair", "banana", "Apple")]
    districts = table(spark, [names[i % 4] for i in range(400)] + [""]).unionByName(table(spark, ["apple unified", "pear"]))
    districts = districts.withColumn("ord", F.expr("CASE WHEN district = 'pear' THEN NULL ELSE ord END"))
    cut = []

    def spy(df, *more):
        cut.append(df.count())
        return explode_costly(df, *more)

    monkeypatch.setattr(search, "explode_costly", spy)
    terms = ["UNI", "p", "apple unified", "éclair", "ear", "nn"]
    found = search.search_many(districts, spark.createDataFrame([(t,) for t in terms], "term string"))
    got: dict[str, list[str]] = {}
    for r in found.collect():
        got.setdefault(r["term"], []).append(r["cds_code"])
    # The row that is there twice counts once, as in a search for many terms it always has.
    once = districts.distinct()
    want = {t: sorted(r["cds_code"] for r in search_districts(once, t).collect()) for t in terms}
    assert {t: sorted(c) for t, c in got.items()} == {t: c for t, c in want.items() if c}
    assert max(cut) <= len(terms)
    # Each task cuts a stretch's names to k before they are sent on.
    assert "dense_rank" in plan_of(found) and "WindowGroupLimit" in plan_of(found)
