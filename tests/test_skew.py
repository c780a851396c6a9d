from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rollatlas.operators.linking import chunk_by_key


@pytest.fixture(scope="module")
def hot(spark):
    """One key with a third of the rows, and nulls."""
    facts = spark.range(3000).select(
        F.col("id").alias("ord"),
        F.expr("CASE WHEN id % 3 = 0 THEN 1 WHEN id % 50 = 1 THEN NULL WHEN id % 7 = 2 THEN 999 ELSE id % 40 END").alias("key"),
    )
    return facts


def test_chunks_hold_everything_in_order(hot):
    facts = hot
    numbered = facts.filter("key IS NOT NULL").withColumn("v", F.col("ord"))
    chunks = chunk_by_key(numbered, "key", ["v"], "items", rows=100)
    got = chunks.orderBy("key", "chunk").collect()
    assert max(r["n"] for r in got) <= 100
    listed: dict[int, list[int]] = {}
    for r in got:
        listed.setdefault(r["key"], []).extend(i["v"] for i in r["items"])
    want: dict[int, list[int]] = {}
    for r in facts.filter("key IS NOT NULL").orderBy("ord").collect():
        want.setdefault(r["key"], []).append(r["ord"])
    assert listed == want


def test_chunks_are_full_and_dense_whatever_the_blocks(spark):
    """Two files; a key with more rows than a block, one with a few across a block's edge, null."""
    place = F.struct(
        F.when(F.col("id") < 6000, "a").otherwise("b").alias("file"), F.lit(0).cast("bigint").alias("block"), F.col("id").alias("row")
    )
    key = F.expr("CASE WHEN id BETWEEN 4094 AND 4098 THEN 'few' WHEN id % 100 = 0 THEN NULL ELSE 'hot' END")
    df = spark.range(12_000).select(place.alias("ord"), key.alias("key"), F.col("id").alias("v"))
    got = chunk_by_key(df, "key", ["v"], "items", rows=1000).orderBy("key", "chunk").collect()
    lists: dict = {}
    for r in got:
        lists.setdefault(r["key"], []).append([i["v"] for i in r["items"]])
    assert [r["chunk"] for r in got if r["key"] == "hot"] == list(range(len(lists["hot"])))
    assert [len(x) for x in lists["hot"][:-1]] == [1000] * (len(lists["hot"]) - 1)
    assert lists["few"] == [[4094, 4095, 4096, 4097, 4098]]
    assert sum(lists[None], []) == list(range(0, 12_000, 100))
    assert sum(lists["hot"], []) == [i for i in range(12_000) if i % 100 and not 4094 <= i <= 4098]
