"""The corpus pipeline, stage by stage, and the registered queries."""

from __future__ import annotations

import os
import re
from collections import defaultdict

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from rollatlas.llm import packing, queries

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and {n for n in range(1, 14)} == {int(k[2:].split("_")[0]) for k in names if re.match(r"op\d", k)}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near copies", "repeats", "benchmark", "packing"]


@needs_tables
def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)

    before = {r.doc_id: r for r in docs.collect()}
    one = stages["language"](spark, docs, FOLDER)
    assert one.columns == COLUMNS
    kept = {r.doc_id: r for r in one.collect()}
    assert all(re.search(r"[^\W\d_]", r.text) for r in kept.values())
    assert len(kept) >= 0.99 * len(before)

    two = stages["near copies"](spark, one, FOLDER)
    assert two.columns == COLUMNS
    texts = [r.text for r in two.collect()]
    shingles = [set(zip(*[re.findall(r"\S+", t.lower())[i:] for i in range(5)])) for t in texts]
    for k, a in enumerate(shingles):
        for b in shingles[:k]:
            both = len(a & b)
            assert not both or 100 * both < 80 * (len(a) + len(b) - both)
    # Everything that goes is near something.
    assert len(texts) < len(kept) and set(texts) <= {r.text for r in kept.values()}

    three = stages["repeats"](spark, two, FOLDER)
    assert three.columns == COLUMNS
    rows = three.collect()
    assert all(r.text and len(r.text) == r.n_chars for r in rows)

    four = stages["benchmark"](spark, three, FOLDER)
    assert four.columns == COLUMNS
    left = {r.doc_id: r.text for r in four.collect()}
    assert not [i for i, t in left.items() if any(item in t for item in items)]
    gone = {r.doc_id: r.text for r in rows if r.doc_id not in left}
    assert all(any(item[:60] in t for item in items) for t in gone.values())

    five = stages["packing"](spark, four, FOLDER).collect()
    tokens = defaultdict(int)
    for r in five:
        tokens[r.sequence_id] += r.length
        assert len(r.ids) == 4 * r.length
    assert max(tokens.values()) <= packing.CAPACITY and {r.doc_id for r in five} == set(left)


def test_odd_documents_pass_all_stages(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string"
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (None, "words without an id " * 9, "en", None, None, "x")]
    rows += [(5, "plain words of one document " * 5, "en", "s", 1, None)] * 2
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "no such words are in any text here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in found} == {5, None}


def text_of(seed, words=90):
    return " ".join(f"w{seed}x{i}" for i in range(words))


def test_documents_without_labels_stay(spark, docs_of):
    rows = [(1, text_of(1)), (None, text_of(2)), (3, "12 34"), (4, None)]
    kept = corpus_pipeline.known_language(spark, docs_of(rows), "").collect()
    assert [(r.doc_id, r.text, r.lang) for r in kept] == [(*r, None) for r in rows[:2]]


def test_near_copies_without_id(spark, docs_of):
    near = text_of(3) + " and more"
    rows = [(1, text_of(1)), (None, text_of(1)), (None, text_of(2)), (None, text_of(2)), (7, near), (None, text_of(3)), (None, text_of(4))]
    kept = corpus_pipeline.one_of_near_copies(spark, docs_of(rows), "").collect()
    want = [(1, text_of(1)), (7, near), (None, text_of(2)), (None, text_of(4))]
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted((str(i), t) for i, t in want)


def test_repeats_keep_a_text_that_also_has_no_id(spark, docs_of):
    rows = [(1, text_of(1)), (None, text_of(1))]
    docs = corpus_pipeline.one_of_near_copies(spark, docs_of(rows), "")
    assert [(r.doc_id, r.text) for r in corpus_pipeline.no_repeats(spark, docs, "").collect()] == rows[:1]


def test_passages_of_over_fifty_words_go(spark, docs_of):
    """Such a passage is often shorter than the strings that operator 10 removes."""
    passage = " ".join(f"p{i}" for i in range(52))
    assert len(passage) < 400
    rows = [(i, f"{text_of(i)} {passage} {text_of(50 + i)}") for i in range(3)] + [(9, text_of(9)), (10, passage[: len(passage) // 2])]
    kept = {r.doc_id: r for r in corpus_pipeline.no_repeats(spark, docs_of(rows), "").collect()}
    assert {i: r.text for i, r in kept.items()} == dict([(i, f"{text_of(i)}  {text_of(50 + i)}") for i in range(3)] + rows[3:])
    assert all(r.n_chars == len(r.text) for r in kept.values())


def test_benchmark_without_id(spark, docs_of, tmp_path):
    item = text_of(9, 20)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"before {item} after"), (None, text_of(1)), (2, text_of(2)), (3, f"this {item}"), (None, None)]
    kept = corpus_pipeline.no_benchmark(spark, docs_of(rows), str(tmp_path)).collect()
    assert {(r.doc_id, r.text) for r in kept} == {(None, text_of(1)), (2, text_of(2)), (None, None)}


@needs_tables
@pytest.mark.parametrize("name", list(queries.registry()))
def test_queries_on_empty_tables(spark, tmp_path, name):
    for table in ("documents", "embeddings", "pages", "benchmark", "labels"):
        spark.read.parquet(f"{FOLDER}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert queries.registry()[name](spark, str(tmp_path)).count() == 0
