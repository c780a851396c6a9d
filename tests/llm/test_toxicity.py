"""Weakly supervised toxicity (operator 9)."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollatlas.llm import queries, toxicity


def corpus(spark):
    random.seed(8)
    bad, stems = ["grubface", "twerp"], ["zornq", "mulpf"]
    rows, labels = [], []
    for i in range(500):
        words = ["".join(random.choice("aeioulnrst") for _ in range(random.randint(2, 8))) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            words[7] = random.choice(bad + [s + words[7] for s in stems])
        rows.append((i, " ".join(words)))
        if i % 5:
            labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_rows(spark):
    docs, labels = corpus(spark)
    model = toxicity.fit(toxicity.labelled_rows(docs, labels, F.lit(True)))
    found = {r.doc_id: r for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    wrong = [i for i, r in found.items() if i % 5 == 0 and r.predicted != int(i % 4 == 0)]
    assert len(found) == 500 and len(wrong) <= 2 and all(0 <= r.score <= 1 for r in found.values())


def test_odd_texts(spark):
    docs, labels = corpus(spark)
    # Repeated labels: toxic if one says so. Labels without a document or a value say nothing.
    labels = labels.union(spark.createDataFrame([(4, 0), (9999, 1), (7, None)], "doc_id long, toxic int"))
    model = toxicity.fit(toxicity.labelled_rows(docs, labels, F.lit(True), train_rows=300))
    odd = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (3, "nice words " * 20_000 + "TWERP!", "x"), (3, "twerp", "x"), (None, "twerp", "x")],
        "doc_id long, text string, predicted string",
    )
    found = toxicity.score(odd, model, odd.columns).select("doc_id", "predicted").collect()
    assert sorted(map(tuple, found), key=str) == sorted([(1, 0), (2, 0), (3, 1), (3, 1), (None, 1)], key=str)
    assert toxicity.score(odd.limit(0), model, ["doc_id"]).collect() == []


def test_without_labels(spark):
    docs, labels = corpus(spark)
    model = toxicity.fit(toxicity.labelled_rows(docs, labels.limit(0), F.lit(True)))
    assert {(r.score, r.predicted) for r in toxicity.score(docs, model, ["doc_id"]).collect()} == {(0.0, 0)}


def test_label_model_discounts_one_voice_in_many():
    rng = np.random.default_rng(1)
    truth = rng.random(2000) < 0.3
    good = [truth & (rng.random(2000) < 0.7) | (rng.random(2000) < 0.02) for _ in range(3)]
    echo = rng.random(2000) < 0.1
    posterior = toxicity.label_model(np.column_stack([*good, echo, echo, echo]), truth)
    assert ((posterior > 0.5) == truth).mean() > 0.93


def test_calibration_takes_off_what_length_adds():
    """Sums that grow with the length alone tell nothing; 0.5 is where both classes are as likely."""
    rng = np.random.default_rng(2)
    words = rng.integers(20, 5000, 4000)
    truth = rng.random(4000) < 0.2
    logit = 6 * truth + 1.5 * np.log1p(words) + rng.normal(0, 1.5, 4000) + 4
    model = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    toxicity.calibrate(model, logit, words, truth)
    scale, shift, length = model.scale
    found = scale * logit + shift + length * (np.log1p(words) - model.length[0]) > 0
    assert (found & truth).sum() / found.sum() > 0.93 and (found & truth).sum() / truth.sum() > 0.9
    assert length < 0 and (logit[~truth] > 0).mean() > 0.99


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_precision_and_recall_on_rows_not_learned_from(spark):
    folder = "/root/testdata/sf0.1"
    scored = queries.registry()["op9_toxicity"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    held = scored.filter("held_out").join(labels, "doc_id").toPandas()
    both = ((held.predicted == 1) & (held.toxic == 1)).sum()
    assert (held.toxic == 1).sum() > 50
    assert both / (held.predicted == 1).sum() >= 0.9 and both / (held.toxic == 1).sum() >= 0.9
