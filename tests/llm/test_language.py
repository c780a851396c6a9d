"""Language codes (operator 1)."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollatlas.llm import language

STEMS = {"aa": ["lan", "tor", "vik"], "bb": ["üssi", "häär", "kyy"], "cc": ["qua", "ubi", "ego"]}


def labelled(spark, n=30):
    random.seed(2)
    rows = []
    for i in range(n):
        for k, (lang, stems) in enumerate(STEMS.items()):
            text = " ".join("".join(random.choices(stems, k=2)) for _ in range(random.randint(3, 30)))
            rows.append((10 * i + k, text, lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows


def test_codewords_are_far_apart():
    for n in (2, 4, 9, 40):
        words = language.codewords(n)
        apart = [(a != b).sum() for i, a in enumerate(words) for b in words[:i]]
        assert min(apart) >= 4 and (words != words[0]).any(axis=0).all()


def test_held_out_texts(spark):
    docs, rows = labelled(spark)
    allowed = F.col("doc_id") % 3 != 0
    model = language.fit(language.training_rows(docs, allowed))
    found = {r.doc_id: r for r in language.identify(docs, model, ["doc_id"]).collect()}
    assert all(found[i].lang_pred == lang and 0 <= found[i].score <= 1 for i, _, lang in rows)


def test_odd_texts_and_clashing_columns(spark):
    docs, _ = labelled(spark)
    model = language.fit(language.training_rows(docs, F.lit(True)))
    mixed = "lantor vikvik torlan " * 20 + "quaubi egoego ubiqua " * 20
    odd = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (3, "12 ?!", "x"), (4, "ü", "x"), (5, mixed, "x"), (None, "lantor " * 50_000, "x"), (6, "quaubi", None), (6, "quaubi", None)],
        "doc_id long, text string, score string",
    )
    found = language.identify(odd, model, odd.columns).collect()
    by_id = {r.doc_id: r for r in found}
    assert [by_id[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by_id[1].score == 0
    assert by_id[4].lang_pred == "bb" and by_id[None].lang_pred == "aa" and by_id[6].lang_pred == "cc"
    assert by_id[5].ambiguous and not by_id[None].ambiguous and len(found) == 8


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    model = language.fit(language.training_rows(docs, F.lit(True)))
    assert [tuple(r) for r in language.identify(docs, model, ["doc_id"]).collect()] == [(1, "und", 0.0, False)]
    assert language.identify(docs.limit(0), model, ["doc_id"]).collect() == []


def test_trigrams_stay_inside_texts():
    data = np.frombuffer(b"abxyz", np.uint8)
    codes, begin = language.trigrams(data, np.array([0, 2, 2, 5]))
    one, start = language.trigrams(data[:2], np.array([0, 2]))
    assert begin.tolist() == [0, 4, 6, 11] and codes[:2].tolist() == one[:2].tolist()
    assert (codes[[2, 3, 4, 5, 9, 10]] == language.CODES).all()


def test_pieces_of_a_long_text_give_its_margins(spark, monkeypatch):
    import numpy as np

    docs, _ = labelled(spark)
    model = language.fit(language.training_rows(docs, F.lit(True)))
    raw = np.frombuffer(("lantor Vikvik, über 12 torlan quaubi " * 40).encode(), np.uint8)
    want, count = language.margins(model, raw, np.array([0, len(raw)]))
    for size in (64, 97, len(raw) - 1, len(raw) - 2, len(raw) - 3):
        monkeypatch.setattr(language.bytetext, "STEP_BYTES", size)
        got, same = language.margins(model, raw, np.array([0, len(raw)]))
        assert np.allclose(got, want, atol=1e-6) and same[0] == count[0]


def test_training_rows_are_the_first_of_each_language(spark):
    rows = [(i, f"t{i}", "ab"[i % 3 == 0]) for i in range(500)] + [(1000, None, "a"), (1001, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.training_rows(docs, F.col("doc_id") != 4, 20).collect()
    by_hash = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    for lang in "ab":
        first = sorted((i for i, t, x in rows if x == lang and t is not None and i != 4), key=by_hash.get)[:20]
        assert sorted(r.text for r in got if r.lang == lang) == sorted(f"t{i}" for i in first)


def test_decoding_equals_the_plain_rule():
    """Loss-weighted decoding, bit by bit and word by word, without arrays."""
    import math

    import numpy as np

    rng = np.random.default_rng(6)
    code = language.codewords(5).T
    model = language.Model(list("abcde"), code, np.zeros((len(code), 1)), rng.normal(size=len(code)), rng.uniform(0.1, 2, len(code)))
    margins, count = rng.normal(size=(len(code), 40)) * 2, rng.integers(0, 900, 40)
    best, score, vague = language.decode(model, margins, count)
    for t in range(40):
        losses = []
        for word in range(5):
            parts = []
            for b in range(len(code)):
                z = (margins[b, t] - model.middle[b]) / model.half[b]
                parts.append(model.half[b] / sum(model.half) * math.log1p(math.exp(-2 * z * code[b, word])))
            losses.append(sum(parts))
        first, second = sorted(losses)[:2]
        assert losses[best[t]] == pytest.approx(first)
        assert score[t] == pytest.approx(1 / sum(math.exp(-language.SHARPNESS * (x - first)) for x in losses))
        gap = language.AMBIGUOUS_GAP * count[t] / (count[t] + language.AMBIGUOUS_TRIGRAMS)
        assert vague[t] == (second - first < gap)
