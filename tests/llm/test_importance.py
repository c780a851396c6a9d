from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import pytest

from rollatlas.llm import importance as I

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def features(text, longest):
    words = WORD.findall(lowered(text))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, longest=1, buckets=50, percent=10, min_words=4, seed=2024):
    def total(texts):
        counts = [0] * buckets
        for t in texts:
            for f in features(t, longest)[1]:
                counts[zlib.crc32(f.encode()) % buckets] += 1
        return counts

    s, t = total(x for _, x in docs), total(target)
    gain = [
        math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)
    ]
    rows = []
    for name, text in docs:
        words, own = features(text, longest)
        weight = math.floor(sum(gain[zlib.crc32(f.encode()) % buckets] for f in own) / len(own)) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if name is None else name}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((name, len(own), weight, score, len(words)))
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = math.floor(percent * len(able) / 100)
    ranked = [(*r[:4], i + 1 if i < drawn else None) for i, r in enumerate(able)]
    return sorted(ranked + [(*r[:4], None) for r in rows if r[4] < min_words], key=str)


def texts(n, seed=3):
    pick = random.Random(seed)
    words = ["Alpha", "beta", "Été", "x1", "ÀB", "zeta—y", "9", "日本", "it's", "tab\tstop", "a-b"]
    return [" ".join(pick.choices(words, k=pick.randint(0, 12))) for _ in range(n)]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_equals_brute_force(spark, docs_of, longest):
    docs = list(enumerate(texts(120))) + [(500, None), (501, ""), (502, "..."), (None, "beta beta beta beta beta"), (7, "x1 x1 x1 x1")]
    docs += [(600, "Alpha beta zeta x1 9")] * 5
    target = ["beta x1", "Été 9 beta", None, "beta x1"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    for percent in (10, 50, 100):
        got = I.resample(docs_of(docs), bench, longest=longest, buckets=50, percent=percent, min_words=4)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted(map(tuple, got.collect()), key=str) == brute(docs, target, longest, percent=percent)


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = " ".join(texts(60, seed=9)) + "w" * 500 + " end"
    want = {n: I.feature_counts(text, n, 997) for n in (1, 2, 4)}
    monkeypatch.setattr(I, "PIECE_BYTES", 64)
    assert len(list(I.word_lists(text))) > 10
    assert {n: I.feature_counts(text, n, 997) for n in want} == want
    for n, (found, words) in want.items():
        plain = features(text, n)
        assert words == len(plain[0]) and sum(found.values()) == len(plain[1])


def test_chained_codes_are_those_of_the_joined_words():
    words = [w.encode() for w in "one two three four five".split()]
    two = I.longer_codes(words, [zlib.crc32(w) for w in words])
    assert two == [zlib.crc32(b" ".join(words[i : i + 2])) for i in range(4)]
    assert I.longer_codes(words, two) == [zlib.crc32(b" ".join(words[i : i + 3])) for i in range(3)]


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert I.resample(docs_of([]), none).collect() == []
    got = I.resample(docs_of([(i, "word " * 30) for i in range(20)]), none, percent=10).collect()
    assert sum(r["rank"] is not None for r in got) == 2 and len({r["weight"] for r in got}) == 1


def test_rows_of_one_id_are_ranked_each(spark, docs_of, monkeypatch):
    monkeypatch.setattr(I, "COPIES", 7)
    docs = [(1, "a b c d e")] * 40 + [(2, "a b c d f"), (3, "a b")]
    bench = spark.createDataFrame([(0, "a b c")], "item_id long, text string")
    got = I.resample(docs_of(docs), bench, percent=100, min_words=4).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 42))
    assert len(got) == 42


def test_drawn_documents_keep_their_columns(spark, docs_of):
    docs = docs_of([(i, "word " * 25) for i in range(30)])
    bench = spark.createDataFrame([(0, "word")], "item_id long, text string")
    drawn = I.drawn_documents(docs, I.resample(docs, bench))
    assert drawn.columns == docs.columns and drawn.count() == 3
