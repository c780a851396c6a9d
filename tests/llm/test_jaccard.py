"""Jaccard links (operator 5) and connected components."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rollatlas.llm import components as components_module
from rollatlas.llm import jaccard
from rollatlas.llm.components import components


def word_set(text, n):
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = [w for w in raw.translate(bytes.maketrans(b"\t\n\v\f\r", b"     ")).split(b" ") if w]
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(rows, n, percent):
    sets = {i: word_set(t, n) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def families(seed):
    """Near copies on both sides of the threshold, a shared passage, short and odd texts."""
    random.seed(seed)
    new = lambda: "".join(random.choice("abcdefgh") for _ in range(4))
    passage = [new() for _ in range(25)]
    texts = ["", None, " \n\t", "One", "one", "one two", "One\ttwo", "a b c d", "A b c  d e", "a b c d e f", "ü b c d"]
    for _ in range(6):
        base = [new() for _ in range(random.choice([12, 30, 60, 150]))]
        for _ in range(12):
            own = list(base)
            for _ in range(random.randint(0, 1 + len(base) // 25)):
                own[random.randrange(len(own))] = new()
            texts.append(" ".join(own))
    texts += [" ".join([new() for _ in range(20)] + passage) for _ in range(15)]
    texts += ["same words again and again " * 30, "same words again and again " * 31]
    texts += random.sample([t for t in texts if t], 6)
    random.shuffle(texts)
    return [(3 * i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("n", "percent", "few"), [(4, 85, 6), (4, 85, 1), (5, 80, 2)])
def test_components_equal_brute_force(docs_of, monkeypatch, n, percent, few):
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 20_000)
    rows = families(n * percent + few)
    found = jaccard.jaccard_components(docs_of(rows), n_words=n, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows, n, percent)


def test_deletion_segments_lose_no_link(docs_of, monkeypatch):
    plain = jaccard.bands

    def with_deletions(texts, percent):
        found = plain(texts, percent)
        wide = found.segments - found.spare > 3
        found.deletions[wide] = 2
        found.segments[wide] -= 2
        return found

    monkeypatch.setattr(jaccard, "bands", with_deletions)
    rows = families(77)
    found = jaccard.jaccard_components(docs_of(rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows, 4, 85)


def test_more_texts_make_deletions_pay():
    assert (jaccard.bands(10**9).deletions > jaccard.bands(1000).deletions).any()


def test_rows_without_id_and_repeated_rows(docs_of):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (None, "q r s t"), (None, None), (2, "A b c d e")]
    found = jaccard.jaccard_components(docs_of(rows)).collect()
    assert sorted(map(tuple, found), key=str) == sorted(
        [(5, 2, 2), (5, 2, 2), (None, 2, None), (None, 1, None), (None, 0, None), (2, 2, 2)], key=str
    )


def test_nothing_to_link(docs_of):
    assert jaccard.jaccard_components(docs_of([])).collect() == []


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    found = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert found == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def test_long_texts_are_read_in_pieces():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 3, 4, 5, 60, 61, 200):
        text = " ".join("".join(rng.choice(list("abé"), rng.integers(1, 9))) for _ in range(n)) + " " * int(rng.integers(0, 40))
        raw = np.frombuffer(text.encode(), np.uint8)
        offsets = np.array([0, len(raw)])
        want = jaccard.shingle_sets(raw, offsets, 4)[1]
        for size in (1, 7, 30, 64, 500):
            row, got = jaccard.shingle_sets(raw, offsets, 4, size)
            assert got.tolist() == want.tolist() and not row.any()


def test_texts_under_one_id_give_one_result_each_time(docs_of):
    one, two = "a b c d e f g h", "p q r s t u v w"
    docs = [(1, one), (1, two), (2, one), (3, two)]
    got = [sorted(map(tuple, jaccard.jaccard_components(docs_of(docs[i:] + docs[:i])).collect())) for i in range(3)]
    assert got[0] == got[1] == got[2]


def test_staged_tables_are_few_files(spark, docs_of, monkeypatch):
    """Files of a table follow the number of texts, not of shuffle partitions."""
    written = []
    plain = jaccard.stage

    def counted(df, label, *files):
        made = plain(df, label, *files)
        written.append((label, len(made.inputFiles())))
        return made

    monkeypatch.setattr(jaccard, "stage", counted)
    monkeypatch.setattr(components_module, "stage", counted)
    monkeypatch.setattr(jaccard, "LEAST_FILES", 2, raising=False)
    settings = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    rows = families(5)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = jaccard.jaccard_components(docs_of(rows).coalesce(1)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows, 4, 85)
    assert {label for label, _ in written} >= {"jaccard-sets", "jaccard-links", "component-hooks"}
    assert all(n <= 2 for _, n in written), written


def test_rows_of_a_large_group_are_made_in_several_tasks(spark, monkeypatch):
    """A group has a row for each document and block, which grow with the square of its size."""
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 4)
    groups = spark.createDataFrame([(i, 0) for i in range(40)] + [(100 + i, 100) for i in range(3)], "node long, root long")
    sets = spark.createDataFrame([(i, bytearray(8)) for i in [*range(40), *range(100, 103)]], "doc long, shingles binary")
    met = jaccard._met_blocks(groups, sets, 4)
    rows = [(r.doc, r.group, r.low, r.high) for r in met.collect()]
    # Ten blocks of the one group and a single one of the other.
    assert len(rows) == len(set(rows)) == 40 * 10 + 3
    together = {}
    for doc, group, low, high in rows:
        together.setdefault((group, low, high), set()).add(doc)
    pairs = {(a, b) for docs in together.values() for a in docs for b in docs if a < b}
    assert pairs == {(a, b) for b in range(40) for a in range(b)} | {(100, 101), (100, 102), (101, 102)}
    tasks = {r.task for r in met.select(F.spark_partition_id().alias("task")).collect()}
    assert len(tasks) > 1
