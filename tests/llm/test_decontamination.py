"""Greedy string tiling against a benchmark (operator 7)."""

from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from rollatlas.llm import decontamination


def plain_tiling(one, two, least):
    """Words of ``two`` that textbook greedy string tiling marks."""
    marked_one, marked_two, total = set(), set(), 0
    while True:
        best = 0
        for a in range(len(one)):
            for b in range(len(two)):
                n = 0
                while (
                    a + n < len(one) and b + n < len(two) and one[a + n] == two[b + n]
                    and a + n not in marked_one and b + n not in marked_two
                ):
                    n += 1
                best = max(best, n)
        if best < least:
            return total, marked_two
        total += best
        # The first longest match, in the order of the operator.
        found = min(
            (a, b)
            for a in range(len(one) - best + 1) for b in range(len(two) - best + 1)
            if one[a : a + best] == two[b : b + best]
            and not any(a + i in marked_one or b + i in marked_two for i in range(best))
        )
        marked_one.update(range(found[0], found[0] + best))
        marked_two.update(range(found[1], found[1] + best))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=16), st.lists(st.integers(0, 2), max_size=12))
def test_tiles_equal_the_plain_rule(one, two):
    k = 2
    seeds = {tuple(two[b : b + k]) for b in range(len(two) - k + 1)}
    where = lambda text, s: [i for i in range(len(text) - k + 1) if tuple(text[i : i + k]) == s]
    places = [(where(one, s), where(two, s)) for s in seeds if where(one, s)]
    found = decontamination.tiles(places, k) if places else []
    assert sum(n for _, _, n in found) == plain_tiling(one, two, k)[0]
    assert all(one[a : a + n] == two[b : b + n] for a, b, n in found)


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


def test_passages_in_any_order(spark, docs_of):
    item = words(40, 1)
    other = words(30, 2)
    filler = words(300, 3)
    benchmark = spark.createDataFrame(
        [(1, " ".join(item)), (1, " ".join(item)), (2, " ".join(other)), (3, "too short"), (4, None), (None, " ".join(words(20, 9)))],
        "item_id long, text string",
    )
    swapped = item[25:] + filler[:10] + item[:10] + filler[20:22] + item[10:25]
    docs = docs_of([
        (1, " ".join(filler[:50] + item + filler[50:])), (2, ". ".join(swapped).upper()), (3, " ".join(filler + item[:15])),
        (4, None), (5, ""), (6, " ".join(filler)), (7, " ".join(item + other)), (7, " ".join(item + other)),
        (8, " ".join(filler * 200 + other)), (None, " ".join(other)),
    ])
    found = decontamination.shared_passages(docs, benchmark).collect()
    got = sorted((r.doc_id or -1, r.item_id, r.matched_words, r.tiles, r.coverage) for r in found)
    assert got == [(-1, 2, 30, 1, 1.0), (1, 1, 40, 1, 1.0), (2, 1, 40, 3, 1.0), (7, 1, 40, 1, 1.0), (7, 2, 30, 1, 1.0), (8, 2, 30, 1, 1.0)]
    some = decontamination.shared_passages(docs, benchmark, min_coverage=0.3).collect()
    assert {(r.doc_id, r.item_id) for r in some} - {(r.doc_id, r.item_id) for r in found} == {(3, 1)}


def test_nothing_to_compare(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, " ".join(words(9, 1)))], "item_id long, text string")
    assert decontamination.shared_passages(docs_of([(1, "a b c d e f")]), none).collect() == []
    assert decontamination.shared_passages(docs_of([]), some).collect() == []


def test_short_items_match_as_a_whole(spark, docs_of):
    benchmark = spark.createDataFrame(
        [(1, "Red, fox!"), (2, "lone"), (3, "one two three four"), (4, " ".join(words(8, 5))), (5, "")], "item_id long, text string"
    )
    docs = docs_of([
        (1, "the red fox and the red fox"), (2, "red foxes"), (3, "lone"), (4, "a one two three four b"), (5, "one two three"),
        (6, " ".join(words(8, 5))),
    ])
    found = decontamination.shared_passages(docs, benchmark).collect()
    assert sorted((r.doc_id, r.item_id, r.matched_words, r.coverage) for r in found) == [
        (1, 1, 2, 1.0), (3, 2, 1, 1.0), (4, 3, 4, 1.0), (6, 4, 8, 1.0)
    ]


def test_a_passage_that_both_repeat(spark, docs_of):
    line = words(6, 7)
    benchmark = spark.createDataFrame([(1, " ".join(line * 30))], "item_id long, text string")
    docs = docs_of([(1, " ".join(line * 3000)), (2, " ".join(line * 10 + words(50, 8) + line * 10))])
    found = sorted((r.doc_id, r.matched_words, r.tiles) for r in decontamination.shared_passages(docs, benchmark).collect())
    assert found == [(1, 180, 1), (2, 120, 2)]
