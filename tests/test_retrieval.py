from __future__ import annotations

import math
import re

import pytest
from helpers import plan_of
from pyspark.sql import functions as F

from rollatlas.operators import retrieval as R
from rollatlas.operators.sections import guide_sections

TEXTS = [
    ("north", "a", "The safety plan of the school"), ("north", "b", "Bus plan, bus times and bus stops"),
    ("north", "c", "The budget of the district: budget"), ("north", "d", "Enrollment plan"), ("north", "e", None),
    ("south", "a", "Bus bus bus"), ("south", "b", "Safety first"), ("south", "c", "Budget talk"), ("south", "z", ""),
]
QUESTIONS = [
    (1, "north", "Which BUS stops? bus!"), (2, "north", "the plan of safety"), (3, "south", "budget"), (4, "south", "enrollment"),
    (5, "west", "bus"), (6, "north", None), (7, "south", "bus safety budget talk first"),
]


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(texts, questions, k):
    out = []
    for q, district, asked in questions:
        own = [(s, words(t)) for d, s, t in texts if d == district]
        mean = sum(len(w) for _, w in own) / len(own) if own else 0
        scores = []
        for s, w in own:
            score = hits = 0
            for term in set(words(asked)):
                df = sum(term in x for _, x in own)
                if term in w and 2 * df < len(own):
                    tf = w.count(term)
                    rarity = math.log((len(own) - df + 0.5) / (df + 0.5))
                    score += math.floor(rarity * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))) * 1_000_000)
                    hits += 1
            if hits:
                scores.append((-score, s))
        out += [(q, district, i + 1, s, -n) for i, (n, s) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def tables(spark):
    sections = spark.createDataFrame(TEXTS, "district string, section_id string, text string")
    return sections, spark.createDataFrame(QUESTIONS, "question_id int, district string, text string")


def test_scores_and_ranks(spark, tables, tmp_path):
    sections, questions = tables
    index = R.build_index(sections)
    for k in (1, 2, 10):
        assert sorted(map(tuple, R.retrieve(index, questions, k).collect())) == brute(TEXTS, QUESTIONS, k)
    R.write_index(index, str(tmp_path / "index"))
    stored = R.read_index(spark, str(tmp_path / "index"))
    assert sorted(map(tuple, R.retrieve(stored, questions, 2).collect())) == brute(TEXTS, QUESTIONS, 2)


def test_one_district_with_most_sections_and_terms(spark):
    texts = [("hot" if i % 3 else f"d{i % 7}", f"s{i:04d}", f"the word{i % 50} word{i % 11} rare{i}") for i in range(900)]
    questions = [(i, "hot" if i % 2 else f"d{i % 7}", f"the word{i} rare{i * 7} word{i % 11}") for i in range(40)]
    index = R.build_index(spark.createDataFrame(texts, "district string, section_id string, text string"))
    found = R.retrieve(index, spark.createDataFrame(questions, "question_id int, district string, text string"), 3)
    assert sorted(map(tuple, found.collect())) == brute(texts, questions, 3)
    plan = plan_of(found)
    # Each task cuts to k before the shuffle.
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


GUIDE = """lost

# One &  Two
Text  of
one.

```
# no heading
```
## One &  Two
> quoted
## Last"""


def test_sections(spark):
    guides = spark.createDataFrame([(7, GUIDE), (8, "none"), (9, None)], "doc_id int, text string")
    got = guide_sections(guides, "https://x").orderBy("pos").collect()
    assert [tuple(r) for r in got] == [
        (7, 0, "7#one---two", "One &  Two", "Text of one.", "https://x/guides/7#one---two"),
        (7, 1, "7#one---two-1", "One &  Two", "> quoted", "https://x/guides/7#one---two-1"),
        (7, 2, "7#last", "Last", "", "https://x/guides/7#last"),
    ]
    assert "Exchange" not in plan_of(guide_sections(guides))
    # Other sections may come without changing an id.
    more = spark.createDataFrame([(7, "# New\n" + GUIDE)], "doc_id int, text string")
    assert {r["section_id"] for r in got} < {r["section_id"] for r in guide_sections(more).collect()}


def test_only_asked_terms_are_shuffled(spark, monkeypatch):
    texts = [(f"d{i % 3}", f"s{i:03d}", f"word{i % 7} other{i} more{i % 5} last{i * 3 % 11}") for i in range(90)]
    questions = [(i, f"d{i % 4}", f"word{i} last{i}") for i in range(12)]
    sections = spark.createDataFrame(texts, "district string, section_id string, text string")
    asked = spark.createDataFrame(questions, "question_id int, district string, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for sent, semi in ((100, 2), (1, 0)):
            monkeypatch.setattr(R, "SENT", sent)
            found = R.retrieve(R.build_index(sections), asked, 4)
            # Postings and their frequencies meet the asked terms where these are sent.
            assert plan_of(found).split("\n\n")[0].count("BroadcastHashJoin LeftSemi") == semi
            assert sorted(map(tuple, found.collect())) == brute(texts, questions, 4)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
