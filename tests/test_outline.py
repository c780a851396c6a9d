from __future__ import annotations

import time

from pyspark.sql import functions as F

from rollatlas.operators.outline import guide_headings, guide_outline, unique_anchors

GUIDE = """Intro line.

# Title
## Conflict & Care #
What happens first?
And then?

> **Why this is important:** Because of *safety*.

### Detail
text
```
## not a heading
```
## Repeat
> **Why this is important:** Only a note.

## Repeat

####### seven
##no space
## Élan vital_2!
Last question?"""


def guides(spark, text=GUIDE):
    return spark.createDataFrame([(1, text), (2, "no headings")], "doc_id int, text string")


def test_headings(spark):
    for text in (GUIDE, GUIDE.replace("\n", "\r\n")):
        got = guide_headings(guides(spark, text)).orderBy("pos").collect()
        assert [(r["depth"], r["slug"], r["text"]) for r in got] == [
            (1, "title", "Title"), (2, "conflict--care", "Conflict & Care"), (3, "detail", "Detail"),
            (2, "repeat", "Repeat"), (2, "repeat-1", "Repeat"), (2, "élan-vital_2", "Élan vital_2!"),
        ]


def test_outline(spark):
    got = guide_outline(guides(spark)).orderBy("number").collect()
    assert [(r["number"], r["text"], r["question"], r["note"]) for r in got] == [
        (1, "Conflict & Care", "What happens first?\nAnd then?", "Because of *safety*."),
        (2, "Repeat", None, "Only a note."),
        (3, "Repeat", "####### seven\n##no space", None),
        (4, "Élan vital_2!", "Last question?", None),
    ]


def test_anchors_are_unique_and_the_outline_has_them(spark):
    text = "## Repeat\n## Repeat\n### Repeat 1\n## Repeat 1\n# Other\n## Repeat\n## Repeat 1-1\n## Other\n"
    slugs = ["repeat", "repeat-1", "repeat-1-1", "repeat-1-2", "other", "repeat-2", "repeat-1-1-1", "other-1"]
    heads = guide_headings(guides(spark, text)).filter("doc_id = 1").orderBy("pos").collect()
    assert [r["slug"] for r in heads] == slugs
    listed = guide_outline(guides(spark, text)).orderBy("number").collect()
    assert [r["anchor"] for r in listed] == [r["slug"] for r in heads if r["depth"] == 2]


def test_long_sections_pass(spark):
    text = "## Long\n" + "words of one line\n" * 100_000 + "\n## Next\n\n\n> quoted\nnot a question\n## End\n  indented\n \t\nbehind"
    got = guide_outline(guides(spark, text)).orderBy("number").collect()
    assert len(got[0]["question"]) == 18 * 100_000 - 1
    assert [r["question"] for r in got[1:]] == [None, "indented"]


def _anchors(slugs: list[str]) -> list[str]:
    """Anchors one after the other, as a plain loop gives them."""
    taken, seen, out = set(), {}, []
    for slug in slugs:
        anchor, n = slug, max(seen.get(slug, 0), 1)
        while anchor in taken:
            anchor, n = f"{slug}-{n}", n + 1
        seen[slug] = seen.get(slug, 0) + 1
        taken.add(anchor)
        out.append(anchor)
    return out


def test_anchors_of_any_mixture(spark):
    import random

    pick = random.Random(5)
    names = ["a", "a-1", "a-2", "a-1-1", "b", "b-x", "b-x-1", "", "-1", "a-01", "é-3", "é"]
    rows = [(i, [pick.choice(names[: pick.randint(1, len(names))]) for _ in range(pick.randint(0, 14))]) for i in range(300)]
    got = spark.createDataFrame(rows, "i int, s array<string>").select("i", unique_anchors(F.col("s")).alias("a")).collect()
    assert {r["i"]: r["a"] for r in got} == {i: _anchors(s) for i, s in rows}


def test_twenty_thousand_headings_in_seconds(spark):
    text = "".join(f"## {'Again' if i % 2 else f'Step {i}'}\n" for i in range(20_000))
    start = time.perf_counter()
    got = guide_outline(guides(spark, text)).orderBy("number").collect()
    assert time.perf_counter() - start < 20
    slugs = ["again" if i % 2 else f"step-{i}" for i in range(20_000)]
    assert [r["anchor"] for r in got] == _anchors(slugs)
