"""Outline of Markdown guides. Everything stays within the document's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollatlas.functions.binding import let
from rollatlas.functions.text import col, trim_blanks
from rollatlas.operators.arrays import posexplode_costly

TOC_DEPTH = 2
# Fixed value: the label that guides set before a note.
NOTE_LABEL = "Why this is important:"

# (?d): only a line feed ends a line.
_FENCE = r"(?msd)^(```|~~~).*?^\1[^\n]*$"
_BEFORE_HEADING = r"(?md)^(?=#{1,6}[ \t])"
_HEADING = r"\A(#{1,6})[ \t]+([^\n]*)"
_NOTE = r"(?md)^>[ \t]*\*\*" + NOTE_LABEL + r"\*\*[ \t]*([^\n]*)$"
# Where the first paragraph ends: before a blank or a quoted line. No repeated group here or
# above: the regex engine recurses for those, and a long document would end the job.
_PARAGRAPH_END = r"\n(?=>|[^\S\n]*(?:\n|\z))"


def heading_slug(text: Column | str) -> Column:
    """Anchor of a heading: lower case, punctuation out, spaces to hyphens."""
    kept = F.regexp_replace(F.lower(col(text)), r"[^\p{L}\p{M}\p{N}\p{Pc}\- ]", "")
    return F.translate(kept, " ", "-")


def first_paragraph(piece: Column) -> Column:
    """Text between the heading line of a piece and the first blank or quoted line after it."""
    body = F.regexp_replace(F.regexp_replace(piece, r"\A[^\n]*", ""), r"\A\s+", "")

    def cut(text: Column) -> Column:
        return F.when(text.startswith(">"), "").otherwise(F.get(F.split(text, _PARAGRAPH_END, 2), F.lit(0)))

    return let(body, cut)


def heading_pieces(text: Column | str) -> Column:
    """A document cut before each heading; code blocks, and what stands before the first, go."""
    plain = F.regexp_replace(F.regexp_replace(col(text), r"\r\n?", "\n"), _FENCE, "")
    return F.filter(F.split(plain, _BEFORE_HEADING), lambda p: p.rlike(_HEADING))


def heading_text(piece: Column) -> Column:
    """The heading of a piece without its marks."""
    return trim_blanks(F.regexp_replace(F.regexp_extract(piece, _HEADING, 2), r"[ \t]+#+[ \t]*$", ""))


def sections(text: Column | str) -> Column:
    """(depth, text, question, note) of every heading of a document."""

    def unless_empty(value: Column) -> Column:
        return F.when(value != "", value)

    def section(piece: Column) -> Column:
        question = trim_blanks(first_paragraph(piece))
        note = trim_blanks(F.regexp_extract(piece, _NOTE, 1))
        return F.struct(
            F.length(F.regexp_extract(piece, _HEADING, 1)).alias("depth"),
            heading_text(piece).alias("text"),
            let(question, unless_empty).alias("question"),
            let(note, unless_empty).alias("note"),
        )

    return F.transform(heading_pieces(text), section)


_NUMBERED = r"-\d+$"


def _in_turn(slugs: Column) -> Column:
    """Anchors of slugs in order by trying each against those before it."""

    def add(done: Column, slug: Column) -> Column:
        before = F.size(F.filter(F.slice(slugs, 1, F.size(done)), lambda s: s == slug))
        # As many other headings as begin like this could hold a number each, and where the first
        # of this slug was displaced, it holds one too.
        alike = F.size(F.filter(slugs, lambda s: s.startswith(F.concat(slug, F.lit("-")))))
        low = F.greatest(before, F.lit(1))
        numbered = F.transform(F.sequence(low, low + alike + 1), lambda n: F.concat_ws("-", slug, n.cast("string")))
        free = F.get(F.filter(numbered, lambda a: ~F.array_contains(done, a)), F.lit(0))
        return F.array_append(done, F.when(F.array_contains(done, slug), free).otherwise(slug))

    return F.aggregate(slugs, F.array().cast("array<string>"), add)


def _runs(items: Column, same: str) -> Column:
    """Sorted structs cut where the field ``same`` changes."""

    def cut(a: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(a) - 1)
        new = F.filter(at, lambda i: (i == 0) | (F.get(a, i)[same] != F.get(a, i - 1)[same]))

        def slices(starts: Column) -> Column:
            end = lambda j: F.coalesce(F.get(starts, j + 1), F.size(a))
            return F.transform(starts, lambda s, j: F.slice(a, s + 1, end(j) - s))

        return let(new, slices)

    return let(items, cut)


def unique_anchors(slugs: Column) -> Column:
    """Anchors of a document's headings in order, each one only once.

    A slug that is taken gets the first free of -1, -2, ...; a numbered anchor may itself be
    taken by a heading that is written that way.

    Headings are sorted by slug and numbered run by run. Only families in which a repeated slug
    meets a heading written as that slug with a number are settled one heading after the other;
    an anchor never leaves the family of its stem, the slug without its numbers.
    """
    placed = F.transform(
        slugs,
        lambda s, i: F.struct(F.regexp_replace(s, r"(-\d+)+$", "").alias("stem"), s.alias("slug"), i.alias("pos")),
    )

    def numbered(run: Column) -> Column:
        return F.transform(
            run,
            lambda h, k: F.struct(
                h["pos"].alias("pos"),
                F.when(k == 0, h["slug"]).otherwise(F.concat_ws("-", h["slug"], k.cast("string"))).alias("anchor"),
            ),
        )

    def settle(family: Column) -> Column:
        def settled(ordered: Column) -> Column:
            return let(
                _in_turn(F.transform(ordered, lambda h: h["slug"])),
                lambda done: F.zip_with(ordered, done, lambda h, a: F.struct(h["pos"].alias("pos"), a.alias("anchor"))),
            )

        by_place = F.array_sort(family, lambda x, y: x["pos"] - y["pos"])

        def choose(runs: Column) -> Column:
            taken = F.transform(F.filter(runs, lambda r: F.size(r) > 1), lambda r: F.get(r, F.lit(0))["slug"])
            written = F.transform(runs, lambda r: F.get(r, F.lit(0))["slug"])
            parents = F.transform(
                F.filter(written, lambda s: s.rlike(_NUMBERED)), lambda s: F.regexp_replace(s, _NUMBERED, "")
            )
            clash = F.arrays_overlap(taken, parents)
            return F.when(clash, let(by_place, settled)).otherwise(F.flatten(F.transform(runs, numbered)))

        return let(_runs(family, "slug"), choose)

    def in_order(parts: Column) -> Column:
        return F.transform(F.array_sort(F.flatten(parts)), lambda h: h["anchor"])

    # Most documents repeat no slug, and most others have none that ends in a number.
    alone = F.transform(slugs, lambda s, i: F.struct(s.alias("slug"), i.alias("pos")))
    plain = F.transform(_runs(F.array_sort(alone), "slug"), numbered)
    families = F.transform(_runs(F.array_sort(placed), "stem"), settle)
    return (
        F.when(F.size(F.array_distinct(slugs)) == F.size(slugs), slugs)
        .when(~F.exists(slugs, lambda s: s.rlike(_NUMBERED)), in_order(plain))
        .otherwise(in_order(families))
    )


def _anchored(guides: DataFrame, text: str) -> DataFrame:
    """(doc_id, sections with their anchor), all within the row."""
    found = guides.select("doc_id", sections(text).alias("_sections"))
    slugs = found.withColumn("_slugs", F.transform("_sections", lambda s: heading_slug(s["text"])))
    anchors = slugs.withColumn("_anchors", unique_anchors(F.col("_slugs")))
    joined = F.zip_with("_sections", "_anchors", lambda s, a: s.withField("slug", a))
    return anchors.select("doc_id", joined.alias("_sections"))


def guide_headings(guides: DataFrame, text: str = "text") -> DataFrame:
    """headings(doc_id, pos, depth, slug, text, question, note) of every guide.

    Anchors are unique within a guide, over headings of all depths.
    """
    found = posexplode_costly(_anchored(guides, text), ["doc_id"], F.col("_sections"), "pos", "_section")
    return found.select("doc_id", "pos", "_section.*")


def guide_outline(guides: DataFrame, text: str = "text") -> DataFrame:
    """Numbered depth-2 headings of every guide (F14, W7), with the anchors of ``guide_headings``."""
    top = F.filter("_sections", lambda s: s["depth"] == TOC_DEPTH)
    listed = posexplode_costly(_anchored(guides, text), ["doc_id"], top, "_pos", "_section")
    return listed.select(
        "doc_id",
        (F.col("_pos") + 1).alias("number"),
        F.col("_section.text").alias("text"),
        F.col("_section.slug").alias("anchor"),
        F.col("_section.question").alias("question"),
        F.col("_section.note").alias("note"),
    )
