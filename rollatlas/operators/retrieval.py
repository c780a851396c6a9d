"""The best sections for a question inside one district, from an inverted index.

Scores are those of Okapi BM25 with its classic weight ``ln((N - df + 0.5) / (df + 0.5))`` of a term
that ``df`` of a district's ``N`` sections hold; a term that half of them or more hold weighs
nothing and is left out, so the longest posting lists are never joined. Each term's part of a score
is a whole number of millionths, so sums do not depend on their order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollatlas.functions.text import col
from rollatlas.operators.arrays import explode_costly
from rollatlas.operators.ranking import top_k

# How soon a repeated term counts no more, and how much a section's length does.
K1 = 1.2
B = 0.75
UNIT = 1_000_000
#: Terms of all questions together, up to which they are sent to every task (some 100 bytes each).
SENT = 200_000


def text_terms(text: Column | str) -> Column:
    """Lower-case words of letters and digits, in order, repeats included."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


@dataclass
class Index:
    #: (district, term, section_id, tf, size): a term's places, with the section's number of terms.
    postings: DataFrame
    #: (district, term, df): sections with the term.
    frequencies: DataFrame
    #: (district, sections, terms): sections of a district and their terms together.
    districts: DataFrame


def build_index(sections: DataFrame, text: str = "text") -> Index:
    """Index of sections(district, section_id, ...); section ids are unique within a district."""
    listed = sections.select("district", "section_id", text_terms(text).alias("_terms"))
    sized = listed.withColumn("size", F.size("_terms"))
    each = explode_costly(sized, ["district", "section_id", "size"], "_terms", "term")
    # Terms stay with their section: nothing more is shuffled until sections' scores are summed,
    # and rows that follow each other are alike, so they pack well.
    each = each.repartition("district", "section_id")
    postings = each.groupBy("district", "term", "section_id", "size").agg(F.count(F.lit(1)).alias("tf"))
    # Counted over tf, so that postings and frequencies of one plan are read from one shuffle.
    frequencies = postings.groupBy("district", "term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    districts = sized.groupBy("district").agg(F.count(F.lit(1)).alias("sections"), F.sum("size").alias("terms"))
    return Index(postings, frequencies, districts)


def write_index(index: Index, path: str) -> None:
    """Store an index; postings lie by district and term, so a question reads few row groups."""
    index.postings.repartitionByRange("district", "term", "section_id").sortWithinPartitions("district", "term").write.mode(
        "overwrite"
    ).parquet(f"{path}/postings")
    stored = index.postings.sparkSession.read.parquet(f"{path}/postings")
    frequencies = stored.groupBy("district", "term").agg(F.count(F.lit(1)).alias("df"))
    frequencies.write.mode("overwrite").parquet(f"{path}/frequencies")
    index.districts.write.mode("overwrite").parquet(f"{path}/districts")


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(*[spark.read.parquet(f"{path}/{name}") for name in ("postings", "frequencies", "districts")])


def term_part(tf: Column, df: Column, size: Column, sections: Column, terms: Column) -> Column:
    """A term's part of a section's score, in millionths."""
    rarity = F.log((sections - df + 0.5) / (df + 0.5))
    mean = terms.cast("double") / sections
    often = (tf * (K1 + 1.0)) / (tf + K1 * (F.lit(1.0 - B) + F.lit(B) * size / mean))
    return F.floor(rarity * often * float(UNIT)).cast("bigint")


def retrieve(index: Index, questions: DataFrame, k: int, text: str = "text") -> DataFrame:
    """(question_id, district, rank, section_id, score) of the ``k`` best sections for each row of
    questions(question_id, district, text), within its district; ties go to the smaller id.

    Sections that share no weighing term with the question are not listed. Only terms that are
    asked in a district are read: where the asked ones are at most ``SENT``, they are sent to every
    task, and an index that is not stored counts no other term and shuffles none. Rows are scored
    before they meet, and each task keeps no more than ``k`` sections of a question.
    """
    asked = explode_costly(questions, ["question_id", "district"], F.array_distinct(text_terms(text)), "term")
    sent = F.broadcast if asked.count() <= SENT else lambda df: df
    wanted = sent(asked.select("district", "term").distinct())
    weighing = sent(
        index.frequencies.join(wanted, ["district", "term"], "left_semi")
        .join(index.districts, "district")
        .filter(F.col("df") * 2 < F.col("sections"))
    )
    part = term_part(F.col("tf"), F.col("df"), F.col("size"), F.col("sections"), F.col("terms"))
    postings = index.postings.join(wanted, ["district", "term"], "left_semi")
    scored = postings.join(weighing, ["district", "term"]).select("district", "term", "section_id", part.alias("part"))
    met = scored.join(sent(asked), ["district", "term"])
    sums = met.groupBy("question_id", "district", "section_id").agg(F.sum("part").alias("score"))
    order = [F.desc("score"), F.col("section_id")]
    best = top_k(sums, ["question_id", "district"], order, k)
    rank = F.row_number().over(Window.partitionBy("question_id", "district").orderBy(*order))
    return best.select("question_id", "district", rank.alias("rank"), "section_id", "score")
