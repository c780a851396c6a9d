"""District search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollatlas.functions.display import page_path
from rollatlas.functions.text import col
from rollatlas.operators.arrays import explode_costly
from rollatlas.operators.ranking import top_k
from rollatlas.schema import ACTIVE

RESULT_LIMIT = 10
GRAM = 3


def locale_key(name: Column | str) -> Column:
    """Root-locale order: letters before case, accents next to their letter."""
    return F.collate(F.coalesce(col(name), F.lit("")), "UNICODE")


def search_districts(
    districts: DataFrame, term: str, k: int = RESULT_LIMIT, base: str = "/"
) -> DataFrame:
    """Active districts whose name contains the term, name order, first k."""
    wanted = term.lower()
    hits = districts.filter(F.col("status") == ACTIVE)
    if wanted:
        hits = hits.filter(F.contains(F.lower("district"), F.lit(wanted)))
    else:
        hits = hits.filter(F.lit(False))
    ranked = hits.orderBy(locale_key("district"), "ord").limit(k)
    return ranked.withColumn("path", page_path("slug", base))


def _pieces(text: Column, size: Column) -> Column:
    """(piece, at) for every place of a text, from 1."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    cut = F.transform(starts, lambda i: F.struct(F.substr(text, i, size).alias("piece"), i.alias("at")))
    return F.when(F.length(text) >= size, cut).otherwise(F.array().cast("array<struct<piece:string,at:int>>"))


def search_many(
    districts: DataFrame, terms: DataFrame, k: int = RESULT_LIMIT, base: str = "/",
) -> DataFrame:
    """Search for every row of ``terms(term)`` at once.

    A term has an anchor: its rarest three-letter piece, the piece's place in it, and its length.
    Where a name holds the piece, the anchor tells which stretch of the name the term would have to
    be, so names meet the different anchors, which are few however many terms share a piece, and
    the stretches then meet the terms in a join on the whole text.

    Different names are searched, each with its place in name order as a whole number. The first
    ``k`` names of a stretch are taken before the stretches meet the texts, in each task before
    they are sent on, so a term that most names hold costs no more than another. Rows come in
    last: the first ``k`` rows of a text have some of its first ``k`` names, by name and first row.
    """
    active = districts.filter(F.col("status") == ACTIVE).select("ord", "cds_code", "district", "slug")
    wanted = terms.select("term", F.lower("term").alias("_text")).distinct().filter(F.col("_text") != "")
    # A null ord comes first, as in the order of rows.
    different = active.filter(F.col("district") != "").groupBy("district").agg(F.min(F.struct("ord")).alias("_first"))
    # Ids rise with the sorted partitions and within them. A few bytes of a name make many pieces,
    # so names lie in as many partitions as a shuffle has, however few bytes they are.
    spread = int(districts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [locale_key("district"), F.col("_first"), F.col("district")]
    placed_names = different.repartitionByRange(spread, *order).sortWithinPartitions(*order).select(
        "district", F.lower("district").alias("_name"), F.monotonically_increasing_id().alias("_place")
    )

    sizes = F.array(*[F.lit(n) for n in range(1, GRAM + 1)])
    pieces = F.flatten(F.transform(sizes, lambda n: _pieces(F.col("_name"), n)))
    kept = ["_place", "district", "_name"]
    postings = explode_costly(placed_names, kept, pieces, "_piece").select(*kept, "_piece.*")

    size = F.least(F.length("_text"), F.lit(GRAM))
    own = explode_costly(wanted.select("_text").distinct(), ["_text"], _pieces(F.col("_text"), size), "_piece")
    frequency = postings.groupBy("piece").agg(F.count(F.lit(1)).alias("_names"))
    # A piece no name has rules its term out: count it as zero and let it win.
    weighed = own.select("_text", "_piece.*").join(frequency, "piece", "left")
    rarest = weighed.groupBy("_text").agg(
        F.min_by(F.struct("piece", F.col("at").alias("_in")), F.struct(F.coalesce("_names", F.lit(0)), "piece", "at")).alias("_anchor")
    )
    anchors = rarest.select("_anchor.*", F.length("_text").alias("_length")).distinct()
    start = F.col("at") - F.col("_in") + 1
    placed = postings.join(anchors, "piece").filter((start >= 1) & (start + F.col("_length") - 1 <= F.length("_name")))
    stretches = placed.select("_place", "district", F.substr("_name", start, F.col("_length")).alias("_text"))
    # A name may hold a stretch several times: its places are one rank.
    first = F.dense_rank().over(Window.partitionBy("_text").orderBy("_place"))
    leading = stretches.withColumn("_rank", first).filter(F.col("_rank") <= k).select("_text", "district").distinct()
    hits = leading.join(wanted.select("_text"), "_text", "left_semi")

    nth = F.dense_rank().over(Window.partitionBy("district").orderBy("ord", "cds_code", "slug"))
    rows = active.withColumn("_rank", nth).filter(F.col("_rank") <= k).drop("_rank").distinct()
    best = top_k(rows.join(hits, "district"), ["_text"], [locale_key("district"), F.col("ord")], k)
    return best.join(wanted, "_text").select("term", "cds_code", "district", "slug", page_path("slug", base).alias("path"))
