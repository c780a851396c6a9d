"""Missing coordinates from a gazetteer.

The gazetteer holds ranked candidates per query text, unique in (query, rank).
The outcome of the cascade depends on the address alone, so it runs on distinct
addresses and is joined back to the records.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollatlas.functions.coordinates import valid_for_ingest
from rollatlas.functions.numbers import parse_float
from rollatlas.functions.text import (
    count_values,
    has_value,
    join_values,
    normalize_street,
    present,
    street_only,
    trim_blanks,
)
from rollatlas.operators.arrays import explode_costly
from rollatlas.operators.ranking import first_per_key, top_k
from rollatlas.schema import NO_DATA

# The state of town queries, candidates asked for, and the worst score accepted.
HOME_STATE = "CA"
SEARCH_CAP = 5
SCORE_LIMIT = 60

# Street types that count as a road, and the score of each match.
ROAD_TYPES = (
    "residential", "primary", "secondary", "tertiary", "unclassified", "living_street", "road",
)
BASE_SCORE = 100
ROAD_SCORE = -50
HOUSE_SCORE = -25
AREA_SCORE = 50
SAME_NAME_SCORE = -30
PART_NAME_SCORE = -10
CITY_SCORE = -5

ADDRESS = ["street_address", "street_city", "street_state"]
# What geocoding reads of a record, and what it tells of it.
GEOCODE_INPUT = [*ADDRESS, "latitude", "longitude"]
GEOCODE_FLAGS = ["geocode_tried", "geocode_ok", "geocode_fallback"]
_CANDIDATE_FIELDS = ["rank", "lat", "lon", "display_name", "name", "class", "type"]


def candidate_score(candidate: Column, street: Column, city: Column) -> Column:
    """Lower is better."""
    kind, sort = candidate["class"], candidate["type"]
    name, shown = F.lower(candidate["name"]), F.lower(candidate["display_name"])
    by_kind = (
        F.when((kind == "highway") & sort.isin(*ROAD_TYPES), ROAD_SCORE)
        .when((kind == "place") & sort.isin("house", "building"), HOUSE_SCORE)
        .when(kind.isin("boundary", "place"), AREA_SCORE)
        .otherwise(0)
    )
    named = present(candidate["name"]) & present(street)
    by_name = (
        F.when(named & (name == F.lower(street)), SAME_NAME_SCORE)
        .when(named & name.contains(F.lower(street)), PART_NAME_SCORE)
        .otherwise(0)
    )
    in_city = present(candidate["display_name"]) & present(city) & shown.contains(F.lower(city))
    by_city = F.when(in_city, CITY_SCORE).otherwise(0)
    return F.lit(BASE_SCORE) + by_kind + by_name + by_city


def best_candidate(candidates: Column, street: Column, city: Column) -> Column:
    """Lowest score, earliest on ties; a single candidate is taken as it is."""
    scored = F.transform(
        candidates,
        lambda c: F.struct(
            candidate_score(c, street, city).alias("score"),
            c["rank"].alias("rank"),
            c["lat"].alias("lat"),
            c["lon"].alias("lon"),
        ),
    )
    best = F.array_min(scored)
    accepted = (F.size(candidates) == 1) | (best["score"] <= SCORE_LIMIT)
    return F.when(accepted, F.struct(best["lat"].alias("lat"), best["lon"].alias("lon")))


def attempts(addresses: DataFrame) -> DataFrame:
    """Distinct addresses to their queries, one row per level that applies."""
    street, city, state = (F.col(c) for c in ADDRESS)
    # Stored step by step: later texts use earlier ones several times.
    parts = addresses.select(
        *ADDRESS,
        normalize_street(street).alias("_norm"),
        trim_blanks(city).alias("_city"),
        trim_blanks(state).alias("_state"),
    ).withColumn("_only", street_only("_norm"))
    full, road = ("_norm", "_city", "_state"), ("_only", "_city", "_state")
    with_text = parts.withColumns(
        {
            "_raw": join_values(street, city, state),
            "_full": F.when(count_values(*full) >= 2, join_values(*full)).otherwise(""),
            "_road": F.when(present("_only") & has_value("_city"), join_values(*road)).otherwise(""),
            "_town": F.when(
                has_value("_city") & (F.col("_state") == HOME_STATE), F.concat_ws(", ", "_city", "_state")
            ).otherwise(""),
        }
    )

    def attempt(level: int, query: str, applies: Column) -> Column:
        return F.when(
            applies & (F.col(query) != ""),
            F.struct(F.lit(level).alias("level"), F.col(query).alias("query")),
        )

    levels = F.array_compact(
        F.array(
            attempt(1, "_raw", count_values(street, city, state) >= 2),
            attempt(2, "_full", F.col("_full") != F.col("_raw")),
            attempt(3, "_road", F.col("_road") != F.col("_full")),
            attempt(4, "_town", ~F.col("_town").isin([F.col(c) for c in ("_raw", "_full", "_road")])),
        )
    )
    target = [F.col("_only").alias("target_street"), F.col("_city").alias("target_city")]
    return explode_costly(with_text, [*ADDRESS, *target], levels, "attempt").select(*ADDRESS, "target_street", "target_city", "attempt.level", "attempt.query")


def top_candidates(gazetteer: DataFrame, cap: int = SEARCH_CAP) -> DataFrame:
    """Per query, the first ``cap`` candidates in rank order.

    Cut per task before the shuffle, so an array never holds more than ``cap`` items.
    """
    kept = top_k(gazetteer, ["query"], ["rank"], cap)
    item = F.struct(*_CANDIDATE_FIELDS)
    return kept.groupBy("query").agg(F.sort_array(F.collect_list(item)).alias("candidates"))


def attempt_results(tried: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Chosen candidate per attempt; attempts without usable coordinates are left out."""
    # Only what is asked for is ranked.
    asked = gazetteer.join(tried.select("query").distinct(), "query", "left_semi")
    found = tried.join(top_candidates(asked), ["query"], "inner")
    first = F.get("candidates", F.lit(0))
    picked = F.when(
        F.col("level") == 3,
        best_candidate(F.col("candidates"), F.col("target_street"), F.col("target_city")),
    ).otherwise(F.struct(first["lat"].alias("lat"), first["lon"].alias("lon")))
    read = found.select(*ADDRESS, "level", "query", picked.alias("_picked")).select(
        *ADDRESS, "level", "query",
        parse_float("_picked.lat").alias("lat"), parse_float("_picked.lon").alias("lon"),
    )
    # Empty text reads as null, so this also drops candidates without coordinates.
    return read.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def resolve_addresses(
    addresses: DataFrame, gazetteer: DataFrame
) -> DataFrame:
    """Lowest successful level per distinct address.

    Attempts do not affect each other, so trying in order equals trying all and
    keeping the lowest level.
    """
    results = attempt_results(attempts(addresses), gazetteer)
    best = results.groupBy(*ADDRESS).agg(
        F.min_by(F.struct("level", "lat", "lon"), "level").alias("_best")
    )
    return best.select(*ADDRESS, F.col("_best.level").alias("_level"),
                       F.col("_best.lat").alias("_lat"), F.col("_best.lon").alias("_lon"))


def needs_geocoding() -> Column:
    return ~valid_for_ingest("latitude", "longitude")


def _lacking(records: DataFrame) -> DataFrame:
    """Records that need coordinates, their address without nulls."""
    return records.filter(needs_geocoding()).withColumns({c: F.coalesce(c, F.lit("")) for c in ADDRESS})


def resolve_records(records: list[DataFrame], gazetteer: DataFrame) -> DataFrame:
    """Outcome of the cascade for the distinct addresses of all the tables that need one.

    One table of attempts, one pass over the gazetteer; ``geocode`` of each table reads it.
    """
    asked = reduce(DataFrame.unionByName, [_lacking(r).select(*ADDRESS) for r in records])
    return resolve_addresses(asked.distinct(), gazetteer)


def geocode(records: DataFrame, gazetteer: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """Repair records whose coordinates fail the strict rule; leave the others as they are.

    Adds geocode_level (0 untouched or failed), geocode_ok, geocode_fallback,
    geocode_tried and numeric lat / lon. A failure sets both texts to the sentinel.
    ``resolved`` is the result of ``resolve_records`` over these records and perhaps others.
    """
    good = records.filter(~needs_geocoding())
    found = resolve_records([records], gazetteer) if resolved is None else resolved
    joined = _lacking(records).join(found, ADDRESS, "left")
    hit = F.col("_level").isNotNull()
    repaired = joined.withColumns(
        {
            "latitude": F.when(hit, F.col("_lat").cast("string")).otherwise(NO_DATA),
            "longitude": F.when(hit, F.col("_lon").cast("string")).otherwise(NO_DATA),
            "geocode_level": F.coalesce("_level", F.lit(0)),
            "geocode_ok": hit,
            "geocode_fallback": F.coalesce(F.col("_level") > 1, F.lit(False)),
            "geocode_tried": F.lit(True),
            "lat": F.col("_lat"),
            "lon": F.col("_lon"),
        }
    ).drop("_level", "_lat", "_lon")
    untouched = good.withColumns(
        {
            "geocode_level": F.lit(0),
            "geocode_ok": F.lit(False),
            "geocode_fallback": F.lit(False),
            "geocode_tried": F.lit(False),
            "lat": parse_float("latitude"),
            "lon": parse_float("longitude"),
        }
    )
    return untouched.unionByName(repaired)


def records_of_kinds(columns: list[str], **tables: DataFrame) -> DataFrame:
    """Columns of several tables as one with their ``kind``; a text column that one lacks is null."""

    def tagged(kind: str, df: DataFrame) -> DataFrame:
        own = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]
        return df.select(F.lit(kind).alias("kind"), *own)

    return reduce(DataFrame.unionByName, [tagged(k, df) for k, df in tables.items()])


def geocode_report(records: DataFrame, entities: list[str]) -> DataFrame:
    """Attempted, successful and fallback-successful records for each kind (A3), in one pass."""
    found = {"tried": "geocode_tried", "successes": "geocode_ok", "fallback_successes": "geocode_fallback"}

    def counts(entity: str) -> Column:
        own = F.col("kind") == entity
        return F.struct(F.lit(entity).alias("entity"), *[F.count_if(own & F.col(c)).alias(n) for n, c in found.items()])

    one = records.agg(F.array(*[counts(e) for e in entities]).alias("_all"))
    return one.select(F.inline("_all"))


def fill_from_address(
    records: DataFrame, gazetteer: DataFrame, address: str,
) -> DataFrame:
    """Single-attempt fallback: first candidate for the address text.

    Expects numeric lat / lon, null where the record's own are not usable.
    """
    missing = F.col("lat").isNull() | F.col("lon").isNull()
    known, lacking = records.filter(~missing), records.filter(missing)
    first = first_per_key(gazetteer, ["query"], ["rank"]).select(
        F.col("query").alias(address),
        parse_float("lat").alias("_lat"),
        parse_float("lon").alias("_lon"),
    )
    first = first.filter(F.col("_lat").isNotNull() & F.col("_lon").isNotNull())
    found = lacking.join(first, [address], "left")
    filled = found.withColumn("lat", F.col("_lat")).withColumn("lon", F.col("_lon"))
    return known.unionByName(filled.drop("_lat", "_lon"))
