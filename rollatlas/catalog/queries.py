"""Registered queries: each reads the whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollatlas.catalog import sample as S
from rollatlas.functions import coordinates as K
from rollatlas.functions import display as D
from rollatlas.functions import text as X
from rollatlas.functions.numbers import parse_float
from rollatlas.operators import cleaning, geocode, geometry, linking, links, outline, ranking, retrieval, search, sections
from rollatlas.plans import build, maps, pages, quality
from rollatlas.schema import DISTRICT_COLUMNS, RAW_COLUMNS, SCHOOL_COLUMNS
from rollatlas.session import tune, work_folder
from rollatlas.sources import assets, directory, geojson, manifest

Query = Callable[[SparkSession, str], DataFrame]
ZOOMS = [6, 9, 12]
SEARCH_TERM = "UNIFIED"

_REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(tune(spark), folder)

    _REGISTRY[fn.__name__] = run
    return fn


def registry() -> dict[str, Query]:
    return dict(_REGISTRY)


# Building blocks ---------------------------------------------------------------


class Tables:
    """Clean tables of one query run, as plans; nothing runs before the query does."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @cached_property
    def gazetteer(self) -> DataFrame:
        return S.gazetteer(self.spark, self.folder)

    @cached_property
    def districts(self) -> DataFrame:
        return _districts(self.spark, self.folder)

    @cached_property
    def schools(self) -> DataFrame:
        return _schools(self.spark, self.folder)

    @cached_property
    def placed_districts(self) -> DataFrame:
        return geocode.geocode(self.districts, self.gazetteer)

    @cached_property
    def placed_schools(self) -> DataFrame:
        return geocode.geocode(self.schools, self.gazetteer)

    @cached_property
    def placed_kinds(self) -> DataFrame:
        """Districts and schools geocoded as one table, for counts over both."""
        both = geocode.records_of_kinds(["slug", *geocode.GEOCODE_INPUT], districts=self.districts, schools=self.schools)
        return geocode.geocode(both, self.gazetteer)

    @cached_property
    def resolved(self) -> DataFrame:
        """Outcome for the addresses of both, for plans that need both tables whole."""
        return geocode.resolve_records([self.districts, self.schools], self.gazetteer)

    def placed_both(self) -> tuple[DataFrame, DataFrame]:
        """Geocoded districts, and geocoded schools that have a district."""
        schools = geocode.geocode(self.schools, self.gazetteer, self.resolved)
        return geocode.geocode(self.districts, self.gazetteer, self.resolved), linking.linked_schools(schools, self.districts)

    @cached_property
    def linked(self) -> DataFrame:
        return linking.linked_schools(self.schools, self.districts)

    @cached_property
    def placed_linked(self) -> DataFrame:
        placed = self.placed_schools
        return linking.linked_schools(placed, self.districts)


def _districts(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.district_rows(S.raw_districts(spark, folder))


def _schools(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.school_rows(S.raw_schools(spark, folder))


def _features(spark: SparkSession, folder: str) -> DataFrame:
    return geometry.parse_features(S.boundary_features(spark, folder))


def _boundaries(spark: SparkSession, folder: str) -> DataFrame:
    return geometry.boundary_rows(_features(spark, folder))


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return S.pages(spark, folder)


def _guides(spark: SparkSession, folder: str) -> DataFrame:
    return S.guides(S.table(spark, folder, "documents"))


def _round_all(df: DataFrame, columns: list[str], places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# Scans, filters, clean tables ----------------------------------------------------


@query
def directory_lines(spark, folder):
    """CSV lines to raw records."""
    quoted = [F.concat(F.lit('" '), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) if c == "district"
              else F.concat(F.lit(" "), F.col(c), F.lit(" ")) for c in RAW_COLUMNS]
    lines = S.raw_directory(spark, folder).select("ord", F.concat_ws(",", *quoted).alias("line"))
    return directory.parse_lines(lines)


@query
def directory_districts(spark, folder):
    """Clean districts with slug."""
    return _districts(spark, folder).select("ord", *DISTRICT_COLUMNS, "slug")


@query
def directory_schools(spark, folder):
    """Clean schools."""
    return _schools(spark, folder).select("ord", *SCHOOL_COLUMNS)


@query
def reject_report(spark, folder):
    """Records per skip reason (A4)."""
    return cleaning.reject_report(S.raw_directory(spark, folder))


@query
def coordinate_checks(spark, folder):
    """The three validity rules on raw coordinate texts."""
    raw = S.raw_directory(spark, folder)
    return raw.select(
        "ord",
        parse_float("latitude").alias("lat"),
        parse_float("longitude").alias("lon"),
        K.valid_for_ingest("latitude", "longitude").alias("ingest_ok"),
        K.valid_for_display("latitude", "longitude").alias("display_ok"),
        K.valid_for_map("latitude", "longitude").alias("map_ok"),
    )


@query
def district_map_rows(spark, folder):
    """Districts under the export's headers."""
    return assets.district_map(_districts(spark, folder))


@query
def schools_by_district(spark, folder):
    """School arrays per district in bounded chunks (A1, S7), arrays shown as code lists."""
    chunks = assets.schools_by_district(Tables(spark, folder).linked, S.SCHOOLS_IN_ARRAY)
    codes = F.array_join(F.transform("schools", lambda s: s["CDS Code"]), ",")
    return chunks.select("district_cds", "chunk", "n", codes.alias("codes"))


@query
def page_params(spark, folder):
    """Slug of every page."""
    return assets.page_params(S.page_districts(_districts(spark, folder)))


# Joins and counts ------------------------------------------------------------------


@query
def school_counts(spark, folder):
    """Flagship: every district with its number of public active schools."""
    counted = linking.school_counts(_schools(spark, folder), _districts(spark, folder))
    return counted.select("cds_code", "district", "slug", "school_count")


@query
def school_links(spark, folder):
    """Link status of every school."""
    t = Tables(spark, folder)
    status = linking.link_status(t.schools, t.districts)
    return status.select("ord", "cds_code", "district_cds", "link_status")


@query
def link_sample(spark, folder):
    """First five schools with their link status, for inspection."""
    t = Tables(spark, folder)
    status = linking.link_status(t.schools, t.districts)
    return ranking.first_rows(status, ["ord"], 5).select("ord", "cds_code", "district_cds", "link_status")


@query
def orphan_schools(spark, folder):
    """Schools without a district, with the reason."""
    t = Tables(spark, folder)
    orphans = linking.orphan_schools(t.schools, t.districts)
    return orphans.select("ord", "cds_code", "school", "link_status")


@query
def strict_school_list(spark, folder):
    """Strict school list in name order."""
    return linking.strict_school_list(Tables(spark, folder).linked).select("district_cds", "cds_code", "school", "ord")


@query
def strict_school_links(spark, folder):
    """Link line and flat address of every school."""
    return pages.school_links(_schools(spark, folder))


# Geocoding --------------------------------------------------------------------------


@query
def geocode_attempts(spark, folder):
    """Queries per distinct address."""
    addresses = _schools(spark, folder).select(*geocode.ADDRESS).distinct()
    return geocode.attempts(addresses)


@query
def geocode_candidates(spark, folder):
    """Candidate chosen per attempt."""
    t = Tables(spark, folder)
    tried = geocode.attempts(_schools(spark, folder).select(*geocode.ADDRESS).distinct())
    return geocode.attempt_results(tried, t.gazetteer)


@query
def geocode_districts(spark, folder):
    """Districts after the cascade."""
    return Tables(spark, folder).placed_districts.select(
        "ord", "cds_code", "lat", "lon", "geocode_level", "geocode_ok", "geocode_fallback", "geocode_tried"
    )


@query
def geocode_schools(spark, folder):
    """Schools after the cascade."""
    return Tables(spark, folder).placed_schools.select(
        "ord", "cds_code", "lat", "lon", "geocode_level", "geocode_ok", "geocode_fallback", "geocode_tried"
    )


@query
def geocode_report(spark, folder):
    """Outcome counts for districts and schools (A3)."""
    return geocode.geocode_report(Tables(spark, folder).placed_kinds, quality.KINDS)


@query
def office_points(spark, folder):
    """Office point per district, address looked up where needed."""
    offices = maps.district_offices(Tables(spark, folder).placed_districts, S.map_gazetteer(spark, folder))
    return offices.select("cds_code", "address", "lat", "lon")


# Scalars -----------------------------------------------------------------------------


@query
def street_names(spark, folder):
    """Street normalisation and street-only text."""
    raw = S.raw_directory(spark, folder)
    norm = X.normalize_street("street_address")
    return raw.select("ord", norm.alias("normalized"), X.street_only(norm).alias("street_only"))


@query
def slugs(spark, folder):
    """Slug, district key, file key of every record."""
    raw = S.raw_directory(spark, folder)
    name = F.when(F.col("record_type") == "School", F.col("school")).otherwise(F.col("district"))
    return raw.select(
        "ord", X.slug(name, "cds_code").alias("slug"), X.district_key("cds_code").alias("district_cds"),
        X.sanitize_key(name).alias("file_key"),
    )


@query
def addresses(spark, folder):
    """The three address forms."""
    raw = S.raw_directory(spark, folder)
    return raw.select(
        "ord",
        D.address_line(*pages.STREET).alias("canonical"),
        D.address_for_map(*pages.STREET).alias("map_form"),
        D.address_flat(*pages.STREET).alias("flat_form"),
    )


@query
def websites(spark, folder):
    """Website target and usable website."""
    raw = S.raw_directory(spark, folder)
    return raw.select("ord", D.website_href("website").alias("href"), D.website_usable("website").alias("usable"))


@query
def grade_spans(spark, folder):
    """Grade range in all styles."""
    raw = S.raw_directory(spark, folder)
    return raw.select(
        "ord", *[D.grade_span("low_grade", "high_grade", s).alias(s) for s in ("district", "school", "popup", "list")]
    )


@query
def profile_links(spark, folder):
    """Profile addresses, page path, marker link."""
    d = _districts(spark, folder)
    return d.select(
        "cds_code",
        D.district_dashboard("cds_code").alias("dashboard"),
        D.directory_profile("cds_code").alias("profile"),
        D.year_report("cds_code").alias("year_report"),
        D.page_path("slug", "/base/").alias("path"),
        D.marker_link("slug", "cds_code", "/base/").alias("marker_link"),
    )


@query
def page_trails(spark, folder):
    """Breadcrumb entries of every page."""
    trail = D.breadcrumbs(D.page_trail("district"), "/base")
    listed = _districts(spark, folder).select("cds_code", F.posexplode(trail).alias("position", "crumb"))
    return listed.select("cds_code", "position", "crumb.text", "crumb.href")


@query
def page_metadata(spark, folder):
    """Title and description by precedence."""
    p = S.table(spark, folder, "part")
    front = F.when(
        F.col("p_partkey") % 3 == 0,
        F.struct(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("title"), F.col("p_type").alias("description")),
    )
    own_title = F.when(F.col("p_partkey") % 5 == 0, F.lit("")).otherwise(F.col("p_brand"))
    shown = p.select(
        "p_partkey",
        D.page_metadata(front, own_title, F.lit(None).cast("string"), "Site", "Site text").alias("m"),
    )
    return shown.select("p_partkey", "m.title", "m.description")


@query
def district_details(spark, folder):
    """Label and value rows of every district."""
    return pages.district_details(_districts(spark, folder))


# Search --------------------------------------------------------------------------------


@query
def search_top10(spark, folder):
    """First ten active districts whose name contains the term."""
    found = search.search_districts(_districts(spark, folder), SEARCH_TERM)
    return found.select("cds_code", "district", "slug", "path")


@query
def search_terms(spark, folder):
    """Top ten per term for all terms taken from the supplier names."""
    supplier = S.table(spark, folder, "supplier")
    parts = F.array(
        F.substring("s_name", 16, 3), F.substring("s_name", 17, 2), F.substring("s_name", 18, 1),
        F.concat(F.substring("s_name", 14, 5), F.lit(" - UNI")), F.substring("s_name", 1, 9),
    )
    terms = supplier.select(F.explode(parts).alias("term"))
    return search.search_many(Tables(spark, folder).districts, terms)


@query
def search_parts(spark, folder):
    """Top ten per term over part names, which repeat and share all their pieces."""
    parts = S.table(spark, folder, "part")
    terms = parts.select(F.explode(F.array(*[F.expr(t) for t in S.PART_TERMS])).alias("term"))
    return search.search_many(S.part_names(spark, folder), terms)


# Boundaries and maps ---------------------------------------------------------------------


@query
def feature_collections(spark, folder):
    """FeatureCollection documents to features."""
    documents = S.boundary_features(spark, folder).select(
        F.col("pos").alias("ord"),
        F.concat(F.lit('{"type":"FeatureCollection","features":['), F.col("feature"), F.lit("]}")).alias("document"),
    )
    parsed = geometry.parse_features(geojson.explode_collections(documents))
    return parsed.select(
        F.col("pos.ord").alias("pos"), "boundary_id", "geom_type",
        geometry.vertex_count("polygons").alias("vertices"),
    )


@query
def boundary_vertices(spark, folder):
    """Reprojected vertices of every boundary."""
    b = _boundaries(spark, folder)
    points = b.select(
        "boundary_key", "reprojected", F.posexplode(F.flatten(F.flatten("polygons"))).alias("vertex", "p")
    )
    return points.select(
        "boundary_key", "reprojected", "vertex",
        F.round(F.col("p")[0], 6).alias("lon"), F.round(F.col("p")[1], 6).alias("lat"),
    )


@query
def boundary_boxes(spark, folder):
    """Bounding box per boundary."""
    b = _boundaries(spark, folder).select("boundary_key", geometry.extent("polygons").alias("box"))
    return _round_all(b.select("boundary_key", "box.*"), geometry.BOX_FIELDS)


@query
def district_markers(spark, folder):
    """District markers with their link."""
    return maps.district_markers(Tables(spark, folder).placed_districts)


@query
def office_markers(spark, folder):
    """District offices with popup text (P5)."""
    return maps.office_markers(Tables(spark, folder).placed_districts, S.map_gazetteer(spark, folder))


@query
def unplaced_districts(spark, folder):
    """Districts left off the map (F13, anti side)."""
    return maps.unplaced_districts(Tables(spark, folder).placed_districts)


@query
def district_marker_cells(spark, folder):
    """Clustered district markers."""
    return maps.district_marker_layer(Tables(spark, folder).placed_districts, ZOOMS)


@query
def school_markers(spark, folder):
    """School markers with popup text."""
    return maps.school_markers(Tables(spark, folder).placed_linked)


@query
def school_marker_cells(spark, folder):
    """Clustered school markers per district."""
    return maps.school_marker_layer(Tables(spark, folder).placed_linked, ZOOMS)


@query
def district_map_view(spark, folder):
    """First view of every district map."""
    t = Tables(spark, folder)
    view = maps.district_map_view(*t.placed_both(), _boundaries(spark, folder), S.map_gazetteer(spark, folder))
    return _round_all(view, geometry.BOX_FIELDS)


@query
def card_map_view(spark, folder):
    """First view of the older card map (P5, second policy)."""
    t = Tables(spark, folder)
    view = maps.card_map_view(t.placed_districts, _boundaries(spark, folder), S.map_gazetteer(spark, folder))
    return _round_all(view, geometry.BOX_FIELDS)


@query
def overview_map_view(spark, folder):
    """First view of the older overview map (P5, third policy)."""
    t = Tables(spark, folder)
    view = maps.overview_map_view(*t.placed_both(), _boundaries(spark, folder), S.map_gazetteer(spark, folder))
    return _round_all(view, geometry.BOX_FIELDS)


# Pages -----------------------------------------------------------------------------------


def _wanted_pages(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Parameters, and districts under their page's slug."""
    homes = S.page_districts(t.districts)
    return assets.page_params(homes).unionByName(S.lost_params(t.spark, t.folder)), homes


@query
def district_pages(spark, folder):
    """Every district page, flat."""
    t = Tables(spark, folder)
    return pages.district_pages(*_wanted_pages(t), t.linked).drop("breadcrumbs")


@query
def page_schools(spark, folder):
    """Schools on every page."""
    t = Tables(spark, folder)
    return pages.page_schools(*_wanted_pages(t), t.linked)


@query
def page_school_chunks(spark, folder):
    """School arrays per page in bounded chunks (P3), arrays shown as code lists."""
    t = Tables(spark, folder)
    params, homes = _wanted_pages(t)
    schools = pages.page_schools(params.distinct(), homes, t.linked)
    chunks = pages.page_school_chunks(schools, S.SCHOOLS_IN_ARRAY)
    codes = F.array_join(F.transform("schools", lambda s: s["cds_code"]), ",")
    return chunks.select("slug", "chunk", "n", codes.alias("codes"))


# Links, outlines, reports --------------------------------------------------------------


@query
def internal_links(spark, folder):
    """Distinct same-origin links of every page."""
    return links.internal_links(_pages(spark, folder))


@query
def broken_links(spark, folder):
    """Internal links without a page behind them."""
    p = _pages(spark, folder)
    return links.broken_links(links.internal_links(p), p)


@query
def broken_targets(spark, folder):
    """Missing targets by number of linking pages."""
    p = _pages(spark, folder)
    return links.broken_targets(links.internal_links(p), p)


@query
def page_link_counts(spark, folder):
    """Internal links per page, at least one expected."""
    return links.page_link_counts(_pages(spark, folder))


@query
def guide_outline(spark, folder):
    """Numbered depth-2 headings with their anchor and note."""
    listed = outline.guide_outline(_guides(spark, folder))
    return listed.select("doc_id", "number", "text", "anchor", "question", "note")


@query
def guide_headings(spark, folder):
    """Headings of every guide with unique anchors."""
    return outline.guide_headings(_guides(spark, folder)).select("doc_id", "pos", "depth", "slug", "text")


@query
def guide_sections(spark, folder):
    """Sections of every guide with their id, text and source address (V3)."""
    return sections.guide_sections(_guides(spark, folder), S.GUIDE_SITE)


@query
def section_answers(spark, folder):
    """The five best sections for every question inside its district (V4)."""
    listed = sections.guide_sections(_guides(spark, folder), S.GUIDE_SITE)
    text = F.concat_ws(" ", "title", "body")
    filed = listed.select(F.expr(S.DISTRICT_OF_GUIDE).alias("district"), "section_id", text.alias("text"))
    asked = S.table(spark, folder, "benchmark").select(
        F.col("item_id").alias("question_id"), F.expr(S.DISTRICT_OF_QUESTION).alias("district"), "text"
    )
    return retrieval.retrieve(retrieval.build_index(filed), asked, S.ANSWERS)


@query
def boundary_totals(spark, folder):
    """Feature counts of the boundary build (A5)."""
    f = _features(spark, folder)
    return quality.boundary_totals(f, geometry.boundary_rows(f))


@query
def quality_report(spark, folder):
    """All counts of a directory build (P10: A3, A4, A5, J2)."""
    t = Tables(spark, folder)
    status = linking.link_status(t.schools, t.districts)
    return quality.quality_report(S.raw_directory(spark, folder), t.placed_kinds, status)


# Builds: written below the shared folder and read back -----------------------------------


@query
def exported_records(spark, folder):
    """Records of CSV files with preambles, blank lines and blank records."""
    files = S.write_export(spark, folder, work_folder(spark, "export"))
    return directory.read_directory(spark, files).select(*RAW_COLUMNS)


@query
def built_districts(spark, folder):
    """Districts, schools and page parameters of a directory build."""
    out = work_folder(spark, "directory")
    raw, gazetteer = S.raw_directory(spark, folder), S.gazetteer(spark, folder)
    if not build.build_directory(raw, gazetteer, out) or build.build_directory(raw, gazetteer, out):
        raise RuntimeError("a build works once, and not again where its outputs are")
    districts = assets.read_districts(spark, f"{out}/districts")
    counts = assets.read_schools(spark, f"{out}/schools").groupBy(F.col("district_cds").alias("cds_code")).agg(
        F.count(F.lit(1)).alias("schools"), F.count_if("geocode_ok").alias("repaired_schools")
    )
    params = assets.read_page_params(spark, f"{out}/page_params").select(F.col("districtSlug").alias("slug"), F.lit(True).alias("page"))
    return districts.join(counts, "cds_code", "left").join(params, "slug", "left").select(
        "cds_code", "slug", "lat", "lon", "geocode_level", F.coalesce("schools", F.lit(0)).alias("schools"),
        F.coalesce("repaired_schools", F.lit(0)).alias("repaired_schools"), F.coalesce("page", F.lit(False)).alias("page"),
    )


@query
def built_boundaries(spark, folder):
    """Features written by key and read back as JSON."""
    out = work_folder(spark, "boundaries")
    build.build_boundaries(S.boundary_features(spark, folder), out, buckets=16)
    stored = spark.read.schema("boundary_key string, feature string").json(f"{out}/boundary_features")
    parsed = geometry.parse_features(stored.withColumn("pos", F.col("boundary_key")))
    boxed = parsed.select(
        F.col("pos").alias("boundary_key"), "geom_type", geometry.vertex_count("polygons").alias("vertices"),
        geometry.extent("polygons").alias("box"),
    )
    return _round_all(boxed.select("boundary_key", "geom_type", "vertices", "box.*"), geometry.BOX_FIELDS)


@query
def district_folders(spark, folder):
    """Linked schools kept district by district, an update, and what the manifest lists (V1, V2)."""
    out = work_folder(spark, "districts")
    linked = Tables(spark, folder).linked.select("district_cds", "ord", "cds_code", "school", "phone")
    older = linked.withColumn("phone", F.when(F.expr(S.OLDER_DISTRICTS), "").otherwise(F.col("phone")))
    for version in (older, linked):
        manifest.write_districts(version, out, "district_cds")
    now = manifest.read_listed(spark, out, schema=linked.schema)
    phones = now.groupBy("district_cds").agg(F.count(F.lit(1)).alias("schools"), F.max("phone").alias("last_phone"))
    key = F.regexp_extract("file", "district_cds=([^/]*)/", 1)
    listed = manifest.manifest(spark, out).groupBy(key.alias("district_cds")).agg(F.sum("rows").alias("listed"))
    return phones.join(listed, "district_cds")
