"""A school directory, a gazetteer and boundaries derived from the given tables.

The tables hold no schools, so districts are worked out from ``supplier``, schools
from ``customer`` and places from ``nation``. The expressions below are plain SQL
text that Spark and DuckDB read alike; ``k`` is the row's key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollatlas.schema import RAW_COLUMNS

BLANK = "''"

# Column types of the tables read here. Stating them saves a footer-reading job per read.
TABLES = {
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
}


def digits(expression: str, width: int) -> str:
    return f"lpad(concat('', {expression}), {width}, '0')"


STREET = """CASE WHEN k % 13 = 5 AND k % 2 = 0 THEN 'INFORMATION redacted - private'
  WHEN k % 13 = 5 THEN 'Information Redacted'
  WHEN k % 31 = 8 THEN ''
  WHEN k % 37 = 9 THEN 'No Data'
  WHEN k % 3 = 0 THEN concat(k % 90 + 1, ' First Street')
  WHEN k % 3 = 1 THEN concat(k % 90 + 1, ' seventh Ave')
  ELSE concat(k % 90 + 1, ' Oak Road') END"""
CITY = "CASE WHEN k % 41 = 10 THEN 'No Data' WHEN k % 43 = 11 THEN '' ELSE n END"
STATE = "CASE WHEN k % 8 = 7 THEN 'NV' WHEN k % 47 = 12 THEN '' ELSE 'CA' END"
LATITUDE = f"""CASE WHEN k % 23 = 6 THEN '33.25 (redacted)' WHEN k % 7 = 0 THEN '' WHEN k % 7 = 1 THEN 'No Data'
  WHEN k % 7 = 2 THEN '0' WHEN k % 7 = 3 THEN '37.5abc' ELSE concat(32 + k % 10, '.', {digits('k % 1000', 3)}) END"""
LONGITUDE = f"""CASE WHEN k % 61 = 4 THEN '-190.5' WHEN k % 7 = 0 THEN '' WHEN k % 7 = 1 THEN 'No Data'
  WHEN k % 7 = 2 THEN '0'
  ELSE concat('-', 114 + k % 10, '.', {digits('(k * 7) % 1000', 3)}) END"""
PLACE = {
    "street_address": STREET,
    "street_city": CITY,
    "street_state": STATE,
    "street_zip": f"CASE WHEN k % 67 = 13 THEN 'no data' ELSE {digits('90000 + k % 1000', 5)} END",
    "phone": f"CASE WHEN k % 53 = 3 THEN '' ELSE concat('(555) 555-', {digits('k % 10000', 4)}) END",
    "low_grade": "CASE k % 5 WHEN 0 THEN 'K' WHEN 1 THEN 'k' WHEN 2 THEN '' ELSE concat('', k % 6 + 1) END",
    "high_grade": "CASE k % 4 WHEN 0 THEN 'No Data' WHEN 1 THEN 'k' ELSE '12' END",
    "latitude": LATITUDE,
    "longitude": LONGITUDE,
    "county": "r",
}

# d is 1 for the repeated row some districts have.
DISTRICT = {
    **PLACE,
    "record_type": "CASE WHEN k % 9 = 0 THEN 'County Office' WHEN k % 17 = 16 THEN 'Other' ELSE 'District' END",
    "cds_code": f"CASE WHEN k % 19 = 7 THEN '' ELSE concat({digits('k', 7)}, '0000000') END",
    "district": """CASE WHEN k % 13 = 4 THEN 'No Data' WHEN k % 29 = 6 THEN '***' WHEN d = 1 THEN concat(s, ' Copy')
      WHEN k % 7 = 2 THEN concat(s, ' - Unified') ELSE s END""",
    "status": "CASE WHEN k % 20 = 13 AND d = 0 THEN 'Closed' WHEN k % 11 = 0 THEN 'Closed' WHEN k % 23 = 5 THEN 'Pending' ELSE 'Active' END",
    "website": """CASE k % 6 WHEN 0 THEN concat('www.', k, '.example.org') WHEN 1 THEN concat('http://d', k, '.example.org')
      WHEN 2 THEN 'No Data' WHEN 3 THEN '' WHEN 4 THEN concat('//d', k, '.example.org') ELSE '/local/path' END""",
    "entity_type": "CASE WHEN k % 12 = 1 THEN '' ELSE 'Unified School District' END",
    "funding_type": "CASE WHEN k % 10 = 1 THEN 'No Data' ELSE 'Directly funded' END",
}
SCHOOL = {
    **PLACE,
    "record_type": "'School'",
    "cds_code": f"""CASE WHEN k % 101 = 3 THEN '' WHEN k % 97 = 13 THEN '12345'
      ELSE concat({digits('CAST(floor(k / 12) AS BIGINT)', 7)}, {digits('k', 7)}) END""",
    "school": "CASE WHEN k % 71 = 4 THEN 'Homeschool' WHEN k % 73 = 5 THEN '' ELSE s END",
    "status": "CASE WHEN k % 10 = 9 THEN 'Closed' ELSE 'Active' END",
    "public_yes_no": "CASE k % 6 WHEN 0 THEN 'N' WHEN 1 THEN 'y' ELSE 'Y' END",
    "educational_program_type": "CASE WHEN k % 59 = 7 THEN 'HomeSchool' ELSE 'Traditional' END",
    "website": """CASE WHEN k % 12 = 5 THEN concat('www.srvusd.net/', k) WHEN k % 12 = 7 THEN concat('WWW.Srvusd.Net/', k)
      WHEN k % 6 = 0 THEN concat('www.', k, '.example.org') WHEN k % 6 = 2 THEN 'No Data' WHEN k % 6 = 3 THEN ''
      WHEN k % 6 = 4 THEN concat('https://s', k, '.example.org') ELSE '/local/path' END""",
}

# Streets the gazetteer knows by name within a nation, as the cascade writes them.
KNOWN_STREETS = ["1st Street", "7th Ave", "Oak Road"]
CANDIDATE_KIND = {
    "class": """CASE v WHEN 0 THEN 'highway' WHEN 1 THEN 'place' WHEN 2 THEN 'boundary' WHEN 3 THEN 'place'
      WHEN 4 THEN 'amenity' ELSE 'highway' END""",
    "type": """CASE v WHEN 0 THEN 'residential' WHEN 1 THEN 'house' WHEN 2 THEN 'administrative' WHEN 3 THEN 'city'
      WHEN 4 THEN 'school' ELSE 'service' END""",
}

# Texts the map looks up: address in map form, flat address, district name.
MAP_QUERIES = [
    "concat(street_address, ', ', street_city, ', ', street_state, ' ', street_zip)",
    "concat(street_address, ', ', street_city, ', ', street_state, ', ', street_zip)",
    "concat(district, ', California')",
]

# Guides and questions belong to one of 25 districts each; a third of the guides to one of them.
GUIDE_SITE = "https://guides.example.org"
DISTRICT_OF_GUIDE = "CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 25 END"
DISTRICT_OF_QUESTION = "item_id % 25"
ANSWERS = 5

# Slugs that pages are built from: some districts have none, some share one. Parameters also ask for
# pages that no district has.
PAGE_SLUG = "CASE WHEN ord % 26 = 4 THEN '' WHEN ord % 34 = 6 THEN 'shared-page' ELSE slug END"
LOST_SLUG = "concat('no-page-', n_nationkey)"

# Districts whose schools had no phone in an older version.
OLDER_DISTRICTS = "substr(district_cds, 6, 2) = '05'"

# Parts as a second table to search: many rows share a name.
PART_NAMES = {"cds_code": "concat('', p_partkey)", "district": "concat(p_name, ' ', p_type)", "slug": "concat('part-', p_partkey)",
              "status": "CASE WHEN p_size % 7 = 3 THEN 'Closed' ELSE 'Active' END"}
PART_TERMS = ["p_name", "upper(substr(p_name, 2, 4))", "substr(p_name, 3, 2)", "p_type", "concat(substr(p_name, 4), ' ', substr(p_type, 1, 4))"]

# Districts of the sample have at most twelve schools, so arrays of this size show a second chunk.
SCHOOLS_IN_ARRAY = 5

# Boundaries: x, y and side of the square drawn for key k, in web-mercator metres.
SQUARE_X = "(-13600000 + (k % 1000) * 1000 + d * 500)"
SQUARE_Y = "(3900000 + (k % 777) * 1000 + d * 500)"
SQUARE_SIDE = "(5000 + (k % 7) * 100)"


# Links of every kind that a page may hold besides root-relative ones, one kind a page. The last
# three lead to the page itself, so some targets exist.
MORE_LINKS = """CASE page_id % 9 WHEN 0 THEN '<a href="more/../list.html">l</a>' WHEN 1 THEN '<a href="./next page.html?q=\u00e9#\u00e8">n</a>'
  WHEN 2 THEN '<a href="//foreign.example.org/x">f</a>' WHEN 3 THEN '<a href="mailto:someone@example.org">m</a>'
  WHEN 4 THEN '<a href="https://foreign.example.net/a">f</a>' WHEN 5 THEN '<a href="?page=3#p">q</a>'
  WHEN 6 THEN '<a href="#part">p</a>' WHEN 7 THEN '<a href="">s</a>' ELSE concat('<a href="', url, '">u</a>') END"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def _with_place(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    nation = table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("n"), "n_regionkey")
    region = table(spark, folder, "region").select("r_regionkey", F.col("r_name").alias("r"))
    # nation and region have a fixed size (25 and 5 rows) at every scale.
    placed = rows.join(F.broadcast(nation), "n_nationkey")
    return placed.join(F.broadcast(region), placed["n_regionkey"] == region["r_regionkey"])


def _raw(rows: DataFrame, expressions: dict[str, str]) -> DataFrame:
    columns = [F.expr(expressions.get(c, BLANK)).alias(c) for c in RAW_COLUMNS]
    return rows.select("ord", *columns)


def raw_districts(spark: SparkSession, folder: str) -> DataFrame:
    supplier = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("k"), F.col("s_name").alias("s"), F.col("s_nationkey").alias("n_nationkey")
    )
    rows = _with_place(spark, folder, supplier).withColumn(
        "d", F.explode(F.expr("CASE WHEN k % 10 = 3 THEN array(0, 1) ELSE array(0) END"))
    )
    return _raw(rows.withColumn("ord", F.expr("k * 2 + d")), DISTRICT)


def raw_schools(spark: SparkSession, folder: str) -> DataFrame:
    customer = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("k"), F.col("c_name").alias("s"), F.col("c_nationkey").alias("n_nationkey")
    )
    rows = _with_place(spark, folder, customer)
    return _raw(rows.withColumn("ord", F.col("k")), SCHOOL)


def raw_directory(spark: SparkSession, folder: str) -> DataFrame:
    """Districts first, then schools, as in one export."""
    schools = raw_schools(spark, folder).withColumn("ord", F.col("ord") + F.lit(1 << 50))
    return raw_districts(spark, folder).unionByName(schools)


def gazetteer(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates per query: house numbers from ``supplier``, streets and towns from ``nation``."""
    supplier = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n_nationkey")
    )
    nation = table(spark, folder, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n"))
    house = _with_place(spark, folder, supplier).filter("k % 4 IN (0, 1) AND k % 13 <> 5 AND k % 31 <> 8 AND k % 37 <> 9")
    text = F.when(
        F.expr("k % 4 = 0"), F.expr(f"concat({STREET}, ', ', n, ', CA')")
    ).otherwise(
        F.expr(
            "concat(k % 90 + 1, ' ', CASE k % 3 WHEN 0 THEN '1st Street' WHEN 1 THEN '7th Ave' ELSE 'Oak Road' END, ', ', n, ', CA')"
        )
    )
    houses = (
        house.groupBy(text.alias("query")).agg(F.min("k").alias("k"))
        .select(
            "query", F.lit(1).alias("rank"),
            F.expr(f"CASE WHEN k % 11 = 4 THEN '' ELSE concat(33 + k % 8, '.', {digits('k % 1000', 3)}) END").alias("lat"),
            F.expr(f"concat('-', 115 + k % 8, '.', {digits('k % 1000', 3)})").alias("lon"),
            F.col("query").alias("display_name"), F.lit("").alias("name"),
            F.lit("place").alias("class"), F.lit("house").alias("type"),
        )
    )
    streets = (
        nation.withColumn("j", F.explode(F.array(*[F.lit(i) for i in range(len(KNOWN_STREETS))])))
        .withColumn("st", F.element_at(F.array(*[F.lit(s) for s in KNOWN_STREETS]), F.col("j") + 1))
        .withColumn("found", (F.col("k") + F.col("j")) % 8)
        .filter("found > 0")
        .withColumn("rank", F.explode(F.sequence(F.lit(1), F.col("found"))))
        .withColumn("v", (F.col("k") * 3 + F.col("j") + F.col("rank")) % 6)
        .select(
            F.expr("concat(st, ', ', n, ', CA')").alias("query"), F.col("rank").cast("int").alias("rank"),
            F.expr(f"CASE WHEN (k + rank) % 11 = 0 THEN '' ELSE concat(34 + rank, '.', {digits('k * 10 + j', 3)}) END").alias("lat"),
            F.expr(f"concat('-', 116 + rank, '.', {digits('k * 10 + j', 3)})").alias("lon"),
            F.expr("concat(CASE WHEN rank % 2 = 0 THEN concat(st, ', ', n) ELSE 'Somewhere' END, ', California')").alias("display_name"),
            F.expr("CASE rank % 3 WHEN 0 THEN st WHEN 1 THEN concat('Old ', st) ELSE '' END").alias("name"),
            F.expr(CANDIDATE_KIND["class"]).alias("class"), F.expr(CANDIDATE_KIND["type"]).alias("type"),
        )
    )
    towns = nation.filter("k % 5 <> 4").select(
        F.expr("concat(n, ', CA')").alias("query"), F.lit(1).alias("rank"),
        F.expr(f"CASE WHEN k % 7 = 3 THEN 'unknown' ELSE concat(36, '.', {digits('k', 3)}) END").alias("lat"),
        F.expr(f"concat('-119.', {digits('k', 3)})").alias("lon"),
        F.expr("concat(n, ', California')").alias("display_name"), F.col("n").alias("name"),
        F.lit("place").alias("class"), F.lit("city").alias("type"),
    )
    return houses.unionByName(streets).unionByName(towns)


def map_gazetteer(spark: SparkSession, folder: str) -> DataFrame:
    """First candidate for the full addresses and the names of some districts."""
    known = raw_districts(spark, folder).filter("ord % 2 = 0")
    rows = known.withColumn("k", F.expr("CAST(ord / 2 AS BIGINT)")).filter("k % 3 <> 1")
    asked = rows.select("k", F.explode(F.array(*[F.expr(q) for q in MAP_QUERIES])).alias("query"))
    return asked.groupBy("query").agg(F.min("k").alias("k")).select(
        "query", F.lit(1).alias("rank"),
        F.expr(f"concat(35 + k % 3, '.', {digits('k % 1000', 3)})").alias("lat"),
        F.expr(f"concat('-', 117 + k % 3, '.', {digits('k % 1000', 3)})").alias("lon"),
    )


def boundary_features(spark: SparkSession, folder: str) -> DataFrame:
    """features(pos, feature): a square per supplier, every fifth with a second one."""
    rows = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("k")).withColumn(
        "d", F.explode(F.expr("CASE WHEN k % 27 = 4 THEN array(0, 1) ELSE array(0) END"))
    )
    placed = (
        rows.withColumn("x", F.expr(SQUARE_X)).withColumn("y", F.expr(SQUARE_Y)).withColumn("w", F.expr(SQUARE_SIDE))
    )

    def ring(shift: int) -> str:
        corners = [("0", "0"), ("w", "0"), ("w", "w"), ("0", "w"), ("0", "0")]
        points = ", ',', ".join(f"'[', x + {shift} + {a}, ',', y + {b}, ']'" for a, b in corners)
        return f"concat('[', {points}, ']')"

    geometry = f"""CASE WHEN k % 50 = 49 THEN concat('{{"type":"Point","coordinates":[', x, ',', y, ']}}')
      WHEN k % 5 = 0 THEN concat('{{"type":"MultiPolygon","coordinates":[[', {ring(0)}, '],[', {ring(20000)}, ']]}}')
      ELSE concat('{{"type":"Polygon","coordinates":[', {ring(0)}, ']}}') END"""
    code = f"concat({digits('k', 7)}, '0000000')"
    properties = f"""CASE WHEN k % 16 = 3 THEN '{{"note":"none"}}'
      WHEN k % 33 = 1 THEN concat('{{"CDSCode":"', {code}, '/A"}}')
      ELSE concat('{{"CDSCode":"', {code}, '"}}') END"""
    feature = F.concat(
        F.lit('{"type":"Feature","properties":'), F.expr(properties), F.lit(',"geometry":'), F.expr(geometry), F.lit("}")
    )
    return placed.select(F.expr("k * 2 + d").alias("pos"), feature.alias("feature"))


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """The given pages with one more link each."""
    return table(spark, folder, "pages").withColumn("html", F.expr(f"concat(html, {MORE_LINKS})"))


def guides(documents: DataFrame) -> DataFrame:
    """Documents as Markdown guides: each line's first sentence becomes a heading.

    Markdown marks a line already starts with are taken off first.
    """
    plain = F.regexp_replace("text", r"(?md)^[#>~` ]+", "")
    text = F.regexp_replace(
        plain, r"(?md)^([^.\n]+)\.([^\n]*)$", "## $1\nAsk:$2\n\n> **Why this is important:** $1\n"
    )
    # Depth by first letter, so that outlines leave some headings out.
    text = F.regexp_replace(F.regexp_replace(text, r"(?m)^## (?=[A-E])", "# "), r"(?m)^## (?=T)", "### ")
    return documents.select("doc_id", text.alias("text"))


def page_districts(districts: DataFrame) -> DataFrame:
    return districts.withColumn("slug", F.expr(PAGE_SLUG))


def lost_params(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select(F.expr(LOST_SLUG).alias("districtSlug"))


def part_names(spark: SparkSession, folder: str) -> DataFrame:
    columns = [F.expr(e).alias(c) for c, e in PART_NAMES.items()]
    return table(spark, folder, "part").select(F.col("p_partkey").alias("ord"), *columns)


def write_export(spark: SparkSession, folder: str, path: str, files: int = 3) -> str:
    """The raw records as CSV files with a preamble each, blank lines and blank records between
    records. The path that names the files."""
    quoted = [
        F.concat(F.lit('" '), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) if c == "district"
        else F.concat(F.lit(" "), F.col(c), F.lit(" ")) for c in RAW_COLUMNS
    ]
    lines = raw_directory(spark, folder).select("ord", F.concat_ws(",", *quoted).alias("line"), (F.col("ord") % files).alias("file"))
    first = F.row_number().over(Window.partitionBy("file").orderBy("ord")) == 1
    known = "School,77,,,,,,,Active" + "," * (len(RAW_COLUMNS) - 9)
    preamble = "\n".join([",".join(RAW_COLUMNS), known, "", known]) + "\n"
    blank = "\n" + '" "' + ", ," * ((len(RAW_COLUMNS) - 1) // 2) + "\n"
    text = F.concat(F.when(first, preamble).otherwise(F.when(F.col("ord") % 7 == 0, blank + "\n").otherwise("")), "line")
    lines.select("file", text.alias("value"), "ord").repartition("file").sortWithinPartitions("file", "ord").drop("ord").write.partitionBy(
        "file"
    ).text(path)
    return f"{path}/file=*/part-*"
