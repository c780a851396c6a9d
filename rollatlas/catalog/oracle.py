"""DuckDB SQL that states each registered query's result on the same tables."""

from __future__ import annotations

import re

from rollatlas.catalog import sample as S
from rollatlas.catalog.queries import SEARCH_TERM, ZOOMS
from rollatlas.schema import DISTRICT_COLUMNS, HEADER_OF, RAW_COLUMNS, SCHOOL_COLUMNS

NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


# SQL text helpers -----------------------------------------------------------------


def hv(x: str) -> str:
    return f"({x} IS NOT NULL AND {x} NOT IN ('', 'No Data'))"


def joined(*parts: str, sep: str = ", ") -> str:
    return f"concat_ws('{sep}', " + ", ".join(f"CASE WHEN {hv(p)} THEN {p} END" for p in parts) + ")"


def stated(*parts: str) -> str:
    return "(" + " + ".join(f"CAST({hv(p)} AS INTEGER)" for p in parts) + ")"


def number(x: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract({x}, '{NUMBER}', 1), '') AS DOUBLE)"


def bounded(lat: str, lon: str) -> str:
    return f"coalesce({lat} BETWEEN -90 AND 90 AND {lon} BETWEEN -180 AND 180, false)"


def slug(name: str, code: str) -> str:
    clean = f"lower({name})"
    for pattern, new in ((r"\s+", "-"), ("[^-a-z0-9]", ""), ("-+", "-"), ("^-|-$", "")):
        clean = f"regexp_replace({clean}, '{pattern}', '{new}', 'g')"
    return f"CASE WHEN {hv(name)} AND {code} <> '' AND {clean} <> '' THEN {clean} || '-' || {code} ELSE {code} END"


def street(x: str) -> str:
    out = f"trim({x})"
    words = "first second third fourth fifth sixth seventh eighth ninth tenth".split()
    for i, word in enumerate(words, 1):
        suffix = {1: "st", 2: "nd", 3: "rd"}.get(i, "th")
        out = rf"regexp_replace({out}, '(?i)\b{word}\b', '{i}{suffix}', 'g')"
    return f"CASE WHEN {x} <> '' THEN {out} END"


def address_line(s: str, c: str, st: str, z: str) -> str:
    def part(x: str) -> str:
        return f"CASE WHEN lower({x}) <> 'no data' AND trim({x}) <> '' THEN trim({x}) END"

    region = f"nullif(concat_ws(' ', {part(st)}, {part(z)}), '')"
    return f"coalesce(nullif(concat_ws(', ', {part(s)}, {part(c)}, {region}), ''), 'Address Not Available')"


def address_map(s: str, c: str, st: str, z: str) -> str:
    kept = f"list_filter([{s}, {c}, {st}, {z}], lambda p: p IS NOT NULL AND p NOT IN ('', 'No Data'))"
    return f"""CASE WHEN len({kept}) >= 3
      THEN trim({kept}[1] || ', ' || {kept}[2] || ', ' || {kept}[3] || ' ' || coalesce({kept}[4], ''))
      WHEN len({kept}) = 2 THEN {kept}[1] || ', ' || {kept}[2]
      WHEN len({kept}) = 1 THEN {kept}[1] ELSE 'Address Not Available' END"""


def href(x: str) -> str:
    return f"""CASE WHEN NOT {hv(x)} THEN 'Website Not Available'
      WHEN contains(trim({x}), '.') AND trim({x}) NOT LIKE 'http%' AND trim({x}) NOT LIKE '//%' THEN '//' || trim({x})
      ELSE trim({x}) END"""


def usable(x: str) -> str:
    return f"CASE WHEN {hv(x)} AND (({href(x)}) LIKE 'http%' OR ({href(x)}) LIKE '//%') THEN {href(x)} END"


def grades(style: str, low: str = "low_grade", high: str = "high_grade") -> str:
    both = f"{hv(low)} AND {hv(high)}"
    span = f"{low} || ' - ' || {high}"
    if style == "district":
        return f"CASE WHEN {both} THEN {span} ELSE 'N/A' END"
    if style == "school":
        return f"CASE WHEN {both} THEN '(' || {span} || ')' ELSE '' END"
    if style == "list":
        return f"CASE WHEN {both} THEN '(Grades: ' || {span} || ')' ELSE '' END"
    cap = [f"CASE WHEN upper({g}) = 'K' THEN 'K' ELSE {g} END" for g in (low, high)]
    return f"CASE WHEN {both} THEN 'Grades: ' || {cap[0]} || ' - ' || {cap[1]} ELSE 'Grades: N/A' END"


def default(x: str, text: str) -> str:
    return f"coalesce(nullif({x}, ''), '{text}')"


SITE = f"CASE WHEN website <> 'No Data' THEN {href('website')} ELSE 'Website Not Available' END"
STREET = ("street_address", "street_city", "street_state", "street_zip")
ADDRESS = "street_address, street_city, street_state"
PAGE_SCHOOL = "status = 'Active' AND upper(trim(public_yes_no)) = 'Y'"
DASH = "https://www.caschooldashboard.org/reports/"
CDE = "https://www.cde.ca.gov/schooldirectory/details?cdscode="


def cells(lat: str, lon: str, zoom: str) -> tuple[str, str]:
    width = f"(256.0::DOUBLE * pow(2.0::DOUBLE, {zoom}))"
    kept = f"greatest(least({lat}, 85.0511287798::DOUBLE), -85.0511287798::DOUBLE)"
    sine = f"sin(radians({kept}))"
    share = f"(0.5::DOUBLE - ln((1.0::DOUBLE + {sine}) / (1.0::DOUBLE - {sine})) / (4.0::DOUBLE * pi()))"
    return (
        f"CAST(floor(({lon} + 180.0::DOUBLE) / 360.0::DOUBLE * {width} / 80.0::DOUBLE) AS BIGINT)",
        f"CAST(floor({share} * {width} / 80.0::DOUBLE) AS BIGINT)",
    )


def exact_avg(x: str) -> str:
    return f"CAST(sum(CAST(round({x} * 10000000) AS BIGINT)) AS DOUBLE) / count({x}) / 10000000.0::DOUBLE"


# Named tables, each in terms of earlier ones -----------------------------------------


def _raw(expressions: dict[str, str], source: str, ord_expression: str) -> str:
    columns = ", ".join(f"{expressions.get(c, S.BLANK)} AS {c}" for c in RAW_COLUMNS)
    return f"SELECT {ord_expression} AS ord, {columns} FROM {source}"


def _accepted(source: str) -> str:
    return f"""SELECT * FROM {source} WHERE cds_code <> '' AND status = 'Active'
      AND NOT contains(lower(street_address), 'information redacted')"""


def _attempts(addresses: str) -> str:
    return f"""
    WITH n AS (SELECT {ADDRESS}, {street('street_address')} AS norm, trim(street_city) AS city, trim(street_state) AS state
               FROM (SELECT DISTINCT {ADDRESS} FROM {addresses})),
    o AS (SELECT *, trim(regexp_replace(norm, '^\\d+\\s+', '')) AS only_street FROM n),
    q AS (SELECT *, {joined('street_address', 'street_city', 'street_state')} AS raw_text,
            {stated('street_address', 'street_city', 'street_state')} AS raw_parts,
            CASE WHEN {stated('norm', 'city', 'state')} >= 2 THEN {joined('norm', 'city', 'state')} ELSE '' END AS full_text,
            CASE WHEN coalesce(only_street, '') <> '' AND {hv('city')} THEN {joined('only_street', 'city', 'state')} ELSE '' END AS road_text,
            CASE WHEN {hv('city')} AND state = 'CA' THEN city || ', CA' ELSE '' END AS town_text FROM o)
    SELECT {ADDRESS}, only_street AS target_street, city AS target_city, 1 AS level, raw_text AS query FROM q WHERE raw_parts >= 2
    UNION ALL SELECT {ADDRESS}, only_street, city, 2, full_text FROM q WHERE full_text <> '' AND full_text <> raw_text
    UNION ALL SELECT {ADDRESS}, only_street, city, 3, road_text FROM q WHERE road_text <> '' AND road_text <> full_text
    UNION ALL SELECT {ADDRESS}, only_street, city, 4, town_text FROM q
      WHERE town_text <> '' AND town_text NOT IN (raw_text, full_text, road_text)"""


def _results(attempts: str) -> str:
    return f"""
    WITH m AS (SELECT a.*, g.rank, g.lat AS lat_text, g.lon AS lon_text,
        count(*) OVER (PARTITION BY {ADDRESS}, level) AS found,
        100 + CASE WHEN g.class = 'highway' AND g.type IN ('residential','primary','secondary','tertiary','unclassified','living_street','road') THEN -50
                   WHEN g.class = 'place' AND g.type IN ('house','building') THEN -25
                   WHEN g.class IN ('boundary','place') THEN 50 ELSE 0 END
            + CASE WHEN coalesce(g.name, '') = '' OR coalesce(target_street, '') = '' THEN 0
                   WHEN lower(g.name) = lower(target_street) THEN -30
                   WHEN contains(lower(g.name), lower(target_street)) THEN -10 ELSE 0 END
            + CASE WHEN target_city <> '' AND contains(lower(g.display_name), lower(target_city)) THEN -5 ELSE 0 END AS score
      FROM {attempts} a JOIN gaz g ON g.query = a.query AND g.rank <= 5),
    p AS (SELECT *, row_number() OVER (PARTITION BY {ADDRESS}, level ORDER BY CASE WHEN level = 3 THEN score ELSE 0 END, rank) AS pick FROM m)
    SELECT {ADDRESS}, level, query, {number('lat_text')} AS lat, {number('lon_text')} AS lon FROM p
    WHERE pick = 1 AND (level <> 3 OR found = 1 OR score <= 60)
      AND {number('lat_text')} IS NOT NULL AND {number('lon_text')} IS NOT NULL"""


def _placed(records: str, results: str) -> str:
    lat, lon = number("latitude"), number("longitude")
    ok = f"({bounded(lat, lon)} AND coalesce({lat} <> 0 AND {lon} <> 0, false))"
    return f"""
    WITH best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {ADDRESS} ORDER BY level) AS pos FROM {results}) WHERE pos = 1),
    r AS (SELECT *, NOT {ok} AS tried FROM {records})
    SELECT r.* EXCLUDE (tried), r.tried AS geocode_tried,
      CASE WHEN r.tried THEN coalesce(b.level, 0) ELSE 0 END AS geocode_level,
      r.tried AND b.level IS NOT NULL AS geocode_ok,
      r.tried AND coalesce(b.level > 1, false) AS geocode_fallback,
      CASE WHEN r.tried THEN b.lat ELSE {lat} END AS lat,
      CASE WHEN r.tried THEN b.lon ELSE {lon} END AS lon
    FROM r LEFT JOIN best b ON r.tried AND r.street_address = b.street_address
      AND r.street_city = b.street_city AND r.street_state = b.street_state"""


def _houses() -> str:
    text = f"""CASE WHEN k % 4 = 0 THEN concat({S.STREET}, ', ', n, ', CA')
      ELSE concat(k % 90 + 1, ' ', CASE k % 3 WHEN 0 THEN '1st Street' WHEN 1 THEN '7th Ave' ELSE 'Oak Road' END, ', ', n, ', CA') END"""
    return f"""SELECT query, 1 AS rank,
        CASE WHEN k % 11 = 4 THEN '' ELSE concat(33 + k % 8, '.', {S.digits('k % 1000', 3)}) END AS lat,
        concat('-', 115 + k % 8, '.', {S.digits('k % 1000', 3)}) AS lon,
        query AS display_name, '' AS name, 'place' AS class, 'house' AS type
      FROM (SELECT {text} AS query, min(k) AS k FROM supplier_in
            WHERE k % 4 IN (0, 1) AND k % 13 <> 5 AND k % 31 <> 8 AND k % 37 <> 9 GROUP BY 1)"""


def _streets() -> str:
    listed = ", ".join(f"({i}, '{s}')" for i, s in enumerate(S.KNOWN_STREETS))
    return f"""SELECT concat(st, ', ', n, ', CA') AS query, rank,
        CASE WHEN (k + rank) % 11 = 0 THEN '' ELSE concat(34 + rank, '.', {S.digits('k * 10 + j', 3)}) END AS lat,
        concat('-', 116 + rank, '.', {S.digits('k * 10 + j', 3)}) AS lon,
        concat(CASE WHEN rank % 2 = 0 THEN concat(st, ', ', n) ELSE 'Somewhere' END, ', California') AS display_name,
        CASE rank % 3 WHEN 0 THEN st WHEN 1 THEN concat('Old ', st) ELSE '' END AS name,
        {S.CANDIDATE_KIND['class']} AS class, {S.CANDIDATE_KIND['type']} AS type
      FROM (SELECT *, (k * 3 + j + rank) % 6 AS v FROM (
        SELECT n_nationkey AS k, n_name AS n, j, st, unnest(range(1, (n_nationkey + j) % 8 + 1)) AS rank
        FROM nation, (VALUES {listed}) t(j, st)))"""


def _towns() -> str:
    return f"""SELECT concat(n, ', CA') AS query, 1 AS rank,
        CASE WHEN k % 7 = 3 THEN 'unknown' ELSE concat(36, '.', {S.digits('k', 3)}) END AS lat,
        concat('-119.', {S.digits('k', 3)}) AS lon, concat(n, ', California') AS display_name, n AS name,
        'place' AS class, 'city' AS type
      FROM (SELECT n_nationkey AS k, n_name AS n FROM nation) WHERE k % 5 <> 4"""


PLACED_NATION = "JOIN nation ON n_nationkey = {key} JOIN region ON n_regionkey = r_regionkey"
ORIGIN = "regexp_extract(url, '^(https?://[^/?#]*)', 1)"

# Parts of an address behind its origin.
PATH = "regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)"
QUERY = "regexp_extract(url, '^[^?#]*([?][^#]*)', 1)"
FRAGMENT = "regexp_extract(url, '(#.*)$', 1)"
NO_FRAGMENT = "''"


def dots_folded(path: str) -> str:
    """``.`` segments go, ``..`` segments take the one before them along."""
    return f"regexp_replace(regexp_replace({path}, '/[.]/', '/', 'g'), '/[^/]+/[.][.]/', '/', 'g')"


def percent_encoded(origin: str, path: str, query: str, fragment: str) -> str:
    """An address of its parts. Blanks, controls and non-ASCII are percent-encoded everywhere;
    of the other characters those that the URL standard names for each part."""

    def part(text: str, unsafe: str) -> str:
        unsafe = unsafe.replace("'", "''")
        one = f"CASE WHEN regexp_matches(c, '[^!-~]|[{unsafe}]') THEN url_encode(c) ELSE c END"
        return f"array_to_string(list_transform(regexp_extract_all({text}, '(?s).'), lambda c: {one}), '')"

    path, query, fragment = part(path, '"<>`{}'), part(query, "\"<>'"), part(fragment, '"<>`')
    return f"{origin} || coalesce(nullif({path}, ''), '/') || {query} || {fragment}"


TABLES: dict[str, str] = {
    "supplier_in": f"SELECT s_suppkey AS k, s_name AS s, n_name AS n, r_name AS r FROM supplier {PLACED_NATION.format(key='s_nationkey')}",
    "customer_in": f"SELECT c_custkey AS k, c_name AS s, n_name AS n, r_name AS r FROM customer {PLACED_NATION.format(key='c_nationkey')}",
    "district_in": "SELECT *, unnest(CASE WHEN k % 10 = 3 THEN [0, 1] ELSE [0] END) AS d FROM supplier_in",
    "raw_d": _raw(S.DISTRICT, "district_in", "k * 2 + d"),
    "raw_s": _raw(S.SCHOOL, "customer_in", "k"),
    "raw": "SELECT * FROM raw_d UNION ALL SELECT * REPLACE (ord + 1125899906842624 AS ord) FROM raw_s",
    "districts": f"""SELECT *, {slug('district', 'cds_code')} AS slug FROM (
        SELECT *, row_number() OVER (PARTITION BY cds_code ORDER BY ord) AS pos FROM ({_accepted('raw_d')})
        WHERE record_type IN ('District', 'County Office')) WHERE pos = 1""",
    "schools": f"""SELECT * REPLACE (CASE WHEN {hv('website')} THEN
        CASE WHEN contains(lower(website), 'srvusd.net') AND lower(trim(website)) LIKE 'www.%' THEN substr(trim(website), 5)
        ELSE trim(website) END ELSE website END AS website)
        FROM ({_accepted('raw_s')}) WHERE record_type = 'School'""",
    "links": """SELECT s.*, substr(s.cds_code, 1, 7) || '0000000' AS district_cds,
        CASE WHEN length(substr(s.cds_code, 1, 7)) <> 7 THEN 'bad_prefix' WHEN d.cds_code IS NULL THEN 'no_district'
        ELSE 'linked' END AS link_status
        FROM schools s LEFT JOIN districts d ON d.cds_code = substr(s.cds_code, 1, 7) || '0000000'""",
    "linked": "SELECT * FROM links WHERE link_status = 'linked'",
    "gaz": f"{_houses()} UNION ALL {_streets()} UNION ALL {_towns()}",
    "attempts_d": _attempts("districts"),
    "attempts_s": _attempts("schools"),
    "results_d": _results("attempts_d"),
    "results_s": _results("attempts_s"),
    "placed_d": _placed("districts", "results_d"),
    "placed_s": _placed("schools", "results_s"),
    "map_gaz": f"""SELECT query, concat(35 + k % 3, '.', {S.digits('k % 1000', 3)}) AS lat,
        concat('-', 117 + k % 3, '.', {S.digits('k % 1000', 3)}) AS lon FROM (
        SELECT query, min(k) AS k FROM (SELECT k, unnest([{', '.join(S.MAP_QUERIES)}]) AS query
          FROM (SELECT *, CAST(ord / 2 AS BIGINT) AS k FROM raw_d WHERE ord % 2 = 0) WHERE k % 3 <> 1) GROUP BY 1)""",
    "offices": f"""SELECT p.cds_code, p.district, p.address,
        CASE WHEN p.ok THEN p.lat WHEN p.address <> 'Address Not Available' THEN {number('g.lat')} END AS lat,
        CASE WHEN p.ok THEN p.lon WHEN p.address <> 'Address Not Available' THEN {number('g.lon')} END AS lon
        FROM (SELECT *, {address_map(*STREET)} AS address, {bounded('lat', 'lon')} AS ok FROM placed_d) p
        LEFT JOIN map_gaz g ON g.query = p.address""",
    "features": f"""SELECT k * 2 + d AS pos, k, d, {S.SQUARE_X} AS x, {S.SQUARE_Y} AS y, {S.SQUARE_SIDE} AS w,
        CASE WHEN k % 50 = 49 THEN 'Point' WHEN k % 5 = 0 THEN 'MultiPolygon' ELSE 'Polygon' END AS geom_type,
        CASE WHEN k % 16 = 3 THEN NULL WHEN k % 33 = 1 THEN {S.digits('k', 7)} || '0000000/A'
          ELSE {S.digits('k', 7)} || '0000000' END AS boundary_id
        FROM (SELECT s_suppkey AS k, unnest(CASE WHEN s_suppkey % 27 = 4 THEN [0, 1] ELSE [0] END) AS d FROM supplier)""",
    "kept_features": """SELECT *, regexp_replace(boundary_id, '[^a-zA-Z0-9_-]', '_', 'g') AS boundary_key FROM features
        WHERE boundary_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY regexp_replace(boundary_id, '[^a-zA-Z0-9_-]', '_', 'g') ORDER BY pos DESC) = 1""",
    "vertices": """SELECT boundary_key, geom_type <> 'Point' AS reprojected, i AS vertex,
        CASE WHEN geom_type = 'Point' THEN px ELSE degrees(px / 6378137.0::DOUBLE) END AS lon,
        CASE WHEN geom_type = 'Point' THEN py ELSE degrees(2 * atan(exp(py / 6378137.0::DOUBLE)) - pi() / 2) END AS lat
        FROM (SELECT *, CAST(x + (i // 5) * 20000 + CASE WHEN i % 5 IN (1, 2) THEN w ELSE 0 END AS DOUBLE) AS px,
                     CAST(y + CASE WHEN i % 5 IN (2, 3) THEN w ELSE 0 END AS DOUBLE) AS py
              FROM (SELECT *, unnest(range(CASE geom_type WHEN 'Point' THEN 1 WHEN 'Polygon' THEN 5 ELSE 10 END)) AS i FROM kept_features))""",
    "boxes": "SELECT boundary_key, min(lat) AS min_lat, min(lon) AS min_lon, max(lat) AS max_lat, max(lon) AS max_lon FROM vertices GROUP BY 1",
    "school_points": f"""SELECT l.district_cds, l.ord, l.cds_code, p.lat, p.lon,
        '<b>' || {default('l.school', 'Unknown School')} || '</b><br>' || {address_map(*[f'l.{c}' for c in STREET])} || '<br>' ||
        {grades('popup', 'l.low_grade', 'l.high_grade')} AS popup
        FROM linked l JOIN placed_s p ON p.ord = l.ord
        WHERE l.status = 'Active' AND upper(trim(l.public_yes_no)) = 'Y' AND {bounded('p.lat', 'p.lon')}""",
    "page_homes": f"""SELECT *, row_number() OVER (PARTITION BY slug ORDER BY ord) AS first_of FROM (SELECT * REPLACE ({S.PAGE_SLUG} AS slug) FROM districts)""",
    "page_wanted": f"SELECT slug FROM page_homes WHERE slug <> '' UNION ALL SELECT {S.LOST_SLUG} FROM nation",
    "page_rows": f"SELECT * FROM linked WHERE {PAGE_SCHOOL}",
    "page_list": f"""SELECT d.slug, s.ord, s.cds_code, {default('s.school', 'Unknown School')} AS name,
        {grades('school', 's.low_grade', 's.high_grade')} AS grades, {address_line(*[f's.{c}' for c in STREET])} AS address,
        {SITE.replace('website', 's.website')} AS website, '{DASH}gissearch/schools/' || s.cds_code AS dashboard_url,
        '{CDE}' || s.cds_code AS profile_url
        FROM page_rows s JOIN page_homes d ON d.cds_code = s.district_cds AND first_of = 1""",
    "page_bases": f"""SELECT page_id, html || {S.MORE_LINKS} AS html, regexp_replace(url, '#.*$', '') AS page,
        regexp_replace(url, '[?#].*$', '') AS bare, {ORIGIN} AS origin, regexp_extract(url, '^(https?:)', 1) AS scheme FROM pages""",
    "page_hrefs": """SELECT page_id, origin, CASE WHEN h LIKE '//%' THEN scheme || h WHEN h LIKE '/%' THEN origin || h
          WHEN h = '' THEN page WHEN h LIKE '#%' THEN page || h WHEN h LIKE '?%' THEN bare || h
          WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h ELSE regexp_replace(bare, '[^/]*$', '') || h END AS url
        FROM (SELECT *, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h FROM page_bases)""",
    "page_links": f"""SELECT DISTINCT page_id, {percent_encoded(ORIGIN, dots_folded(PATH), QUERY, FRAGMENT)} AS link
        FROM page_hrefs WHERE {ORIGIN} = origin""",
    "known_urls": f"SELECT DISTINCT {percent_encoded(ORIGIN, PATH, QUERY, NO_FRAGMENT)} AS url FROM pages",
    "section_lines": r"""SELECT doc_id, i, line, regexp_matches(line, '^[^.]+\..*$') AS heads,
        sum(CASE WHEN regexp_matches(line, '^[^.]+\..*$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS number
        FROM (SELECT doc_id, i, regexp_replace(raw_line, '^[#>~` ]+', '') AS line FROM (
          SELECT doc_id, unnest(string_split(text, chr(10))) AS raw_line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))""",
    "section_bodies": r"""SELECT doc_id, number, trim(regexp_replace(string_agg(CASE WHEN heads THEN
          'Ask:' || regexp_extract(line, '^[^.]+\.(.*)$', 1) || ' > **Why this is important:** ' || regexp_extract(line, '^([^.]+)\.', 1)
          ELSE line END, ' ' ORDER BY i), '\s+', ' ', 'g')) AS body FROM section_lines WHERE number > 0 GROUP BY 1, 2""",
    "guide_lines": r"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS number,
        trim(regexp_extract(line, '^([^.]+)\.', 1)) AS text,
        trim('Ask:' || regexp_extract(line, '^[^.]+\.(.*)$', 1)) AS question
        FROM (SELECT doc_id, i, regexp_replace(raw_line, '^[#>~` ]+', '') AS line FROM (
          SELECT doc_id, unnest(string_split(text, chr(10))) AS raw_line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))
        WHERE regexp_matches(line, '^[^.]+\..*$')""",
    "guide_anchors": r"""SELECT doc_id, number - 1 AS pos, text, question,
        CASE WHEN regexp_matches(text, '^[A-E]') THEN 1 WHEN text LIKE 'T%' THEN 3 ELSE 2 END AS depth,
        replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}\p{Pc}\- ]', '', 'g'), ' ', '-') AS anchor FROM guide_lines""",
    "guide_slugs": r"""SELECT *, CASE WHEN seen = 1 THEN anchor ELSE anchor || '-' || (seen - 1) END AS slug
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, anchor ORDER BY pos) AS seen FROM guide_anchors) x""",
    "sections": f"""SELECT s.doc_id, pos, concat(s.doc_id, '#', slug) AS section_id, s.text AS title, body,
        concat('{S.GUIDE_SITE}/guides/', s.doc_id, '#', url_encode(slug)) AS source_url
        FROM guide_slugs s JOIN section_bodies b ON b.doc_id = s.doc_id AND b.number = s.pos + 1""",
    "filed": f"""SELECT {S.DISTRICT_OF_GUIDE} AS district, section_id,
        regexp_extract_all(lower(title || ' ' || body), '[\\p{{L}}\\p{{N}}]+') AS terms FROM sections""",
    "postings": "SELECT district, term, section_id, len(terms) AS size, count(*) AS tf FROM (SELECT *, unnest(terms) AS term FROM filed) GROUP BY ALL",
    "weighing": """SELECT * FROM (SELECT district, term, count(*) AS df FROM postings GROUP BY ALL)
        JOIN (SELECT district, count(*) AS sections, sum(len(terms)) AS terms FROM filed GROUP BY ALL) USING (district) WHERE 2 * df < sections""",
    "asked": f"""SELECT DISTINCT question_id, district, term FROM (SELECT item_id AS question_id, {S.DISTRICT_OF_QUESTION} AS district,
        unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM benchmark)""",
    "answers": f"""SELECT question_id, district, section_id, CAST(sum(CAST(floor(ln((sections - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))
          * ((tf * (1.2::DOUBLE + 1.0)) / (tf + 1.2::DOUBLE * (1.0::DOUBLE - 0.75 + 0.75::DOUBLE * size / (terms::DOUBLE / sections)))) * 1000000.0::DOUBLE) AS BIGINT)) AS BIGINT) AS score
        FROM asked JOIN postings USING (district, term) JOIN weighing USING (district, term) GROUP BY 1, 2, 3""",
}


def with_tables(body: str) -> str:
    """Prefix ``body`` with the named tables it needs, in order."""
    names = list(TABLES)
    needed: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name in names:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN|,)\s*\(?\s*{name}\b", text):
                needed.add(name)
                todo.append(TABLES[name])
    ctes = [f"{name} AS ({TABLES[name]})" for name in names if name in needed]
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


def _quality() -> str:
    def counts(table: str, section: str, **metrics: str) -> str:
        return " UNION ALL ".join(
            f"SELECT '{section}' AS section, '{m}' AS metric, CAST({e} AS BIGINT) AS value FROM {table}" for m, e in metrics.items()
        )

    geocoded = {"tried": "count_if(geocode_tried)", "successes": "count_if(geocode_ok)", "fallback_successes": "count_if(geocode_fallback)"}
    return " UNION ALL ".join(
        [
            f"SELECT 'rejects' AS section, reject_reason AS metric, records AS value FROM ({REJECTS}) x",
            counts("placed_d", "geocode_districts", **geocoded),
            counts("placed_s", "geocode_schools", **geocoded),
            counts("raw", "totals", records="count(*)"),
            counts("placed_d", "totals", districts="count(*)", slugs="count_if(slug <> '')", valid_markers=f"count_if({bounded('lat', 'lon')})"),
            counts("links", "totals", schools="count(*)", linked_schools="count_if(link_status = 'linked')",
                   bad_prefix="count_if(link_status = 'bad_prefix')", no_district="count_if(link_status = 'no_district')"),
        ]
    )


REJECTS = """SELECT CASE WHEN cds_code = '' THEN 'missing_key' WHEN status <> 'Active' THEN 'status'
    WHEN contains(lower(street_address), 'information redacted') THEN 'redacted'
    WHEN record_type NOT IN ('District', 'County Office', 'School') THEN 'record_type' ELSE 'kept' END AS reject_reason,
    count(*) AS records FROM raw GROUP BY 1"""
GEO_COLUMNS = "ord, cds_code, lat, lon, geocode_level, geocode_ok, geocode_fallback, geocode_tried"
RAW_NAME = "CASE WHEN record_type = 'School' THEN school ELSE district END"
LAT, LON = number("latitude"), number("longitude")
OWN = "(box_s IS NOT NULL OR box_o IS NOT NULL)"


def _details() -> str:
    entries = [
        ("County", "county"), ("Type", "entity_type"), ("Status", "status"), ("Funding Type", "funding_type"),
        ("Address", joined(*STREET)), ("Grade Span", f"CASE WHEN {hv('low_grade')} AND {hv('high_grade')} THEN low_grade || ' - ' || high_grade END"),
        ("Phone", "phone"), ("Website", "website"),
    ]
    rows = " UNION ALL ".join(
        f"SELECT cds_code, {i} AS i, '{label}' AS label, {expression} AS value FROM districts" for i, (label, expression) in enumerate(entries)
    )
    return f"""SELECT cds_code, CAST(row_number() OVER (PARTITION BY cds_code ORDER BY i) - 1 AS INTEGER) AS position, label, value
        FROM ({rows}) x WHERE {hv('value')}"""


def _cluster(table: str, keys: str) -> str:
    x, y = cells("lat", "lon", "zoom")
    group = ", ".join([*([keys] if keys else []), "zoom", "cell_x", "cell_y"])
    return f"""SELECT {group}, count(*) AS points, {exact_avg('lat')} AS lat, {exact_avg('lon')} AS lon
        FROM (SELECT *, {x} AS cell_x, {y} AS cell_y FROM (SELECT *, unnest({ZOOMS}) AS zoom FROM {table}) z) c GROUP BY {group}"""


def _map_view() -> str:
    box = {f: f"CASE WHEN {OWN} THEN {'least' if f.startswith('min') else 'greatest'}(b.{f}, o.{'lat' if f.endswith('lat') else 'lon'}, s.{f}) ELSE s.{f} END"
           for f in ("min_lat", "min_lon", "max_lat", "max_lon")}
    shown = ", ".join(f"round({e}, 6) AS {f}" for f, e in box.items())
    return f"""SELECT cds_code, district,
        CASE WHEN {OWN} THEN 'bounds' WHEN markers > 0 THEN 'schools' ELSE 'default' END AS view,
        box_s IS NOT NULL AS has_boundary, box_o IS NOT NULL AS has_office, coalesce(markers, 0) AS school_markers,
        min_lat, min_lon, max_lat, max_lon,
        CASE WHEN min_lat IS NULL THEN 36.7783::DOUBLE END AS centre_lat, CASE WHEN min_lat IS NULL THEN -119.4179::DOUBLE END AS centre_lon,
        CASE WHEN min_lat IS NULL THEN 6 END AS zoom
        FROM (SELECT o.cds_code, o.district, box_s, box_o, s.markers, {shown}
          FROM (SELECT *, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN 1 END AS box_o FROM offices) o
          LEFT JOIN (SELECT *, 1 AS box_s FROM boxes) b ON b.boundary_key = o.cds_code
          LEFT JOIN (SELECT district_cds, count(*) AS markers, min(lat) AS min_lat, min(lon) AS min_lon, max(lat) AS max_lat, max(lon) AS max_lon
                     FROM school_points GROUP BY 1) s ON s.district_cds = o.cds_code) v"""


def _queries() -> dict[str, str]:
    district_columns, school_columns = ", ".join(DISTRICT_COLUMNS), ", ".join(SCHOOL_COLUMNS)
    headers = ", ".join(f'{c} AS "{HEADER_OF[c]}"' for c in DISTRICT_COLUMNS)
    chunked = """SELECT {key}, (place - 1) // {rows} AS chunk, CAST(count(*) AS INTEGER) AS n, string_agg(cds_code, ',' ORDER BY ord) AS codes
        FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ord) AS place FROM {table}) GROUP BY 1, 2"""
    wanted = SEARCH_TERM.lower()
    return {
        "directory_lines": "SELECT ord, " + ", ".join("' ' || district AS district" if c == "district" else f"trim({c}) AS {c}" for c in RAW_COLUMNS) + " FROM raw",
        "directory_districts": f"SELECT ord, {district_columns}, slug FROM districts",
        "directory_schools": f"SELECT ord, {school_columns} FROM schools",
        "reject_report": REJECTS,
        "coordinate_checks": f"""SELECT ord, {LAT} AS lat, {LON} AS lon,
            {bounded(LAT, LON)} AND coalesce({LAT} <> 0 AND {LON} <> 0, false) AS ingest_ok,
            {bounded(LAT, LON)} AND NOT contains(lower(latitude || longitude), 'redacted') AS display_ok,
            {bounded(LAT, LON)} AS map_ok FROM raw""",
        "district_map_rows": f"SELECT cds_code AS key, ord, {headers}, slug FROM districts",
        "schools_by_district": chunked.format(key="district_cds", table="linked", rows=S.SCHOOLS_IN_ARRAY),
        "page_params": "SELECT slug AS \"districtSlug\" FROM page_homes WHERE slug <> ''",
        "school_counts": f"""SELECT d.cds_code, d.district, d.slug, coalesce(n, 0) AS school_count FROM districts d
            LEFT JOIN (SELECT district_cds, count(*) AS n FROM links WHERE link_status <> 'bad_prefix' AND {PAGE_SCHOOL} GROUP BY 1) c
            ON c.district_cds = d.cds_code""",
        "school_links": "SELECT ord, cds_code, district_cds, link_status FROM links",
        "link_sample": "SELECT ord, cds_code, district_cds, link_status FROM links ORDER BY ord LIMIT 5",
        "orphan_schools": "SELECT ord, cds_code, school, link_status FROM links WHERE link_status <> 'linked'",
        "strict_school_list": """SELECT district_cds, cds_code, school, ord FROM linked WHERE status = 'Active' AND public_yes_no = 'Y'
            AND lower(educational_program_type) <> 'homeschool' AND lower(school) <> 'homeschool'
            AND street_address <> 'Information Redacted'""",
        "strict_school_links": f"""SELECT ord, cds_code, substr(cds_code, 1, 7) || '0000000' AS district_cds, school, {grades('list')} AS grades,
            {joined(*STREET)} AS address, concat_ws(' | ', {usable('website')}, '{DASH}' || cds_code || '/2024', '{CDE}' || cds_code) AS links
            FROM schools""",
        "geocode_attempts": f"SELECT {ADDRESS}, target_street, target_city, level, query FROM attempts_s",
        "geocode_candidates": f"SELECT {ADDRESS}, level, query, lat, lon FROM results_s",
        "geocode_districts": f"SELECT {GEO_COLUMNS} FROM placed_d",
        "geocode_schools": f"SELECT {GEO_COLUMNS} FROM placed_s",
        "geocode_report": """SELECT 'districts' AS entity, count_if(geocode_tried)::BIGINT AS tried, count_if(geocode_ok)::BIGINT AS successes,
            count_if(geocode_fallback)::BIGINT AS fallback_successes FROM placed_d UNION ALL
            SELECT 'schools', count_if(geocode_tried)::BIGINT, count_if(geocode_ok)::BIGINT, count_if(geocode_fallback)::BIGINT FROM placed_s""",
        "office_points": "SELECT cds_code, address, lat, lon FROM offices",
        "street_names": f"SELECT ord, {street('street_address')} AS normalized, trim(regexp_replace({street('street_address')}, '^\\d+\\s+', '')) AS street_only FROM raw",
        "slugs": f"""SELECT ord, {slug(f'({RAW_NAME})', 'cds_code')} AS slug, substr(cds_code, 1, 7) || '0000000' AS district_cds,
            regexp_replace({RAW_NAME}, '[^a-zA-Z0-9_-]', '_', 'g') AS file_key FROM raw""",
        "addresses": f"SELECT ord, {address_line(*STREET)} AS canonical, {address_map(*STREET)} AS map_form, {joined(*STREET)} AS flat_form FROM raw",
        "websites": f"SELECT ord, {href('website')} AS href, {usable('website')} AS usable FROM raw",
        "grade_spans": "SELECT ord, " + ", ".join(f'{grades(s)} AS "{s}"' for s in ("district", "school", "popup", "list")) + " FROM raw",
        "profile_links": f"""SELECT cds_code, '{DASH}gissearch/districts/' || cds_code AS dashboard, '{CDE}' || cds_code AS profile,
            '{DASH}' || cds_code || '/2024' AS year_report, '/base/districts/' || slug AS path,
            '/base/districts/' || coalesce(nullif(slug, ''), cds_code) || '/' AS marker_link FROM districts""",
        "page_trails": f"""SELECT cds_code, 0 AS position, 'Home' AS text, '/base/' AS href FROM districts UNION ALL
            SELECT cds_code, 1, {default('district', 'Unknown District')}, NULL FROM districts""",
        "page_metadata": """SELECT p_partkey, coalesce(nullif(CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN p_name END
            WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand END, ''), 'Site') AS title,
            coalesce(nullif(CASE WHEN p_partkey % 3 = 0 THEN p_type END, ''), 'Site text') AS description FROM part""",
        "district_details": _details(),
        "search_top10": f"""SELECT cds_code, district, slug, '/districts/' || slug AS path FROM districts
            WHERE status = 'Active' AND contains(lower(district), '{wanted}') ORDER BY district, ord LIMIT 10""",
        "search_terms": """SELECT term, cds_code, district, slug, '/districts/' || slug AS path FROM (
            SELECT t.term, d.*, row_number() OVER (PARTITION BY t.term ORDER BY d.district, d.ord) AS place
            FROM (SELECT DISTINCT unnest([substr(s_name, 16, 3), substr(s_name, 17, 2), substr(s_name, 18, 1),
                    substr(s_name, 14, 5) || ' - UNI', substr(s_name, 1, 9)]) AS term FROM supplier) t
            JOIN districts d ON d.status = 'Active' AND contains(lower(d.district), lower(t.term))) x WHERE place <= 10""",
        "search_parts": f"""SELECT term, cds_code, district, slug, '/districts/' || slug AS path FROM (
            SELECT t.term, d.*, row_number() OVER (PARTITION BY t.term ORDER BY d.district, d.ord) AS place
            FROM (SELECT DISTINCT unnest([{', '.join(S.PART_TERMS)}]) AS term FROM part) t
            JOIN (SELECT p_partkey AS ord, {', '.join(f'{e} AS {c}' for c, e in S.PART_NAMES.items())} FROM part) d
              ON d.status = 'Active' AND t.term <> '' AND contains(lower(d.district), lower(t.term))) x WHERE place <= 10""",
        "exported_records": "SELECT " + ", ".join("' ' || district AS district" if c == "district" else f"trim({c}) AS {c}" for c in RAW_COLUMNS) + " FROM raw",
        "built_districts": """SELECT p.cds_code, p.slug, p.lat, p.lon, p.geocode_level, coalesce(n, 0) AS schools, coalesce(repaired, 0) AS repaired_schools,
            p.slug <> '' AS page FROM placed_d p LEFT JOIN (SELECT l.district_cds, count(*) AS n, CAST(count_if(s.geocode_ok) AS BIGINT) AS repaired
              FROM linked l JOIN placed_s s ON s.ord = l.ord GROUP BY 1) c ON c.district_cds = p.cds_code""",
        "built_boundaries": """SELECT f.boundary_key, geom_type, CASE geom_type WHEN 'Point' THEN 1 WHEN 'Polygon' THEN 5 ELSE 10 END AS vertices,
            round(min_lat, 6) AS min_lat, round(min_lon, 6) AS min_lon, round(max_lat, 6) AS max_lat, round(max_lon, 6) AS max_lon
            FROM kept_features f JOIN boxes b ON b.boundary_key = f.boundary_key""",
        "district_folders": "SELECT district_cds, count(*) AS schools, max(phone) AS last_phone, count(*) AS listed FROM linked GROUP BY 1",
        "feature_collections": """SELECT pos, boundary_id, geom_type,
            CASE geom_type WHEN 'Point' THEN 1 WHEN 'Polygon' THEN 5 ELSE 10 END AS vertices FROM features""",
        "boundary_vertices": "SELECT boundary_key, reprojected, CAST(vertex AS INTEGER) AS vertex, round(lon, 6) AS lon, round(lat, 6) AS lat FROM vertices",
        "boundary_boxes": "SELECT boundary_key, round(min_lat, 6) AS min_lat, round(min_lon, 6) AS min_lon, round(max_lat, 6) AS max_lat, round(max_lon, 6) AS max_lon FROM boxes",
        "office_markers": "SELECT cds_code, lat, lon, '<b>' || district || ' Office</b><br>' || address AS popup FROM offices WHERE lat IS NOT NULL AND lon IS NOT NULL",
        "district_markers": f"""SELECT cds_code, district, lat, lon, '/districts/' || slug || '/' AS link,
            '<b>' || district || '</b><br><a href="/districts/' || slug || '/">View Details</a>' AS popup FROM placed_d WHERE {bounded('lat', 'lon')}""",
        "unplaced_districts": f"SELECT cds_code, district FROM placed_d WHERE NOT {bounded('lat', 'lon')}",
        "district_marker_cells": _cluster(f"(SELECT lat, lon FROM placed_d WHERE {bounded('lat', 'lon')}) m", ""),
        "school_markers": "SELECT district_cds, ord, cds_code, lat, lon, popup FROM school_points",
        "school_marker_cells": _cluster("school_points", "district_cds"),
        "district_map_view": _map_view(),
        "card_map_view": f"""SELECT cds_code, district, CASE WHEN b_lat IS NOT NULL THEN 'boundary' WHEN lat IS NOT NULL AND lon IS NOT NULL THEN 'point'
            WHEN g_lat IS NOT NULL THEN 'address' ELSE 'none' END AS view,
            round(b_lat, 6) AS min_lat, round(b_lon, 6) AS min_lon, round(c_lat, 6) AS max_lat, round(c_lon, 6) AS max_lon,
            CASE WHEN b_lat IS NULL THEN CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN lat ELSE g_lat END END AS centre_lat,
            CASE WHEN b_lat IS NULL THEN CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN lon ELSE g_lon END END AS centre_lon,
            CASE WHEN b_lat IS NOT NULL THEN NULL WHEN lat IS NOT NULL AND lon IS NOT NULL THEN 13 WHEN g_lat IS NOT NULL THEN 15 END AS zoom
            FROM (SELECT p.cds_code, p.district, p.lat, p.lon, b.min_lat AS b_lat, b.min_lon AS b_lon, b.max_lat AS c_lat, b.max_lon AS c_lon,
              {number('g.lat')} AS g_lat, {number('g.lon')} AS g_lon
              FROM (SELECT *, {joined(*STREET)} AS address FROM placed_d) p
              LEFT JOIN (SELECT x.* FROM boxes x JOIN kept_features f ON f.boundary_key = x.boundary_key WHERE f.geom_type <> 'Point') b ON b.boundary_key = p.cds_code
              LEFT JOIN map_gaz g ON g.query = p.address AND p.address <> '') v""",
        "overview_map_view": f"""SELECT cds_code, district, CASE WHEN e1 IS NOT NULL THEN 'bounds' WHEN g_lat IS NOT NULL THEN 'name' ELSE 'default' END AS view,
            round(e1, 6) AS min_lat, round(e2, 6) AS min_lon, round(e3, 6) AS max_lat, round(e4, 6) AS max_lon,
            CASE WHEN e1 IS NULL THEN coalesce(g_lat, 36.7783::DOUBLE) END AS centre_lat, CASE WHEN e1 IS NULL THEN coalesce(g_lon, -119.4179::DOUBLE) END AS centre_lon,
            CASE WHEN e1 IS NOT NULL THEN NULL WHEN g_lat IS NOT NULL THEN 10 ELSE 6 END AS zoom
            FROM (SELECT p.cds_code, p.district, {number('g.lat')} AS g_lat, {number('g.lon')} AS g_lon,
              least(b.min_lat, p.o_lat, s.min_lat) AS e1, least(b.min_lon, p.o_lon, s.min_lon) AS e2,
              greatest(b.max_lat, p.o_lat, s.max_lat) AS e3, greatest(b.max_lon, p.o_lon, s.max_lon) AS e4
              FROM (SELECT *, CASE WHEN {bounded('lat', 'lon')} THEN lat END AS o_lat, CASE WHEN {bounded('lat', 'lon')} THEN lon END AS o_lon FROM placed_d) p
              LEFT JOIN boxes b ON b.boundary_key = p.cds_code
              LEFT JOIN (SELECT district_cds, min(lat) AS min_lat, min(lon) AS min_lon, max(lat) AS max_lat, max(lon) AS max_lon FROM school_points GROUP BY 1) s
                ON s.district_cds = p.cds_code
              LEFT JOIN map_gaz g ON g.query = p.district || ', California') v""",
        "district_pages": f"""SELECT d.slug, d.cds_code, {default('district', 'Unknown District')} || ' - District Details' AS title,
            'Information and schools for ' || {default('district', 'Unknown District')} || ' in ' || {default('county', 'California')} ||
            '. View address, website, grades, and map.' AS description, {default('district', 'Unknown District')} AS name,
            {default('status', 'N/A')} AS status, {default('entity_type', 'N/A')} AS entity_type, {grades('district')} AS grades,
            {address_line(*STREET)} AS address, {default('phone', 'N/A')} AS phone, {SITE} AS website,
            '{DASH}gissearch/districts/' || d.cds_code AS dashboard_url, '{CDE}' || d.cds_code AS profile_url, coalesce(n, 0) AS school_count
            FROM page_wanted w JOIN page_homes d ON d.slug = w.slug AND first_of = 1
            LEFT JOIN (SELECT district_cds, count(*) AS n FROM page_rows GROUP BY 1) c ON c.district_cds = d.cds_code""",
        "page_schools": "SELECT l.* FROM page_wanted w JOIN page_list l ON l.slug = w.slug",
        "page_school_chunks": chunked.format(key="slug", table="page_list WHERE slug <> ''", rows=S.SCHOOLS_IN_ARRAY),
        "internal_links": "SELECT page_id, link FROM page_links",
        "broken_links": "SELECT page_id, link FROM page_links WHERE regexp_replace(link, '#.*$', '') NOT IN (SELECT url FROM known_urls)",
        "broken_targets": """SELECT regexp_replace(link, '#.*$', '') AS target, count(DISTINCT page_id) AS pages FROM page_links
            WHERE regexp_replace(link, '#.*$', '') NOT IN (SELECT url FROM known_urls) GROUP BY 1""",
        "page_link_counts": """SELECT p.page_id, CAST(coalesce(n, 0) AS INTEGER) AS internal_links, coalesce(n, 0) > 0 AS has_link FROM pages p
            LEFT JOIN (SELECT page_id, count(*) AS n FROM page_links GROUP BY 1) l ON l.page_id = p.page_id""",
        "guide_outline": """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS number,
            text, question, text AS note, slug AS anchor FROM guide_slugs WHERE depth = 2""",
        "guide_headings": "SELECT doc_id, pos, depth, slug, text FROM guide_slugs",
        "guide_sections": "SELECT doc_id, CAST(pos AS INTEGER) AS pos, section_id, title, body, source_url FROM sections",
        "section_answers": f"""SELECT question_id, district, CAST(place AS INTEGER) AS rank, section_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY question_id, district ORDER BY score DESC, section_id) AS place FROM answers) WHERE place <= {S.ANSWERS}""",
        "boundary_totals": """SELECT 'boundaries' AS section, 'features' AS metric, count(*) AS value FROM features UNION ALL
            SELECT 'boundaries', 'without_id', count(*) FROM features WHERE boundary_id IS NULL UNION ALL
            SELECT 'boundaries', 'boundaries', count(*) FROM kept_features UNION ALL
            SELECT 'boundaries', 'not_reprojected', count(*) FROM kept_features WHERE geom_type = 'Point'""",
        "quality_report": _quality(),
    }


def statements() -> dict[str, str]:
    return {name: with_tables(body) for name, body in _queries().items()}
