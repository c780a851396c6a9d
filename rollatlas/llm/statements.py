"""DuckDB SQL that gives the rows of some queries, written from their rules."""

from __future__ import annotations

from rollatlas.llm import importance, spelling, urlrules

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The 256 steps of a reflected crc32, as a list.
CRC_STEPS = """crc_steps AS (SELECT list(list_reduce(range(8),
      lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS steps FROM range(256) r(b))"""


def crc32(text: str) -> str:
    """Unsigned crc32 of a text's UTF-8; wants ``steps`` of ``crc_steps`` in its row."""
    digit = "(strpos('0123456789ABCDEF', substr(hex({0}), {1}, 1)) - 1)"
    byte = f"{digit.format(text, '2 * i + 1')} * 16 + {digit.format(text, '2 * i + 2')}"
    codes = f"list_transform(range(strlen({text})), lambda i: {byte})"
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, steps[xor(c & 255, b) + 1]), 4294967295), 4294967295)"


def _op5() -> str:
    return f"""WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
    sets AS (SELECT doc_id, CASE WHEN len(words) = 0 OR words IS NULL THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS shingles FROM texts),
    sizes AS (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n FROM sets),
    listed AS (SELECT doc_id, unnest(shingles) AS shingle FROM sets),
    common AS (SELECT a.doc_id AS one, b.doc_id AS two, count(*) AS shared FROM listed a JOIN listed b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
    links AS (SELECT one, two FROM common JOIN sizes x ON x.doc_id = one JOIN sizes y ON y.doc_id = two WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
    sides AS (SELECT one, two FROM links UNION ALL SELECT two, one FROM links),
    reached AS (SELECT doc_id, doc_id AS other FROM sizes UNION SELECT r.doc_id, b.two FROM reached r JOIN sides b ON b.one = r.other)
    SELECT s.doc_id, s.n AS n_shingles, min(other) AS component_id FROM sizes s JOIN reached r ON r.doc_id = s.doc_id GROUP BY 1, 2"""


def _op6() -> str:
    return """WITH payloads AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    firsts AS (SELECT payload_digest, min(page_id) AS first_id FROM payloads WHERE payload_bytes >= 100 GROUP BY 1)
    SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN first_id < page_id THEN first_id END AS refers_to
    FROM payloads p LEFT JOIN firsts f ON f.payload_digest = p.payload_digest AND payload_bytes >= 100"""


def _op11() -> str:
    seed, buckets, percent, least = importance.SEED, importance.BUCKETS, importance.PERCENT, importance.MIN_WORDS
    words = f"regexp_extract_all(translate({{0}}, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH {CRC_STEPS},
    own AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({words.format('text')}) AS word FROM documents) x GROUP BY 1, 2),
    wanted AS (SELECT word, count(*) AS n FROM (SELECT unnest({words.format('text')}) AS word FROM benchmark) x GROUP BY 1),
    codes AS (SELECT word, {crc32('word')} % {buckets} AS bucket
      FROM (SELECT word FROM own UNION SELECT word FROM wanted) x, crc_steps),
    source AS (SELECT bucket, sum(n) AS s FROM own JOIN codes USING (word) GROUP BY 1),
    target AS (SELECT bucket, sum(n) AS t FROM wanted JOIN codes USING (word) GROUP BY 1),
    totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM source) AS s_all, (SELECT coalesce(sum(t), 0) FROM target) AS t_all),
    gains AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + {buckets}) / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + {buckets})))) AS BIGINT) AS gain
      FROM (SELECT DISTINCT bucket FROM codes) c LEFT JOIN source USING (bucket) LEFT JOIN target USING (bucket), totals),
    weighed AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain)::DOUBLE / sum(n)) AS BIGINT) AS weight
      FROM own JOIN codes USING (word) JOIN gains USING (bucket) GROUP BY 1),
    scored AS (SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
      FROM (SELECT doc_id, CAST('0x' || substr(sha256('{seed}:' || doc_id), 1, 8) AS BIGINT)::DOUBLE AS h FROM documents) d
      LEFT JOIN weighed w ON w.doc_id = d.doc_id),
    placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able
      FROM scored WHERE n_features >= {least})
    SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= {percent} * able // 100 THEN place END AS rank
    FROM scored s LEFT JOIN placed p ON p.doc_id = s.doc_id"""


def _op12() -> str:
    listed = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in urlrules.RULES)
    return f"""WITH rules(rule_host, rule_path, action) AS (VALUES {listed}),
    split AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
      coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    fits AS (SELECT page_id, url, rule_host || rule_path AS rule, action,
        row_number() OVER (PARTITION BY page_id, url ORDER BY length(rule_host) DESC, length(rule_path) DESC) AS place
      FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
    SELECT s.page_id, host, path, rule, coalesce(action, 'allow') AS verdict
    FROM split s LEFT JOIN fits f ON f.page_id = s.page_id AND f.url = s.url AND place = 1"""


def _op13() -> str:
    every, chars, least, factor = spelling.EVERY, spelling.MIN_CHARS, spelling.MIN_COUNT, spelling.FACTOR
    runs = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')"
    return f"""WITH RECURSIVE {CRC_STEPS},
    runs AS (SELECT run, coalesce(doc_id || '', '') || ':' || run AS name, count(*) AS n
      FROM (SELECT doc_id, unnest({runs}) AS run FROM documents) x WHERE length(run) >= {chars} GROUP BY 1, 2),
    coded AS (SELECT run, n, {crc32('name')} AS h FROM runs, crc_steps),
    results AS (SELECT CASE WHEN h % {every} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM coded),
    words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM results WHERE length(word) >= {chars} GROUP BY 1 HAVING sum(n) >= {least}),
    cuts AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less
      FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words) x),
    near AS (SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
      UNION SELECT c.word, w.word FROM cuts c JOIN words w ON w.word = c.less
      UNION SELECT w.word, c.word FROM cuts c JOIN words w ON w.word = c.less),
    best AS (SELECT near.word, count(*) AS n_near, max(n) AS top, arg_min(other, (-n, other)) AS other
      FROM near JOIN words ON words.word = near.other GROUP BY 1),
    formed AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {factor} * n THEN other END AS form,
        CASE WHEN top >= {factor} * n THEN top END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
    chain AS (SELECT word, word AS at FROM formed UNION ALL
      SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL),
    ends AS (SELECT c.word, c.at AS root FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NULL)
    SELECT f.word, form, root, n, n_near, form_n FROM formed f JOIN ends e ON e.word = f.word"""


def statements() -> dict[str, str]:
    return {"op5_jaccard": _op5(), "op6_warc": _op6(), "op11_importance": _op11(), "op12_url_rules": _op12(), "op13_spelling": _op13()}
