from __future__ import annotations

import random

from rollatlas.llm import urlrules as U


def pages(spark, urls):
    rows = [(i, u, None, "x", None) for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, rule string")


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute(urls, rules):
    out = []
    for i, url in enumerate(urls):
        host, path = split(url)
        fits = [
            (len(h), len(p), a == "block", h + p) for h, p, a in rules
            if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        best = max(fits, default=None)
        out.append((i, host, path, best and best[3], "block" if best and best[2] else "allow"))
    return out


URLS = [
    None, "", "no scheme", "http://", "https://example.com", "https://example.com/", "https://EXAMPLE.com/en/x?y#z",
    "https://www.example.com/en/1", "http://a.www.example.com/en/", "http://notexample.com/en/", "http://x.net/es/1#t",
    "http://net/fr/", "http://x.net/fr", "http://x.net?/es/", "ftp://B.COM:80/es/", "http://example.com./en/", "http://.com/",
    "a://b://c.com/", "http://user@example.com/en/", "http://ÉXÄ.com/é/", "http://x.com#/en/", "http://x.com/a b/\nc",
    "http://com/en/", "://com/", "http://x.net/es/" + "d/" * 20_000,
]


def test_asked_rules(spark):
    got = U.judge(pages(spark, URLS), U.rule_table(spark, U.RULES))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, got.collect())) == brute(URLS, U.RULES)


def test_any_rules_and_a_filter_that_lets_much_through(spark):
    pick = random.Random(4)
    hosts = ["com", "a.com", "b.a.com", "net", "a.net", "", "c.b.a.com", None]
    paths = ["/", "", "/x", "/x/", "/x/y", "/xy/", None]
    rules = [(pick.choice(hosts), pick.choice(paths), pick.choice(["allow", "block", None])) for _ in range(40)]
    urls = [
        f"http://{'.'.join(pick.choices(['a', 'b', 'c'], k=pick.randint(0, 3)) + [pick.choice(['com', 'net', 'org'])])}"
        f"{pick.choice(['', '/', '/x', '/x/', '/x/y/z', '/xy/', '/xyz'])}{pick.choice(['', '?q', '#f'])}" for _ in range(200)
    ]
    for settings in ({}, {"bits_per_key": 1, "filter_bytes": 64}):
        got = U.judge(pages(spark, urls), U.rule_table(spark, rules), **settings)
        assert sorted(map(tuple, got.collect())) == brute(urls, rules)


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = [f"h{i}.com /p{i}" for i in range(5000)]
    filled = U.block_filter(spark.createDataFrame([(k,) for k in keys], "key string").repartition(5), len(keys))
    assert U.possible(filled, keys) == keys
    others = [f"h{i}.org /p{i}" for i in range(5000)]
    assert len(U.possible(filled, others)) < 50
    assert U.block_filter(spark.createDataFrame([(k,) for k in keys], "key string"), len(keys), 16, 128).shape == (2, U.WORDS)


def test_empty_tables_and_repeated_rows(spark):
    rules, none = U.rule_table(spark, U.RULES), U.rule_table(spark, [])
    assert U.judge(pages(spark, []), rules).collect() == []
    assert {r["verdict"] for r in U.judge(pages(spark, URLS), none).collect()} == {"allow"}
    same = spark.createDataFrame([(None, "http://x.net/es/")] * 3 + [(5, "http://x.net/es/")] * 2, "page_id long, url string")
    got = U.judge(same, rules.unionByName(rules)).collect()
    assert [tuple(r)[1:] for r in got] == [("x.net", "/es/", "net/es/", "block")] * 5
    assert sorted(str(r["page_id"]) for r in got) == ["5", "5", "None", "None", "None"]
