"""WARC source and archives (operator 6)."""

from __future__ import annotations

import gzip
import hashlib

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from rollatlas.llm import warc


@pytest.fixture
def pages(spark):
    same = "<p>the same long page</p>" * 10
    rows = [
        (3, "http://a/3", same, 1), (1, "http://a/1", same, 1), (2, None, "short", 1), (4, "http://a/4", "short", 1),
        (5, "bad\r\nX: y", None, 1), (6, "http://ü", "ä" * 200_000, 1), (None, "http://n", same, 1), (7, "u", "", 1),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string, record_type int"), rows


def test_round_trip(spark, pages, tmp_path):
    df, rows = pages
    warc.write_warc(warc.page_records(df.repartition(3)), f"{tmp_path}/a", fileBytes="200")
    found = {r.page_id: r for r in warc.archived_pages(warc.read_warc(spark, f"{tmp_path}/a", taskBytes="1000")).collect()}
    assert len(found) == len(rows)
    for page, _, html, _ in rows:
        raw = (html or "").encode()
        revisit = page in (3, None)
        want = (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", 1 if revisit else None)
        r = found[page]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == want
    uris = {r.record_id: r.target_uri for r in warc.read_warc(spark, f"{tmp_path}/a").collect()}
    assert uris["urn:x-page:2"] is None and uris["urn:x-page:5"] == "bad X: y" and uris["urn:x-page:6"] == "http://ü"


def test_no_pages(spark, pages, tmp_path):
    warc.write_warc(warc.page_records(pages[0].limit(0)), f"{tmp_path}/a")
    assert warc.read_warc(spark, f"{tmp_path}/a").collect() == []


def test_appending_keeps_earlier_records(spark, pages, tmp_path):
    for _ in range(2):
        warc.write_warc(warc.page_records(pages[0]), f"{tmp_path}/a")
    assert warc.read_warc(spark, f"{tmp_path}/a", ["record_id"]).count() == 16


def test_predicates_reach_the_source(spark, pages, tmp_path):
    warc.write_warc(warc.page_records(pages[0]), f"{tmp_path}/a")
    df = warc.read_warc(spark, f"{tmp_path}/a")
    some = df.filter((F.col("record_type") == "revisit") & F.col("target_uri").startswith("http") & F.col("refers_to").isNotNull())
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", "")
    assert {r.record_id for r in some.collect()} == {"urn:x-page:3", "urn:x-page:"}
    assert df.filter(F.col("record_id").isin("urn:x-page:2", "urn:x-page:9")).count() == 1
    assert df.filter(F.col("target_uri").isNull()).count() == 1
    assert df.filter(F.col("payload_length") > 1000).count() == 1


def archive(path):
    f = fs.LocalFileSystem().open_input_file(str(path))
    return warc.Archive(f, f.size())


def test_unwanted_payloads_are_not_decoded(spark, pages, tmp_path):
    warc.write_warc(warc.page_records(pages[0].coalesce(1)), f"{tmp_path}/a")
    for file in tmp_path.glob("a/*.gz"):
        own = archive(file)
        list(own.records(lambda h: h["warc-type"] == "revisit", True))
        assert own.counts["decoded"] == 0 and own.counts["records"] > 0


@pytest.mark.parametrize("kind", ["plain", "gzip", "one gzip"])
def test_archives_of_other_writers(spark, tmp_path, kind):
    def record(i, body, extra=""):
        head = f"WARC/1.0\r\nWARC-Type: {'resource' if i % 2 else 'warcinfo'}\r\nWARC-Record-ID: <urn:r:{i}>\r\n{extra}"
        return (head + f"Content-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"

    bodies = [b"x" * n for n in (0, 5, 300_000, 70_000)]
    raw = [record(i, b, "X-Folded: a\r\n b\r\n" if i == 1 else "") for i, b in enumerate(bodies)]
    if kind == "plain":
        path = tmp_path / "a.warc"
        path.write_bytes(b"".join(raw))
    else:
        path = tmp_path / "a.warc.gz"
        path.write_bytes(b"".join(map(gzip.compress, raw)))
    found = warc.read_warc(spark, str(path) if kind != "one gzip" else str(tmp_path)).collect()
    assert [(r.record_id, r.payload_length, bytes(r.payload)) for r in found] == [(f"urn:r:{i}", len(b), b) for i, b in enumerate(bodies)]
    light = warc.read_warc(spark, str(path), ["record_id", "record_type"]).filter("record_type = 'resource'").collect()
    assert [r.record_id for r in light] == ["urn:r:1", "urn:r:3"]


@pytest.mark.parametrize("pad", [65_200, 65_300, 65_400, 65_500, 65_600, 200_000])
@pytest.mark.parametrize("packed", [True, False])
def test_protocol_headers_beyond_the_first_read(spark, tmp_path, pad, packed):
    """Record or protocol headers that end near or behind the edge of what is read first."""
    body = b"<p>page</p>"
    for name, record_pad, http_pad in (("record", pad, 0), ("http", 0, pad)):
        block = b"HTTP/1.1 200 OK\r\nX-Pad: " + b"y" * http_pad + b"\r\n\r\n" + body
        head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:{name}>\r\nX-Pad: {'x' * record_pad}\r\n"
        head += f"Content-Type: application/http;msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
        raw = head.encode() + block + b"\r\n\r\n"
        folder = tmp_path / name
        folder.mkdir()
        (folder / ("a.warc.gz" if packed else "a.warc")).write_bytes(gzip.compress(raw) * 2 if packed else raw * 2)
        got = warc.read_warc(spark, str(folder)).select("payload").collect()
        assert [bytes(r.payload) for r in got] == [body, body]
