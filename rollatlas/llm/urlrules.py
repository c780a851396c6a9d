"""URL lists: a blocked Bloom filter in front of an exact hash join (operator 12).

A rule is a host, a path and an action. It fits its host and all subdomains of it where the URL's
path begins with the rule's path. Of the rules that fit, the one with the longest host wins, then
the one with the longest path; of equal rules with different actions ``block`` wins. A URL that no
rule fits is not listed, and passes (``allow``).

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; path:
from there up to ``?``, ``#`` or the end. Both are empty for null and for text without ``://``.
Ports and user names stay in the host, and nothing is decoded.

1. Every listed canonical URL (host and path) sets some bits of one 64-byte block of the filter.
   Tasks fill blocks, which are united by a grouped bit-or. The filter has ``bits_per_key`` bits
   for each rule up to ``filter_bytes``; beyond that it lets more through, and nothing is lost.
2. A page's candidates are its host's suffixes (whole labels) with the beginnings of its path that
   are as long as some listed path. Those that the filter lets through are possible hits.
3. Possible hits meet the list in an exact hash join; the longest true one is the page's rule.

Null and repeated rules are dropped. Repeated rows of pages get a result each, whatever their
page_id; null page_id stays null. A rule that many pages hit is joined with Spark's skew handling,
and results are put together by row, so no group is larger than one page's hits. Empty tables give
empty results; an empty list lets everything pass. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollatlas.llm.shared import stage

BITS_PER_KEY = 16
FILTER_BYTES = 32 << 20
#: Bits that a key sets in its block, and words of 64 bits of a block.
PROBES = 8
WORDS = 8

# The asked rules (host, path, action).
RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, action string")


def url_host(url: Column | str) -> Column:
    found = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column | str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def canonical(rules: DataFrame) -> DataFrame:
    """(key, rule, rank, blocked) of every listed URL, each one once; ``rank`` grows with what wins."""
    whole = rules.filter("host IS NOT NULL AND path IS NOT NULL").select("host", "path", "action")
    key = F.concat("host", F.lit(" "), "path")
    rank = F.struct(F.length("host").alias("host"), F.length("path").alias("path"))
    return whole.groupBy("host", "path").agg(F.max(F.coalesce(F.col("action") == "block", F.lit(False))).alias("blocked")).select(
        key.alias("key"), F.concat("host", "path").alias("rule"), rank.alias("rank"), "blocked"
    )


def _bits(key: str, blocks: int) -> tuple[int, list[int]]:
    """Block of a key and the bits it sets there."""
    h = xxhash.xxh3_128_intdigest(key)
    low = h >> 64
    return (h & 0xFFFFFFFFFFFFFFFF) % blocks, [low >> (9 * i) & 511 for i in range(PROBES - 1)] + [(low ^ h) & 511]


def block_filter(keys: DataFrame, n: int, bits_per_key: int = BITS_PER_KEY, filter_bytes: int = FILTER_BYTES) -> np.ndarray:
    """Blocks of ``WORDS`` words for the ``n`` keys; at most ``filter_bytes`` bytes reach the driver."""
    blocks = int(min(max(1, -(-n * bits_per_key // 512)), max(1, filter_bytes // 64)))
    names = [f"w{i}" for i in range(WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: dict[int, list[int]] = {}
            for key in batch.column(0).to_pylist():
                block, bits = _bits(key, blocks)
                words = own.setdefault(block, [0] * WORDS)
                for bit in bits:
                    words[bit >> 6] |= 1 << (bit & 63)
            filled = np.array(list(own.values()), np.uint64).reshape(-1, WORDS).view(np.int64)
            columns = [pa.array(list(own), pa.int32()), *[pa.array(filled[:, i]) for i in range(WORDS)]]
            yield pa.RecordBatch.from_arrays(columns, names=["block", *names])

    schema = "block int, " + ", ".join(f"{w} long" for w in names)
    united = keys.select("key").mapInArrow(run, schema).groupBy("block").agg(*[F.bit_or(w).alias(w) for w in names])
    found = united.toArrow()
    out = np.zeros((blocks, WORDS), np.uint64)
    at = found.column("block").to_numpy()
    for i, w in enumerate(names):
        out[at, i] = found.column(w).to_numpy().view(np.uint64)
    return out


def possible(filled: np.ndarray, keys: list[str]) -> list[str]:
    """The keys that the filter lets through."""
    out = []
    for key in keys:
        block, bits = _bits(key, len(filled))
        words = filled[block].tolist()
        if all(words[b >> 6] >> (b & 63) & 1 for b in bits):
            out.append(key)
    return out


def candidate_keys(host: str, path: str, lengths: list[int]) -> list[str]:
    """Keys of all listed URLs that could fit; ``lengths`` are those of listed paths, ascending."""
    heads = []
    for n in lengths:
        if n > len(path):
            break
        heads.append(path[:n])
    out, at = [], 0
    while True:
        out += [f"{host[at:]} {head}" for head in heads]
        at = host.find(".", at) + 1
        if at == 0:
            return out


def possible_hits(pages: DataFrame, filled: np.ndarray, lengths: list[int]) -> DataFrame:
    """pages(row, host, path) with the candidates that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, path = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            maybe = [possible(filled, candidate_keys(h, p, lengths)) for h, p in zip(host, path)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(maybe, pa.list_(pa.string()))], names=[*batch.schema.names, "_maybe"]
            )

    schema = T.StructType([*pages.schema.fields, T.StructField("_maybe", T.ArrayType(T.StringType()))])
    return pages.mapInArrow(run, schema)


def judge(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
    bits_per_key: int = BITS_PER_KEY, filter_bytes: int = FILTER_BYTES,
) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    listed = stage(canonical(rules), "url-rules")
    n = listed.count()
    lengths = sorted(r[0] for r in listed.select("rank.path").distinct().collect())
    filled = block_filter(listed, n, bits_per_key, filter_bytes)
    rows = pages.select(
        F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("page_id"),
        url_host(url_col).alias("host"), url_path(url_col).alias("path"),
    )
    maybe = possible_hits(rows, filled, lengths)
    hits = maybe.select("_row", "page_id", "host", "path", F.explode_outer("_maybe").alias("key"))
    joined = hits.join(listed, "key", "left")
    best = F.max_by(F.struct("rule", "blocked"), "rank")
    found = joined.groupBy("_row", "page_id", "host", "path").agg(best.alias("_best"))
    verdict = F.when(F.col("_best.blocked"), "block").otherwise("allow")
    return found.select("page_id", "host", "path", F.col("_best.rule").alias("rule"), verdict.alias("verdict"))
