"""Benchmark passages in documents by greedy string tiling (operator 7).

Texts are words of letters and digits, ASCII lower-cased. Running Karp-Rabin hashes of
``seed_words`` consecutive words of a document meet those of the benchmark in a join. Where a
document and an item share seeds, the longest match that touches no marked word is marked again
and again, on both sides, until none of ``seed_words`` words is left. The share of the item's
words that is marked is its coverage; it does not depend on the order of the passages.

A document's seeds first pass a bitmap of the benchmark's seeds of fixed size, so what is
shuffled is little more than real matches. An item shorter than ``seed_words`` words is one seed as
a whole, and matches documents that hold all of it. A seed's places in a document and in an item
are kept as two lists, so a passage that both repeat takes the sum of its places, not the product,
until a task tiles the two texts.

Null or empty texts match nothing. Rows with one doc_id and text are one document, as are items with
one item_id and text: a pair gives one row. Rows with one doc_id and different texts give one each.
A null doc_id or item_id is an id like others. Very long texts are read whole, one at a time. Other
columns of the input are not read. Empty tables give an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollatlas.llm import bytetext

SEED_WORDS = 5
MIN_COVERAGE = 0.5
#: Bits of the bitmap's address: a table of 4 MiB, whatever the benchmark's size.
SIEVE_BITS = 22
PAIRS = "matched_words long, longest_tile long, tiles long"


def _short_wholes(w: bytetext.Words, count: np.ndarray, seed_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of the texts with fewer than ``seed_words`` words, and their first words."""
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for n in range(1, seed_words):
        seed, at = bytetext.shingles(w.hash, w.row, n)
        whole = count[w.row[at]] == n
        found.append((_of_length(seed[whole], n), at[whole]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _of_length(seed: np.ndarray, n: int) -> np.ndarray:
    return bytetext.mix(seed + np.uint64(n))


def seed_rows(
    texts: DataFrame, id_col: str, text_col: str, seed_words: int, sieve: np.ndarray | None = None,
    lengths: tuple[int, ...] | None = None,
) -> DataFrame:
    """(id, version, n_words, pos, seed) of each text; only seeds in the sieve, if there is one.

    Without ``lengths`` a short text is a seed as a whole; with them, seeds of these numbers of
    words come beside those of ``seed_words``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in bytetext.steps(batch.column(2)):
                w = bytetext.words(bytetext.LOWER[data], offsets, bytetext.MARKS)
                count = np.bincount(w.row, minlength=end - first)
                seed, at = bytetext.shingles(w.hash, w.row, seed_words)
                more = [_short_wholes(w, count, seed_words)] if lengths is None else []
                for n in lengths or ():
                    short, place = bytetext.shingles(w.hash, w.row, n)
                    more.append((_of_length(short, n), place))
                seed = np.concatenate([seed, *[m[0] for m in more]])
                at = np.concatenate([at, *[m[1] for m in more]])
                if sieve is not None:
                    known = sieve[(seed >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)]
                    seed, at = seed[known], at[known]
                row = w.row[at]
                take = pa.array(row + first)
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column(0).take(take), "version": batch.column(1).take(take),
                    "n_words": pa.array(count[row], pa.int64()),
                    "pos": pa.array(at - (np.cumsum(count) - count)[row], pa.int64()),
                    "seed": pa.array(seed.view(np.int64)),
                })

    source = texts.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "id long, version long, n_words long, pos long, seed long")


def _runs(places: list[tuple[list[int], list[int]]]) -> list[tuple[int, int, int]]:
    """(place in one, place in the other, seeds) of the longest runs of seeds at consecutive places."""
    one = np.concatenate([np.repeat(np.array(a, np.int64), len(b)) for a, b in places])
    two = np.concatenate([np.tile(np.array(b, np.int64), len(a)) for a, b in places])
    order = np.lexsort((one, one - two))
    one, two = one[order], two[order]
    new = np.ones(len(one), bool)
    new[1:] = (one[1:] - two[1:] != one[:-1] - two[:-1]) | (one[1:] != one[:-1] + 1)
    first = np.flatnonzero(new)
    return list(zip(one[first].tolist(), two[first].tolist(), np.diff(first, append=len(one)).tolist()))


def tiles(places: list[tuple[list[int], list[int]]], seed_words: int) -> list[tuple[int, int, int]]:
    """(start in one, start in the other, words) of the tiles that greedy string tiling marks.

    ``places``: for each seed that the two texts share, its different places in either.
    """
    heap = [(-(n + seed_words - 1), a, b) for a, b, n in _runs(places)]
    heapq.heapify(heap)
    one: set[int] = set()
    two: set[int] = set()
    found = []
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        free = [a + i not in one and b + i not in two for i in range(n)]
        if all(free):
            found.append((a, b, n))
            one.update(range(a, a + n))
            two.update(range(b, b + n))
            continue
        start = None
        for i, ok in enumerate([*free, False]):
            if ok and start is None:
                start = i
            elif not ok and start is not None:
                if i - start >= seed_words:
                    heapq.heappush(heap, (start - i, a + start, b + start))
                start = None
    return found


def shared_passages(
    docs: DataFrame, benchmark: DataFrame, seed_words: int = SEED_WORDS, min_coverage: float = MIN_COVERAGE,
) -> DataFrame:
    """doc_id, item_id, item_words, matched_words, coverage, longest_tile and tiles of every
    document and benchmark item with enough of the item covered."""
    own = seed_rows(benchmark.select("item_id", "text").distinct(), "item_id", "text", seed_words)
    # At most as many values as the sieve has places.
    places = own.select(F.shiftrightunsigned("seed", 64 - SIEVE_BITS).alias("p")).distinct().toArrow()
    sieve = np.zeros(1 << SIEVE_BITS, bool)
    sieve[places.column("p").to_numpy()] = True
    # Numbers of words of short items, fewer than ``seed_words``.
    short = own.filter(F.col("n_words") < seed_words).select("n_words").distinct().collect()
    theirs = seed_rows(docs, "doc_id", "text", seed_words, sieve, tuple(sorted(r[0] for r in short)))
    theirs = theirs.groupBy("id", "version", "seed").agg(F.collect_set("pos").alias("pos"))
    items = own.select(
        F.col("id").alias("item_id"), F.col("version").alias("item_version"), F.col("n_words").alias("item_words"),
        F.col("pos").alias("item_pos"), "seed",
    ).groupBy("item_id", "item_version", "item_words", "seed").agg(F.collect_set("item_pos").alias("item_pos"))
    pairs = theirs.join(items, "seed").groupBy("id", "version", "item_id", "item_version", "item_words").agg(
        F.collect_list(F.struct("pos", "item_pos")).alias("places")
    )

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for words, places in zip(batch.column(2).to_pylist(), batch.column(3)):
                both = [(p["pos"], p["item_pos"]) for p in places.as_py()]
                size = [n for _, _, n in tiles(both, min(seed_words, words))]
                rows.append((sum(size), max(size), len(size)))
            more = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), *more],
                names=["doc_id", "item_id", "item_words", "matched_words", "longest_tile", "tiles"],
            )

    tiled = pairs.select("id", "item_id", "item_words", "places").mapInArrow(
        tile, "doc_id long, item_id long, item_words long, " + PAIRS
    )
    coverage = F.col("matched_words") / F.col("item_words")
    return tiled.withColumn("coverage", coverage).filter(F.col("coverage") >= min_coverage)


def contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """doc_id of the documents to leave out of training."""
    return shared_passages(docs, benchmark, **how).select("doc_id").distinct()
