"""Resampling towards a target distribution by hashed n-gram importance weights (operator 11).

Words: a table of 256 bytes lower-cases A-Z and blanks every other ASCII byte that is no digit or
letter, so ``bytes.split`` yields the words; bytes above 127 (UTF-8 of other scripts) belong to
words. Features are all runs of 1 to ``longest`` words joined by one space, repeats counted; the
crc32 of a run is the seed of the crc32 of the next longer one. Counters reduce features to
``buckets`` counts, for the documents (S, s in a bucket) and for the target (T, t). A bucket's gain
is ``floor(1000 * ln((t+1)(S+buckets) / ((s+1)(T+buckets))))`` in doubles, a document's weight the
floored mean of the gains of its features (0 without any).

A Gumbel number of ``<seed>:<doc_id>`` is added to the weight, and of the documents with at least
``min_words`` words the ``percent`` % with the highest scores are drawn, which samples without
replacement in proportion to the weights' exponentials. Ranks follow the score, ties the smaller
doc_id.

Null text counts as empty. A null doc_id counts as empty text in the draw and comes last in ties.
Repeated rows get one result each, and ranks of their own. An empty table gives an empty result,
an empty target equal gains. Very long texts are read in pieces that end between words, so memory
follows the piece. Columns of the input other than doc_id and text are not read.

Ranks need no global sort: scores are whole numbers, so counts per score, summed from the top, give
every score its first rank, and rows are numbered within their score. The Gumbel number spreads any
group of equal weights over thousands of scores (no score holds more than 0.04 % of them), and rows
repeated with one doc_id are counted before they are numbered.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollatlas.llm.shared import stage

LONGEST = 1
BUCKETS = 10_000
SEED = 2024
PERCENT = 10
MIN_WORDS = 20
#: Bytes of a text that are split into words at once.
PIECE_BYTES = 1 << 20
#: Words whose gain is remembered by a task.
KNOWN_WORDS = 1 << 17
#: Copies of a row that one array lists.
COPIES = 1 << 14

FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def word_lists(text: str) -> Iterator[list[bytes]]:
    """Words of a text, in lists of about ``PIECE_BYTES`` bytes; no word is cut."""
    raw = text.encode().translate(FOLD)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE_BYTES) if len(raw) - at > PIECE_BYTES else -1
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def longer_codes(words: list[bytes], codes: list[int]) -> list[int]:
    """Codes of runs one word longer than those of ``codes``, from the run that begins at each word."""
    n = len(words) - len(codes) + 1
    crc = zlib.crc32
    return [crc(word, crc(b" ", code)) for code, word in zip(codes, words[n:])]


def feature_counts(text: str, longest: int, buckets: int) -> tuple[Counter, int]:
    """(features in each bucket, number of words) of a text."""
    found: Counter = Counter()
    total = 0
    tail: list[bytes] = []
    for words in word_lists(text):
        total += len(words)
        for word, n in Counter(words).items():
            found[zlib.crc32(word) % buckets] += n
        if longest > 1:
            # Runs that begin in the piece before end in this one.
            joined = tail + words
            codes = [zlib.crc32(w) for w in joined]
            for size in range(2, longest + 1):
                codes = longer_codes(joined, codes)
                skip = max(0, len(tail) - size + 1)
                found.update(c % buckets for c in codes[skip:])
            tail = joined[-(longest - 1) :]
    return found, total


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket.

    Each task sends one row for each bucket, and the driver gets one, however many texts there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                found, _ = feature_counts(text.as_py() or "", longest, buckets)
                if found:
                    total[np.fromiter(found.keys(), np.int64, len(found))] += np.fromiter(found.values(), np.int64, len(found))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "n": pa.array(total[at])})

    partial = texts.select(F.col(text_col)).mapInArrow(run, "bucket int, n long")
    found = partial.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(buckets, np.int64)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """What a feature of each bucket adds to a text's weight, in thousandths of a natural logarithm."""
    buckets, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return [
        math.floor(1000 * math.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets))))
        for s, t in zip(source.tolist(), target.tolist())
    ]


class _Gains(dict):
    """Gain of each word, worked out once."""

    def __init__(self, table: list[int]):
        super().__init__()
        self.table = table

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        gain = self[word] = self.table[zlib.crc32(word) % len(self.table)]
        return gain


def weights(
    docs: DataFrame, table: list[int], id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST
) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Gains(table)
        for batch in batches:
            n_words, n_features, weight = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                if longest == 1:
                    words = features = total = 0
                    for part in word_lists(text):
                        words += len(part)
                        total += sum(map(known.__getitem__, part))
                    features = words
                else:
                    found, words = feature_counts(text, longest, len(table))
                    features = sum(found.values())
                    total = sum(table[b] * n for b, n in found.items())
                n_words.append(words)
                n_features.append(features)
                weight.append(total // features if features else 0)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n_words": pa.array(n_words, pa.int64()),
                "n_features": pa.array(n_features, pa.int64()), "weight": pa.array(weight, pa.int64()),
            })

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: int, id_col: str = "doc_id"):
    """The row's Gumbel number, in thousandths, of the first 32 bits of a digest of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    bits = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((bits + 0.5) / F.lit(4294967296.0))))


def draw(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, and rank of the drawn rows, of (.., n_words, score)."""
    fits = F.col("n_words") >= min_words
    kinds = stage(
        scored.groupBy("doc_id", "n_words", "n_features", "weight", "score").agg(F.count(F.lit(1)).alias("_copies")),
        "importance-rows",
    )
    # One row for each score that occurs: whole numbers from a span of some ten thousands.
    levels = kinds.filter(fits).groupBy("score").agg(F.sum("_copies").alias("_n"))
    down = Window.orderBy(F.desc("score"))
    ahead = F.sum("_n").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    asked = F.floor(F.sum("_n").over(Window.partitionBy(F.lit(0))) * percent / 100)
    first = levels.select("score", ahead.alias("_ahead"), asked.cast("long").alias("_asked")).filter("_ahead < _asked")
    able = kinds.filter(fits).join(first, "score", "left")
    inside = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_words", "n_features", "weight")
    before = F.sum("_copies").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_copies")
    placed = able.withColumn("_at", F.col("_ahead") + before)
    rest = kinds.filter(~fits).select("*", *[F.lit(None).cast("long").alias(c) for c in ("_ahead", "_asked", "_at")])
    every = placed.select(rest.columns).unionByName(rest)
    # A row for each copy, some thousands of them in an array at a time.
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(COPIES).cast("long")))
    parts = every.withColumn("_from", part)
    last = F.least(F.col("_from") + COPIES, F.col("_copies")) - 1
    each = parts.withColumn("_copy", F.explode(F.sequence("_from", last)))
    rank = F.col("_at") + F.col("_copy") + 1
    return each.select(
        "doc_id", "n_features", "weight", "score", F.when(rank <= F.col("_asked"), rank).alias("rank")
    )


def resample(
    docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT,
    min_words: int = MIN_WORDS, seed: int = SEED,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every document."""
    table = gains(
        bucket_counts(docs, longest=longest, buckets=buckets), bucket_counts(target, longest=longest, buckets=buckets)
    )
    scored = weights(docs, table, longest=longest).withColumn("score", F.col("weight") + gumbel(seed))
    return draw(scored, percent, min_words)


def drawn_documents(docs: DataFrame, ranked: DataFrame) -> DataFrame:
    """The rows of documents that ``resample`` drew, as they are; ids must be unique."""
    return docs.join(ranked.filter("rank IS NOT NULL").select("doc_id"), "doc_id", "left_semi")
