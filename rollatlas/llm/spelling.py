"""Spelling variants by permuterm rotations (operator 13).

Words: runs of ``[A-Za-z]`` and U+00C0 to U+00FF of whole texts, A-Z in lower case. Where ``every``
divides the unsigned crc32 h of the UTF-8 text ``<doc_id>:<run>``, the run loses its character
h % length, which plants misspellings. Results of at least ``min_chars`` characters that occur at
least ``min_count`` times in all texts together are the words, with their counts n.

Two words are near if one inserted, deleted or replaced character makes them equal. A word's form
is its near word of largest n (ties: the smallest in code-point order), if that n is at least
``factor`` times the word's own; its root is the last of the chain of forms.

1. Permuterm: every word is closed by a terminator and written in all its rotations. Where the
   last character of a rotation is a letter, the rest of it is the word without that letter, and
   a key: words that differ in just that letter have the same key (a replacement), and a word
   that lacks the letter has the key as a rotation of its own (an indel).
2. Rotations are sorted by key, so words that are near through one place stand side by side. A
   group holds at most the letters of the alphabet and one word without the letter, whatever the
   tables hold, and is scanned once: members are counted, and each gets the best of the others
   from the two best, so pairs are never written. Two words meet in one group only: of equal
   letters in a row, only the first counts as the one that is inserted.
3. Chains of forms are followed by doubling: each round joins roots with the roots of roots. A form
   has at least ``factor`` times the count, so chains have no cycle and are short.

Null text has no words; a null doc_id counts as empty text. Repeated rows count each. Very long texts
are read in pieces that end between runs. Empty tables, and tables without words, give an empty
result. Columns of the input other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollatlas.llm.shared import stage

EVERY = 97
MIN_CHARS = 5
MIN_COUNT = 3
FACTOR = 2
TERMINATOR = "$"
#: Characters of a text that are split into runs at once.
PIECE_CHARS = 1 << 20
#: Distinct words a task counts before it hands the counts on.
HELD_WORDS = 1 << 18

# Latin-1 letters; all other characters of the set count as blanks, and A-Z as a-z.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def run_lists(text: str) -> Iterator[list[bytes]]:
    """Lower-cased runs of a text in Latin-1, in lists of about ``PIECE_CHARS`` characters."""
    # Characters beyond Latin-1 become question marks, which part runs as they do.
    raw = text.encode("latin-1", "replace").translate(FOLD)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE_CHARS) if len(raw) - at > PIECE_CHARS else -1
        end = len(raw) if end < 0 else end
        yield raw[at:end].split(b" ")
        at = end


def planted(run: bytes, seed: int, every: int) -> bytes:
    """The run, without one character where ``every`` divides its code."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = EVERY,
    min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT,
) -> DataFrame:
    """(word, n) of all words."""

    def batch_of(total: Counter) -> pa.RecordBatch:
        words = [w.decode("latin-1") for w in total]
        return pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                seed = zlib.crc32(f"{name}:".encode())
                for runs in run_lists(text.as_py() or ""):
                    for word, n in Counter(runs).items():
                        if len(word) >= min_chars:
                            word = planted(word, seed, every)
                            if len(word) >= min_chars:
                                total[word] += n
                    if len(total) >= HELD_WORDS:
                        yield batch_of(total)
                        total.clear()
        yield batch_of(total)

    named = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    counts = named.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= min_count)


def rotations(words: DataFrame) -> DataFrame:
    """(key, word, n, skipped, counted) of every rotation of each word.

    ``skipped`` is the letter behind the key, null where the key is a whole rotation. ``counted``
    is false for a letter that follows an equal one.
    """
    size = F.length("word")
    marked = F.concat("word", F.lit(TERMINATOR))
    # The rotation that begins with the character at ``i`` (from 1), twice over for a plain cut.
    doubled = F.concat(marked, marked)

    def cut(i, length):
        return F.substr(doubled, i, length)

    whole = F.transform(
        F.sequence(F.lit(1), size + 1),
        lambda i: F.struct(cut(i, size + 1).alias("key"), F.lit(None).cast("string").alias("skipped"), F.lit(True).alias("counted")),
    )
    less = F.transform(
        F.sequence(F.lit(1), size),
        lambda i: F.struct(
            cut(i + 1, size).alias("key"), cut(i, F.lit(1)).alias("skipped"),
            ((i == 1) | (cut(i, F.lit(1)) != cut(i + size, F.lit(1)))).alias("counted"),
        ),
    )
    both = words.select("word", "n", F.explode(F.concat(whole, less)).alias("r"))
    return both.select("r.key", "word", "n", "r.skipped", "r.counted")


class _Best:
    """Number of words and the two best of them."""

    def __init__(self):
        self.count, self.first, self.second = 0, None, None

    def add(self, item: tuple[int, str]) -> None:
        self.count += 1
        if self.first is None or item < self.first:
            self.first, self.second = item, self.first
        elif self.second is None or item < self.second:
            self.second = item

    def without(self, item: tuple[int, str]) -> tuple[int, str] | None:
        return self.second if item == self.first else self.first


def scan_group(members: list[tuple[str, int, str | None, bool]]) -> Iterator[tuple[str, int, tuple[int, str]]]:
    """(word, number of near words, best of them as (-n, word)) of (word, n, skipped, counted)
    with one key; words without near ones are left out."""
    replaced, inserted, whole = _Best(), _Best(), None
    for word, n, skipped, counted in members:
        if skipped is None:
            whole = (-n, word)
        else:
            replaced.add((-n, word))
            if counted:
                inserted.add((-n, word))
    for word, n, skipped, counted in members:
        if skipped is not None:
            near, best = replaced.count - 1, replaced.without((-n, word))
            if counted and whole is not None:
                near, best = near + 1, whole if best is None else min(best, whole)
            if near:
                yield word, near, best
    if whole is not None and inserted.count:
        yield whole[1], inserted.count, inserted.first


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best) of the words that have near ones; best is (n, word) of the best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
            same = same_as_before(rows.column(0))
            # The last group may go on in the next batch.
            last = int(np.flatnonzero(~same)[-1])
            yield batch_of(scan(rows.slice(0, last), same[:last]))
            held = rows.slice(last).combine_chunks()
        if held is not None:
            yield batch_of(scan(held, same_as_before(held.column(0))))

    def same_as_before(keys: pa.ChunkedArray) -> np.ndarray:
        same = np.zeros(len(keys), bool)
        same[1:] = pc.equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False) if len(keys) > 1 else []
        return same

    def scan(rows: pa.Table, same: np.ndarray) -> list[tuple]:
        # Most keys are one word's alone; only the others leave Arrow.
        shared = same | np.append(same[1:], False)
        at = np.flatnonzero(shared)
        kept = rows.take(pa.array(at))
        members = list(zip(*[kept.column(c).to_pylist() for c in range(1, kept.num_columns)]))
        begin = [*np.flatnonzero(~same[at]).tolist(), len(members)]
        return [found for i, j in zip(begin, begin[1:]) for found in scan_group(members[i:j])]

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "word": pa.array([f[0] for f in found], pa.string()), "near": pa.array([f[1] for f in found], pa.int64()),
            "n": pa.array([-f[2][0] for f in found], pa.int64()), "other": pa.array([f[2][1] for f in found], pa.string()),
        })

    turned = rotations(words)
    # A key lies in one task: the exchange deals by key, and the sort brings its rows together.
    sorted_keys = turned.repartition("key").sortWithinPartitions("key")
    found = sorted_keys.select("key", "word", "n", "skipped", "counted").mapInArrow(run, "word string, near long, n long, other string")
    best = F.min_by(F.struct("n", "other"), F.struct((-F.col("n")).alias("n"), "other"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of (word, form) links without cycles."""
    found = stage(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = found.join(further, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")
        )
        step = stage(step, "spelling-roots")
        if step.filter("moved").isEmpty():
            return step.select("word", "root")
        found = step.drop("moved")


def spelling_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = EVERY,
    min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, factor: int = FACTOR,
) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    words = stage(word_counts(docs, id_col, text_col, every, min_chars, min_count), "spelling-words")
    near = near_words(words)
    strong = F.col("best.n") >= factor * F.col("n")
    formed = stage(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(strong, F.col("best.other")).alias("form"), F.when(strong, F.col("best.n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    last = roots(formed.filter("form IS NOT NULL"))
    joined = formed.join(last, "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
