"""Exact repeated passages across documents by sharded suffix arrays (operator 10).

A byte is covered if it lies in a ``length``-byte string that also starts at another place, in
the same text or another. Texts are UTF-8 bytes and matches never cross texts.

1. Anchors: of every ``length``-byte window, the places of its least hash of ``GRAM`` bytes.
   They hang on the window's bytes alone, so equal windows have equal anchors.
2. Anchors whose hash occurs once cannot lie in a repeated window and are dropped. Around each
   other anchor the bytes that windows with it can reach make a region.
3. Regions go to shards by their anchor's hash, so any two equal windows meet in a shard. Equal
   regions count as repeated at once and stand there once. Of the others a shard keeps what lies
   around anchors of strings nearly as long as a window that occur again, mostly less than half,
   and equal stretches of that once. The suffix array of the string of these and its permuted
   common prefixes tell which windows occur again.
4. A hash whose regions would fill a good part of a shard is no shard key. Those regions get
   anchors anew, of longer strings (``finer``), which equal windows share just so. Equal regions
   are counted by a digest of their bytes, one of them goes on, and only different ones go to
   shards or, where they are too many again, to the next longer strings. At the last, strings are
   whole windows, and their digests tell which occur again.

A text that is there more than once is covered whole if it has ``length`` bytes or more; one of
its rows stands for it in the steps above, so groups of copies cost no more than one text. Null
counts as empty. Texts shorter than ``length`` are left alone.

Where a number of words is given as well, a byte is also covered if it lies in a run of so many
words that also begins at another place, whatever its bytes are. Words are runs of ASCII letters
and digits and of all other scripts, A-Z count as a-z, and what stands between words does not
matter. Anchors of runs are the places of their least hash of ``WORD_GRAM`` words; runs whose
anchor occurs once are dropped, and the others' 64-bit hashes are counted by Spark. A text that is
there more than once is covered whole if it has so many words.

Repeated rows count as copies, and an empty table gives an empty result. Very long texts are read
in overlapping steps while anchors are looked for; a task holds such a text once or twice. Columns
that are not read may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollatlas.llm import bytetext, suffixes
from rollatlas.llm.shared import stage

LENGTH = 400
GRAM = 32
#: Words of the strings that anchor runs of words.
WORD_GRAM = 8
#: A word, as a pattern of characters.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of regions that a shard is meant to hold.
SHARD_BYTES = 3 << 20
#: A hash whose regions hold more than this part of ``SHARD_BYTES`` is split.
HOT_PART = 4
#: Windows of a long text that are looked at together.
LONG_STEP = 1 << 20
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, from block-wise running minima."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, _LAST)
    blocks[:n] = values
    square = blocks.reshape(-1, width)
    left = np.minimum.accumulate(square, axis=1).reshape(-1)
    right = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def _least_places(hashes: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """Places of the hashes that are the least of a window; 0 in ``least`` marks what is no window."""
    none = np.zeros(width - 1, np.uint64)
    most = ~_least(~np.concatenate([none, least, none]), width)
    return np.flatnonzero((hashes == most) & (most > 0) & (hashes != _LAST))


def anchors(
    data: np.ndarray, offsets: np.ndarray, length: int, gram: int, step: int = LONG_STEP
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the row, hash) of the least hashes of all windows of ``length`` bytes.

    A single text of more than ``step`` windows is read in steps of so many, which overlap by
    ``length - 1`` bytes: every window lies in one of them, and memory follows the step.
    """
    if len(offsets) != 2 or len(data) < step + length:
        return _anchors(data, offsets, length, gram)
    found = []
    for at in range(0, len(data) - length + 1, step):
        piece = data[at : at + step + length - 1]
        _, place, value = _anchors(piece, np.array([0, len(piece)]), length, gram)
        found.append((place + at, value))
    # A string may be the least of windows of two steps.
    place, first = np.unique(np.concatenate([f[0] for f in found]), return_index=True)
    return np.zeros(len(place), np.int64), place, np.concatenate([f[1] for f in found])[first]


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, width = len(data), length - gram + 1
    size = np.diff(offsets)
    if n < length or (size < length).all():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = bytetext.prefix_sums(data)
    at = np.arange(n - gram + 1)
    hashes = bytetext.span_hash(sums, at, at + gram)
    # All ones mark grams over a border; no real hash is to look like one.
    hashes[hashes == _LAST] = _LAST - np.uint64(1)
    for j in range(gram - 1):
        border = offsets[1:-1] - 1 - j
        hashes[border[(border >= 0) & (border < len(hashes))]] = _LAST
    least = _least(hashes, width)
    # A window begins where ``length`` bytes of its row are left.
    room = np.repeat(offsets[1:], size)[: len(least)] - np.arange(len(least))
    least[room < length] = 0
    place = _least_places(hashes, least, width)
    row = np.searchsorted(offsets, place, side="right") - 1
    return row, place - offsets[row], hashes[place]


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def text_key(column: str = "text") -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(_text(column)))


def finer(length: int, gram: int) -> int:
    """The next longer strings after ``gram``; ``length`` is the last."""
    return length - (length - gram) // 8


def _anchor_runs(
    data: np.ndarray, offsets: np.ndarray, length: int, gram: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, first, last) of runs of near anchors with one hash, in order."""
    row, place, value = anchors(data, offsets, length, gram)
    order = np.lexsort((place, value, row))
    row, place, value = row[order], place[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1]) | (place[1:] - place[:-1] > length)
    if gram == length:
        # Nothing checks these later, so a run holds equal windows, not only equal hashes.
        raw, at = memoryview(data), offsets[row] + place
        for i in np.flatnonzero(~new).tolist():
            new[i] = raw[at[i - 1] : at[i - 1] + length] != raw[at[i] : at[i] + length]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row))[: len(first)] - 1
    return row[first], value[first], place[first], place[last]


def anchor_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(hash, key, first, last) of runs of near anchors with one hash, of (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, _, data, offsets in bytetext.steps(batch.column(1)):
                row, value, first, last = _anchor_runs(data, offsets, length, gram)
                yield pa.RecordBatch.from_pydict({
                    "hash": pa.array(value.view(np.int64)),
                    "key": batch.column(0).take(pa.array(row + begin)),
                    "first": pa.array(first, pa.int32()),
                    "last": pa.array(last, pa.int32()),
                })

    return texts.select("key", "text").mapInArrow(run, "hash long, key binary, first int, last int")


def regions(marked: DataFrame, shards: int) -> DataFrame:
    """(shard, key, start, bytes) of (key, at, bytes, places of hash, hot, from, to).

    ``at`` is the place of the bytes in their text. Hot places have shard -1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytetext.text_bytes(batch.column(2))
            lists = batch.column(3)
            flat = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            shard = (flat.field(0).to_numpy().view(np.uint64) % np.uint64(shards)).astype(np.int64)
            shard[flat.field(1).to_numpy(zero_copy_only=False).astype(bool)] = -1
            at = batch.column(1).to_numpy().astype(np.int64)
            start = flat.field(2).to_numpy().astype(np.int64) - at[row]
            end = np.minimum(flat.field(3).to_numpy().astype(np.int64) - at[row], np.diff(offsets)[row])
            # Overlapping regions of a text in one shard become one, so that no byte is there twice.
            order = np.lexsort((start, shard, row))
            row, shard, start, end = row[order], shard[order], start[order], end[order]
            group = np.ones(len(row), bool)
            group[1:] = (row[1:] != row[:-1]) | (shard[1:] != shard[:-1])
            new, reached = group.copy(), 0
            for i, (s, e, g) in enumerate(zip(start.tolist(), end.tolist(), group.tolist())):
                if g or s > reached:
                    new[i], reached = True, e
                else:
                    reached = max(reached, e)
            head = np.flatnonzero(new)
            end = np.maximum.reduceat(end, head) if len(head) else end
            row, shard, start = row[head], shard[head], start[head]
            raw, base = memoryview(data), offsets[row]
            # Some megabytes at a time: overlapping shards repeat bytes.
            for lo in range(0, len(head), 4096):
                cut = slice(lo, lo + 4096)
                parts = [raw[b + s : b + e] for b, s, e in zip(base[cut].tolist(), start[cut].tolist(), end[cut].tolist())]
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array(shard[cut]),
                    "key": batch.column(0).take(pa.array(row[cut])),
                    "start": pa.array(at[row[cut]] + start[cut], pa.int32()),
                    "bytes": pa.array([bytes(p) for p in parts], pa.binary()),
                })

    return marked.mapInArrow(run, "shard long, key binary, start int, bytes binary")


def region_rows(pieces: DataFrame, length: int, gram: int) -> DataFrame:
    """(hash, digest, key, at, from, to, own) of the regions around the anchors of (key, at, bytes).

    ``own``: there are several anchors with that hash in the region. Where ``gram`` is ``length``
    a region is a run of equal windows and the digest is that of one.
    """
    reach = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(1).to_numpy().astype(np.int64)
            for begin, _, data, offsets in bytetext.steps(batch.column(2)):
                row, value, first, last = _anchor_runs(data, offsets, length, gram)
                start = np.maximum(first - reach, 0)
                end = np.minimum(last + length, np.diff(offsets)[row])
                if reach:
                    new = np.ones(len(row), bool)
                    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1]) | (start[1:] > end[:-1])
                    head = np.flatnonzero(new)
                    tail = np.append(head[1:], len(row))[: len(head)] - 1
                    row, value, start, end = row[head], value[head], start[head], end[tail]
                    first, last = first[head], last[tail]
                raw, base = memoryview(data), offsets[row]
                upto = end if reach else start + length
                digest = [
                    hashlib.blake2b(raw[b + s : b + e], digest_size=16).digest()
                    for b, s, e in zip(base.tolist(), start.tolist(), upto.tolist())
                ]
                place = at[row + begin]
                yield pa.RecordBatch.from_pydict({
                    "hash": pa.array(value.view(np.int64)), "digest": pa.array(digest, pa.binary()),
                    "key": batch.column(0).take(pa.array(row + begin)), "at": pa.array(place, pa.int32()),
                    "from": pa.array(place + start, pa.int32()), "to": pa.array(place + end, pa.int32()),
                    "own": pa.array(first < last),
                })

    return pieces.select("key", "at", "bytes").mapInArrow(
        run, "hash long, digest binary, key binary, at int, from int, to int, own boolean"
    )


def repeated_starts(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each of the different ``parts``, a mask of the places whose ``length`` bytes occur
    at another place of any part."""
    size = np.array([len(p) for p in parts])
    t = np.ones(int(size.sum()) + len(parts) + 1, np.int32)
    begin = np.cumsum(size + 1) - size - 1
    whole = np.frombuffer(b"".join(parts), np.uint8)
    inside = np.ones(len(t) - 1, bool)
    inside[begin + size] = False
    t[:-1][inside] = whole.astype(np.int32) + 2
    t[-1] = 0
    array = suffixes.suffix_array(t)
    shared = suffixes.permuted_common_prefixes(t, array)
    again = shared >= length
    again[array[:-1]] |= shared[array[1:]] >= length
    out = []
    for b, n in zip(begin.tolist(), size.tolist()):
        mask = again[b : b + n].copy()
        mask[max(0, n - length + 1) :] = False
        out.append(mask)
    return out


def likely_stretches(parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, from, to) of the stretches of the different ``parts`` that can hold windows of
    ``length`` bytes that occur again: around anchors of strings nearly as long that occur again."""
    gram = length - length // 8
    found = []
    for begin, _, data, offsets in bytetext.steps(pa.array(parts, pa.binary())):
        row, value, first, last = _anchor_runs(data, offsets, length, gram)
        end = np.minimum(last + length, np.diff(offsets)[row])
        found.append((row + begin, value, np.maximum(first - (length - gram), 0), end, first < last))
    none = np.zeros(0, np.int64)
    row, value, start, end, own = (np.concatenate(f) for f in zip((none, none.view(np.uint64), none, none, none == 1), *found))
    _, which, times = np.unique(value, return_inverse=True, return_counts=True)
    keep = np.flatnonzero((times[which] > 1) | own)
    keep = keep[np.lexsort((start[keep], row[keep]))]
    row, start, end = row[keep], start[keep], end[keep]
    if not len(row):
        return row, start, end
    # Ends made to rise from part to part: one running maximum tells where a stretch is left.
    far = row * (int(end.max()) + 1)
    reached = np.maximum.accumulate(far + end)
    new = np.ones(len(row), bool)
    new[1:] = far[1:] + start[1:] > reached[:-1]
    new[1:] |= row[1:] != row[:-1]
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(row)) - 1
    return row[head], start[head], (reached - far)[tail]


def _runs(mask: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge[::2].tolist(), edge[1::2].tolist()


def covered(cut: DataFrame, length: int) -> DataFrame:
    """(key, from, to) stretches of covered bytes found in each shard of regions."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        where: dict[bytes, list[int]] = {}
        for i, part in enumerate(table.column("bytes").to_pylist()):
            where.setdefault(part, []).append(i)
        start = table.column("start").to_pylist()
        take, low, high = [], [], []
        parts = list(where)

        def add(rows: list[int], stretches: list[tuple[int, int]]) -> None:
            for i in rows:
                for a, b in stretches:
                    take.append(i)
                    low.append(start[i] + a)
                    high.append(start[i] + b)

        cuts: dict[bytes, list[tuple[bytes, int]]] = {}
        for number, a, b in zip(*(x.tolist() for x in likely_stretches(parts, length))):
            cuts.setdefault(parts[number][a:b], []).append((parts[number], a))
        for part, rows in where.items():
            if len(rows) > 1:
                add(rows, [(0, len(part))])
        for (cut, places), mask in zip(cuts.items(), repeated_starts(list(cuts), length) if cuts else []):
            stretches = [(0, len(cut))] if len(places) > 1 else [(a, b - 1 + length) for a, b in zip(*_runs(mask))]
            for part, at in places:
                # Of a part that is there several times all is covered already.
                if len(where[part]) == 1:
                    add(where[part], [(at + a, at + b) for a, b in stretches])
        return pa.table({
            "key": table.column("key").take(pa.array(take, pa.int64())),
            "from": pa.array(low, pa.int32()), "to": pa.array(high, pa.int32()),
        })

    return cut.groupBy("shard").applyInArrow(run, "key binary, from int, to int")


def _word_steps(
    column: pa.Array, words: int, step: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, offsets, place of the bytes in their text) of runs of texts.

    A text of more than ``step`` bytes is read in pieces that end between words and overlap by
    ``words - 1`` words, so every run of ``words`` words lies in just one of them.
    """
    for begin, _, data, offsets in bytetext.steps(column):
        if len(offsets) != 2 or len(data) <= step:
            yield begin, data, offsets, 0
            continue
        apart = bytetext.MARKS[data]
        gaps = np.flatnonzero(apart)
        at, upto = 0, step
        while True:
            after = int(np.searchsorted(gaps, upto))
            end = int(gaps[after]) if after < len(gaps) else len(data)
            inside = ~apart[at:end]
            first = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]))
            if len(first) >= words or end == len(data):
                yield begin, data[at:end], np.array([0, end - at]), at
                if end == len(data):
                    break
                at += int(first[len(first) - words + 1]) if words > 1 else end - at
            upto = end + step


def _word_windows(data: np.ndarray, offsets: np.ndarray, words: int, gram: int) -> tuple[bytetext.Words, np.ndarray, np.ndarray]:
    """Words of texts, hash of the ``gram`` words from each, and the least of these in the
    ``words`` words from each (0: so many are not left in the text)."""
    found = bytetext.words(bytetext.LOWER[data], offsets, bytetext.MARKS)
    n = len(found.row)
    if n < words:
        return found, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    hashes = np.full(n - gram + 1, _LAST)
    value, at = bytetext.shingles(found.hash, found.row, gram)
    hashes[at] = np.minimum(value, _LAST - np.uint64(1))
    least = _least(hashes, words - gram + 1)
    least[found.row[: n - words + 1] != found.row[words - 1 :]] = 0
    return found, hashes, least


def word_anchor_rows(texts: DataFrame, words: int, gram: int, step: int = LONG_STEP) -> DataFrame:
    """(hash, key, place) of the anchors of all runs of ``words`` words, of (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, data, offsets, shift in _word_steps(batch.column(1), words, step):
                found, hashes, least = _word_windows(data, offsets, words, gram)
                if not len(least):
                    continue
                place = _least_places(hashes, least, words - gram + 1)
                row = found.row[place]
                yield pa.RecordBatch.from_pydict({
                    "hash": pa.array(hashes[place].view(np.int64)),
                    "key": batch.column(0).take(pa.array(row + begin)),
                    "place": pa.array(found.start[place] - offsets[row] + shift, pa.int32()),
                })

    return texts.select("key", "text").mapInArrow(run, "hash long, key binary, place int")


def word_runs(marked: DataFrame, words: int, gram: int, step: int = LONG_STEP) -> DataFrame:
    """(run, key, from, to): hash and bytes of the runs of ``words`` words whose anchor is one of
    ``grams``, of (key, text, grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = np.unique(batch.column(2).flatten().to_numpy().view(np.uint64))
            for begin, data, offsets, shift in _word_steps(batch.column(1), words, step):
                found, _, least = _word_windows(data, offsets, words, gram)
                place = np.flatnonzero((least > 0) & np.isin(least, known))
                if not len(place):
                    continue
                value, at = bytetext.shingles(found.hash, found.row, words)
                row = found.row[place]
                yield pa.RecordBatch.from_pydict({
                    "run": pa.array(value[np.searchsorted(at, place)].view(np.int64)),
                    "key": batch.column(0).take(pa.array(row + begin)),
                    "from": pa.array(found.start[place] - offsets[row] + shift, pa.int32()),
                    "to": pa.array(found.end[place + words - 1] - offsets[row] + shift, pa.int32()),
                })

    return marked.select("key", "text", "grams").mapInArrow(run, "run long, key binary, from int, to int")


def _repeated_runs(marked: DataFrame, words: int, gram: int) -> DataFrame:
    """(key, from, to) of the runs of ``words`` words of (key, text, grams) that are there again.

    They are found a second time for the join, which is cheaper than to keep them on disk.
    """
    runs = word_runs(marked.filter("grams is not null"), words, gram)
    again = runs.groupBy("run").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("run")
    return runs.join(again, "run", "left_semi").select("key", "from", "to")


def _union(low: list[int], high: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(low, high)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _crowded(cut: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, from, to) stretches of covered bytes of the hot regions, those of shard -1, in ``cut``."""
    out = []
    while True:
        pieces = cut.filter("shard = -1").select("key", F.col("start").alias("at"), "bytes")
        gram = finer(length, gram)
        rows = stage(region_rows(pieces, length, gram), "repeat-split")
        kinds = stage(
            rows.groupBy("hash", "digest").agg(
                F.count(F.lit(1)).alias("n"), F.max("own").alias("own"), F.min(F.struct("key", "at", "from", "to")).alias("one")
            ),
            "repeat-kinds",
        )
        # What is there several times is covered whole; one of it meets what is not the same.
        again = kinds.filter("n > 1").select("hash", "digest")
        out.append(rows.join(again, ["hash", "digest"], "left_semi").select("key", "from", "to"))
        if gram == length:
            out.append(rows.filter("own").select("key", "from", "to"))
            break
        size = F.sum(F.col("one.to") - F.col("one.from"))
        each = kinds.groupBy("hash").agg(size.alias("size"), F.count(F.lit(1)).alias("kinds"), F.max("own").alias("own"))
        each = stage(
            each.filter("kinds > 1 or own").select("hash", "size", (F.col("size") > SHARD_BYTES // HOT_PART).alias("hot")),
            "repeat-hashes",
        )
        cold, hot = _totals(each)
        one = kinds.join(each.select("hash", "hot"), "hash").select("one.*", "hash", "hot")
        places = one.groupBy("key", "at").agg(F.collect_list(F.struct("hash", "hot", "from", "to")).alias("places"))
        marked = pieces.join(places, ["key", "at"]).select("key", "at", "bytes", "places")
        cut = stage(regions(marked, max(1, cold // SHARD_BYTES)), "repeat-cut")
        out.append(covered(cut.filter("shard >= 0"), length))
        if not hot:
            break
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def _totals(sized: DataFrame) -> tuple[int, bool]:
    """Bytes of what is not hot, and whether there is something hot, of (size, hot)."""
    cold = F.sum(F.when(F.col("hot"), 0).otherwise(F.col("size")))
    row = sized.agg(F.coalesce(cold, F.lit(0)).alias("cold"), F.coalesce(F.max("hot"), F.lit(False)).alias("hot")).first()
    return int(row.cold), row.hot


def _repeats(
    docs: DataFrame, text_col: str, length: int, gram: int, words: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(key, text) of texts looked into and (key, found: from and to) of those with covered bytes,
    of texts that are there once."""
    source = docs.select(text_key(text_col).alias("key"), _text(text_col).alias("text"))
    found = stage(anchor_rows(source, length, gram).distinct(), "repeat-anchors")
    # A run of anchors with one hash in one text is a repeat in itself.
    times = F.sum(F.when(F.col("first") < F.col("last"), 2).otherwise(1))
    size = F.col("last") - F.col("first") + 2 * length
    often = found.groupBy("hash").agg(times.alias("n"), F.sum(size).alias("all")).filter("n > 1")
    often = often.select("hash", (F.col("all") > SHARD_BYTES // HOT_PART).alias("hot"))
    hits = stage(found.join(often, "hash").select("*", size.alias("size")), "repeat-hits")
    cold, hot = _totals(hits)
    place = F.struct(
        "hash", "hot", F.greatest(F.col("first") - (length - gram), F.lit(0)).alias("from"), (F.col("last") + length).alias("to")
    )
    places = hits.groupBy("key").agg(F.collect_list(place).alias("places"))
    if words is None:
        once = source.filter(F.octet_length("text") >= length).dropDuplicates(["key"])
        marked = stage(once.join(places, "key"), "repeat-texts")
    else:
        said = word_anchor_rows(source, words, min(WORD_GRAM, words)).distinct()
        again = said.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash")
        grams = said.join(again, "hash", "left_semi").groupBy("key").agg(F.collect_set("hash").alias("grams"))
        grams = stage(grams, "repeat-grams")
        once = source.filter(F.octet_length("text") >= min(length, 2 * words - 1)).dropDuplicates(["key"])
        marked = stage(once.join(places.join(grams, "key", "full"), "key"), "repeat-texts")
    cut = marked.filter("places is not null").select("key", F.lit(0).alias("at"), "text", "places")
    cut = regions(cut, max(1, cold // SHARD_BYTES))
    if hot:
        cut = stage(cut, "repeat-cut")
    spans = covered(cut.filter("shard >= 0") if hot else cut, length)
    if hot:
        spans = spans.unionByName(_crowded(cut, length, gram))
    both = F.collect_list(F.struct("from", "to"))
    lists = spans.groupBy("key").agg(both.alias("found"))
    if words is not None:
        # One after the other, so that the shuffle files of one are gone when the next begins.
        runs = stage(_repeated_runs(marked, words, min(WORD_GRAM, words)).groupBy("key").agg(both.alias("runs")), "repeat-runs")
        found = F.concat(*[F.coalesce(c, F.array().cast(lists.schema["found"].dataType)) for c in ("found", "runs")])
        lists = stage(lists.join(runs, "key", "full").select("key", found.alias("found")), "repeat-spans")
    return marked.select("key", "text"), lists


def repeated_texts(docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, text, spans of from and to) of the texts with covered bytes that are there once."""
    marked, lists = _repeats(docs, text_col, length, gram)
    return marked.join(lists, "key")


def repeat_digests(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, digest = [], [], []
            data, offsets = bytetext.text_bytes(batch.column(1))
            raw = data.tobytes()
            for row, found in enumerate(batch.column(2).to_pylist()):
                text = raw[offsets[row] : offsets[row + 1]]
                stretches = _union([f["from"] for f in found], [f["to"] for f in found])
                kept = hashlib.sha256()
                at = 0
                for a, b in stretches:
                    kept.update(text[at:a])
                    at = b
                kept.update(text[at:])
                removed.append(sum(b - a for a, b in stretches))
                spans.append(len(stretches))
                digest.append(kept.hexdigest())
            yield pa.RecordBatch.from_pydict({
                "key": batch.column(0), "removed": pa.array(removed, pa.int64()),
                "spans": pa.array(spans, pa.int64()), "digest": pa.array(digest, pa.string()),
            })

    text = _text(text_col)
    rows = stage(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("key"),
            F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"),
        ),
        "repeat-rows",
    )
    copies = rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    found = repeated_texts(docs, text_col, length, gram).mapInArrow(
        run, "key binary, removed long, spans long, digest string"
    )
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    joined = rows.join(copies.join(found, "key", "left"), "key")
    return joined.select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("digest", "whole")).alias("kept_sha256"),
    )


def without_repeats(
    docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, words: int | None = None,
) -> DataFrame:
    """The documents with covered bytes cut out of their text; a text of which nothing is left is
    null, null stays null, and half a character at a cut goes with it.

    With ``words``, runs of so many words that occur again are covered too.
    """

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, found in zip(texts.to_pylist(), spans.to_pylist()):
            if found is None:
                out.append(None)
                continue
            raw, at, kept = text.encode(), 0, []
            for a, b in _union([f["from"] for f in found], [f["to"] for f in found]):
                kept.append(raw[at:a].decode("utf-8", "ignore"))
                at = b
            kept.append(raw[at:].decode("utf-8", "ignore"))
            out.append("".join(kept))
        return pa.array(out, pa.string())

    names = docs.columns
    keyed = docs.withColumn("_key", text_key(text_col))
    copies = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_copies")).filter("_copies > 1")
    lists = _repeats(docs, text_col, length, gram, words)[1].select(F.col("key").alias("_key"), F.col("found").alias("_found"))
    joined = keyed.join(copies.join(lists, "_key", "full"), "_key", "left")
    whole = F.octet_length(text_col) >= length
    if words is not None:
        whole = whole | (F.regexp_count(text_col, F.lit(WORD)) >= words)
    # Of the other texts nothing goes to Python.
    left = cut.asNondeterministic()(F.when(F.col("_found").isNotNull(), F.col(text_col)), F.col("_found"))
    text = F.when((F.col("_copies") > 1) & whole, F.lit(None)).when(F.col("_found").isNull(), F.col(text_col))
    return joined.withColumn("_left", left).withColumn(text_col, text.otherwise(F.when(F.col("_left") != "", F.col("_left")))).select(*names)
