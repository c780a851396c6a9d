"""Exact Jaccard links between documents' word shingle sets (operator 5).

Sets are banded by size so that a set can only link with sets of its own band or a neighbour.
Within a band two linked sets differ in at most ``limit`` shingles (symmetric difference). The
universe of shingles is hashed into segments. With ``limit + 1`` segments, one is equal in both
sets (pigeonhole). Some segments may instead be compared up to one deletion, which counts for
two. ``spare`` segments more than needed let each set give up its most crowded ones without losing
a link. Each band gets spare segments, or half as many segments with a deletion each, whichever
costs less by estimate: rows written, plus sets that share a segment by chance.

Sets that share a segment are verified exactly. In a crowded segment all are first compared with
one of them, so groups of near copies need one comparison for each member. What shares segments
and is still in different components is compared in blocks of sets, as matrix products that
return links and no pairs; so no link between components is lost. Texts that are there more than once are compared once.

Words are stretches without ASCII white space, A-Z lower-cased. A shingle's identity is 52 bits
of its hash. A text without words has an empty set and links with nothing; one of fewer words
than a shingle has one shingle, all its words. Rows with null doc_id get their set's size and no
component. Rows with one doc_id are one document; of different texts under one id the one with the
smallest digest is compared. An empty table gives an empty result. Very long texts are read in pieces
that overlap by three words; their set is held whole. Other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollatlas.llm import bytetext
from rollatlas.llm.components import components
from rollatlas.llm.repeats import text_key
from rollatlas.llm.shared import stage

WORDS = 4
PERCENT = 85
#: Segments shared by at most so many sets have all their pairs compared at once.
FEW = 6
#: Bytes and number of sets in a block that is compared with other blocks in one task.
BLOCK_BYTES = 4 << 20
BLOCK_ROWS = 512
#: Shingles that are counted together in one block.
BLOCK_SHINGLES = 4096
#: Texts for each task that looks for equal segments.
TASK_TEXTS = 8000
#: Texts for each file of a staged table, and the number of files from which that counts.
FILE_TEXTS = 16000
LEAST_FILES = 8
#: Steps of a text column hold at most so many rows, which leaves 52 bits for a shingle.
STEP_ROWS = 4096
#: Bytes of a long text that are looked at together.
LONG_TEXT = 2 << 20
_SEGMENT = np.uint64(0xC2B2AE3D27D4EB4F)
_BAND = np.uint64(0x165667B19E3779F9)


@dataclass
class Bands:
    """For each band: least size, segments, segments with one deletion, and segments to spare."""

    least: np.ndarray
    segments: np.ndarray
    deletions: np.ndarray
    spare: np.ndarray


def _at_least(n: int, mean: float) -> float:
    """Probability that a Poisson number with this mean is ``n`` or more."""
    if n > mean + 12 * math.sqrt(mean) + 12:
        return 0.0
    term = below = math.exp(-mean)
    for i in range(1, n):
        term *= mean / i
        below += term
    return max(0.0, 1 - below)


def bands(texts: int, percent: int = PERCENT) -> Bands:
    least = [1]
    while least[-1] < 1 << 40:
        least.append(least[-1] * 100 // percent + 1)
    rows = []
    each = max(1, texts / 10)
    for low, following in zip(least, least[1:]):
        # 100 * both >= percent * (all - both) bounds what two sets differ in.
        limit = 2 * (following - 1) * (100 - percent) // (100 + percent)
        best = None
        plenty = limit + 3 + math.ceil(0.3 * limit) if limit else 1
        half = limit // 2 + 1
        for segments, deletions in ((plenty, 0), (half, half)):
            spare = segments + deletions - limit - 1
            size = (low + following) / 2 / segments
            written = segments + deletions * size
            # A segment without shingles is shared by chance, and given up as far as there are
            # segments to spare. One with a shingle at most is so where a deletion is allowed.
            plain = segments - deletions
            chance = each / 2 * (
                plain * math.exp(-2 * size) * _at_least(spare + 1, plain * math.exp(-size))
                + deletions * ((1 + size) * math.exp(-size)) ** 2
            )
            if best is None or written + chance < best[0]:
                best = (written + chance, segments, deletions, spare)
        rows.append((low, *best[1:]))
    return Bands(*(np.array(x, np.int64) for x in zip(*rows)))


def _pieces(data: np.ndarray, n_words: int, size: int) -> Iterator[np.ndarray]:
    """A text in pieces of about ``size`` bytes that begin and end between words and overlap by
    one word less than a shingle has, so that every shingle lies in one of them."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while True:
            gap = np.flatnonzero(bytetext.SPACES[data[end : end + size]])
            end = end + int(gap[0]) if len(gap) else min(end + size, len(data))
            if len(gap) or end == len(data):
                w = bytetext.words(data[at:end], np.array([0, end - at]))
                # Short of a shingle and its overlap, a piece would not move on.
                if end == len(data) or len(w.start) > 2 * n_words:
                    break
                end = min(end + size, len(data))
        # What is left behind the overlap may hold no word.
        if at == 0 or len(w.start) >= n_words:
            yield data[at:end]
        if end == len(data):
            return
        at = at + int(w.start[len(w.start) - n_words + 1]) if n_words > 1 else end


def shingle_sets(
    data: np.ndarray, offsets: np.ndarray, n_words: int, size: int = LONG_TEXT
) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of the different shingles of each row, in order.

    A single text of more than ``size`` bytes is read in pieces, so that memory follows the piece
    and the set.
    """
    if len(offsets) != 2 or len(data) <= size:
        return _shingle_sets(data, offsets, n_words)
    found = np.zeros(0, np.uint64)
    for piece in _pieces(data, n_words, size):
        found = np.union1d(found, _shingle_sets(piece, np.array([0, len(piece)]), n_words)[1])
    return np.zeros(len(found), np.int64), found


def _shingle_sets(data: np.ndarray, offsets: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    w = bytetext.words(bytetext.LOWER[data], offsets)
    value, at = bytetext.shingles(w.hash, w.row, n_words)
    row = w.row[at]
    count = np.bincount(w.row, minlength=len(offsets) - 1)
    for n in range(1, n_words):
        short = np.flatnonzero((count == n)[w.row])[::n]
        if len(short):
            whole = np.full(len(short), n, np.uint64)
            for j in range(n):
                whole = whole * np.uint64(0x9FB21C651E98DF25) + w.hash[short + j]
            value, row = np.concatenate([value, bytetext.mix(whole)]), np.concatenate([row, w.row[short]])
    both = np.sort((row.astype(np.uint64) << np.uint64(52)) | (value >> np.uint64(12)))
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    both = both[new]
    return (both >> np.uint64(52)).astype(np.int64), both & np.uint64((1 << 52) - 1)


def _steps(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for first, end, data, offsets in bytetext.steps(column):
        for lo in range(0, end - first, STEP_ROWS):
            own = offsets[lo : lo + STEP_ROWS + 1]
            yield first + lo, data[own[0] : own[-1]], own - own[0]


def signatures(row: np.ndarray, shingle: np.ndarray, rows: int, plan: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, signature, number of the band) of all segments; an even signature may be given up."""
    size = np.bincount(row, minlength=rows)
    out = []
    value = bytetext.mix(shingle)
    for step in (0, 1):
        band = np.searchsorted(plan.least, np.maximum(size, 1), side="right") - 1 + step
        segments = np.where(size > 0, plan.segments[band], 0)
        base = np.cumsum(segments) - segments
        segment = (((shingle >> np.uint64(20)) * segments[row].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        sums = np.zeros(int(segments.sum()), np.uint64)
        np.add.at(sums, base[row] + segment, value)
        owner = np.repeat(np.arange(rows), segments)
        number = np.arange(len(sums)) - base[owner]
        salt = band[owner].astype(np.uint64) * _BAND + number.astype(np.uint64) * _SEGMENT
        fixed = number < plan.deletions[band[owner]]
        out.append((owner, bytetext.mix(sums + salt) & ~np.uint64(1) | fixed, band[owner]))
        drop = np.flatnonzero(segment < plan.deletions[band[row]])
        if len(drop):
            at = base[row[drop]] + segment[drop]
            less = bytetext.mix(sums[at] - value[drop] + salt[at]) | np.uint64(1)
            out.append((row[drop], less, band[row[drop]]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _signature_rows(texts: DataFrame, plan: Bands, n_words: int, tasks: int) -> DataFrame:
    """(task, ids, signatures, bands) with the arrays as bytes; negative tasks carry set sizes."""

    def rows_of(ids: np.ndarray, signature: np.ndarray, band: np.ndarray) -> pa.RecordBatch:
        task = (signature >> np.uint64(1)) % np.uint64(tasks)
        order = np.argsort(task.astype(np.uint16) if tasks < 1 << 16 else task, kind="stable")
        task, ids, signature, band = task[order], ids[order], signature[order], band[order]
        bounds = np.append(np.flatnonzero(np.diff(task, prepend=task[0] + np.uint64(1))), len(task))
        pick = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())
        return pa.RecordBatch.from_pydict({
            "task": pa.array(task[bounds[:-1]].astype(np.int64)), "ids": pick(ids),
            "signatures": pick(signature), "bands": pick(band.astype(np.uint8)),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, data, offsets in _steps(batch.column(1)):
                rows = len(offsets) - 1
                row, shingle = shingle_sets(data, offsets, n_words)
                own = ids[first : first + rows]
                size = np.bincount(row, minlength=rows).astype(np.int64)
                # Sizes travel with the segments, so that the texts are read once.
                yield pa.RecordBatch.from_pydict({
                    "task": pa.array([-1 - int(own[0]) % tasks]), "ids": pa.array([own.tobytes()], pa.binary()),
                    "signatures": pa.array([size.tobytes()], pa.binary()), "bands": pa.array([b""], pa.binary()),
                })
                owner, signature, band = signatures(row, shingle, rows, plan)
                held.append((own[owner], signature, band))
                count += len(owner)
                if count > 1 << 20:
                    yield rows_of(*(np.concatenate(x) for x in zip(*held)))
                    held, count = [], 0
        if count:
            yield rows_of(*(np.concatenate(x) for x in zip(*held)))

    return texts.mapInArrow(run, "task long, ids binary, signatures binary, bands binary")


#: Rows of the staged table: sizes (kind 0: id a, size) and members of shared segments (kind 1:
#: the list a has member b, size members, equal in n segments).
_FOUND = "kind int, a long, b long, size long, n int, band int, fixed boolean"


def _shared_segments(rows: DataFrame) -> DataFrame:
    def empty() -> dict[str, list[np.ndarray]]:
        return {k: [] for k in ("kind", "a", "b", "size", "n", "band", "fixed")}

    def add(out: dict, kind: int, a, b, size, n, band, fixed) -> None:
        for k, v in (("kind", kind), ("a", a), ("b", b), ("size", size), ("n", n), ("band", band), ("fixed", fixed)):
            out[k].append(np.broadcast_to(np.asarray(v, bool if k == "fixed" else np.int64), np.shape(a)))

    def run(table: pa.Table) -> pa.Table:
        joined = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
        ids, out = joined("ids", np.int64), empty()
        if table.column("task")[0].as_py() < 0:
            add(out, 0, ids, 0, joined("signatures", np.int64), 0, 0, False)
        else:
            signature, band = joined("signatures", np.uint64), joined("bands", np.uint8)
            order = np.lexsort((ids, signature))
            signature, ids, band = signature[order], ids[order], band[order]
            first = np.flatnonzero(np.concatenate([[True], signature[1:] != signature[:-1]]))
            size = np.diff(first, append=len(ids))
            # Segments with one and the same members count as one, seen several times.
            shared = np.flatnonzero(size > 1)
            if len(shared):
                row = np.repeat(first[shared], size[shared])
                row += np.arange(len(row)) - np.repeat(np.cumsum(size[shared]) - size[shared], size[shared])
                start = np.cumsum(size[shared]) - size[shared]
                fixed = (signature[first[shared]] & np.uint64(1)).astype(bool)
                key = np.add.reduceat(bytetext.mix(ids[row].view(np.uint64)), start)
                key = bytetext.mix(key + band[first[shared]].astype(np.uint64) * _BAND + fixed)
                name, pick, times = np.unique(key, return_index=True, return_counts=True)
                length = size[shared][pick]
                member = np.repeat(start[pick], length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
                repeat = lambda x: np.repeat(x, length)
                add(out, 1, repeat(name.view(np.int64)), ids[row][member], repeat(length), repeat(times),
                    repeat(band[first[shared]][pick].astype(np.int64)), repeat(fixed[pick]))
        kinds = {"kind": pa.int32(), "n": pa.int32(), "band": pa.int32(), "fixed": pa.bool_()}
        return pa.table({
            k: pa.array(np.concatenate(v) if v else np.zeros(0, bool if k == "fixed" else np.int64), kinds.get(k, pa.int64()))
            for k, v in out.items()
        })

    return rows.groupBy("task").applyInArrow(run, _FOUND)


def _sets(texts: DataFrame, n_words: int) -> DataFrame:
    """(doc, shingles as bytes) of (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in _steps(batch.column(1)):
                row, shingle = shingle_sets(data, offsets, n_words)
                bounds = np.searchsorted(row, np.arange(len(offsets)))
                parts = [shingle[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_pydict({
                    "doc": batch.column(0).slice(first, len(offsets) - 1), "shingles": pa.array(parts, pa.binary()),
                })

    return texts.mapInArrow(run, "doc long, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                if 100 * len(x) < percent * len(y):
                    keep.append(False)
                    continue
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int(np.count_nonzero(y[at] == x))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("one"))
    two = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("two"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two")
    return joined.mapInArrow(run, "a long, b long")


def _met_blocks(groups: DataFrame, sets: DataFrame, tasks: int) -> DataFrame:
    """(doc, group, low, high): the pairs of blocks that each document of (node, root) takes part in.

    A group is dealt into blocks, and a document has a row for every block of its group. The
    documents are few bytes that would all be read by one task, so they are dealt out to ``tasks``
    before these rows are made.
    """
    members = groups.select(F.col("node").alias("doc"), F.col("root").alias("group"))
    sized = members.join(sets.select("doc", F.octet_length("shingles").cast("long").alias("bytes")), "doc")
    most = F.greatest(F.sum("bytes") / BLOCK_BYTES, F.count(F.lit(1)) / BLOCK_ROWS)
    blocks = sized.groupBy("group").agg(F.ceil(most).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    dealt = members.join(blocks, "group").repartition(tasks, "doc").withColumn("own", own).select(
        "doc", "group", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    )
    return dealt.select("doc", "group", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))


def _block_links(groups: DataFrame, sets: DataFrame, percent: int, tasks: int) -> DataFrame:
    """Links that join what is similar enough within each group of (node, root).

    Every two blocks of a group meet in one task, which counts the shingles that their documents
    share as a product of 0/1 matrices and returns a tree for each cluster.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        docs = table.column("doc").to_numpy()
        parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles").combine_chunks()]
        size = np.array([len(x) for x in parts])
        row = np.repeat(np.arange(len(parts)), size)
        name, place, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        order = np.argsort(place, kind="stable")
        row, place = row[order], place[order]
        # A shingle of one document alone is shared by nobody.
        often = (times > 1)[place]
        row, place = row[often], (np.cumsum(times > 1) - 1)[place[often]]
        both = np.zeros((len(parts), len(parts)), np.float32)
        for low in range(0, int((times > 1).sum()), BLOCK_SHINGLES):
            a, b = np.searchsorted(place, [low, low + BLOCK_SHINGLES])
            has = np.zeros((len(parts), BLOCK_SHINGLES), np.float32)
            has[row[a:b], place[a:b] - low] = 1
            both += has @ has.T
        together = size[:, None] + size[None, :]
        linked = (100 + percent) * both.astype(np.int64) >= percent * together
        label = np.arange(len(parts))
        while True:
            least = np.where(linked, label[None, :], len(parts)).min(axis=1)
            least = np.minimum(label, least)
            least = least[least]
            if (least == label).all():
                break
            label = least
        moved = label != np.arange(len(parts))
        return pa.table({"a": docs[moved], "b": docs[label[moved]]})

    met = _met_blocks(groups, sets, tasks)
    return met.join(sets, "doc").groupBy("group", "low", "high").applyInArrow(run, "a long, b long")


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = WORDS, percent: int = PERCENT,
) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of every row."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = stage(source.select("doc_id", text_key().alias("key")), "jaccard-rows")
    known = source.withColumn("key", text_key())
    # One text of each group of copies; its smallest doc_id stands for it. Rows without an id
    # are only measured; a text that has no other row gets a stand-in below all ids.
    once = known.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))
    stand_in = F.lit(-(1 << 62)) + F.pmod(F.xxhash64("key"), F.lit(1 << 61))
    texts = once.select(F.coalesce("doc_id", stand_in).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    owners = rows.groupBy("key").agg(F.coalesce(F.min("doc_id"), F.min(stand_in)).alias("doc"))
    count = rows.count()
    plan = bands(count, percent)
    tasks = max(32, count // TASK_TEXTS)
    files = max(LEAST_FILES, count // FILE_TEXTS)
    found = stage(_shared_segments(_signature_rows(texts, plan, n_words, tasks)), "jaccard-segments", files)

    sizes = found.filter("kind = 0").groupBy(F.col("a").alias("doc")).agg(F.max("size").alias("n_shingles"))
    # Each set gives up its most crowded segments, as many as its band can spare.
    spare = F.element_at(F.array([F.lit(int(x)) for x in plan.spare]), F.col("band") + 1)
    members = (
        found.filter("kind = 1").groupBy(F.col("a").alias("list"), F.col("b").alias("doc"), "band", "fixed", "size")
        .agg(F.sum("n").alias("n"))
    )
    crowd = W.partitionBy("doc", "band").orderBy("fixed", F.desc("size"), "list").rowsBetween(W.unboundedPreceding, 0)
    chosen = ~((F.sum("n").over(crowd) <= spare) & ~F.col("fixed"))
    # Two linked sets share more segments than can be given up.
    least = F.element_at(F.array([F.lit(int(x)) for x in plan.spare + 1 - 2 * plan.deletions]), F.col("band") + 1)
    enough = F.sum(F.when(~F.col("fixed"), F.col("n")).otherwise(0)).over(W.partitionBy("doc", "band")) >= least
    members = stage(members.withColumn("chosen", chosen).withColumn("enough", enough).filter("enough"), "jaccard-lists", files)
    needed = members.groupBy("list").agg(F.max("chosen").alias("any")).filter("any").select("list")
    members = stage(members.join(needed, "list", "left_semi").select("list", "doc", "chosen", "size"), "jaccard-lists", files)
    few = members.filter(F.col("size") <= FEW)
    pairs = few.select("list", F.col("doc").alias("a"), F.col("chosen").alias("a_chosen")).join(
        few.select("list", F.col("doc").alias("b"), F.col("chosen").alias("b_chosen")), "list"
    ).filter("a > b and (a_chosen or b_chosen)").select("a", "b")

    docs_met = members.select("doc").distinct()
    mine = source.join(docs_met.withColumnRenamed("doc", "doc_id"), "doc_id", "left_semi")
    mine = mine.groupBy("doc_id").agg(F.min_by("text", text_key()).alias("text"))
    sets = stage(_sets(mine, n_words), "jaccard-sets", files)

    members = members.filter(F.col("size") > FEW)
    centre = members.groupBy("list").agg(F.min("doc").alias("b"))
    stars = members.filter("chosen").join(centre, "list").select(F.col("doc").alias("a"), "b").filter("a != b")
    links = stage(_verified(pairs.union(stars).distinct(), sets, percent), "jaccard-links", files)
    labels = components(links, files)
    labelled = members.join(labels.select(F.col("node").alias("doc"), "root"), "doc", "left").select(
        "list", "doc", F.coalesce("root", "doc").alias("root")
    )
    split = labelled.groupBy("list").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.min("doc").alias("b")
    ).filter("low < high")
    open_lists = stage(labelled.join(split.select("list", "b"), "list").select(F.col("doc").alias("a"), "b"), "jaccard-open", files)
    if not open_lists.isEmpty():
        # What shares such segments is compared in blocks; a group of one document is none.
        groups = components(open_lists, files)
        links = links.union(_block_links(groups, sets, percent, tasks))
        labels = components(links, files)

    told = rows.join(owners, "key").join(sizes, "doc").join(labels.select(F.col("node").alias("doc"), "root"), "doc", "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("root", "doc"))
    return told.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))
