"""Packed id matrices by best-fit-decreasing with a segment tree over capacities (operator 3).

A text's ids and an end id are cut without loss into pieces of at most one row of the matrix.
Pieces go in decreasing length to the row with the least room that still holds them; a segment
tree over room sizes finds it in log(capacity) steps. Packing happens where the texts are read,
a bounded number of tokens at a time, so ids are never shuffled.

Null or empty text is the end id alone; repeated rows are packed like any other; an empty table
gives an empty result; a very long text is encoded alone and held whole; columns other than the two
named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollatlas.llm import wordpieces
from rollatlas.llm.shared import send_file

CAPACITY = 4096
#: Tokens that are packed together in one task.
BLOCK_TOKENS = 4 << 20
ROWS = (
    "sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_ids binary,"
    " doc_ids array<long>, doc_starts array<long>, doc_tokens array<long>"
)


class RoomTree:
    """Open rows by the room they have left."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += by
            at //= 2

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def least(self, need: int) -> int | None:
        """The smallest room of at least ``need`` that some row has."""
        at = need + self.size
        if self.count[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None

    def take(self, room: int) -> int:
        self._add(room, -1)
        return self.rows[room].pop()


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Positions of the pieces in each row, longest first."""
    tree, rows = RoomTree(capacity), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        room = tree.least(n)
        if room is None:
            row, room = len(rows), capacity
            rows.append([])
        else:
            row = tree.take(room)
        rows[row].append(i)
        if room > n:
            tree.put(room - n, row)
    return rows


def packed_matrices(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Rows of ids (little-endian unsigned 32-bit, padded with 0 to ``capacity``), the cumulative
    lengths of their segments, position ids (32-bit) that restart with each segment, and the
    document and place that each segment comes from."""
    sent = send_file(docs.sparkSession, tokenizer)

    def matrix(block: list[tuple], number: int) -> pa.RecordBatch:
        ids = np.concatenate([b[1] for b in block])
        base = np.cumsum([0] + [len(b[1]) for b in block])
        ends = np.concatenate([b[2] + o for b, o in zip(block, base)])
        keys = pa.concat_arrays([b[0] for b in block]).to_pylist()
        tokens = np.diff(ends, prepend=0)
        count = -(-tokens // capacity)
        doc = np.repeat(np.arange(len(ends)), count)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * capacity
        length = np.minimum(tokens[doc] - start, capacity)
        at = (ends - tokens)[doc] + start
        columns: dict[str, list] = {name.split()[0]: [] for name in ROWS.split(", ")}
        for row in best_fit(length, capacity):
            own = length[row]
            out, place = np.zeros(capacity, "<u4"), np.zeros(capacity, "<u4")
            cum = np.concatenate([[0], np.cumsum(own)])
            for i, a, n in zip(row, cum.tolist(), own.tolist()):
                out[a : a + n] = ids[at[i] : at[i] + n]
                place[a : a + n] = np.arange(n)
            values = (
                number, int(cum[-1]), out.tobytes(), cum.tolist(), place.tobytes(),
                [keys[doc[i]] for i in row], start[row].tolist(), tokens[doc[row]].tolist(),
            )
            for name, value in zip(columns, values):
                columns[name].append(value)
            number += 1
        kinds = (
            pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(),
            pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()),
        )
        return pa.RecordBatch.from_pydict({n: pa.array(v, k) for (n, v), k in zip(columns.items(), kinds)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block, held = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for first, ids, ends in wordpieces.encoded_rows(batch.column(1), sent):
                block.append((batch.column(0).slice(first, len(ends)), ids, ends))
                held += len(ids)
                if held >= BLOCK_TOKENS:
                    yield (done := matrix(block, number))
                    number, block, held = number + done.num_rows, [], 0
        if block:
            yield matrix(block, number)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, ROWS)


def unpacked(rows: DataFrame) -> DataFrame:
    """The pieces back out of the matrix: doc_id, start, doc_tokens, ids (binary)."""
    each = rows.select(
        F.explode(F.arrays_zip("doc_ids", "doc_starts", "doc_tokens", F.slice("cu_seqlens", 1, F.size("doc_ids")),
                               F.slice("cu_seqlens", 2, F.size("doc_ids")))).alias("p"), "ids",
    )
    return each.select(
        F.col("p.doc_ids").alias("doc_id"), F.col("p.doc_starts").alias("start"), F.col("p.doc_tokens").alias("doc_tokens"),
        F.expr("substring(ids, 4 * p.`3` + 1, 4 * (p.`4` - p.`3`))").alias("ids"),
    )
