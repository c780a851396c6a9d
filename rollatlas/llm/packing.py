"""Packing of token pieces into near-equal windows by Karmarkar-Karp differencing (operator 4).

Every text becomes its token ids and an end id. A document longer than a window fills whole
windows first; what remains of it, and every shorter document, is one piece. The pieces of a
bucket of documents are split over ``k`` windows by multiway differencing, beginning with the
fewest windows that could hold them; ``k`` rises until no window exceeds the capacity.

Null or empty text is the end id alone. Rows repeated with the same doc_id are packed like any
other, in different buckets. An empty table gives an empty result. A very long text is encoded
alone and held whole. Columns other than the two named are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollatlas.llm import differencing, wordpieces
from rollatlas.llm.shared import send_file

CAPACITY = 4096
#: Rows of documents that one differencing task sees; padding hardly falls beyond it.
BUCKET_ROWS = 1000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECES}, sequence_id long, offset long"


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id",
    text_col: str = "text", keep_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens, with their ids (unsigned 32-bit) if asked for."""
    sent = send_file(docs.sparkSession, tokenizer)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for first, ids, ends in wordpieces.encoded_rows(batch.column(1), sent):
                tokens = np.diff(ends, prepend=0)
                count = -(-tokens // capacity)
                row = np.repeat(np.arange(len(ends)), count)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * capacity
                length = np.minimum(tokens[row] - start, capacity)
                at = (ends - tokens)[row] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                parts = [raw[4 * a : 4 * (a + n)] for a, n in zip(at.tolist(), length.tolist())]
                out = {
                    "doc_id": keys.take(pa.array(row + first)),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                    "doc_tokens": pa.array(tokens[row], pa.int64()),
                }
                if keep_ids:
                    out["ids"] = pa.array([bytes(p) for p in parts], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(cut, PIECES + ", ids binary" * keep_ids)


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Positions of ``sizes`` in the fewest near-equal windows differencing can find."""
    k = -(-sum(sizes) // capacity)
    while True:
        found = differencing.partition(sizes, k)
        if max((sum(sizes[i] for i in part) for part in found), default=0) <= capacity:
            return [part for part in found if part]
        k += max(1, k // 200)


def pack(pieces: DataFrame, rows: int, capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Give each piece a sequence and its place there. ``rows``: documents, for the bucket count."""
    buckets = max(1, -(-rows // bucket_rows))

    def fill(table: pa.Table) -> pa.Table:
        # The order does not depend on how the rows have arrived.
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "start", "length", "ids_crc32")])
        bucket = table.column("bucket")[0].as_py()
        length = table.column("length").to_pylist()
        short = [i for i, n in enumerate(length) if n < capacity]
        groups = [[i] for i, n in enumerate(length) if n >= capacity]
        groups += [[short[i] for i in part] for part in windows([length[i] for i in short], capacity)]
        sequence, offset = [0] * len(length), [0] * len(length)
        for number, group in enumerate(groups):
            place = 0
            for i in group:
                sequence[i], offset[i] = (bucket << 32) + number, place
                place += length[i]
        table = table.drop_columns(["bucket"])
        table = table.append_column("sequence_id", pa.array(sequence, pa.int64()))
        return table.append_column("offset", pa.array(offset, pa.int64()))

    schema = PACKED if "ids" not in pieces.columns else PACKED.replace("doc_tokens long,", "doc_tokens long, ids binary,")
    # The place among the rows deals out what is repeated under one id.
    key = F.xxhash64("doc_id", "doc_tokens", F.monotonically_increasing_id())
    keyed = pieces.withColumn("bucket", F.pmod(key, F.lit(buckets)))
    return keyed.groupBy("bucket").applyInArrow(fill, schema)


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Whole path from documents to pieces with their sequence."""
    pieces = token_pieces(docs, tokenizer, capacity, id_col, text_col, keep_ids)
    return pack(pieces, docs.count(), capacity)
