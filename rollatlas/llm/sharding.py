"""Shards of near-equal bytes by Karmarkar-Karp differencing of indivisible groups (operator 8).

Rows of a group stay together; the default group is rows of equal text. Each bucket of groups is
differenced into ``shards`` parts in its own task. The buckets' partial partitions are then
combined in the same way, the most uneven two first and oppositely ordered, up to ``FAN_IN`` in
a task and level by level, so that no task and no driver sees more than that many.

A null text counts as empty (size 1). A null doc_id is a row like any other. Repeated rows keep
their own slots, given in the order of doc_id and size. An empty table gives an empty result.
A group larger than a shard's share makes its shard as large as the group: it is never split.
Of a text, however long, only its size, digest and checksum leave the row. Other columns of the
input are not read, whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rollatlas.llm import differencing
from rollatlas.llm.shared import stage

SHARDS = 16
BUCKET_GROUPS = 20_000
FAN_IN = 512
#: Rows numbered together in one task.
UNIT_ROWS = 50_000


def group_parts(groups: DataFrame, shards: int, bucket_groups: int = BUCKET_GROUPS) -> DataFrame:
    """(key, bucket, part) for groups of (key, bytes): one partial partition for each bucket."""
    buckets = max(1, -(-groups.count() // bucket_groups))

    def split(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        part = [0] * table.num_rows
        for number, found in enumerate(differencing.partition(table.column("bytes").to_pylist(), shards)):
            for i in found:
                part[i] = number
        return table.append_column("part", pa.array(part, pa.int32()))

    keyed = groups.select("key", "bytes", F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))
    return keyed.groupBy("bucket").applyInArrow(split, "key binary, bytes long, bucket long, part int")


def combined(parts: DataFrame, shards: int, fan_in: int = FAN_IN) -> DataFrame:
    """(bucket, part, shard): which shard each part of each bucket joins."""

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["bucket"], r["part"]))
        partial: dict[int, list] = {}
        for i, r in enumerate(rows):
            partial.setdefault(r["bucket"], []).append((r["bytes"], i))
        for found in partial.values():
            found.sort(key=lambda p: -p[0])
        whole = differencing.combine(list(partial.values()), shards)
        up = [0] * len(rows)
        for number, (_, tree) in enumerate(whole):
            for i in differencing.members(tree):
                up[i] = number
        return pa.Table.from_pylist(
            [{**r, "up": u} for r, u in zip(rows, up)],
            pa.schema([("node", pa.int64()), ("bucket", pa.int64()), ("part", pa.int32()), ("bytes", pa.int64()), ("up", pa.int32())]),
        )

    level = stage(parts.groupBy("bucket", "part").agg(F.sum("bytes").alias("bytes")), "shard-parts")
    chain = []
    while True:
        # Integer division of the bucket number: the next level has ``fan_in`` times fewer.
        keyed = level.select(F.expr(f"bucket div {fan_in}").alias("node"), "bucket", "part", "bytes")
        merged = stage(
            keyed.groupBy("node").applyInArrow(merge, "node long, bucket long, part int, bytes long, up int"), "shard-level"
        )
        chain.append(merged)
        if merged.agg(F.max("node")).first()[0] in (0, None):
            break
        level = merged.groupBy(F.col("node").alias("bucket"), F.col("up").alias("part")).agg(F.sum("bytes").alias("bytes"))
    found = chain[-1].select("bucket", "part", F.col("up").alias("shard"))
    for merged in reversed(chain[:-1]):
        above = found.select(F.col("bucket").alias("node"), F.col("part").alias("up"), "shard")
        found = merged.join(above, ["node", "up"]).select("bucket", "part", "shard")
    return found


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
    bucket_groups: int = BUCKET_GROUPS, fan_in: int = FAN_IN,
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: the law is ``bytes``)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stage(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.md5(text)).alias("key"),
        ),
        "shard-rows",
    )
    groups = stage(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-groups")
    parts = stage(group_parts(groups, shards, bucket_groups), "shard-groups-parts")
    shard_of = combined(parts, shards, fan_in)
    keys = parts.join(shard_of, ["bucket", "part"]).select("key", "shard")
    units = max(1, -(-rows.count() // UNIT_ROWS))
    # The unit hangs on the row alone, so that a large group is numbered by many tasks.
    unit = F.pmod(F.xxhash64("doc_id", "size"), F.lit(units))
    placed = stage(rows.join(keys, "key").select("doc_id", "size", "text_crc32", "shard", unit.alias("unit")), "shard-placed")
    counts = placed.groupBy("shard", "unit").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("unit")) - F.col("n")
    offsets = counts.select("shard", "unit", before.alias("before"))
    order = W.partitionBy("unit", "shard").orderBy("doc_id", "size", "text_crc32")
    numbered = placed.withColumn("number", F.row_number().over(order))
    return numbered.join(offsets, ["unit", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("number") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
