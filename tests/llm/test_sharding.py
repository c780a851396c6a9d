"""Byte shards (operator 8)."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

from rollatlas.llm import sharding


def checked(found, rows, shards):
    size = defaultdict(int)
    slots = defaultdict(list)
    of_text = {}
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t or "")
    for r in found:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
        assert (r.size, r.text_crc32) in {(len(t.encode()) + 1, zlib.crc32(t.encode())) for t in texts[r.doc_id]}
        assert of_text.setdefault((r.size, r.text_crc32), r.shard) == r.shard
    assert len(found) == len(rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return [size[s] for s in range(shards)]


def test_even_shards_through_several_levels(docs_of, monkeypatch):
    monkeypatch.setattr(sharding, "UNIT_ROWS", 20)
    random.seed(5)
    rows = [(i, "x" * random.randint(1, 400) + str(i)) for i in range(150)]
    rows += [(200 + i, "copy of one text") for i in range(40)] + [(1, rows[1][1]), (None, "ä"), (None, None), (300, "")]
    found = sharding.shard_documents(docs_of(rows), shards=4, bucket_groups=12, fan_in=3).collect()
    sums = checked(found, rows, 4)
    assert max(sums) - min(sums) < 0.02 * sum(sums)


def test_one_large_group_stays_whole(docs_of):
    rows = [(i, "y" * 5000) for i in range(10)] + [(20 + i, "z" * i) for i in range(10)]
    found = sharding.shard_documents(docs_of(rows), shards=4).collect()
    checked(found, rows, 4)


def test_nothing_to_shard(docs_of):
    assert sharding.shard_documents(docs_of([])).collect() == []
