"""Token ids, packed windows (operator 4) and packed matrices (operator 3)."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rollatlas.llm import differencing, matrices, packing, wordpieces
from rollatlas.llm.queries import TOKENIZER

ODD = [
    "", None, " ", "It's don't 'll 's A.b,C-d--", "x.<|endoftext|>.y <|ENDOFTEXT|>", "A≠b İa é é",
    "１2３   a\x1cb\x85c", "naïve ÉTÉ straße", "word, word. WORD; " * 40, "a" * 3000,
]


def ids_of(text):
    tokenizer = wordpieces.encoder(TOKENIZER).tokenizer
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_ids_equal_the_tokenizer(texts):
    for first, ids, ends in wordpieces.encoded_rows(pa.array(texts, pa.string()), TOKENIZER):
        for i, (a, b) in enumerate(zip([0, *ends], ends)):
            assert ids[a:b].tolist() == ids_of(texts[first + i])


def test_ids_of_odd_texts_and_a_full_cache(monkeypatch):
    monkeypatch.setattr(wordpieces, "CACHE_WORDS", 3)
    own = wordpieces.WordEncoder(TOKENIZER)
    for text in ODD * 2:
        data = np.frombuffer((text or "").encode(), np.uint8)
        ids, ends = own.encode(data, np.array([0, len(data)]))
        assert ids.tolist() == ids_of(text) and ends.tolist() == [len(ids)]


def checked(rows, docs, capacity):
    want = sorted((i if i is not None else -1, tuple(ids_of(t))) for i, t in docs)
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.doc_tokens].append(r)
        windows[r.sequence_id].append(r)
    for own in windows.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == list(np.cumsum([0] + [r.length for r in own])[:-1])
        assert sum(r.length for r in own) <= capacity
    assert sum(r.length for r in rows) == sum(len(ids) for _, ids in want)
    have = defaultdict(int)
    for (doc, total), own in pieces.items():
        have[doc, total] = sum(r.length for r in own) // total
    wanted = defaultdict(int)
    for doc, ids in want:
        wanted[doc if doc >= 0 else None, len(ids)] += 1
    assert have == wanted
    return windows


def test_windows(docs_of):
    random.seed(3)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id here"), (7, ODD[7])]
    rows += [(100 + i, " ".join(random.choice("ab cd ef".split()) for _ in range(random.randint(1, 90)))) for i in range(200)]
    found = packing.pack_documents(docs_of(rows), TOKENIZER, capacity=64, keep_ids=True).collect()
    windows = checked(found, rows, 64)
    texts = dict(rows)
    for r in found:
        own = np.array(ids_of(texts[r.doc_id]), "<u4")[r.start : r.start + r.length].tobytes()
        assert bytes(r.ids) == own and zlib.crc32(own) == r.ids_crc32
    padding = 64 * len(windows) - sum(r.length for r in found)
    assert padding < 0.1 * 64 * len(windows)


def test_windows_of_nothing(docs_of):
    assert packing.pack_documents(docs_of([]), TOKENIZER).collect() == []


def test_window_count_rises_until_all_fit():
    assert sorted(map(len, packing.windows([6, 6, 6], 10))) == [1, 1, 1]
    assert packing.windows([], 10) == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 1000), max_size=40), st.integers(1, 9))
def test_differencing_is_a_near_equal_partition(sizes, k):
    parts = differencing.partition(sizes, k)
    assert len(parts) == k and sorted(i for p in parts for i in p) == list(range(len(sizes)))
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert max(sums) - min(sums) <= max(sizes, default=0)


def test_differencing_beats_the_greedy_rule():
    sizes = [8, 7, 6, 5, 4]
    assert sorted(sum(sizes[i] for i in p) for p in differencing.partition(sizes, 2)) == [14, 16]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit_equals_a_scan(sizes):
    rows = matrices.best_fit(np.array(sizes, np.int64), 50)
    room, want = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [r for r in room if r >= sizes[i]]
        if fits:
            best = min(fits)
            room.remove(best)
        else:
            best = 50
            want.append(i)
        if best > sizes[i]:
            room.append(best - sizes[i])
    assert len(rows) == len(want) and sorted(i for r in rows for i in r) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in r) <= 50 for r in rows)


def test_matrices_round_trip(docs_of):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3])]
    found = matrices.packed_matrices(docs_of(rows), TOKENIZER, capacity=64)
    for r in found.collect():
        place = np.frombuffer(r.position_ids, "<u4")
        assert len(r.ids) == len(r.position_ids) == 4 * 64 and r.cu_seqlens[-1] == r.n_tokens <= 64
        for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]):
            assert place[a:b].tolist() == list(range(b - a))
        assert not any(np.frombuffer(r.ids, "<u4")[r.n_tokens :])
    back = defaultdict(dict)
    for p in matrices.unpacked(found).collect():
        back[p.doc_id].setdefault(p.start, np.frombuffer(p.ids, "<u4").tolist())
    for i, text in rows:
        assert [x for _, part in sorted(back[i].items()) for x in part] == ids_of(text)


def test_matrices_of_nothing(docs_of):
    assert matrices.packed_matrices(docs_of([]), TOKENIZER).collect() == []
    with pytest.raises(IndexError):
        matrices.RoomTree(4).take(2)


def test_one_id_on_many_rows_is_dealt_over_buckets(docs_of):
    docs = docs_of([(1, "the same words again and again")] * 3000 + [(None, "x")] * 500)
    pieces = packing.token_pieces(docs, TOKENIZER)
    rows = packing.pack(pieces, 3500, bucket_rows=100).collect()
    assert len(rows) == 3500
    buckets = Counter(r.sequence_id >> 32 for r in rows)
    assert len(buckets) == 35 and max(buckets.values()) < 200
    placed = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    for (a, at, n), (b, begin, _) in zip(placed, placed[1:]):
        assert begin == (at + n if a == b else 0)
