"""Suffix arrays and repeated passages (operator 10)."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from rollatlas.llm import repeats, suffixes


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60), st.integers(1, 4))
def test_suffix_array_and_prefixes(symbols, times):
    t = np.array(symbols * times + [0], np.int64)
    array = suffixes.suffix_array(t)
    assert array.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    shared = suffixes.permuted_common_prefixes(t, array)
    for a, b in zip(array, array[1:]):
        n = 0
        while t[a + n] == t[b + n]:
            n += 1
        assert shared[b] == n


def brute(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for (doc, _), b in zip(rows, raw):
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, cover) if not c)
        out.append((doc, len(b), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest(), kept))
    return out


def texts(seed):
    random.seed(seed)
    new = lambda n: "".join(random.choice("abcdé ") for _ in range(n))
    long = new(90)
    rows = ["", None, "short", "ab" * 60, "a" * 100, new(300), new(200) + long, long[5:] + new(50), long * 2, new(30) + long[:39]]
    rows += ["exact copy " * 8] * 3 + ["tiny copy"] * 2 + [new(20) + long[20:70] + new(20) for _ in range(6)]
    return list(enumerate(rows))


def test_digests_equal_brute_force(docs_of, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD_BYTES", 2000)
    for seed in (1, 2):
        rows = texts(seed)
        found = repeats.repeat_digests(docs_of(rows), length=40, gram=8).collect()
        assert sorted(map(tuple, found)) == sorted(x[:5] for x in brute(rows, 40))


def test_kept_texts(docs_of):
    rows = texts(4)
    found = {r.doc_id: r.text for r in repeats.without_repeats(docs_of(rows), length=40, gram=8).collect()}
    for (doc, n, removed, _, _, kept), (_, text) in zip(brute(rows, 40), rows):
        want = text if not removed else kept.decode("utf-8", "ignore") or None
        assert found[doc] == want


def test_repeated_rows_and_nothing(docs_of):
    rows = [(1, "x y z " * 20), (1, "x y z " * 20)]
    found = repeats.repeat_digests(docs_of(rows), length=40, gram=8).collect()
    assert [(r.n_removed, r.n_spans) for r in found] == [(120, 1)] * 2
    assert repeats.repeat_digests(docs_of([])).collect() == []


def test_no_shard_takes_all_of_a_quoted_passage(docs_of, monkeypatch):
    random.seed(5)
    new = lambda n: "".join(random.choice("abcdé ") for _ in range(n))
    passage, near = new(70), new(25)
    rows = [(i, new(60) + passage + new(60)) for i in range(120)]
    # Some agree with others beyond the passage, some hold runs of other lengths, one is a copy.
    rows += [(200 + i, new(30) + near + passage[:50] + new(30)) for i in range(40)]
    rows += [(300 + i, new(30) + "-" * (40 + i) + new(30)) for i in range(40)] + [(400, rows[0][1])]
    monkeypatch.setattr(repeats, "SHARD_BYTES", 1000)
    largest, covered = [], repeats.covered

    def spy(cut, length):
        largest.extend(r[1] for r in cut.selectExpr("shard", "octet_length(bytes) as n").groupBy("shard").sum("n").collect())
        return covered(cut, length)

    monkeypatch.setattr(repeats, "covered", spy)
    found = repeats.repeat_digests(docs_of(rows), length=40, gram=8).collect()
    assert sorted(map(tuple, found)) == sorted(x[:5] for x in brute(rows, 40))
    assert max(largest, default=0) <= 3 * repeats.SHARD_BYTES


def test_long_texts_have_the_same_anchors_in_steps():
    rng = np.random.default_rng(4)
    for n in (39, 40, 41, 150, 1000):
        data = rng.integers(97, 99, n).astype(np.uint8)
        offsets = np.array([0, n])
        want = repeats.anchors(data, offsets, 40, 8)
        for step in (1, 13, 40, 120, 999):
            got = repeats.anchors(data, offsets, 40, 8, step)
            assert [x.tolist() for x in got] == [x.tolist() for x in want]


def test_memory_of_a_very_long_text():
    """64 MB: anchors are found within a bounded piece, not many times the text."""
    import tracemalloc

    data = np.random.default_rng(5).integers(97, 123, 64 << 20).astype(np.uint8)
    tracemalloc.start()
    row, place, _ = repeats.anchors(data, np.array([0, len(data)]), repeats.LENGTH, repeats.GRAM)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(place) > len(data) // repeats.LENGTH and (np.diff(place) <= repeats.LENGTH).all()
    assert most < 400 << 20


def test_memory_of_a_shard():
    """Suffix arrays hold 32-bit places: some 40 bytes for a byte of regions."""
    import tracemalloc

    rng = np.random.default_rng(6)
    parts = [rng.integers(97, 123, 768).astype(np.uint8).tobytes() for _ in range(1500)]
    parts += [p[20:] + b"." for p in parts[:700]]
    repeats.repeated_starts(parts[:10], 400)
    tracemalloc.start()
    masks = repeats.repeated_starts(parts, 400)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(int(m.sum()) for m in masks) == 1400 * (748 - 400 + 1)
    assert most < 50 * sum(map(len, parts))


def test_likely_stretches_hold_all_repeated_windows():
    for seed in (1, 2, 3):
        parts = list(dict.fromkeys(t.encode() for _, t in texts(seed) if t and len(t.encode()) >= 40))
        row, start, end = repeats.likely_stretches(parts, 40)
        assert all(b < c for i, j, b, c in zip(row, row[1:], end, start[1:]) if i == j)
        seen = Counter(p[i : i + 40] for p in parts for i in range(len(p) - 39))
        for n, p in enumerate(parts):
            for i in range(len(p) - 39):
                if seen[p[i : i + 40]] > 1:
                    assert any(a <= i and i + 40 <= b for r, a, b in zip(row, start, end) if r == n)
    assert [len(x) for x in repeats.likely_stretches([], 40)] == [0, 0, 0]


def test_parts_that_share_short_strings_alone_cost_no_suffix_array(docs_of):
    random.seed(8)
    new = lambda n: "".join(random.choice("abcdé ") for _ in range(n))
    line, passage = new(20), new(60)
    rows = [(i, new(60) + line + new(60)) for i in range(50)] + [(100 + i, new(50) + passage + new(50)) for i in range(2)]
    row, start, end = repeats.likely_stretches([t.encode() for _, t in rows], 40)
    assert set(row.tolist()) == {50, 51} and (end - start).sum() < 2 * 90
    found = repeats.repeat_digests(docs_of(rows), length=40, gram=8).collect()
    assert sorted(map(tuple, found)) == sorted(x[:5] for x in brute(rows, 40))


def without_runs(rows, words):
    """What is left of texts without the runs of ``words`` words that begin at two places, by brute force."""
    raw = [(t or "").encode() for _, t in rows]
    found = [[(m.start(), m.end(), m.group().lower()) for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", b)] for b in raw]
    seen = Counter(tuple(w[2] for w in ws[i : i + words]) for ws in found for i in range(len(ws) - words + 1))
    out = []
    for b, ws in zip(raw, found):
        cover = bytearray(len(b))
        for i in range(len(ws) - words + 1):
            if seen[tuple(w[2] for w in ws[i : i + words])] > 1:
                cover[ws[i][0] : ws[i + words - 1][1]] = b"\1" * (ws[i + words - 1][1] - ws[i][0])
        out.append(bytes(x for x, c in zip(b, cover) if not c).decode())
    return out


def test_runs_of_words_that_occur_again(docs_of, monkeypatch):
    random.seed(9)
    pick = lambda n: [random.choice("aé bé the of it wörd x1 On Ex".split()) + str(random.randrange(90)) for _ in range(n)]
    passage, other = pick(12), pick(30)
    rows = [" ".join(pick(20) + passage + pick(20)), ", ".join(pick(3) + passage).upper().replace("É", "é").replace("Ö", "ö") + "."]
    rows += [" ".join(pick(5) + passage[:10]), " ".join(passage[:9] + pick(5)), " ".join(other), " ".join(pick(4) + other[3:25] + pick(4))]
    rows += ["to " * 11, "so " * 10, " ".join(pick(200) + other[:12] + pick(200)), " ".join(pick(300)), "", None, "9", "-" * 300]
    rows = list(enumerate(rows))
    for step in (repeats.LONG_STEP, 200):
        monkeypatch.setattr(repeats.word_anchor_rows, "__defaults__", (step,))
        monkeypatch.setattr(repeats.word_runs, "__defaults__", (step,))
        found = {r.doc_id: r.text for r in repeats.without_repeats(docs_of(rows), length=2000, words=10).collect()}
        for (doc, text), left in zip(rows, without_runs(rows, 10)):
            assert found[doc] == (text if left == (text or "") else left or None)
    assert sum(found[doc] != text for doc, text in rows) == 7


def test_copies_and_bytes_beside_runs_of_words(docs_of):
    random.seed(10)
    new = lambda n: "".join(random.choice("abcdé") for _ in range(n))
    word, copy = new(50), " ".join(new(3) for _ in range(12)) + "!"
    rows = [(1, new(9) + word + new(9)), (2, word + new(20)), (3, copy), (None, copy), (4, "few words"), (4, "few words"), (5, None)]
    found = repeats.without_repeats(docs_of(rows), length=40, gram=8, words=10).collect()
    kept = brute(rows, 40)
    want = [(i, kept[n][5].decode("utf-8", "ignore")) for n, (i, _) in enumerate(rows[:2])] + [(3, None), (None, None), *rows[4:]]
    assert sorted(map(str, ((r.doc_id, r.text) for r in found))) == sorted(map(str, want))


def test_long_texts_have_the_same_runs_of_words_in_pieces():
    random.seed(11)
    text = " ".join(random.choice(["a", "bé", "Some", "x" * 90]) + random.choice(["", ".", "  "]) for _ in range(120))
    column = pa.array([text])

    def runs(step):
        out = []
        for begin, data, offsets, shift in repeats._word_steps(column, 7, step):
            found, _, least = repeats._word_windows(data, offsets, 7, 3)
            at = np.flatnonzero(least)
            out += [(begin, a + shift, b + shift, h) for a, b, h in zip(found.start[at], found.end[at + 6], least[at])]
        return out

    whole = runs(1 << 20)
    assert len(whole) == len(re.findall(r"\w+", text)) - 6
    for step in (1, 50, 333, 1000):
        assert runs(step) == whole
