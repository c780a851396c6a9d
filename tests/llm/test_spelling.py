from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from rollatlas.llm import spelling as S

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    """Exactly one insertion, deletion or replacement apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, every=97, min_chars=5, min_count=3, factor=2):
    counts = Counter()
    for name, text in docs:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}
    rows = {}
    for w, n in words.items():
        others = sorted((-m, v) for v, m in words.items() if near(v, w))
        top = others[0] if others and -others[0][0] >= factor * n else None
        rows[w] = (w, top[1] if top else None, n, len(others), -top[0] if top else None)

    def root(w):
        while rows[w][1] is not None:
            w = rows[w][1]
        return w

    return sorted((w, form, root(w), n, count, form_n) for w, form, n, count, form_n in rows.values())


def result(frame):
    assert frame.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, frame.collect()))


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(docs_of, seed):
    pick = random.Random(seed)
    base = ["aabba", "ababab", "éèàxyz", "Hello", "aaaaaa", "ÀBCDE", "straße", "colour", "abcab"]
    letters = "abé"

    def spelled():
        w = list(pick.choice(base))
        for _ in range(pick.choice([0, 0, 0, 1, 1, 2])):
            i, kind = pick.randrange(len(w)), pick.random()
            if kind < 0.3:
                w.insert(i, pick.choice(letters))
            elif kind < 0.6 and len(w) > 1:
                del w[i]
            else:
                w[i] = pick.choice(letters)
        return "".join(w)

    docs = [(i, " ".join(spelled() for _ in range(60)) + pick.choice(["-", "日本 ", "1", "\n"])) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "12 日本 ..."), (None, "colour " * 5), (3, "aaaaa aaaaaaa " * 9)]
    docs += [(7, "hello hallo hella")] * 4
    assert result(S.spelling_groups(docs_of(docs), every=7)) == brute(docs, every=7)
    assert result(S.spelling_groups(docs_of(docs), every=7, min_count=1, min_chars=2)) == brute(docs, 7, 2, 1)


def test_chains_end_at_the_last_form(docs_of):
    words = ["aaaaaaaa"[: 5 + i] for i in range(4)]
    docs = [(i, " ".join(f"{w} " * (3 * 3**k) for k, w in enumerate(words))) for i in range(1)]
    got = result(S.spelling_groups(docs_of(docs), every=1 << 40))
    assert got == brute(docs, every=1 << 40) and {r[2] for r in got} == {words[-1]}


def test_groups_are_scanned_without_pairs():
    members = [("abcde", 5, "a", True), ("bbcde", 5, "b", True), ("cbcde", 9, "c", True), ("bcde", 7, None, True)]
    assert {w: (n, best) for w, n, best in S.scan_group(members)} == {
        "abcde": (3, (-9, "cbcde")), "bbcde": (3, (-9, "cbcde")), "cbcde": (3, (-7, "bcde")), "bcde": (3, (-9, "cbcde")),
    }
    assert list(S.scan_group([("aab", 1, "a", False), ("ab", 1, None, True)])) == []


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = "word Ünder × " * 300 + "x" * 400 + " tail"
    want = [w for part in S.run_lists(text) for w in part if w]
    monkeypatch.setattr(S, "PIECE_CHARS", 50)
    assert len(list(S.run_lists(text))) > 20
    assert [w for part in S.run_lists(text) for w in part if w] == want
    assert [w.decode("latin-1") for w in want[:3]] == ["word", "Ünder", "×"]


def test_counts_are_handed_on_when_many(docs_of, monkeypatch):
    docs = [(i, " ".join(f"w{chr(97 + j % 26)}{chr(97 + j // 26)}rds" for j in range(200))) for i in range(4)]
    want = brute(docs)
    monkeypatch.setattr(S, "HELD_WORDS", 16)
    assert result(S.spelling_groups(docs_of(docs))) == want


def test_no_words(docs_of):
    for docs in ([], [(1, None), (2, "a b c"), (3, "only twice twice")]):
        assert S.spelling_groups(docs_of(docs)).collect() == []
