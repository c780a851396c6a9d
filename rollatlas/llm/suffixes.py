"""Suffix arrays by induced sorting, and permuted common prefixes, over numpy arrays.

Suffixes are classed as smaller (S) or larger (L) than their right neighbour. Leftmost-S
substrings are named in order; where names repeat, the string of names is sorted by the same
method. From the sorted leftmost-S suffixes all others follow in two linear sweeps over the
buckets of first symbols, each bucket in waves of whole arrays.

Places and names are 32-bit numbers, so a string has at most 2^31 symbols; the arrays of a string
take some 40 bytes a symbol at once.
"""

from __future__ import annotations

import numpy as np


def _places(mask: np.ndarray) -> np.ndarray:
    return np.flatnonzero(mask).astype(np.int32)


def _upto(n: int) -> np.ndarray:
    return np.arange(n, dtype=np.int32)


def _smaller(t: np.ndarray) -> np.ndarray:
    """S-type mask; the last symbol is the only smallest one."""
    n = len(t)
    s = np.ones(n, bool)
    smaller = t[:-1] < t[1:]
    # Every run of equal symbols takes the type of its last one.
    end = np.flatnonzero(t[:-1] != t[1:])
    s[:-1] = np.repeat(smaller[end], np.diff(end, prepend=-1))
    return s


def _block_names(t: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Order-preserving names of the blocks ``t[start:end]``; equal blocks get equal names.

    A block that is the beginning of another sorts behind it: it ends in a leftmost-S symbol
    where the other goes on with an L symbol. The name is the number of smaller blocks.
    """
    pad = int(t.max()) + 1
    bits = pad.bit_length()
    each = 63 // bits
    last = len(t) - 1

    def word(rows: np.ndarray, number: int) -> np.ndarray:
        key = np.zeros(len(rows), np.int64)
        for j in range(number * each, (number + 1) * each):
            at = start[rows] + j
            key = (key << bits) | np.where(at < end[rows], t[np.minimum(at, last)], pad)
        return key

    def places(order_keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Sort order, and for each place in it where its run of equal keys begins."""
        order = np.lexsort(order_keys) if len(order_keys) > 1 else np.argsort(order_keys[0], kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = False
        for k in order_keys:
            new[1:] |= k[order][1:] != k[order][:-1]
        return order, np.maximum.accumulate(np.where(new, _upto(len(order)), np.int32(0)))

    order, begin = places([word(_upto(len(start)), 0)])
    name = np.empty(len(start), np.int32)
    name[order] = begin
    length = end - start
    number = 1
    while (long := length > number * each).any():
        # Only groups of equal names with something left to compare.
        marked = np.zeros(len(start), bool)
        marked[name[long]] = True
        rows = _places(marked[name])
        order, begin = places([word(rows, number), name[rows]])
        old = name[rows][order]
        first = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), _upto(len(rows)), np.int32(0)))
        name[rows[order]] = old + begin - first
        number += 1
    return name


def _dense(name: np.ndarray) -> tuple[np.ndarray, int]:
    used = np.zeros(int(name.max()) + 1, bool)
    used[name] = True
    return (np.cumsum(used, dtype=np.int32) - np.int32(1))[name], int(used.sum())


def _sorted_marks(name: np.ndarray) -> np.ndarray:
    """Order of the suffixes of the string of names (its last is the only smallest)."""
    dense, different = _dense(name)
    if different == len(name):
        order = np.empty(len(name), np.int32)
        order[dense] = _upto(len(name))
        return order
    return _sort_names(dense)


def _sort_names(t: np.ndarray) -> np.ndarray:
    """Suffix array of a string over a large alphabet."""
    s = _smaller(t)
    marks = _places(s[1:] & ~s[:-1]) + np.int32(1)
    # The next mark behind each place; the last place is its own block.
    at = _upto(len(t))
    count = np.zeros(len(t), np.int32)
    count[marks] = 1
    following = np.minimum(np.cumsum(count, dtype=np.int32), np.int32(len(marks) - 1))
    name = _block_names(t, at, np.minimum(np.maximum(marks[following], at) + 1, len(t)))
    order = _sorted_marks(name[marks])
    rank = np.empty(len(marks), np.int32)
    rank[order] = _upto(len(marks))
    # One sort of one number: names first, ranks of what follows among equal ones.
    return np.argsort((name.astype(np.int64) << 32) | rank[following], kind="stable").astype(np.int32)


def _induce(t: np.ndarray, s: np.ndarray, marks: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes in order from the leftmost-S suffixes in order."""
    n = len(t)
    count = np.bincount(t, minlength=symbols)
    end = np.cumsum(count)
    start = end - count
    bounds = np.searchsorted(t[marks], np.arange(symbols + 1))
    array = np.full(n, -1, np.int32)
    small = t.astype(np.uint16)
    used = np.flatnonzero(count)
    head, tail = start.copy(), end.copy()

    def push(seen: np.ndarray, smaller: bool) -> None:
        before = seen[seen > 0] - np.int32(1)
        before = before[s[before] == smaller]
        if not len(before):
            return
        symbol = small[before]
        order = np.argsort(symbol, kind="stable")
        symbol, before = symbol[order], before[order]
        own = np.bincount(symbol, minlength=symbols)
        number = np.arange(len(before)) - (np.cumsum(own) - own)[symbol]
        if smaller:
            array[tail[symbol] - 1 - number] = before
            np.subtract(tail, own, out=tail)
        else:
            array[head[symbol] + number] = before
            np.add(head, own, out=head)

    for c in used.tolist():
        done = start[c]
        while done < head[c]:
            seen = array[done : head[c]]
            done = head[c]
            push(seen, False)
        push(marks[bounds[c] : bounds[c + 1]], False)
    for c in used[::-1].tolist():
        done = end[c]
        while done > tail[c]:
            seen = array[tail[c] : done][::-1]
            done = tail[c]
            push(seen, True)
        push(array[start[c] : head[c]][::-1], True)
    array[0] = n - 1
    return array


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of symbols whose last one is 0 and the only 0; alphabets up to 2^16."""
    if len(t) < 2:
        return np.arange(len(t))
    t = np.asarray(t, np.int32)
    s = _smaller(t)
    marks = _places(s[1:] & ~s[:-1]) + np.int32(1)
    name = _block_names(t, marks, np.append(marks[1:] + np.int32(1), np.int32(len(t))))
    return _induce(t, s, marks[_sorted_marks(name)], int(t.max()) + 1)


def permuted_common_prefixes(t: np.ndarray, array: np.ndarray) -> np.ndarray:
    """For each place, how many symbols its suffix shares with the one before it in the array.

    Only places whose left neighbours differ are compared, four symbols at a time; every other
    place shares one symbol less than the place on its left.
    """
    n = len(t)
    before = np.full(n, -1, np.int32)
    before[array[1:]] = array[:-1]
    symbols = np.zeros(n + 8, "<u2")
    symbols[:n] = t
    # The end never equals anything, so that no comparison runs over it.
    words = np.ndarray((n + 4,), "<u8", buffer=symbols, strides=(2,))
    at = _upto(n)
    alone = (before < 1) | (at == 0)
    alone[1:] |= t[at[1:] - 1] != t[before[1:] - 1]
    places = _places(alone & (before >= 0))
    shared = np.zeros(n, np.int32)
    a, b = places.copy(), before[places]
    while len(places):
        differs = words[a] ^ words[b]
        same = differs == 0
        low = differs[~same]
        extra = (low & 0xFFFF == 0).astype(np.int32) + (low & 0xFFFFFFFF == 0) + (low & 0xFFFFFFFFFFFF == 0)
        shared[places[~same]] = a[~same] - places[~same] + extra
        # Four more equal symbols; a word at the end differs in the one smallest symbol.
        places, a, b = places[same], a[same] + 4, b[same] + 4
    base = np.maximum.accumulate(np.where(alone, at, np.int32(0)))
    return np.maximum(shared[base] - (at - base), 0)
