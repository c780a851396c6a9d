"""Token ids of whole texts, each different word encoded once per cache fill.

The vocabulary drops white space, lower-cases, and lets no token span white space or the
border between an ASCII letter and a plain mark. So the ids of a text are the ids of its pieces
cut there, in order; the pieces themselves go through the tokenizer. Marks that the tokenizer
joins with letters (the apostrophe, those of special tokens) are never a border.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles

from rollatlas.llm import bytetext

#: Words held at a time; a full cache is emptied, which changes no id.
CACHE_WORDS = 600_000
#: Bytes of text encoded together; fewer make more merges of the cache.
STEP_BYTES = 2 << 20
END_ID = 2
_LETTERS = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_PLAIN_MARKS = np.isin(np.arange(256), list(b'.,;:!?()[]{}"-#&$%*+/=@_~^'))
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        # One call for all: a token belongs to the text that its place in the joined text falls in.
        length = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        encoded = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        place = np.fromiter((o[0] for o in encoded.offsets), np.int64, len(encoded.ids))
        owner = np.searchsorted(np.cumsum(length), place, side="right")
        count = np.bincount(owner, minlength=len(texts))
        first = len(self.pool) + np.cumsum(count) - count
        self.pool = np.concatenate([self.pool, np.array(encoded.ids, np.uint32)])
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.first = np.insert(self.first, at, first)
        self.count = np.insert(self.count, at, count)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, ``END_ID`` after each, and where each text ends."""
        if b"<|" not in data.tobytes():
            data = bytetext.LOWER[data]
        w = bytetext.words(data, offsets, borders=(_LETTERS, _PLAIN_MARKS))
        keys, where, back = np.unique(w.hash, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_WORDS:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        if not known.all():
            raw = data.tobytes()
            new = where[~known]
            texts = [raw[s:e].decode() for s, e in zip(w.start[new].tolist(), w.end[new].tolist())]
            self._learn(keys[~known], texts)
            at = np.searchsorted(self.keys, keys)
        count, first = self.count[at][back], self.first[at][back]
        done = np.cumsum(count)
        total = int(done[-1]) if len(done) else 0
        rows = len(offsets) - 1
        per_row = np.bincount(w.row, weights=count, minlength=rows).astype(np.int64)
        ends = np.cumsum(per_row + 1)
        ids = np.full(total + rows, END_ID, np.uint32)
        keep = np.ones(len(ids), bool)
        keep[ends - 1] = False
        ids[keep] = self.pool[np.repeat(first - (done - count), count) + np.arange(total)]
        return ids, ends


def encoder(path: str) -> WordEncoder:
    """Encoder of a vocabulary file: a whole path, or the name of a file that Spark has sent."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path if os.path.isabs(path) else SparkFiles.get(path))
    return _encoders[path]


def encoded_rows(column: pa.Array, path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids, end of each row's ids) for runs of rows of a text column."""
    own = encoder(path)
    for first, _, data, offsets in bytetext.steps(column, STEP_BYTES):
        yield first, *own.encode(data, offsets)
