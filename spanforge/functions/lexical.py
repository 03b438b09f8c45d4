"""Lexical tokens of whole batches of texts in numpy: the same as ``text.lexical_tokens``, without a list of strings for each text.

A token is known by a 64-bit hash of its lower-cased bytes inside a batch; strings are made for distinct tokens only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are looked at at once; one longer text stands alone.
SLICE = 1 << 20
_P = 0x9E3779B97F4A7C15
_BACK = pow(_P, -1, 1 << 64)
#: Lower-cased bytes; 0 for what ends a token, 1 for what goes on with one, 2 for what begins one.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[[ord(c) for c in "_-."]] = 1
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 2
_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers modulo 2^64, kept for the next call."""
    held = _tables.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, SLICE + 4096), base, np.uint64)
        held[0] = 1
        _tables[base] = held = np.cumprod(held, dtype=np.uint64)
    return held[:n]


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins, with the end of the last; nulls are empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _hashed(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(_P, len(raw)), out=sums[1:])
    h = (sums[end] - sums[start]) * powers(_BACK, len(raw) + 1)[start]
    h = (h ^ (h >> np.uint64(29)) ^ (end - start).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Tokens:
    """Of each token of the texts in order: hash ``h`` and text ``row``; of each text its count ``dl``."""

    def __init__(self, texts: pa.Array):
        raw, at = flat_bytes(texts)
        self.raw, kind = _LOWER[raw], _KIND[raw]
        inside, first = kind > 0, np.zeros(len(raw) + 1, bool)
        first[at] = True  # texts do not run on
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | first[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | first[1:-1]
        run = np.cumsum(begins, dtype=np.int64) - 1
        letter = np.flatnonzero(kind == 2)
        of = run[letter]
        self.start = letter[np.concatenate([[True], of[1:] != of[:-1]])] if len(letter) else letter
        self.end = (np.flatnonzero(ends) + 1)[run[self.start]] if len(letter) else letter
        self._rows(at)

    def _rows(self, at: np.ndarray) -> None:
        self.h = _hashed(self.raw, self.start, self.end)
        self.row = np.searchsorted(at, self.start, "right") - 1
        self.dl = np.bincount(self.row, minlength=len(at) - 1)

    @classmethod
    def listed(cls, lists: pa.Array) -> Tokens:
        """Of tokens that come as lists of strings."""
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        out = cls.__new__(cls)
        out.raw, at = flat_bytes(lists.flatten())
        out.start, out.end = at[:-1], at[1:]
        out.h = _hashed(out.raw, out.start, out.end)
        out.dl = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        out.row = np.repeat(np.arange(len(out.dl)), out.dl)
        return out

    def counted(self) -> tuple[pa.Array, np.ndarray]:
        """Distinct tokens, and in how many texts each stands."""
        order = np.argsort(self.h, kind="stable")
        h, row = self.h[order], self.row[order]
        new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        pair = new | np.concatenate([[True], row[1:] != row[:-1]]) if len(h) else new
        at = np.flatnonzero(new)
        n = np.add.reduceat(pair.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
        start, size = self.start[order[at]], (self.end - self.start)[order[at]]
        offsets = np.concatenate([[0], np.cumsum(size)])
        data = self.raw[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())), n


def hash_of(tokens: list[str]) -> np.ndarray:
    """The hashes of whole strings."""
    return Tokens.listed(pa.array([tokens], pa.list_(pa.string()))).h


def parts(batches: Iterator[pa.RecordBatch], column: str, rows: int = 1024) -> Iterator[tuple[pa.RecordBatch, Tokens]]:
    """Batches of at most ``rows`` rows and about ``SLICE`` bytes, with the tokens of a column of texts or of lists."""
    for whole in batches:
        listed = pa.types.is_list(whole.schema.field(column).type)
        size = (pc.list_value_length(whole.column(column)) if listed else pc.binary_length(whole.column(column))).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) * (8 if listed else 1)
        ends, at = np.cumsum(size), 0
        while at < whole.num_rows:
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right"))))
            batch = whole.slice(at, to - at)
            yield batch, (Tokens.listed if listed else Tokens)(batch.column(column))
            at = to
