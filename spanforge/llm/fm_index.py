"""An FM-index over word codes: wavelet matrix of plain bit vectors, backward search, matching statistics. All steps are vectorised."""

from __future__ import annotations

import numpy as np

from spanforge.llm import common

_U = np.uint64
#: For each place in a word: the bits before it.
_BEFORE = (_U(1) << np.arange(64, dtype=np.uint64)) - _U(1)
#: Searches that run side by side, few enough for their arrays to stay in a core's cache.
TOGETHER = 1 << 13


class BitRank:
    """A bit vector in 64-bit words with counts of ones before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits) // 64 + 1
        padded = np.zeros(n * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))[:-1]]).astype(np.int32)
        self.ones = int(np.count_nonzero(bits))
        self.zeros = len(bits) - self.ones

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & _BEFORE[at & 63])


class WaveletMatrix:
    """Ranks of symbols in a sequence, in one bit vector for each bit of a symbol."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.levels = []
        for k in range(self.bits - 1, -1, -1):
            bit = (sequence >> k & 1).astype(np.uint8)
            self.levels.append(BitRank(bit))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])
        self.start = self._down(np.arange(symbols), np.zeros(symbols, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            ones = level.rank(at)
            at = at - ones
            np.copyto(at, ones + level.zeros, where=(symbol >> k & 1).astype(bool))
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position; positions may have a leading axis more."""
        return self._down(symbol, at) - self.start[symbol]


def _ordered(key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of n keys below (n + 1) ** 2, and the keys in this order."""
    bits = n.bit_length()
    if 3 * bits > 63:
        order = np.argsort(key)
        return order, key[order]
    both = np.sort(key << bits | np.arange(n))  # a key and its place in one number: plain sorting is faster than that of places
    return both & ((1 << bits) - 1), both >> bits


def suffix_array(text: np.ndarray, most: int | None = None) -> np.ndarray:
    """Order of the suffixes of a sequence of non-negative integers by their first ``most`` values at least, by all without it.

    The compared prefix is doubled.
    """
    n = len(text)
    rank = text.astype(np.int64) if n and text.max() < n else np.unique(text, return_inverse=True)[1]
    order, step = np.zeros(n, np.int64), 1
    while n and (step == 1 or rank.max() < n - 1 and (most is None or step < most)):
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        order, ordered = _ordered(rank * (n + 1) + after, n)
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        step *= 2
    return order


class FMIndex:
    """Index over several sequences of codes 0 .. symbols - 1; each ends in a separator of its own.

    With ``most``, suffixes are in order by that many codes only: enough for sequences up to this length, whose rows are the
    same then, as a search by one more code counts rows and does not ask for the order inside them.
    """

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, symbols: int, most: int | None = None):
        m = len(lengths)
        self.sequence = np.repeat(np.arange(m), lengths + 1)
        self.starts = np.cumsum(lengths + 1) - (lengths + 1)
        ends = self.starts + lengths
        word = np.ones(len(codes) + m, bool)
        word[ends] = False
        text = np.empty(len(codes) + m, np.int64)
        text[word], text[ends] = codes + m, np.arange(m)
        self.order = suffix_array(text, most)
        self.text = np.where(word, text - m + 1, 0)  # separators are one symbol, 0, which no search extends by
        self.tree = WaveletMatrix(self.text[self.order - 1], symbols + 1)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=symbols + 1))])
        self.lengths = lengths

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose suffixes begin with the symbol (shifted by one) followed by those of [low, high)."""
        low, high = self.first[symbol] + self.tree.rank(symbol, np.stack([low, high]))
        return low, high

    def statistics(self, codes: np.ndarray, ends: np.ndarray, most: int, once: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For a streamed sequence: at each end, the longest match ending there, up to ``most``, and its rows [low, high).

        A search stops where no more than ``once`` rows are left: with 1, a sequence that is itself in the index is
        followed only as far as it occurs elsewhere too. Codes outside the index are negative.
        """
        length, low, high = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64), np.full(len(ends), len(self.text))
        for a in range(0, len(ends), TOGETHER):
            part = slice(a, a + TOGETHER)
            self._statistics(codes, ends[part], most, once, length[part], low[part], high[part])
        return length, low, high

    def rows_of(self, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the ``size`` codes of the index itself up to each end: whether they stand at two places or more, and their rows.

        Places with one hash are searched once, by the first of them; a place that is not among the rows found has other codes
        and a search of its own.
        """
        begins = ends - (size - 1)
        _, lead, of = np.unique(common.grams(common.mixed(self.text.astype(np.uint64)), size)[begins], return_index=True, return_inverse=True)
        length, low, high = (x[of] for x in self.statistics(self.text - 1, ends[lead], size, once=1))
        row = np.empty(len(self.text), np.int64)
        row[self.order] = np.arange(len(row))
        found = (length == size) & (low <= row[begins]) & (row[begins] < high)
        own = ~found
        own[lead] = False
        length, low[own], high[own] = self.statistics(self.text - 1, ends[own], size, once=1)
        found[own] = length == size
        return found, low, high

    def _statistics(self, codes: np.ndarray, ends: np.ndarray, most: int, once: int, length: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Fills length, low and high."""
        alive = np.arange(len(ends))
        for k in range(most):
            at = ends[alive] - k
            symbol = np.where(at >= 0, codes[np.maximum(at, 0)], -1) + 1
            fine = (symbol > 0) & (symbol < len(self.first) - 1)
            alive, symbol = alive[fine], symbol[fine]
            # the empty sequence has all rows, so the first code needs no search
            a, b = self.extend(symbol, low[alive], high[alive]) if k else (self.first[symbol], self.first[symbol + 1])
            more = b - a > once
            alive = alive[more]
            low[alive], high[alive], length[alive] = a[more], b[more], k + 1
            if not len(alive):
                break


def least_in_rows(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low:high]) for each non-empty row range."""
    if not len(low):
        return np.zeros(0, values.dtype)
    pairs, at = np.unique(np.stack([low, high], 1), axis=0, return_inverse=True)
    padded = np.append(values, values.max())
    return np.minimum.reduceat(padded, pairs.ravel())[::2][at.ravel()]
