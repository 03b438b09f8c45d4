"""Operator 8, byte-level BPE encoding and decoding with length-bucketed padded numpy matrices.

A text is cut by the vocabulary's pattern; each distinct piece of a batch is a row of a matrix of token ids, padded within its
length bucket. In each round every row merges its leftmost pair of least rank; pairs are looked up in an open-addressing
hash table held in numpy arrays, the tail of the row moves up by one, and finished rows leave the matrix. A piece over
``LONGEST`` bytes is a row for each of its overlapping windows, and the windows are joined at tokens that neighbours share, which
gives the ids of the whole (see ``merge_windows``).

Cases: a null or empty text has no tokens. Any bytes can be encoded, since all 256 single bytes have ranks. Decoding ids gives
the text's bytes back. Repeated rows give equal values. Ids of rows are passed through; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanforge.llm import common

#: Bytes beyond which a piece is several rows; upper ends of the length buckets; distinct pieces that a worker remembers.
LONGEST, BUCKETS, REMEMBERED = 256, (2, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256), 150_000
#: Bytes of a window of a long piece, from one window's start to the next, in both of them; cells of a matrix.
WINDOW, STRIDE, OVERLAP, CELLS = 128, 96, 32, 1 << 20
NONE = np.int32(1 << 30)


def _bucket(length: int) -> int:
    """Width of the matrix for pieces of a length; windows that had to grow have powers of two."""
    return next((w for w in BUCKETS if length <= w), 1 << (length - 1).bit_length())


class Merges:
    """The ranks of a vocabulary, and the pairs of tokens whose joined bytes have a rank."""

    def __init__(self, data: bytes):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}
        top = max(self.ranks.values()) + 1
        tokens = [b""] * top
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.ends = np.cumsum([len(t) for t in tokens])
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.tokens = tokens
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        get = self.ranks.get
        pairs = [(a, b, rank) for token, rank in self.ranks.items() for at in range(1, len(token)) if (a := get(token[:at])) is not None and (b := get(token[at:])) is not None]
        self._build(np.array(pairs, np.int64).reshape(-1, 3))

    def _build(self, pairs: np.ndarray) -> None:
        self.bits = max(4, int(4 * max(1, len(pairs))).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        todo, at = pairs, self._slot(pairs[:, 0] << 32 | pairs[:, 1])
        self.probes = 0
        while len(todo):
            free = self.keys[at] == -1
            _, first = np.unique(np.where(free, at, -1), return_index=True)
            won = first[free[first]]
            self.keys[at[won]], self.values[at[won]] = todo[won, 0] << 32 | todo[won, 1], todo[won, 2]
            left = np.ones(len(todo), bool)
            left[won] = False
            todo, at = todo[left], (at[left] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each joined pair, NONE where it has none; negative ids are padding."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at, out = self._slot(key), np.full(key.shape, NONE, np.int32)
        found = self.keys[at]
        hit = found == key
        out[hit] = self.values[at[hit]]
        open_ = np.nonzero(~hit & (found != -1) & (right >= 0) & (left >= 0))
        at, key = at[open_], key[open_]
        for _ in range(self.probes):
            if not len(at):
                break
            at = (at + 1) & ((1 << self.bits) - 1)
            found = self.keys[at]
            hit = found == key
            out[tuple(x[hit] for x in open_)] = self.values[at[hit]]
            on = ~hit & (found != -1)
            open_, at, key = tuple(x[on] for x in open_), at[on], key[on]
        out[(left < 0) | (right < 0)] = NONE
        return out

    def merge_rows(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Token ids of pieces of up to ``width`` bytes."""
        n, result = len(pieces), [None] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        ids = np.full((n, width + 1), -1, np.int32)
        inside = np.arange(width + 1) < lengths[:, None]
        ids[inside] = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        rows, columns = np.arange(n), np.arange(width)
        while len(rows):
            at = ranks.argmin(axis=1)
            each = np.arange(len(rows))
            best = ranks[each, at]
            over = best == NONE
            if over.any():
                for k in np.flatnonzero(over):
                    row = ids[k]
                    result[rows[k]] = row[: int((row >= 0).sum())].copy()
                keep = ~over
                ids, ranks, rows, at, best = ids[keep], ranks[keep], rows[keep], at[keep], best[keep]
                each = np.arange(len(rows))
                if not len(rows):
                    break
            ids[each, at] = best
            later = columns > at[:, None]
            shifted = ids[:, 2:] if width > 1 else ids[:, :0]
            ids[:, 1:-1][later[:, : width - 1] | (columns[: width - 1] == at[:, None])] = shifted[later[:, : width - 1] | (columns[: width - 1] == at[:, None])]
            ids[:, -1] = -1
            moved = ranks[:, 1:][columns[: width - 1] >= at[:, None]]
            ranks[:, :-1][columns[: width - 1] >= at[:, None]] = moved
            ranks[:, -1] = NONE
            ranks[each, at] = self.pair_ranks(ids[each, at], ids[each, at + 1])
            back = np.flatnonzero(at > 0)
            ranks[back, at[back] - 1] = self.pair_ranks(ids[back, at[back] - 1], ids[back, at[back]])
        return result

    def merged(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces up to the widest bucket, by merges alone."""
        out: list = [None] * len(pieces)
        sorted_in: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            sorted_in.setdefault(_bucket(len(piece)), []).append(k)
        for width, where in sorted_in.items():
            step = max(1, CELLS // width)
            for at in range(0, len(where), step):
                part = where[at : at + step]
                for k, ids in zip(part, self.merge_rows([pieces[k] for k in part], width), strict=True):
                    out[k] = ids
        return out

    def merge_windows(self, piece: bytes, rows: dict[bytes, np.ndarray]) -> np.ndarray:
        """Ids of a long piece from ``rows``, the ids of its windows; windows that are lacking are merged and added.

        Windows are joined at a token that both have at the same place: then any two tokens that stand side by side do so in
        a window, so each pair is what merges make of its own bytes, and no merge of the whole crosses them. Where two windows
        share no token (a run of one letter, cut out of step), the next window starts at a token of the last, further and
        further back, and then grows until they do; the last resort is the piece as one row.
        """

        def window(start: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            own = piece[start : start + width]
            if (ids := rows.get(own)) is None:
                ids = rows[own] = self.merged([own])[0]
            ends = start + np.cumsum(self.lengths[ids])
            return ids, ends - self.lengths[ids], ends

        def shared(one: tuple, other: tuple) -> tuple[int, int] | None:
            _, at, to = np.intersect1d(one[1], other[1], assume_unique=True, return_indices=True)
            same = np.flatnonzero(one[2][at] == other[2][to])
            return (int(at[same[-1]]), int(to[same[-1]])) if len(same) else None

        last, done = window(0, WINDOW), []
        while (end := int(last[2][-1])) < len(piece):
            following = window((end - OVERLAP) // STRIDE * STRIDE, WINDOW)
            seam = shared(last, following)
            at, more = len(last[0]), WINDOW
            while seam is None:
                if at == 0:
                    if end + more >= len(piece):
                        return self.merged([piece])[0]
                    at, more = len(last[0]), 2 * more
                at //= 2
                start = int(last[1][at])
                following = window(start, end + more - start)
                seam = shared(last, following)
            done.append(last[0][: seam[0]])
            last = tuple(x[seam[1] :] for x in following)
        return np.concatenate([*done, last[0]])

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece; a piece that is a token as a whole is that token."""
        whole = [self.ranks.get(piece) for piece in pieces]
        short = [k for k, piece in enumerate(pieces) if whole[k] is None and len(piece) <= LONGEST]
        long = [k for k, piece in enumerate(pieces) if whole[k] is None and len(piece) > LONGEST]
        out = [None if rank is None else np.array([rank], np.int32) for rank in whole]
        for k, ids in zip(short, self.merged([pieces[k] for k in short]), strict=True):
            out[k] = ids
        windows = list({pieces[k][at : at + WINDOW] for k in long for at in range(0, len(pieces[k]) - OVERLAP, STRIDE)})
        rows = dict(zip(windows, self.merged(windows), strict=True))
        for k in long:
            out[k] = self.merge_windows(pieces[k], rows)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return gathered(self.flat, self.ends - self.lengths, self.lengths, ids).tobytes()


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs flat[starts[k] : starts[k] + lengths[k]] for k in which, joined."""
    n = lengths[which]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts[which] - (ends - n), n) + np.arange(total)]


@lru_cache(maxsize=2)
def merges(data: bytes) -> Merges:
    """One table a worker and vocabulary."""
    return Merges(data)


class Encoder:
    """Encodes whole batches; remembers the ids of distinct pieces."""

    def __init__(self, table: Merges, pattern: str):
        import regex

        self.table, self.split, self.known = table, regex.compile(pattern).findall, {}

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        found = [self.split(text) for text in texts]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        codes, vocabulary = common.coded(pa.array([p for x in found for p in x], pa.string()))
        pieces = vocabulary.cast(pa.binary()).to_pylist()
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, pieces
        self.known.update(zip(new, self.table.encode_pieces(new), strict=True))
        ids = [self.known[p] for p in pieces]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        stream = gathered(flat, np.cumsum(lengths) - lengths, lengths, codes)
        ends = np.cumsum(np.bincount(np.repeat(np.arange(len(texts)), counts), weights=lengths[codes], minlength=len(texts)).astype(np.int64))
        return np.split(stream, ends[:-1]) if len(texts) else []


def encode(df: DataFrame, vocabulary: bytes, pattern: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids binary: little-endian unsigned 32-bit integers, decoded binary: the ids' bytes).

    ``vocabulary`` is the content of a rank file, under a megabyte; it travels with the function.
    """
    slim = df.select(df[ident].alias("doc_id"), df[text].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = merges(vocabulary)
        encoder = Encoder(table, pattern)
        for part in common.slices(batches, "text", 2 << 20):
            ids = encoder.batch(common.filled(part.column("text")).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([table.decode(x) for x in ids], pa.binary())], ["doc_id", "ids", "decoded"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary")
