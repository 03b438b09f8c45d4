"""Operator 5, substring dedup: repeated word windows by a compressed FM-index per shard.

A window is ``WINDOW`` consecutive words of one text. Equal windows have equal minimisers (the least hash among their runs of
``GRAM`` words), so neighbouring windows with one minimiser form a segment, and the minimiser names its shard. Segments whose
minimiser stands at one place only in the whole corpus cannot repeat and are not shipped; blocks and parts of the key space
exchange these counts as packed arrays. Equal segments are reduced to the first one before they reach a shard, so a passage
that a third of the documents share is one segment. In a shard, an FM-index holds its segments; they are streamed through
backward search, whose matching statistics report where a whole window occurs elsewhere; the suffix-array rows of the match
give its first occurrence. A word goes if a window over it also starts earlier. Windows are judged on the input.

Cases: a null or empty text has no words, the rest is the empty string; texts under ``WINDOW`` words keep all. "Earlier" is a
smaller id (null least), then an earlier start, whichever row of that id has it; each row is cut by its own marks, and rows
that repeat an id and a text count as one place. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm import common
from spanforge.llm.fm_index import FMIndex, least_in_rows

#: Words of a window and of a gram; minimisers of a part and characters of a shard about.
WINDOW, GRAM, PART_KEYS, SHARD_CHARS = 20, 8, 1_000_000, 4 << 20
_U = np.uint64


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, from those of half the width."""
    got, size = x, 1
    while 2 * size <= width:
        got, size = np.minimum(got[:-size], got[size:]), 2 * size
    return np.minimum(got[: len(x) - width + 1], got[width - size :])


def segments(flat: pa.Array, counts: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Runs of windows with one minimiser: key, text, first word (in flat), windows, and whether it stands at two places."""
    empty = {k: np.zeros(0, t) for k, t in (("key", np.uint64), ("doc", np.int64), ("at", np.int64), ("windows", np.int64), ("twice", bool))}
    total = len(flat)
    if total < window:
        return empty
    codes, vocabulary = common.coded(flat)
    kg = common.grams(common.hashes(vocabulary)[codes], gram)
    doc = np.repeat(np.arange(len(counts)), counts)
    view = np.lib.stride_tricks.sliding_window_view(kg, window - gram + 1)
    real = np.flatnonzero(doc[: total - window + 1] == doc[window - 1 :])
    if not len(real):
        return empty
    key = _least(kg, window - gram + 1)
    new = np.ones(len(real), bool)
    new[1:] = (key[real[1:]] != key[real[:-1]]) | (real[1:] != real[:-1] + 1) | (doc[real[1:]] != doc[real[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(real)) - 1
    # two places: the first window's leftmost minimum is not the last window's rightmost one
    left = real[first] + view[real[first]].argmin(1)
    right = real[last] + (window - gram) - view[real[last]][:, ::-1].argmin(1)
    return {"key": key[real[first]], "doc": doc[real[first]], "at": real[first], "windows": last - first + 1, "twice": left != right}


def _place(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    return ((keys >> _U(32)) % _U(parts)).astype(np.int64), (keys & _U(0xFFFFFFFF)).astype(np.uint32)


def _ask(parts: int):
    def run(table: pa.Table) -> pa.Table:
        got = segments(*common.words(common.filled(table.column("text"))))
        part, low = _place(np.concatenate([got["key"], got["key"][got["twice"]]]), parts)
        rows = common.messages(part, parts, lambda pick: (np.sort(low[pick]).astype("<u4").tobytes(),))
        block = table.column("block")[0].as_py()
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([block] * len(rows), pa.int32()), "keys": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """One part: tells each block which of its minimisers stand at two places or more."""
    lists = table.column("keys").to_pylist()
    asked = np.frombuffer(b"".join(lists), "<u4")
    ordered = np.sort(asked)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    ends = np.cumsum([len(x) // 4 for x in lists])
    # all blocks at once: what a block costs is its own keys, however many others there are
    hit = again[np.minimum(np.searchsorted(again, asked), len(again) - 1)] == asked if len(again) else np.zeros(len(asked), bool)
    new = np.ones(len(asked), bool)
    new[1:] = asked[1:] != asked[:-1]
    new[ends[:-1]] = True  # no list of a block is empty
    held = np.concatenate([[0], np.cumsum(hit & new)])[ends]
    told = [x.tobytes() for x in np.split(asked[hit & new], held[:-1])]
    return pa.table({"block": table.column("block"), "part": table.column("part"), "keys": pa.array(told, pa.binary())})


def _cut(parts: int):
    """Block of texts and its repeated minimisers -> the segments to ship."""

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        ids = texts.column("doc_id")
        flat, counts = common.words(common.filled(texts.column("text")))
        got = segments(flat, counts)
        rows = told.to_pylist()
        known = np.sort(np.concatenate([np.frombuffer(r["keys"], "<u4").astype(np.uint64) | _U(r["part"]) << _U(32) for r in rows] or [np.zeros(0, np.uint64)]))
        part, low = _place(got["key"], parts)
        place = part.astype(np.uint64) << _U(32) | low
        at = np.minimum(np.searchsorted(known, place), max(0, len(known) - 1))
        keep = known[at] == place if len(known) else np.zeros(len(place), bool)
        doc, first, size = got["doc"][keep], got["at"][keep], got["windows"][keep] + WINDOW - 1
        ends = np.cumsum(size)
        take = np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), flat.take(pa.array(take)))
        starts = np.cumsum(counts) - counts
        block = texts.column("block")[0].as_py() if texts.num_rows else 0
        return pa.table({
            "block": pa.array([block] * len(doc), pa.int32()), "doc_id": ids.take(pa.array(doc)), "h": texts.column("h").take(pa.array(doc)), "start": pa.array(first - starts[doc], pa.int32()),
            "shard": pa.array(got["key"][keep].view(np.int64)), "segment": pc.binary_join(lists, " "),
        })

    return run


def _first_windows(table: pa.Table) -> pa.Table:
    """One shard: distinct segments with their first place -> for each, which of its windows also start earlier."""
    flat, lengths = common.words(common.filled(table.column("segment")))
    codes, vocabulary = common.coded(flat)
    codes = codes.astype(np.int64)
    index = FMIndex(codes, lengths, len(vocabulary), WINDOW)
    in_text = np.flatnonzero(index.text > 0)
    offset = np.arange(len(index.text)) - index.starts[index.sequence]
    ends = in_text[offset[in_text] >= WINDOW - 1]
    hit, low, high = index.rows_of(ends, WINDOW)
    # order of all places by (id, start)
    ids = table.column("doc_id")
    nth_id = np.empty(len(ids), np.int64)
    ranks = pc.rank(common.chunked(ids), sort_keys="ascending", null_placement="at_start", tiebreaker="dense")
    nth_id[:] = ranks.to_numpy(zero_copy_only=False)
    start = table.column("start").to_numpy(zero_copy_only=False).astype(np.int64)
    order = (nth_id[index.sequence] << 32) + start[index.sequence] + offset
    begins = ends[hit] - (WINDOW - 1)
    earliest = least_in_rows(order[index.order], low[hit], high[hit])
    gone = begins[earliest < order[begins]]
    marks = np.zeros(len(index.text), np.uint8)
    marks[gone] = 1
    mask = [marks[a : a + n - WINDOW + 1].tobytes() for a, n in zip(index.starts, lengths, strict=True)]
    return pa.table({"shard": table.column("shard"), "mark": table.column("mark"), "first": table.column("first"), "mask": pa.array(mask, pa.binary())})


def _drop(texts: pa.Table, told: pa.Table) -> pa.Table:
    """One block: removes the words under the marked windows. A row is known by its id and the hash of its text."""
    ids, h = common.chunked(texts.column("doc_id")), texts.column("h").to_numpy(zero_copy_only=False)
    known = pc.unique(ids)
    ident = pc.index_in(ids, value_set=known).to_numpy(zero_copy_only=False).astype(np.int64)
    # rows that repeat both are one text
    _, first, row = np.unique(np.stack([ident, h], 1), axis=0, return_index=True, return_inverse=True)
    row = row.ravel()
    flat, counts = common.words(common.filled(texts.column("text").take(pa.array(first))))
    n = len(counts)
    starts = np.cumsum(counts) - counts
    edge = np.zeros(len(flat) + 1, np.int64)
    if told.num_rows and n:
        marks = [np.frombuffer(m, np.uint8) if m is not None else np.ones(w, np.uint8) for m, w in zip(told.column("mask").to_pylist(), told.column("windows").to_pylist(), strict=True)]
        asked = np.stack([pc.index_in(common.chunked(told.column("doc_id")), value_set=known).to_numpy(zero_copy_only=False).astype(np.int64), told.column("h").to_numpy(zero_copy_only=False)], 1)
        _, code = np.unique(np.concatenate([np.stack([ident, h], 1)[first], asked]), axis=0, return_inverse=True)
        which = code.ravel()[n:]  # first stands in the order of the pairs, and all pairs asked are among them
        sizes = np.fromiter(map(len, marks), np.int64, len(marks))
        begin = starts[which] + told.column("start").to_numpy(zero_copy_only=False).astype(np.int64)
        place = (np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum())))[np.concatenate(marks).astype(bool)]
        np.add.at(edge, place, 1)
        np.add.at(edge, place + WINDOW, -1)
    gone = np.cumsum(edge)[:-1] > 0
    doc = np.repeat(np.arange(n), counts)
    removed = np.bincount(doc, weights=gone, minlength=n).astype(np.int64)
    kept = flat.filter(pa.array(~gone))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts - removed)]), pa.int32()), kept)
    return pa.table({"doc_id": texts.column("doc_id"), "n_words": pa.array(counts[row]), "n_removed": pa.array(removed[row]), "kept": pc.binary_join(lists, " ").take(pa.array(row))})


def drop_repeats(df: DataFrame, ident: str = "doc_id", text: str = "text", block_bytes: int = common.BLOCK_BYTES // 2) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every text; kept words are joined by one space."""
    spark = df.sparkSession
    blocks, total, _ = common.in_blocks(df, ident, text, block_bytes)
    blocks = blocks.withColumn("h", F.xxhash64("text"))
    kind = blocks.schema["doc_id"].dataType.simpleString()
    parts = max(4, min(1 << 20, total // (40 * PART_KEYS)))
    told = blocks.groupBy("block").applyInArrow(common.lean(_ask(parts)), "part int, block int, keys binary").groupBy("part").applyInArrow(common.lean(_repeated), "block int, part int, keys binary")
    cut = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(common.lean(_cut(parts)), f"block int, doc_id {kind}, h long, start int, shard long, segment string")
    windows = F.size(F.split("segment", " ")) - (WINDOW - 1)
    places = common.written(cut.withColumn("mark", F.xxhash64("segment")).withColumn("windows", windows))
    del told, cut
    common.release(spark)
    first = places.groupBy("shard", "mark", "segment").agg(F.min(F.struct("doc_id", "start")).alias("first"))
    first = common.written(first)
    size = first.agg(F.sum(F.length("segment"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_CHARS))
    ordered = first.select("shard", "mark", "segment", "first", F.col("first.doc_id").alias("doc_id"), F.col("first.start").alias("start"), F.pmod(F.xxhash64("shard"), F.lit(shards)).alias("at"))
    masks = common.written(ordered.groupBy("at").applyInArrow(common.lean(_first_windows), f"shard long, mark long, first struct<doc_id:{kind},start:int>, mask binary"))
    common.drop_written(first)
    del first, ordered
    common.release(spark)
    gone = places.drop("segment").join(masks, ["shard", "mark"]).select("block", "doc_id", "h", "start", "windows", F.when(F.col("first").eqNullSafe(F.struct("doc_id", "start")), F.col("mask")).alias("mask"))
    gone = gone.where("mask IS NULL OR instr(hex(mask), '01') > 0")
    return blocks.groupBy("block").cogroup(gone.groupBy("block")).applyInArrow(common.lean(_drop), f"doc_id {kind}, n_words long, n_removed long, kept string")
