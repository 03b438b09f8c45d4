"""Operator 10, line dedup: a log-template tree.

Lines are parsed at a fixed depth: first by their count of words, then by their leading words; words with a digit are variable
(``<*>``) from the start, unless they are most of their line. In a leaf the variable fields of the other places are found in
two ways that look at counts only, so that no leaf has to stand in one task and no order of lines matters:

1. A word that fewer than ``DOCS`` documents have in this place of this leaf can be no constant of a recurring template: its
   place is variable. A line with more than ``1 - LIKE`` of its words variable in this way belongs to no template.
2. A place in which a template differs from another one, while they are equal in all others, is variable. Templates that do so in
   any place share a key, the template with that place variable, so keys are counted. All such places of a template become
   variable at once, those whose keys most templates share first (then the earlier ones), round after round until none moves. No
   template makes more than ``1 - LIKE`` of its line variable, so rounds end.

A template met in ``DOCS`` documents or more recurs, whatever its length; its lines stay in the first of these documents and are
dropped from all others.

Equal masked lines are counted before anything is exchanged, so a line that a third of the documents hold is one row a batch.
Leaves that fewer than ``DOCS`` documents reach are left at once. Templates are 64-bit hashes, the exclusive or over their
constant places, so a key costs one operation. The plan is the same at every size.

Cases: a null text stays null with 0 lines; lines of fewer than ``LEAST_WORDS`` words and blank lines are always kept. "First"
is the least id; a null id is dropped from nowhere and counts as no document. Rows that repeat an id count as one document.
Other columns are carried as they are; counts take other names where df has columns ``n_lines`` or ``n_dropped`` (``count_names``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from spanforge.llm import common

#: Leading words in the tree; least words of a template; share of words alike; documents of a recurring template.
LEADING, LEAST_WORDS, LIKE, DOCS = 2, 3, 0.75, 4
VARIABLE = "<*>"
_U = np.uint64


_SCATTER = common.mixed(np.arange(1, 257, dtype=np.uint64) * _U(0xA0761D6478BD642F))
_BACK = pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words: differences of prefix sums over the bytes of all of them, so no word becomes an object."""
    words = words.cast(pa.binary())
    if not len(words):
        return np.zeros(0, np.uint64)
    edges = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    size, ends = np.diff(edges), edges[1:] - edges[0]
    ahead, back = np.ones(len(raw) + 1, np.uint64), np.ones(len(raw) + 1, np.uint64)
    np.cumprod(np.full(len(raw), 0x9E3779B97F4A7C15, np.uint64), out=ahead[1:])
    np.cumprod(np.full(len(raw), _BACK, np.uint64), out=back[1:])
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_SCATTER[raw] * ahead[:-1], out=sums[1:])
    return common.mixed(common.mixed((sums[ends] - sums[ends - size]) * back[ends - size]) + size.astype(np.uint64))


class Lines:
    """The lines of texts with their masked words, leaf and hash; arrays by line."""

    def __init__(self, texts: pa.Array):
        lists = pc.split_pattern(texts, "\n")
        self.raw = lists.flatten()
        self.per = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.doc = np.repeat(np.arange(len(texts)), self.per)
        self.words, self.counts = common.words(self.raw)
        codes, vocabulary = common.coded(self.words)
        digit = pc.match_substring_regex(vocabulary, "[0-9]").to_numpy(zero_copy_only=False).astype(bool)
        starts = np.cumsum(self.counts) - self.counts
        # a line that is mostly figures is compared as it stands: its figures are what it says
        line = np.repeat(np.arange(len(self.counts)), self.counts)
        figures = np.bincount(line, weights=digit[codes] if len(codes) else None, minlength=len(self.counts))
        mask = digit[codes] & (2 * figures <= self.counts)[line]
        self.vocabulary = pa.concat_arrays([vocabulary, pa.array([VARIABLE])])
        self.codes = np.where(mask, len(vocabulary), codes)
        h = word_hashes(self.vocabulary)[self.codes]
        nth = np.arange(len(codes)) - np.repeat(starts, self.counts)
        powers = np.cumprod(np.full(int(nth.max()) + 1 if len(nth) else 1, 0x9E3779B97F4A7C15, np.uint64))
        sums = np.add.reduceat(np.append(common.mixed(h) * powers[nth], _U(0)), np.minimum(starts, len(codes))) if len(starts) else np.zeros(0, np.uint64)
        self.hash = common.mixed(sums * (self.counts > 0) + self.counts.astype(np.uint64))
        self.fit = self.counts >= LEAST_WORDS
        leaf = self.counts.astype(np.uint64)
        for k in range(LEADING):
            has = self.counts > k
            leaf = common.mixed(leaf * _U(0x9E3779B97F4A7C15) + np.where(has, h[np.minimum(starts + k, max(0, len(h) - 1))] if len(h) else _U(0), _U(0)))
        self.leaf, self.starts = leaf, starts

    def masked(self, which: np.ndarray) -> pa.Array:
        size = self.counts[which]
        ends = np.cumsum(size)
        take = np.repeat(self.starts[which] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), self.vocabulary.take(pa.array(self.codes[take]))), " ")


def _gathered(keys: np.ndarray, docs: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lines ``which``: one line for each distinct key, the starts of the keys' documents, and these, each once."""
    order = which[np.lexsort((docs[which], keys[which]))]
    new = np.ones(len(order), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (docs[order][1:] != docs[order][:-1])
    order = order[new]
    first = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]])) if len(order) else np.zeros(0, np.int64)
    return order[first], np.append(first, len(order)), docs[order]


def lines_of(df: DataFrame) -> DataFrame:
    """(leaf, mark, line, docs): the masked lines of each batch with the documents that hold them, by (doc_id, text)."""
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "text"):
            lines = Lines(common.filled(part.column("text")))
            which, edges, docs = _gathered(lines.hash, lines.doc, np.flatnonzero(lines.fit))
            held = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), part.column("doc_id").take(pa.array(docs)))
            yield pa.RecordBatch.from_arrays([pa.array(lines.leaf[which].view(np.int64)), pa.array(lines.hash[which].view(np.int64)), common.chunked(lines.masked(which)), held], ["leaf", "mark", "line", "docs"])

    return df.mapInArrow(run, f"leaf long, mark long, line string, docs array<{kind}>")


def masked_templates(reached: DataFrame, docs: int = DOCS, like: float = LIKE) -> DataFrame:
    """(mark, t, room, cells) of the masked lines that can have a recurring template: t is the hash of the template, cells its
    constant places after the leading ones with their hashes, room how many of them may still become variable."""
    lines = reached.groupBy("leaf", "mark").agg(F.sum(F.size("docs")).alias("n"), F.first("line").alias("line")).withColumn("words", F.split("line", " "))
    places = F.transform("words", lambda w, k: F.struct(k.alias("pos"), F.when(w != VARIABLE, F.xxhash64(F.col("leaf"), k, w)).alias("h")))
    room = F.floor((1 - like) * F.size("words") + 1e-9).cast("int")
    base = common.written(lines.select("leaf", "mark", "n", room.alias("room"), F.filter(places, lambda c: c["h"].isNotNull() & (c["pos"] >= LEADING)).alias("cells")))
    held = common.written(base.select("n", F.explode("cells.h").alias("h")).groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= docs).select("h"))
    each = base.select("mark", F.explode("cells").alias("c")).select("mark", F.col("c.pos").alias("pos"), F.col("c.h").alias("h"))
    # a masked line is known by its mark alone: its leaf and its room join again once its places are counted
    constant = each.join(held, "h").groupBy("mark").agg(F.collect_list(F.struct("pos", "h")).alias("kept"), F.bit_xor("h").alias("x"))
    out = base.select("mark", "leaf", "room", F.size("cells").alias("of")).join(constant, "mark", "left")
    kept = F.coalesce("kept", F.expr("cast(array() as array<struct<pos:int,h:bigint>>)"))
    out = out.select("mark", F.xxhash64("leaf", F.lit(-1)).bitwiseXOR(F.coalesce("x", F.lit(0).cast("long"))).alias("t"), (F.col("room") - F.col("of") + F.size(kept)).alias("room"), kept.alias("cells"))
    out = common.written(out.where("room >= 0"))
    for done in (base, held):
        common.drop_written(done)
    return out


def merged(now: DataFrame) -> tuple[DataFrame, int]:
    """One round over templates (t, room, cells): (t, to, room, cells) with the template that each becomes, its room and places by
    then, written; and how many became another."""
    each = now.where("room > 0").select("t", "room", F.explode("cells").alias("c")).select("t", "room", F.col("t").bitwiseXOR(F.col("c.h")).alias("to"), "c")
    often = now.select(F.col("t").alias("to")).unionByName(each.select("to")).groupBy("to").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # as many picks as there are words in a line
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("c.pos").alias("pos"), F.col("c.h").alias("h"))))
    picks = each.join(often, "to").groupBy("t", F.col("room").alias("most")).agg(ordered.alias("p")).select("t", F.slice("p", 1, F.col("most")).alias("p"))
    became = F.aggregate("p", F.col("t"), lambda t, x: t.bitwiseXOR(x["h"]))
    left = F.filter("cells", lambda c: ~F.array_contains("p.pos", c["pos"]))
    after = now.join(picks, "t", "left").select("t", F.coalesce(became, "t").alias("to"), (F.col("room") - F.coalesce(F.size("p"), F.lit(0))).alias("room"), F.when(F.col("p").isNull(), F.col("cells")).otherwise(left).alias("cells"))
    counted = Observation()
    after = common.written(after.observe(counted, F.count_if(F.col("t") != F.col("to")).alias("moves")))
    return after, counted.get["moves"]


def templates(reached: DataFrame, docs: int = DOCS, like: float = LIKE) -> DataFrame:
    """(mark, t): the template of each masked line that can have a recurring one."""
    first = masked_templates(reached, docs, like)
    once = lambda rows: common.written(rows.groupBy("t").agg(F.max(F.struct("room", "cells")).alias("m")).select("t", "m.room", "m.cells"))
    now = begun = once(first.select("t", "room", "cells"))
    rounds = []
    while True:  # every move leaves a template with a constant place less, so this ends
        after, moves = merged(now)
        if not moves:
            break
        rounds.append(after.where("t <> to").select(F.col("t").alias("at"), F.col("to").alias("on")))
        now = once(after.select(F.col("to").alias("t"), "room", "cells"))
    if not rounds:
        return first.select("mark", "t")
    ends = begun.select("t", F.col("t").alias("to"))
    for step in rounds:
        ends = ends.join(step, F.col("to") == F.col("at"), "left").select("t", F.coalesce("on", "to").alias("to"))
    return first.select("mark", "t").join(common.written(ends.where("t <> to")), "t", "left").select("mark", F.coalesce("to", "t").alias("t"))


def recurring(df: DataFrame, ident: str = "doc_id", text: str = "text", docs: int = DOCS) -> DataFrame:
    """(doc_id, mark): the lines to drop, by the hash of their masked words."""
    slim = df.select(F.col(ident).alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    lines = common.written(lines_of(slim))
    leaves = common.written(lines.groupBy("leaf").agg(F.sum(F.size("docs")).alias("n")).where(F.col("n") >= docs).select("leaf"))
    reached = common.written(lines.join(leaves.hint("shuffle_hash"), "leaf"))
    # read back, so that a common template can be split in the join
    held = common.written(reached.select("mark", "docs").join(templates(reached, docs), "mark").select("mark", "t", F.explode("docs").alias("doc_id")))
    per = held.select("t", "doc_id").distinct().groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    per = common.written(per.where(F.col("n") >= docs).select("t", "first"))
    out = common.written(held.join(per, "t").where("doc_id <> first").select("doc_id", "mark"))
    for done in (lines, leaves, reached, held, per):
        common.drop_written(done)
    common.release(df.sparkSession)
    return out


def without(texts: pa.Array, marks: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts without their lines that stand in the list of marks of their row (null: none), and how many lines went."""
    dropped = np.zeros(len(texts), np.int64)
    listed = pc.is_valid(marks).to_numpy(zero_copy_only=False)
    hit = np.flatnonzero(listed)
    if not len(hit):
        return texts, dropped
    lines, asked = Lines(texts.take(pa.array(hit))), marks.take(pa.array(hit))
    owner = np.repeat(np.arange(len(hit)), pc.list_value_length(asked).to_numpy(zero_copy_only=False))
    values, code = np.unique(asked.flatten().to_numpy(zero_copy_only=False).view(np.uint64), return_inverse=True)
    pairs = owner * len(values) + code

    def named(keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(values, keys), len(values) - 1)
        return (values[at] == keys) & np.isin(lines.doc * len(values) + at, pairs)

    gone = lines.fit & named(lines.hash) if len(values) else np.zeros(len(lines.doc), bool)
    dropped[hit] = np.bincount(lines.doc, weights=gone, minlength=len(hit))
    left = np.bincount(lines.doc, weights=~gone, minlength=len(hit)).astype(np.int64)
    rest = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(left)]), pa.int32()), lines.raw.filter(pa.array(~gone)))
    return pc.replace_with_mask(texts, pa.array(listed), pc.binary_join(rest, "\n")), dropped


def count_names(df: DataFrame) -> tuple[str, str]:
    """The names of the counts beside the columns of df: n_lines and n_dropped, with underscores before them where df has these."""
    return common.fresh(df, "n_lines"), common.fresh(df, "n_dropped")


def dedup_lines(df: DataFrame, ident: str = "doc_id", text: str = "text", docs: int = DOCS) -> DataFrame:
    """All columns of df, its text without recurring lines, and two counts (``count_names``): its lines, and those dropped."""
    rest, counts = df.columns, count_names(df)
    of, salt, same, held = (common.fresh(df, name) for name in ("of", "salt", "same", "marks"))
    marks = recurring(df, ident, text, docs).groupBy(F.col("doc_id").alias(of)).agg(F.collect_set("mark").alias(held)).withColumn(same, F.lit(0).cast("long"))
    # rows without an id meet nothing, and must not meet in one task either
    mine = df.select(*[F.col(f"`{c}`") for c in rest], F.when(F.col(ident).isNull(), F.xxhash64(text)).otherwise(0).alias(salt))
    both = mine.join(marks.hint("merge"), (F.col(ident) == F.col(of)) & (F.col(salt) == F.col(same)), "left").select(*[F.col(f"`{c}`") for c in rest], held)
    place, fields = rest.index(text), both.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, text):
            given = part.column(place)
            texts = common.filled(given)
            total = pc.if_else(pc.is_null(given), 0, pc.add(pc.count_substring(texts, "\n"), 1)).cast(pa.int64())
            out, dropped = without(texts, common.chunked(part.column(part.num_columns - 1)))
            columns = [part.column(k) for k in range(len(rest))]
            columns[place] = pc.if_else(pc.is_null(given), pa.nulls(len(texts), pa.string()), out)
            yield pa.RecordBatch.from_arrays([*columns, total, pa.array(dropped)], [*rest, *counts])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return both.mapInArrow(run, f"{schema}, {counts[0]} long, {counts[1]} long")
