"""Finding many verbatim texts in many documents: rolling fingerprints of short byte windows, rarest window first.

A few windows of each quote are fingerprinted. One map over the documents writes which of them stand in which, the rarest becomes
the quote's anchor, an equi-join of ids on the anchors' fingerprints names quotes and documents, and only those pairs are searched.
The map carries a Bloom filter of bounded size in place of the quotes, so quotes of any number and
length take the same plan: there is no join without keys, and nothing that grows with quotes or documents reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.functions.lexical import powers
from spanforge.session import settled

#: Bytes of a window: a quote takes the largest that it can hold. Windows of a quote that are weighed against each other.
WIDTHS = (24, 12, 6, 3, 1)
CANDIDATES = 4
#: Bits a window has in the filter, bits of the filter at least and at most, bits that are looked at.
BITS_EACH, LEAST_BITS, MOST_BITS, LOOKS = 64, 1 << 16, 1 << 30, 3
#: Bytes that are fingerprinted at once.
STRIDE = 1 << 20
#: Stands between documents; no UTF-8 text holds it.
_GAP = b"\xff"
_P = 0x9E3779B97F4A7C15
_BACK = pow(_P, -1, 1 << 64)


def fingerprints(raw: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit fingerprint of the ``width`` bytes from each position on: differences of one polynomial's prefix sums."""
    n = len(raw) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(_P, len(raw)), out=sums[1:])
    h = (sums[width:] - sums[:n]) * powers(_BACK, n)
    h = (h ^ (h >> np.uint64(29)) ^ np.uint64(width)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _places(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The bits of a fingerprint: ``LOOKS`` of them, from different parts of it."""
    for k in range(LOOKS):
        yield ((h >> np.uint64(11 * k)) * np.uint64(2 * k + 1)) & np.uint64(bits - 1)


def windows(quotes: DataFrame, ident: str = "item_id", quote: str = "quote") -> DataFrame:
    """(ident, fp, width): up to ``CANDIDATES`` windows of each quote that is not empty, evenly spread over it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, fps, widths = [], [], []
            for k, text in enumerate(batch.column("q").to_pylist()):
                raw = np.frombuffer(text.encode(), np.uint8)
                width = next((w for w in WIDTHS if w <= len(raw)), 0)
                if width:
                    starts = np.unique(np.linspace(0, len(raw) - width, CANDIDATES).astype(int))
                    for at in starts:
                        rows.append(k)
                        fps.append(int(fingerprints(raw[at : at + width], width)[0].view(np.int64)))
                        widths.append(width)
            yield pa.RecordBatch.from_arrays([batch.column("i").take(pa.array(rows, pa.int64())), pa.array(fps, pa.int64()), pa.array(widths, pa.int32())], [ident, "fp", "width"])

    kind = quotes.schema[ident].dataType.simpleString()
    slim = quotes.select(F.col(ident).alias("i"), F.col(quote).cast("string").alias("q")).where("q IS NOT NULL")
    return slim.mapInArrow(run, f"{ident} {kind}, fp long, width int").distinct()


class Filter:
    """A Bloom filter over fingerprints, and the widths that are worth looking at."""

    def __init__(self, marks: np.ndarray, widths: list[int]):
        self.marks, self.widths = marks, widths
        # a small filter is looked at first as one byte a bit
        self.flags = np.unpackbits(marks.astype("<u4").view(np.uint8), bitorder="little").astype(bool) if len(marks) <= 1 << 19 else None

    @classmethod
    def of(cls, found: DataFrame) -> Filter:
        """From rows (fp, width). Words of bits are joined by Spark; what is collected is the filter, whose size is bounded."""
        head = found.agg(F.count(F.lit(1)).alias("n"), F.collect_set("width").alias("widths")).first()
        n = head.n
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << (n * BITS_EACH).bit_length()))
        fp = F.col("fp")
        spots = F.array(*(F.call_function("shiftrightunsigned", fp, F.lit(11 * k)).bitwiseAND(F.lit((1 << 63) - 1)) for k in range(LOOKS)))
        # low bits of a product are those of the product of low bits, so no product overflows
        spot = F.explode(F.array(*(((spots[k].bitwiseAND(F.lit(bits - 1))) * (2 * k + 1)).bitwiseAND(F.lit(bits - 1)) for k in range(LOOKS))))
        words = found.select(spot.alias("spot")).groupBy(F.shiftright("spot", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 31 as int))")).alias("mask"))
        marks = np.zeros(bits // 32, np.uint32)
        for row in words.toLocalIterator():
            marks[row.word] = row.mask
        return cls(marks, sorted(head.widths))

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        """Positions of fingerprints that pass."""
        bits = 32 * len(self.marks)
        at = np.arange(len(h)) if self.flags is None else np.flatnonzero(self.flags[h & np.uint64(bits - 1)])
        for spots in _places(h, bits):
            spots = spots[at]
            at = at[(self.marks[spots >> np.uint64(5)] >> (spots & np.uint64(31)).astype(np.uint32)) & np.uint32(1) != 0]
        return at


def hits(texts: pa.Array, keep: Filter) -> tuple[np.ndarray, np.ndarray]:
    """(row, fingerprint) of windows of the texts that pass the filter, each once a row."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(_GAP.join(x or b"" for x in texts.cast(pa.binary()).to_pylist()), np.uint8)
    starts = np.concatenate([[0], np.cumsum(size + 1)[:-1]]) if len(size) else np.zeros(0, np.int64)
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for width in keep.widths:
        for at in range(0, max(1, len(raw)), STRIDE):
            h = fingerprints(raw[at : at + STRIDE + width - 1], width)
            passed = keep.may_hold(h)
            rows.append(np.searchsorted(starts, passed + at, "right") - 1)
            found.append(h[passed])
    both = np.unique(np.stack([np.concatenate(rows).astype(np.uint64), np.concatenate(found)]), axis=1)
    return both[0].astype(np.int64), both[1].view(np.int64)


def found_windows(docs: DataFrame, keep: Filter, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, fp): the fingerprints that pass, each once a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, fps = hits(batch.column("t"), keep)
            yield pa.RecordBatch.from_arrays([batch.column("d").take(pa.array(rows)), pa.array(fps, pa.int64())], [doc, "fp"])

    slim = docs.select(F.col(doc).alias("d"), F.col(text).cast("string").alias("t")).where("t IS NOT NULL")
    return slim.mapInArrow(run, f"`{doc}` {slim.schema['d'].dataType.simpleString()}, fp long")


def document_counts(docs: DataFrame, keep: Filter, text: str = "text") -> DataFrame:
    """(fp, n): in how many documents each fingerprint that passes stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, n = np.unique(hits(batch.column("t"), keep)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(n.astype(np.int64))], ["fp", "n"])

    return docs.select(F.col(text).alias("t")).mapInArrow(run, "fp long, n long").groupBy("fp").agg(F.sum("n").alias("n"))


def rarest(own: DataFrame, counts: DataFrame, ident: str = "item_id") -> DataFrame:
    """(ident, fp, width): of each quote the window in the fewest documents; a quote whose windows do not all stand somewhere
    stands nowhere and has none. ``own`` are the quotes' windows, ``counts`` has (fp, n)."""
    counted = own.join(counts, "fp", "left")
    per = counted.groupBy(ident).agg(F.min_by(F.struct("fp", "width"), F.struct("n", "fp")).alias("a"), F.bool_and(F.col("n").isNotNull()).alias("all"))
    return per.where("all").select(ident, "a.fp", "a.width")


def anchors(quotes: DataFrame, docs: DataFrame, ident: str = "item_id", quote: str = "quote", text: str = "text") -> DataFrame:
    """The rarest windows of quotes in documents."""
    own = windows(quotes, ident, quote)
    return rarest(own, document_counts(docs, Filter.of(own.select("fp", "width")), text), ident)


def holding(quotes: DataFrame, docs: DataFrame, ident: str = "item_id", quote: str = "quote", doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, doc, quote, text) of pairs in which the document holds the quote, character by character.

    What meets by fingerprint are ids, so a window that stands in many documents is no heap of texts in one task; texts then go by
    their own ids.
    """
    own = settled(windows(quotes, ident, quote))
    found = settled(found_windows(docs, Filter.of(own), doc, text))
    chosen = settled(rarest(own, found.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), ident))  # one row a quote
    pairs = found.join(chosen.select(ident, "fp"), "fp").select(ident, F.col(doc).alias("_d")).distinct()
    pairs = settled(pairs.join(quotes.select(ident, quote), ident))
    return docs.join(pairs, F.col(doc).eqNullSafe(F.col("_d"))).where(F.contains(F.col(text).cast("string"), quote)).select(ident, F.col(doc).alias(doc), quote, F.col(text).cast("string").alias(text))
