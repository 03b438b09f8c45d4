"""Chunkers: documents (doc_id, text) -> chunks (doc_id, start, end, chunk_text, ...), offsets in code points."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import splitters, text


def fixed_chunks(docs: DataFrame, size: int = 800, overlap: int = 100) -> DataFrame:
    """Windows every ``size - overlap`` characters; the first that reaches the end is the last. Blank ones are dropped."""
    if overlap >= size or overlap < 0:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap

    def cut(body: str) -> list[tuple[int, int]]:
        n = len(body)
        # the last start is the first at which the window reaches the end
        spans = ((at, min(at + size, n)) for at in range(0, max(0, -(-(n - size) // step)) * step + 1, step))
        return [(a, b) for a, b in spans if splitters.has_content(body[a:b])]

    # a map, as an expression would copy the whole text for each window and walk it up to the window's start
    return _mapped(docs, cut, [])


def _mapped(docs: DataFrame, fn: Callable, extra: list[tuple[str, str, pa.DataType]], cut: bool = True, many: bool = False) -> DataFrame:
    """Runs a splitter over every text in Arrow batches; fn gives (start, end, *extra), of a list of texts if it takes ``many``.
    Without ``cut`` the texts are null."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", "start long", "end long", "chunk_text string", *(f"{name} {sql}" for name, sql, _ in extra)])
    slim = docs.select("doc_id", "text").where(F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # bounds what one output batch holds
                part = batch.slice(at, 256)
                rows, which = [], []
                bodies = part.column("text").to_pylist()
                for k, (body, spans) in enumerate(zip(bodies, fn(bodies) if many else map(fn, bodies), strict=True)):
                    for a, b, *more in spans:
                        rows.append((a, b, body[a:b] if cut else None, *more))
                        which.append(k)
                types = [pa.int64(), pa.int64(), pa.string(), *(t for _, _, t in extra)]
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(which, pa.int64())), *columns], ["doc_id", "start", "end", "chunk_text", *(n for n, _, _ in extra)])

    return slim.mapInArrow(run, schema)


def recursive_chunks(docs: DataFrame, size: int = 800, overlap: int = 100) -> DataFrame:
    return _mapped(docs, lambda body: splitters.recursive_spans(body, size, overlap), [])


def heading_chunks(docs: DataFrame, max_size: int = 1200, min_size: int = 200, overlap: int = 100) -> DataFrame:
    """With the heading path as ``context_prefix`` and whether the section was split."""
    extra = [("context_prefix", "string", pa.string()), ("sub_split", "boolean", pa.bool_())]
    return _mapped(docs, lambda body: splitters.heading_spans(body, max_size, min_size, overlap), extra)


def semantic_chunks(docs: DataFrame, percentile: float = 90.0, max_size: int = 1200, min_size: int = 200, buffer: int = 0, vectors: Callable = splitters.bag_vectors) -> DataFrame:
    """``vectors`` embeds a list of sentences; the default is the hashed bag."""
    return _mapped(docs, lambda bodies: splitters.semantic_many(bodies, vectors, percentile, max_size, min_size, buffer), [("n_sentences", "long", pa.int64())], many=True)


def recovered_offsets(pieces: DataFrame, docs: DataFrame, reorder: bool = False) -> DataFrame:
    """(doc_id, ix, start, end) of verbatim pieces (doc_id, ix, piece), in the order of ix: of each its first place that does not
    begin before the piece ahead of it. Empty and null pieces have none; a piece that does not occur, and a document that is
    missing, fail with a message that names the document.

    A document's pieces go with its text, as a splitter would have made them; they are no more than the text holds, and documents
    are dealt over tasks.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    per = pieces.where("piece <> ''").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ix", "piece"))).alias("pieces"))
    both = per.join(docs.select("doc_id", "text"), "doc_id", "left").select("doc_id", "text", F.col("pieces.ix").alias("ix"), F.col("pieces.piece").alias("piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ident, body, ix, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "ix", "piece")), strict=True):
                try:
                    if body is None:
                        raise splitters.OffsetError("no such document")
                    spans = splitters.recover_offsets(body, found, reorder)
                except splitters.OffsetError as error:
                    raise splitters.OffsetError(f"document {ident}: {error}") from None
                yield pa.RecordBatch.from_arrays([pa.array([ident] * len(ix), batch.schema.field("doc_id").type), pa.array(ix, pa.int64()), *(pa.array([s[k] for s in spans], pa.int64()) for k in (0, 1))], ["doc_id", "ix", "start", "end"])

    return both.mapInArrow(run, f"doc_id {kind}, ix long, start long, end long")


def chapter_texts(docs: DataFrame, start: str, end: str, chapter: str, min_chars: int = 2000, max_chars: int = 8000, keep: int | None = None) -> DataFrame:
    """(doc_id, part, text) of raw books; ``keep`` is the number of parts kept of each book."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ident, body in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                parts = splitters.chapters(body or "", start, end, chapter, min_chars, max_chars)[:keep]
                yield pa.RecordBatch.from_arrays([pa.array([ident] * len(parts), batch.schema.field("doc_id").type), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.string())], ["doc_id", "part", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, part long, text string")


def build_chunks(docs: DataFrame, chunker: str, **params) -> DataFrame:
    """Chunks by a chunker's name."""
    try:
        return CHUNKERS[chunker](docs, **params)
    except KeyError:
        raise ValueError(f"unknown chunker {chunker!r}") from None


CHUNKERS: dict[str, Callable[..., DataFrame]] = {"fixed": fixed_chunks, "recursive": recursive_chunks, "heading": heading_chunks, "semantic": semantic_chunks}


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_ix, start, end); one map without an exchange, linear in a document's sentences."""
    numbered = _mapped(docs, lambda body: [(a, b, k) for k, (a, b) in enumerate(splitters.sentence_spans(body))], [("sentence_ix", "long", pa.int64())], cut=False)
    return numbered.select("doc_id", "sentence_ix", "start", "end")


def buffered_windows(docs: DataFrame, spans: DataFrame, buffer: int) -> DataFrame:
    """(doc_id, sentence_ix, window_text): each sentence with ``buffer`` neighbours on either side."""
    w = Window.partitionBy("doc_id").orderBy("sentence_ix").rowsBetween(-buffer, buffer)
    wide = spans.select("doc_id", "sentence_ix", F.min("start").over(w).alias("a"), F.max("end").over(w).alias("b"))
    return wide.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "sentence_ix", F.expr("substring(text, cast(a as int) + 1, cast(b - a as int))").alias("window_text"))


#: Fixed value: what ends a line, as a Java regular expression.
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"


def heading_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, start, level, title, path) of headings outside fences, in SQL: fence parity and titles by running windows."""
    breaks = F.regexp_extract_all("text", F.lit(f"({LINE_BREAK})"), F.lit(1))
    lines = docs.select("doc_id", breaks.alias("breaks"), F.posexplode(F.split("text", LINE_BREAK, -1)).alias("line_ix", "line"))
    w = Window.partitionBy("doc_id").orderBy("line_ix")
    size = F.length("line") + F.coalesce(F.length(F.get("breaks", F.col("line_ix"))), F.lit(0))
    lines = lines.withColumn("start", F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    lines = lines.withColumn("is_fence", F.col("line").rlike(r"^[ \t]*(```|~~~)")).withColumn("parity", F.sum(F.col("is_fence").cast("int")).over(w) % 2)
    found = lines.where(~F.col("is_fence") & (F.col("parity") == 0) & F.col("line").rlike(r"^#{1,6}[ \t]+[^ \t]"))
    found = found.select("doc_id", "start", F.length(F.regexp_extract("line", "^(#+)", 1)).cast("long").alias("level"), text.strip(F.regexp_extract("line", r"^#{1,6}[ \t]+(.+?)[ \t]*$", 1)).alias("title"))
    # the title at level L is shown while no heading at or above L came since
    at = Window.partitionBy("doc_id").orderBy("start")
    parts = []
    for level in range(1, 7):
        here = F.last(F.when(F.col("level") <= level, F.struct("level", "title")), ignorenulls=True).over(at)
        parts.append(F.when((here["level"] == level) & (level <= F.col("level")), here["title"]))
    return found.select("doc_id", "start", "level", "title", F.concat_ws(" > ", *parts).alias("path"))


def invariant_violations(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks whose text is not the document's slice, whose span is invalid, or whose document is missing."""
    joined = chunks.join(docs.select("doc_id", "text"), "doc_id", "left")
    slice_ = F.expr("substring(text, cast(start as int) + 1, cast(`end` - start as int))")
    bad = F.col("text").isNull() | (F.col("start") < 0) | (F.col("end") < F.col("start")) | ~slice_.eqNullSafe(F.col("chunk_text"))
    return joined.where(bad).select(*chunks.columns)


def coverage(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, coverage): share of each document's characters under at least one chunk; 1 for an empty document."""
    w = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max("end").over(w), F.lit(0))
    new = chunks.select("doc_id", F.greatest(F.lit(0), F.col("end") - F.greatest("start", seen)).alias("new")).groupBy("doc_id").agg(F.sum("new").alias("covered"))
    out = docs.select("doc_id", F.length("text").alias("n")).join(new, "doc_id", "left")
    return out.select("doc_id", F.when(F.col("n") == 0, F.lit(1.0)).otherwise(F.coalesce("covered", F.lit(0)) / F.col("n")).alias("coverage"))


def chunk_stats(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: chunks, mean length, lengths at a tenth and nine tenths of the order, mean coverage."""
    lengths = chunks.select((F.col("end") - F.col("start")).alias("len")).groupBy("len").agg(F.count(F.lit(1)).alias("c"))
    # lengths are few; their running counts place the picks without sorting the chunks
    w = Window.orderBy("len")
    ranked = lengths.select("len", "c", F.sum("c").over(w).alias("upto"), F.sum("c").over(Window.partitionBy()).alias("n"))
    pick = lambda share: F.min(F.when(F.col("upto") > F.floor(F.col("n") * share / 10), F.col("len")))
    stats = ranked.agg(F.max("n").alias("n_chunks"), F.round(F.sum(F.col("len") * F.col("c")) / F.max("n"), 6).alias("mean_len"), pick(1).alias("p10"), pick(9).alias("p90"))
    return stats.crossJoin(coverage(docs, chunks).agg(F.round(F.avg("coverage"), 6).alias("mean_coverage")))
