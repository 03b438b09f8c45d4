"""Retrieval: questions x chunks -> ranked rows (qid, rank, doc_id, start, end, score). All set at a time.

A chunk is named by (doc_id, start, end); chunk_ix is its place in document order and breaks ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spanforge.functions import lexical, splitters, text
from spanforge.session import settled

#: BM25 saturation and length weight; floor of negative weights as a share of the mean; fusion constant; pool sizes.
K1, B, FLOOR, RRF_K, POOL, RERANK_POOL = 1.5, 0.75, 0.25, 60, 50, 30
#: Bytes of query vectors that travel with a function; beyond, queries go in slices.
QUERY_BYTES = 32 << 20
#: Bytes of the matrix of question tokens by questions that travels with a function.
MATRIX_BYTES = 80 << 20
#: Questions of a token beyond which it is a column of the product that scores chunks.
MANY = 16
#: Bytes of query vectors that the driver holds at once.
HELD_BYTES = 256 << 20


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    """One row for each span."""
    return chunks.dropDuplicates(["doc_id", "start", "end"])


def distinct_written(chunks: DataFrame) -> DataFrame:
    """The same of a written table: only its keys are exchanged, and texts where some span does come twice."""
    key = ["doc_id", "start", "end"]
    once = chunks.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    return chunks if once else distinct_chunks(chunks)


def indexed_text(chunks: DataFrame) -> Column:
    return text.with_context(F.col("chunk_text"), F.col("context_prefix")) if "context_prefix" in chunks.columns else F.col("chunk_text")


def tokened(chunks: DataFrame) -> DataFrame:
    """(doc_id, start, end, toks); a column of that name, kept with the chunks, is taken as it is."""
    if "toks" in chunks.columns:
        return chunks.select("doc_id", "start", "end", "toks")
    return chunks.select("doc_id", "start", "end", text.lexical_tokens(indexed_text(chunks)).alias("toks"))


def postings(chunks: DataFrame) -> DataFrame:
    """(doc_id, start, end, dl, tok, tf). Chunks dealt by doc_id stay where they are."""
    toks = tokened(chunks).select("doc_id", "start", "end", F.size("toks").cast("long").alias("dl"), F.explode("toks").alias("tok"))
    return toks.groupBy("doc_id", "start", "end", "dl", "tok").agg(F.count(F.lit(1)).alias("tf"))


#: Distinct tokens that a task holds before it hands on their counts.
HELD_TOKENS = 1 << 19


def slim(chunks: DataFrame) -> DataFrame:
    """(doc_id, start, end, body): what is indexed, or the list of its tokens where ``toks`` is kept with the chunks."""
    body = F.col("toks") if "toks" in chunks.columns else indexed_text(chunks)
    return chunks.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), body.alias("body"))


def token_counts(chunks: DataFrame) -> DataFrame:
    """(tok, df, n_toks): in how many chunks each token stands; the row without a token counts chunks and all their tokens.

    One map over the chunks: no token of a chunk becomes a row, a task hands on its distinct tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, rows = ["tok", "df", "n_toks"], [], 0
        n = toks = 0

        def merged() -> pa.Table:
            got = pa.concat_tables(held).group_by("tok").aggregate([("df", "sum")])
            return pa.table({"tok": got.column("tok"), "df": got.column("df_sum")})

        def told(table: pa.Table) -> Iterator[pa.RecordBatch]:
            for part in table.to_batches(1 << 16):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.nulls(part.num_rows, pa.int64())], names)

        for _, found in lexical.parts(batches, "body", 8192):
            n, toks = n + len(found.dl), toks + int(found.dl.sum())
            own, df = found.counted()
            held.append(pa.table({"tok": own, "df": pa.array(df)}))
            rows += len(own)
            if rows > 2 * HELD_TOKENS:
                held = [merged()]
                rows = held[0].num_rows
                if rows > HELD_TOKENS:
                    yield from told(held[0])
                    held, rows = [], 0
        if held:
            yield from told(merged())
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([n], pa.int64()), pa.array([toks], pa.int64())], names)

    found = slim(chunks).select("body").mapInArrow(run, "tok string, df long, n_toks long")
    return found.groupBy("tok").agg(F.sum("df").alias("df"), F.sum("n_toks").alias("n_toks"))


def _size(counts: DataFrame) -> DataFrame:
    return counts.where("tok IS NULL AND df > 0").select(F.col("df").alias("n"), (F.col("n_toks") / F.col("df")).alias("avgdl"))


def corpus_size(chunks: DataFrame) -> DataFrame:
    """One row: n chunks and their mean length in tokens."""
    return _size(token_counts(chunks)).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.max("avgdl").alias("avgdl"))


def weights(chunks: DataFrame) -> DataFrame:
    """(tok, df, idf, n, avgdl): negative weights become FLOOR of the mean weight over the vocabulary. The counts are written, so
    that the chunks are read once, whoever asks for weights."""
    counts = settled(token_counts(chunks))
    raw = counts.where("tok IS NOT NULL").select("tok", "df").crossJoin(F.broadcast(_size(counts)))  # one row
    raw = raw.withColumn("raw", F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("tok", "df", F.when(F.col("raw") < 0, FLOOR * F.col("mean")).otherwise(F.col("raw")).alias("idf"), "n", "avgdl")


def question_tokens(questions: DataFrame) -> DataFrame:
    """(qid, tok, qtf) of questions (qid, question)."""
    return questions.select("qid", F.explode(text.lexical_tokens(F.col("question"))).alias("tok")).groupBy("qid", "tok").agg(F.count(F.lit(1)).alias("qtf"))


def top(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k of each question; Spark cuts each task's rows to k before the exchange."""
    w = Window.partitionBy("qid").orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def bm25(chunks: DataFrame, questions: DataFrame, k: int = 10, zero_fill: bool = True, k1: float = K1, b: float = B, idf: DataFrame | None = None) -> DataFrame:
    """Okapi ranking by score, then document order. ``zero_fill`` also ranks chunks without a common token, with score 0.

    Questions travel to the chunks as matrices of their weights by token, of ``MATRIX_BYTES`` at most: a batch of chunks becomes a
    matrix over the tokens that it shares with them, and one product scores all pairs. A task holds k rows a question, and what
    does not reach the last of these is left out at once, so that k rows a question leave a task. Pairs never become rows. Many
    questions are many matrices; postings.search has a written index for these.
    """
    idf = weights(chunks) if idf is None else idf
    wanted = question_tokens(questions).join(idf, "tok")
    # one row a question and known token, read by several jobs
    wanted = settled(wanted.select("qid", "tok", "qtf", "idf", *(["avgdl"] if "avgdl" in idf.columns else [])))
    ids = questions.select("qid").distinct()
    kind = questions.schema["qid"].dataType.simpleString()
    key = ["doc_id", "start", "end"]
    parts = max(1, -(-8 * wanted.select("tok").distinct().count() * ids.count() // MATRIX_BYTES))
    known = wanted.select("avgdl").first() if "avgdl" in idf.columns else corpus_size(chunks).first()
    avgdl = known["avgdl"] or 1.0 if known else 1.0  # without a known token no length counts
    qid_type = to_arrow_type(questions.schema["qid"].dataType)
    schema = f"qid {kind}, doc_id {chunks.schema['doc_id'].dataType.simpleString()}, start long, end long, score double"
    scored = chunks.limit(0).select(F.lit(None).cast(kind).alias("qid"), *key, F.lit(0.0).alias("score"))
    for part in range(parts):
        own = F.pmod(F.xxhash64("qid"), F.lit(parts)) == part
        qids = [r.qid for r in ids.where(own).orderBy("qid").collect()]
        if qids:
            found = slim(chunks).mapInArrow(_scorer(qids, wanted.where(own).collect(), qid_type, avgdl, k, zero_fill, k1, b), schema)
            scored = found if parts == 1 else scored.unionByName(found)
    # adding 0 turns a negative zero into zero
    scored = scored.withColumn("score", F.round("score", 9) + F.lit(0.0))
    return top(scored, k, F.col("score").desc(), F.col("doc_id"), F.col("start"), F.col("end")).select("qid", "rank", *key, "score")


def firsts(q: np.ndarray, order: list[np.ndarray], k: int) -> np.ndarray:
    """Positions of the first k of each q in the order of these columns, the most important last, as in lexsort."""
    at = np.lexsort((*order, q))
    new = np.concatenate([[True], q[at][1:] != q[at][:-1]]) if len(at) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    return at[np.arange(len(at)) - begin[np.cumsum(new) - 1] < k] if len(at) else at


def _scorer(qids: list, rows: list, qid_type: pa.DataType, avgdl: float, k: int, zero_fill: bool, k1: float, b: float):
    """The map from chunks (doc_id, start, end, body) to the k best of each task for each of these questions."""
    vocabulary, key = sorted({r.tok for r in rows}), ["doc_id", "start", "end"]
    place, number = {t: j for j, t in enumerate(vocabulary)}, {q: i for i, q in enumerate(qids)}
    hashed = lexical.hash_of(vocabulary)
    order = np.argsort(hashed)
    matrix = np.zeros((len(vocabulary), len(qids)))
    for r in rows:
        matrix[place[r.tok], number[r.qid]] = r.qtf * r.idf
    matrix, hashed = matrix[order], hashed[order]
    # tokens of many questions are multiplied, the others' few questions are added one by one
    asks = matrix != 0
    n_asked = asks.sum(1)
    many = n_asked > MANY
    column, dense, dense_asks = np.cumsum(many) - 1, matrix[many], asks[many].astype(np.float64)
    few_q, few_w = np.nonzero(asks)[1], matrix[asks]
    first = np.cumsum(n_asked) - n_asked

    def scored(found: lexical.Tokens, n: int) -> tuple[np.ndarray, np.ndarray | None]:
        """Of each chunk and question the score and, where that is asked for, whether they share a token."""
        at = np.searchsorted(hashed, found.h)
        hit = at < len(hashed)
        hit[hit] = hashed[at[hit]] == found.h[hit]
        pair, tf = np.unique(found.row[hit] * max(1, len(hashed)) + at[hit], return_counts=True)
        row, tok = np.divmod(pair, max(1, len(hashed)))
        part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * found.dl.astype(np.float64) / avgdl)[row])
        is_many = many[tok]
        parts = np.zeros((n, len(dense)))
        parts[row[is_many], column[tok[is_many]]] = part[is_many]
        row, tok, part = row[~is_many], tok[~is_many], part[~is_many]
        times = n_asked[tok]
        place = np.repeat(first[tok] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        cell = np.repeat(row, times) * len(qids) + few_q[place]
        scores = parts @ dense + np.bincount(cell, np.repeat(part, times) * few_w[place], n * len(qids)).reshape(n, -1)
        if zero_fill:
            return scores, None
        shared = (parts > 0).astype(np.float64) @ dense_asks > 0
        shared.reshape(-1)[cell] = True
        return scores, shared

    def cut(held: pa.Table) -> pa.Table:
        held = held.take(pc.sort_indices(held, [("q", "ascending"), ("score", "descending"), *((c, "ascending") for c in key)]))
        q = held.column("q").to_numpy()
        return held.take(pa.array(firsts(q, [np.arange(len(q))], k)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pending, rows = None, [], 0
        bar = np.full(len(qids), -np.inf)
        for batch, found in lexical.parts(batches, "body"):
            n = batch.num_rows
            scores, shared = scored(found, n)
            scores = np.round(scores, 9).T + 0.0
            keep = scores >= bar[:, None]
            if shared is not None:
                keep &= shared.T
            q, c = np.nonzero(keep)
            if not len(q):
                continue
            score = scores[q, c]
            if len(q) > 2 * k * len(qids):  # ties go by the chunk's place
                rank = np.empty(n, np.int64)
                rank[pc.sort_indices(batch.select(key), [(x, "ascending") for x in key]).to_numpy()] = np.arange(n)
                best = firsts(q, [rank[c], -score], k)
                q, c, score = q[best], c[best], score[best]
            pending.append(pa.table({"q": pa.array(q), **{x: batch.column(x).take(pa.array(c)) for x in key}, "score": pa.array(score)}))
            rows += len(q)
            if rows > k * len(qids):
                held, pending, rows = cut(pa.concat_tables([*([held] if held else []), *pending])), [], 0
                full, last = np.bincount(held.column("q").to_numpy(), minlength=len(qids)), held.column("score").to_numpy()
                ends = np.cumsum(full) - 1
                bar = np.where(full == k, last[np.maximum(ends, 0)], -np.inf)
        if held or pending:
            held = cut(pa.concat_tables([*([held] if held else []), *pending]))
            names = pa.array(qids, qid_type).take(held.column("q").combine_chunks())
            yield pa.RecordBatch.from_arrays([names, *(held.column(x).combine_chunks() for x in (*key, "score"))], ["qid", *key, "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, ident: list[str] | None = None, exclude_self: bool = False, embed=None) -> DataFrame:
    """Exact cosine top-k of unit vectors: (qid, rank, *ident, score).

    ``queries`` has (qid, vector), a stated set; every partition of ``vectors`` (ident, vector) is multiplied with it in numpy
    and keeps k rows a query, so only k rows a query and batch leave a task. Queries travel in slices of ``QUERY_BYTES``; the
    driver reads them in parts, dealt by a hash of their ids, of ``HELD_BYTES`` about. With ``embed``, a function from a list of
    texts to vectors, the column ``vector`` of ``vectors`` holds texts, whose vectors never leave the task.
    """
    ident = ident or ["vec_id"]
    asked = queries.select("qid", F.col("vector").cast("array<double>").alias("vector"))
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dims")).first()
    if not size["n"]:
        return vectors.limit(0).select(F.lit(None).cast(queries.schema["qid"].dataType).alias("qid"), F.lit(0).cast("long").alias("rank"), *ident, F.lit(0.0).alias("score"))
    step = max(1, QUERY_BYTES // (8 * max(1, size["dims"])))
    parts = -(-8 * size["n"] * max(1, size["dims"]) // HELD_BYTES)
    kind, qid_type = queries.schema["qid"].dataType.simpleString(), to_arrow_type(queries.schema["qid"].dataType)
    schema = ", ".join([f"qid {kind}", *(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in ident), "score double"])
    slim = vectors.select(*ident, F.col("vector") if embed else F.col("vector").cast("array<double>").alias("vector"))

    def against(ids: list, matrix: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if embed:
                    found = np.asarray(embed(pc.fill_null(batch.column("vector"), "").to_pylist()), np.float64)
                else:
                    found = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                scores = matrix @ found.T
                keep = min(k + exclude_self, batch.num_rows)
                best = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
                # all that tie with the last one stay, so that the final order decides
                floor = np.take_along_axis(scores, best, 1).min(1, keepdims=True)
                q, c = np.nonzero(scores >= floor - 1e-9)
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q], qid_type), *(batch.column(n).take(pa.array(c)) for n in ident), pa.array(scores[q, c])], ["qid", *ident, "score"])

        return slim.mapInArrow(run, schema)

    out = None
    for part in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == part).collect()
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            found = against([r.qid for r in some], np.array([r.vector for r in some], np.float64))
            out = found if out is None else out.unionByName(found)
    scored = out.withColumn("score", F.round("score", 9))
    if exclude_self:
        scored = scored.where(F.col("qid") != F.col(ident[0]))
    return top(scored, k, F.col("score").desc(), *[F.col(c) for c in ident]).select("qid", "rank", *ident, "score")


def dense(chunks: DataFrame, questions: DataFrame, k: int = 10) -> DataFrame:
    """Nearest chunks by the hashed bag of what is indexed; put a model's vector column in its place where there is one."""
    vectors = chunks.select("doc_id", "start", "end", indexed_text(chunks).alias("vector"))
    asked = questions.select("qid", text.hashed_bag(F.col("question")).alias("vector"))
    return nearest(vectors, asked, k, ["doc_id", "start", "end"], embed=splitters.bag_vectors)


def fuse(dense_ranked: DataFrame, lexical_ranked: DataFrame, k: int = 10, constant: int = RRF_K) -> DataFrame:
    """Reciprocal ranks summed over both pools; ties go to dense order, then to lexical order."""
    both = dense_ranked.select("qid", "doc_id", "start", "end", F.col("rank").alias("d"), F.lit(None).cast("long").alias("l"))
    both = both.unionByName(lexical_ranked.select("qid", "doc_id", "start", "end", F.lit(None).cast("long").alias("d"), F.col("rank").alias("l")))
    scored = both.groupBy("qid", "doc_id", "start", "end").agg(F.min("d").alias("d"), F.min("l").alias("l"))
    share = lambda c: F.coalesce(1.0 / (constant + F.col(c)), F.lit(0.0))
    scored = scored.withColumn("score", F.round(share("d") + share("l"), 9))
    return top(scored, k, F.col("score").desc(), F.col("d").asc_nulls_last(), F.col("l").asc_nulls_last()).select("qid", "rank", "doc_id", "start", "end", "score")


def hybrid(chunks: DataFrame, questions: DataFrame, k: int = 10, pool: int = POOL, idf: DataFrame | None = None) -> DataFrame:
    return fuse(dense(chunks, questions, pool), bm25(chunks, questions, pool, idf=idf), k)


def rerank(ranked: DataFrame, chunks: DataFrame, questions: DataFrame, k: int = 10, pool: int = RERANK_POOL, scorer=None) -> DataFrame:
    """Scores the first ``pool`` candidates jointly with the question, then ranks by that; ties keep the first order.

    ``scorer(question, text)`` is a column; the default, a stand-in for a cross-encoder, is the share of the question's
    distinct tokens that the text holds.
    """
    scorer = scorer or shared_tokens
    pooled = ranked.where(F.col("rank") <= pool).select("qid", F.col("rank").alias("base_rank"), "doc_id", "start", "end")
    body = chunks.select("doc_id", "start", "end", indexed_text(chunks).alias("body"))
    scored = pooled.join(body, ["doc_id", "start", "end"]).join(questions.select("qid", "question"), "qid")
    scored = scored.withColumn("score", F.round(scorer(F.col("question"), F.col("body")), 9))
    return top(scored, k, F.col("score").desc(), F.col("base_rank")).select("qid", "rank", "doc_id", "start", "end", "score")


def shared_tokens(question: Column, body: Column) -> Column:
    asked = F.array_distinct(text.lexical_tokens(question))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(asked, text.lexical_tokens(body))).cast("double"), F.nullif(F.size(asked), F.lit(0))), F.lit(0.0))


def retrieve(name: str, chunks: DataFrame, questions: DataFrame, k: int = 10, reranked: bool = False, idf: DataFrame | None = None) -> DataFrame:
    """A retriever by name, with or without the second stage; ``idf`` are token weights of these chunks, if at hand."""
    retrievers = {"bm25": lambda n: bm25(chunks, questions, n, idf=idf), "dense": lambda n: dense(chunks, questions, n), "hybrid": lambda n: hybrid(chunks, questions, n, idf=idf)}
    if name not in retrievers:
        raise ValueError(f"unknown retriever {name!r}")
    return rerank(retrievers[name](RERANK_POOL), chunks, questions, k) if reranked else retrievers[name](k)
