"""A written lexical index: blocks of postings with their largest weight, and top-k search that skips blocks.

Chunks get places as the scan gives them and fall into ranges of ``RANGE`` places, each of one batch: no text is exchanged. A block
holds the postings of one token in one range as packed arrays, and the largest part of a score that any of them can give; a row
without a token holds the range's chunks. A search first adds up those parts by question and range, which reads no postings, and
scores the few ranges with the highest bounds; the k-th best score so far is what a range's bound has to reach to be read at all.
A range is scored as one matrix over its chunks and hands on k rows a question: no pair of a posting and a question becomes a row.
Results are those of scoring everything.

A block is at most ``RANGE`` postings, so a common token is many keys. Blocks lie in buckets by token, and only the buckets and row
groups of asked tokens are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import lexical, text
from spanforge.operators import retrieval
from spanforge.operators.order import with_positions
from spanforge.session import settled

#: Chunks of a range; folders of the index by token; ranges of each question that are scored before any is skipped.
RANGE, BUCKETS, FIRST = 4096, 32, 2
#: Scores are compared after rounding to nine digits, bounds with this much to spare.
SPARE = 1e-6


#: Questions and tokens that are multiplied with the chunks of a range at once.
ASKED, TOKENS = 512, 1024
#: Bits of a place below the number of the task that gave it out.
_BITS = 33

BLOCKS = "tok string, range long, n int, most double, at array<int>, tf array<int>, dl array<int>"


@dataclass(frozen=True)
class Index:
    """What ``write`` left in a folder."""

    spark: SparkSession
    root: str
    k1: float
    b: float
    kind: str

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    @property
    def _rows(self) -> DataFrame:
        # an empty index has no file of blocks to tell its schema
        return self.spark.read.schema(f"{BLOCKS}, {_keys(self.kind)}, bucket int").parquet(f"{self.root}/blocks")

    @property
    def held(self) -> DataFrame:
        """(range, dl, doc_id, start, end): the chunks of each range as arrays."""
        return self._rows.where(F.col("bucket") == BUCKETS).select("range", "dl", "doc_id", "start", "end")

    @property
    def keys(self) -> DataFrame:
        """(doc_id, start, end, dl)"""
        return self.held.select(F.inline(F.arrays_zip("doc_id", "start", "end", "dl")))

    @property
    def chunks(self) -> DataFrame:
        """(cid, doc_id, start, end, dl), numbered in document order."""
        return with_positions(self.keys, "doc_id", "start", "end", out="cid", first=0).select("cid", "doc_id", "start", "end", "dl")

    @property
    def blocks(self) -> DataFrame:
        """(bucket, tok, range, n, most, at array, tf array, dl array): at counts from the range's first chunk."""
        return self._rows.where(F.col("bucket") < BUCKETS).select("bucket", "tok", "range", "n", "most", "at", "tf", "dl")

    @property
    def terms(self) -> DataFrame:
        """(tok, df, idf)"""
        return self._read("terms")


def _keys(kind: str) -> str:
    return f"doc_id array<{kind}>, start array<long>, end array<long>"


def write(chunks: DataFrame, root: str, k1: float = retrieval.K1, b: float = retrieval.B, width: int = RANGE) -> Index:
    """Writes the index of chunks (doc_id, start, end, chunk_text or toks) into a new folder."""
    spark = chunks.sparkSession
    terms = retrieval.weights(chunks)
    stats = terms.select("n", "avgdl").first()
    n, avgdl = (stats["n"], stats["avgdl"] or 1.0) if stats else (retrieval.corpus_size(chunks).first()["n"], 1.0)
    terms.select("tok", "df", "idf").write.parquet(f"{root}/terms")
    kind = chunks.schema["doc_id"].dataType.simpleString()
    packed = retrieval.slim(chunks).mapInArrow(_packer(float(avgdl), k1, b, width), f"{BLOCKS}, {_keys(kind)}")
    bucket = F.when(F.col("tok").isNull(), F.lit(BUCKETS)).otherwise(F.pmod(F.hash("tok"), F.lit(BUCKETS)))
    packed.withColumn("bucket", bucket).sortWithinPartitions("bucket", "tok", "range").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{root}/blocks")
    spark.createDataFrame([(n, float(avgdl), k1, b, width, kind)], "n long, avgdl double, k1 double, b double, width int, kind string").coalesce(1).write.parquet(f"{root}/about")
    return Index(spark, root, k1, b, kind)


def _packer(avgdl: float, k1: float, b: float, width: int):
    """The map from chunks (body and cid, or body and key) to blocks, those of one batch: no posting becomes a row.

    Without a cid each batch is a range of its own, and a row without a token holds its chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, key, base = ["tok", "range", "n", "most", "at", "tf", "dl"], ["doc_id", "start", "end"], None
        for batch, found in lexical.parts(batches, "body", min(RANGE, width)):
            placed = "cid" in batch.schema.names
            if not placed:
                base = base + width if base is not None else -(-(TaskContext.get().partitionId() << _BITS) // width) * width
            place = batch.column("cid").to_numpy() if placed else base + np.arange(batch.num_rows)
            cid = place[found.row]
            order = np.lexsort((cid, found.h))
            h, cid, row = found.h[order], cid[order], found.row[order]
            changes = lambda *keys: np.flatnonzero(np.logical_or.reduce([np.concatenate([[True], k[1:] != k[:-1]]) for k in keys])) if len(h) else np.zeros(0, np.int64)
            each = changes(h, cid)
            tf, dl, range_ = np.diff(np.append(each, len(h))), found.dl[row[each]], cid[each] // width
            part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
            begin = np.searchsorted(each, changes(h, cid // width))
            edges = pa.array(np.append(begin, len(each)), pa.int32())
            listed = lambda x: pa.ListArray.from_arrays(edges, pa.array(x, pa.int32()))
            one = order[each[begin]]
            tok = [bytes(found.raw[x:y]).decode() for x, y in zip(found.start[one], found.end[one], strict=True)]
            most = np.maximum.reduceat(part, begin) if len(begin) else part
            columns = [pa.array(tok, pa.string()), pa.array(range_[begin], pa.int64()), pa.array(np.diff(np.append(begin, len(each))), pa.int32()), pa.array(most), listed(cid[each] % width), listed(tf), listed(dl)]
            if not placed:
                whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                own = [pa.nulls(1, pa.string()), pa.array([base // width], pa.int64()), *(pa.nulls(1, c.type) for c in columns[2:6]), whole(pa.array(found.dl, pa.int32()))]
                keys = [whole(batch.column(c)) for c in key]
                yield pa.RecordBatch.from_arrays([*own, *keys], [*names, *key])
                columns += [pa.nulls(len(tok), k.type) for k in keys]
            if len(tok):
                yield pa.RecordBatch.from_arrays(columns, names if placed else [*names, *key])

    return run


def opened(spark: SparkSession, root: str) -> Index:
    about = spark.read.parquet(f"{root}/about").first()
    return Index(spark, root, about.k1, about.b, about.kind)


def _asked(index: Index, questions: DataFrame) -> DataFrame:
    """(qid, tok, bucket, w): question tokens that the index knows."""
    found = retrieval.question_tokens(questions).join(index.terms, "tok")
    return found.select("qid", "tok", F.pmod(F.hash("tok"), F.lit(BUCKETS)).alias("bucket"), (F.col("qtf") * F.col("idf")).alias("w"))


def _scored(index: Index, chosen: DataFrame, asked: DataFrame, avgdl: float, k: int, floors: DataFrame | None = None) -> DataFrame:
    """(qid, doc_id, start, end, score): the k best chunks of each chosen (qid, range), none below the question's floor."""
    per = asked.groupBy("qid").agg(F.collect_list(F.struct("tok", "w")).alias("t")).select("qid", F.col("t.tok").alias("toks"), F.col("t.w").alias("ws"))
    wanted = chosen.select("qid", "range").join(per, "qid")
    wanted = wanted.withColumn("floor", F.lit(None).cast("double")) if floors is None else wanted.join(floors, "qid", "left")
    ranges = chosen.select("range").distinct()
    empty = [F.lit(None).cast(c).alias(n) for n, c in ((f.name, f.dataType) for f in index.held.schema) if n in ("doc_id", "start", "end")]
    read = index.blocks.join(asked.select("bucket", "tok").distinct(), ["bucket", "tok"], "left_semi").select("range", "tok", "at", "tf", "dl", *empty)
    held = index.held.select("range", F.lit(None).cast("string").alias("tok"), *[F.lit(None).cast("array<int>").alias(c) for c in ("at", "tf")], F.lit(None).cast("array<int>").alias("dl"), "doc_id", "start", "end")
    both = read.unionByName(held).join(ranges, "range", "left_semi")
    kind = chosen.schema["qid"].dataType.simpleString()
    schema = f"qid {kind}, doc_id {index.kind}, start long, end long, score double"
    return both.groupBy("range").cogroup(wanted.groupBy("range")).applyInArrow(_ranker(avgdl, index.k1, index.b, k), schema)


def _ranker(avgdl: float, k1: float, b: float, k: int):
    """The function of one range's blocks and chunks, and the questions that it is chosen for."""
    key = ["doc_id", "start", "end"]

    def run(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        own = blocks.filter(pc.is_null(blocks.column("tok")))
        blocks = blocks.filter(pc.is_valid(blocks.column("tok")))
        chunks = pa.table({c: pc.list_flatten(own.column(c)).combine_chunks() for c in key})
        n, rank = chunks.num_rows, np.empty(chunks.num_rows, np.int64)
        rank[pc.sort_indices(chunks, [(c, "ascending") for c in key]).to_numpy()] = np.arange(n)
        at, tf, dl = (pc.list_flatten(blocks.column(c)).to_numpy() for c in ("at", "tf", "dl"))
        part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
        edges = np.concatenate([[0], np.cumsum(pc.list_value_length(blocks.column("at")).to_numpy())])
        toks, outs = blocks.column("tok").combine_chunks(), []
        for begin in range(0, asked.num_rows if n else 0, ASKED):
            some = asked.slice(begin, ASKED)
            of = np.repeat(np.arange(some.num_rows), pc.list_value_length(some.column("toks")).to_numpy())
            t = pc.fill_null(pc.index_in(pc.list_flatten(some.column("toks")), value_set=toks), -1).to_numpy()
            w = pc.list_flatten(some.column("ws")).to_numpy()
            of, t, w = of[t >= 0], t[t >= 0], w[t >= 0]
            used, t = np.unique(t, return_inverse=True)  # tokens that these questions ask of this range
            scores, met = np.zeros((some.num_rows, n)), None if (w > 0).all() else np.zeros((some.num_rows, n))
            for first in range(0, len(used), TOKENS):
                now = used[first : first + TOKENS]
                size = edges[now + 1] - edges[now]
                line = np.repeat(np.arange(len(now)), size)
                post = np.arange(len(line)) + np.repeat(edges[now] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
                parts, weights = np.zeros((len(now), n)), np.zeros((some.num_rows, len(now)))
                parts[line, at[post]] = part[post]
                inside = (t >= first) & (t < first + len(now))
                weights[of[inside], t[inside] - first] = w[inside]
                scores += weights @ parts
                if met is not None:
                    asks = np.zeros_like(weights)
                    asks[of[inside], t[inside] - first] = 1.0
                    met += asks @ (parts > 0)
            floor = pc.fill_null(some.column("floor"), -np.inf).to_numpy()
            hit, scores = (scores if met is None else met) > 0, np.round(scores, 9) + 0.0
            q, c = np.nonzero(hit & (scores >= floor[:, None]))
            best = retrieval.firsts(q, [rank[c], -scores[q, c]], k)
            q, c = q[best], c[best]
            outs.append(pa.table({"qid": some.column("qid").take(pa.array(q)), **{x: chunks.column(x).take(pa.array(c)) for x in key}, "score": pa.array(scores[q, c])}))
        none = {"qid": asked.column("qid").slice(0, 0), **{x: chunks.column(x).slice(0, 0) for x in key}, "score": pa.array([], pa.float64())}
        return pa.concat_tables(outs) if outs else pa.table(none)

    return run


@dataclass
class Search:
    """Ranked rows (qid, rank, doc_id, start, end, score), and what it took."""

    ranked: DataFrame
    bounds: DataFrame
    read: DataFrame

    def skipped(self) -> tuple[int, int]:
        """Pairs of question and range with a common token, and how many of these were never read."""
        total = self.bounds.count()
        return total, total - self.read.count()


def search(index: Index, questions: DataFrame, k: int = 10, zero_fill: bool = True, first: int = FIRST) -> Search:
    """The first k chunks of each question by score, then document order; ``zero_fill`` as in retrieval.bm25."""
    spark = index.spark
    about = spark.read.parquet(f"{index.root}/about").first()
    asked = settled(_asked(index, questions))
    # a token of negative weight can only lower a score, so it adds nothing to a bound
    most = index.blocks.select("bucket", "tok", "range", "most").join(asked, ["bucket", "tok"])
    bounds = settled(most.groupBy("qid", "range").agg(F.sum(F.greatest(F.col("w"), F.lit(0.0)) * F.col("most")).alias("bound")))
    begun = settled(retrieval.top(bounds, first, F.col("bound").desc(), F.col("range")).select("qid", "range"))
    order = [F.col("score").desc(), F.col("doc_id"), F.col("start"), F.col("end")]
    held = settled(retrieval.top(_scored(index, begun, asked, about.avgdl, k), k, *order))
    floor = held.where(F.col("rank") == k).select("qid", F.col("score").alias("floor"))
    rest = bounds.join(begun, ["qid", "range"], "left_anti").join(floor, "qid", "left")
    rest = settled(rest.where(F.col("floor").isNull() | (F.col("bound") + SPARE >= F.col("floor"))).select("qid", "range"))
    key = ["qid", "doc_id", "start", "end"]
    scored = held.select(*key, "score").unionByName(_scored(index, rest, asked, about.avgdl, k, floor))
    best = retrieval.top(scored, k, *order).select(*key, "score")
    if zero_fill:
        best = settled(best)
        # a question with fewer than k hits takes chunks in order; among the first 2k of them k are no hits
        hits = best.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
        few = questions.select("qid").distinct().join(hits, "qid", "left").where(F.coalesce("n", F.lit(0)) < k).select("qid")
        firsts = index.keys.select("doc_id", "start", "end").orderBy("doc_id", "start", "end").limit(2 * k)
        none = few.crossJoin(F.broadcast(firsts)).join(best.select(*key), key, "left_anti")  # 2k rows
        best = best.unionByName(none.withColumn("score", F.lit(0.0)))
    ranked = retrieval.top(best.withColumn("score", F.col("score") + F.lit(0.0)), k, *order)
    return Search(ranked.select("qid", "rank", "doc_id", "start", "end", "score"), bounds, begun.unionByName(rest))
