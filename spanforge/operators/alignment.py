"""Alignment of ranked chunks with truth spans, and its reductions. Keys: config columns (if any), qid, rank, span_ix.

``by`` names the columns that tell configurations apart, e.g. ["config_id"]; questions are keyed by them and qid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.overlap import overlap_chars, overlap_score


#: Characters of a bin: spans meet in the bins that they reach into.
BIN = 2048


def binned(spans: DataFrame, start: str, end: str, width: int, out: str = "bin") -> DataFrame:
    """The spans, each once for every bin that it reaches into; an empty span stands in the bin of its place."""
    first, last = (F.floor(c / F.lit(width)) for c in (F.col(start), F.greatest(F.col(start), F.col(end) - 1)))
    return spans.withColumn(out, F.explode(F.sequence(first, last)))


def pair_scores(left: DataFrame, right: DataFrame, width: int = BIN) -> DataFrame:
    """Chunks (doc_id, start, end) x truths (qid, span_ix, doc_id, start, end) that share characters, in all three modes.

    Both sides are dealt by document and bin, so that a long document is many keys; a pair counts in the first bin that it has in
    common, which is where the later of the two starts.
    """
    t = right.select("qid", "span_ix", "doc_id", F.col("start").alias("t1"), F.col("end").alias("t2"))
    met = binned(left.select("doc_id", "start", "end"), "start", "end", width).join(binned(t, "t1", "t2", width), ["doc_id", "bin"])
    met = met.where((F.col("start") < F.col("t2")) & (F.col("t1") < F.col("end")) & (F.col("bin") == F.floor(F.greatest("start", "t1") / F.lit(width))))
    shared, size, truth = overlap_chars(F.col("start"), F.col("end"), F.col("t1"), F.col("t2")), F.col("end") - F.col("start"), F.col("t2") - F.col("t1")
    modes = [F.round(overlap_score(m, shared, size, truth), 9).alias(m) for m in ("coverage", "precision", "iou")]
    return met.select("qid", "span_ix", "doc_id", "start", "end", shared.alias("overlap_chars"), *modes)


def align(ranked: DataFrame, truth: DataFrame, mode: str = "coverage", by: tuple = ()) -> DataFrame:
    """(by, qid, span_ix, rank, overlap, chunk_len): every ranked row of a question with every span of it.

    The questions are those of the truth: one without ranked rows keeps its spans, with rank null and overlap 0, under each
    configuration that ranks anything, so that every reduction counts it.
    """
    t = truth.select("qid", "span_ix", F.col("doc_id").alias("t_doc"), F.col("start").alias("t1"), F.col("end").alias("t2"))
    asked = ranked.select(*by).distinct().crossJoin(t) if by else t
    both = asked.join(ranked.select(*by, "qid", "rank", "doc_id", "start", "end"), [*by, "qid"], "left")
    shared = F.when(F.col("doc_id") == F.col("t_doc"), overlap_chars(F.col("start"), F.col("end"), F.col("t1"), F.col("t2"))).otherwise(F.lit(0).cast("long"))
    size = F.col("end") - F.col("start")
    return both.select(*by, "qid", "span_ix", "rank", F.coalesce(overlap_score(mode, shared, size, F.col("t2") - F.col("t1")), F.lit(0.0)).alias("overlap"), size.alias("chunk_len"))


def scores(aligned: DataFrame, by: tuple = ()) -> DataFrame:
    """(by, qid, rank, score): the best overlap of each ranked row."""
    return aligned.groupBy(*by, "qid", "rank").agg(F.max("overlap").alias("score"))


def first_hits(aligned: DataFrame, k: int | None, tau: float, by: tuple = ()) -> DataFrame:
    """(by, qid, first_rank): the first row that reaches tau within k, null if none; no k means all."""
    hit = (F.col("overlap") >= tau) & ((F.col("rank") <= k) if k else F.lit(True))
    return aligned.groupBy(*by, "qid").agg(F.min(F.when(hit, F.col("rank"))).alias("first_rank"))


def span_best(aligned: DataFrame, k: int | None, by: tuple = ()) -> DataFrame:
    """(by, qid, span_ix, best): each span's best overlap within k."""
    inside = (F.col("rank") <= k) if k else F.lit(True)
    return aligned.groupBy(*by, "qid", "span_ix").agg(F.coalesce(F.max(F.when(inside, F.col("overlap"))), F.lit(0.0)).alias("best"))


def span_recall(aligned: DataFrame, k: int | None, tau: float, by: tuple = ()) -> DataFrame:
    """(by, qid, span_recall, soft_score)."""
    best = span_best(aligned, k, by)
    return best.groupBy(*by, "qid").agg(F.avg((F.col("best") >= tau).cast("double")).alias("span_recall"), F.avg("best").alias("soft_score"))


def chars_retrieved(ranked: DataFrame, k: int | None, by: tuple = ()) -> DataFrame:
    """(by, qid, chars): summed over ranked rows, not over aligned pairs, which repeat a row for each span; a question without
    rows has none."""
    inside = (F.col("rank") <= k) if k else F.lit(True)
    return ranked.groupBy(*by, "qid").agg(F.coalesce(F.sum(F.when(inside, F.col("end") - F.col("start"))), F.lit(0)).cast("long").alias("chars"))


def reachability(chunks: DataFrame, truth: DataFrame, mode: str = "coverage") -> DataFrame:
    """(qid, span_ix, best): the best that any chunk of the index could do for a span; 0 where none touches it."""
    best = pair_scores(chunks, truth).groupBy("qid", "span_ix").agg(F.max(mode).alias("best"))
    return truth.select("qid", "span_ix").join(best, ["qid", "span_ix"], "left").select("qid", "span_ix", F.coalesce("best", F.lit(0.0)).alias("best"))


def ceiling(reach: DataFrame, taus: tuple) -> DataFrame:
    """(tau, n_spans, reachable): the share of spans within reach at each threshold, in one pass; 0 without spans."""
    one = reach.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.avg((F.col("best") >= t).cast("double")), F.lit(0.0)).alias(f"r{i}") for i, t in enumerate(taus)])
    rows = F.array(*[F.struct(F.lit(float(t)).alias("tau"), F.col("n").alias("n_spans"), F.round(F.col(f"r{i}"), 6).alias("reachable")) for i, t in enumerate(taus)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def per_question(aligned: DataFrame, reach: DataFrame, k: int = 10, tau: float = 0.5, by: tuple = ()) -> DataFrame:
    """(by, qid, rank, reachable, max_achievable, best_coverage, soft): what diagnosis needs, rounded to 4 digits."""
    asked = first_hits(aligned, k, tau, by).withColumnRenamed("first_rank", "rank")
    best = span_best(aligned, k, by).groupBy(*by, "qid").agg(F.max("best").alias("b"), F.avg("best").alias("s"))
    per = reach.groupBy("qid").agg(F.avg((F.col("best") >= tau).cast("double")).alias("r"), F.max("best").alias("m"))
    out = asked.join(best, [*by, "qid"]).join(per, "qid")
    return out.select(*by, "qid", "rank", F.round("r", 4).alias("reachable"), F.round("m", 4).alias("max_achievable"), F.round("b", 4).alias("best_coverage"), F.round("s", 4).alias("soft"))


def ndcg(aligned: DataFrame, k: int, by: tuple = ()) -> DataFrame:
    """(by, qid, ndcg): gains are raw overlaps, the ideal is the same list in falling order; 0 without gain or rows."""
    got = scores(aligned, by).withColumn("inside", F.coalesce(F.col("rank") <= k, F.lit(False)))
    w = Window.partitionBy(*by, "qid", "inside")
    both = got.withColumn("here", F.row_number().over(w.orderBy("rank"))).withColumn("ideal", F.row_number().over(w.orderBy(F.col("score").desc(), "rank")))
    gain = lambda place: F.sum(F.when(F.col("inside"), F.col("score") / F.log2(F.col(place) + 1)))
    sums = both.groupBy(*by, "qid").agg(gain("here").alias("dcg"), gain("ideal").alias("best"))
    return sums.select(*by, "qid", F.round(F.coalesce(F.try_divide("dcg", F.nullif("best", F.lit(0.0))), F.lit(0.0)), 9).alias("ndcg"))
