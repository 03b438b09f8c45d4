"""The ground-truth study: scoring against an author's chunks instead of evidence spans, and how much that biases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.overlap import overlap_chars, overlap_score
from spanforge.operators import alignment


def gold_chunks(author_chunks: DataFrame, truth: DataFrame, by: tuple = ()) -> DataFrame:
    """(by, qid, span_ix, doc_id, start, end, coverage): the author's chunk that covers most of each span, the first of equals."""
    t = truth.select("qid", "span_ix", "doc_id", F.col("start").alias("t1"), F.col("end").alias("t2"))
    met = author_chunks.select(*by, "doc_id", "start", "end").join(t, "doc_id").where((F.col("start") < F.col("t2")) & (F.col("t1") < F.col("end")))
    shared = overlap_chars(F.col("start"), F.col("end"), F.col("t1"), F.col("t2"))
    scored = met.withColumn("coverage", F.round(overlap_score("coverage", shared, F.col("end") - F.col("start"), F.col("t2") - F.col("t1")), 9))
    w = Window.partitionBy(*by, "qid", "span_ix").orderBy(F.col("coverage").desc(), "start", "end")
    return scored.withColumn("nth", F.row_number().over(w)).where("nth = 1").select(*by, "qid", "span_ix", "doc_id", "start", "end", "coverage")


def chunk_hits(ranked: DataFrame, gold: DataFrame, ious: tuple = (0.9,), by: tuple = ("config_id",), author: str = "author") -> DataFrame:
    """(author, by, qid, rank, best_iou): each retrieved chunk's best overlap with a gold chunk of each author."""
    g = gold.select(author, "qid", F.col("doc_id").alias("g_doc"), F.col("start").alias("g1"), F.col("end").alias("g2"))
    both = ranked.join(g, "qid")
    shared = F.when(F.col("doc_id") == F.col("g_doc"), overlap_chars(F.col("start"), F.col("end"), F.col("g1"), F.col("g2"))).otherwise(F.lit(0).cast("long"))
    iou = overlap_score("iou", shared, F.col("end") - F.col("start"), F.col("g2") - F.col("g1"))
    return both.groupBy(author, *by, "qid", "rank").agg(F.max(iou).alias("best_iou"))


def rotation(ranked: DataFrame, gold: DataFrame, truth: DataFrame, k: int = 5, tau: float = 0.5, ious: tuple = (0.9,)) -> DataFrame:
    """(author, config_id, iou, naive_hit, naive_mrr, aligned_hit, aligned_mrr): every author judges every configuration."""
    spark = ranked.sparkSession
    cut = ranked.where(F.col("rank") <= k)
    limits = F.broadcast(spark.createDataFrame([(float(i),) for i in ious], "iou double"))
    first = chunk_hits(cut, gold).crossJoin(limits).groupBy("author", "config_id", "iou", "qid").agg(F.min(F.when(F.col("best_iou") >= F.col("iou"), F.col("rank"))).alias("first"))
    asked = gold.select("author").distinct().crossJoin(cut.select("config_id").distinct()).crossJoin(limits)
    questions = truth.select("qid").distinct()
    every = asked.crossJoin(questions).join(first, ["author", "config_id", "iou", "qid"], "left")
    rate = lambda c: (F.round(F.avg(F.col(c).isNotNull().cast("double")), 9), F.round(F.avg(F.coalesce(1.0 / F.col(c), F.lit(0.0))), 9))
    naive = every.groupBy("author", "config_id", "iou").agg(rate("first")[0].alias("naive_hit"), rate("first")[1].alias("naive_mrr"))
    spans = alignment.first_hits(alignment.align(cut, truth, by=("config_id",)), k, tau, ("config_id",))
    spans = cut.select("config_id").distinct().crossJoin(questions).join(spans, ["config_id", "qid"], "left")
    aligned = spans.groupBy("config_id").agg(rate("first_rank")[0].alias("aligned_hit"), rate("first_rank")[1].alias("aligned_mrr"))
    return naive.join(aligned, "config_id").withColumn("hit_delta", F.round(F.col("aligned_hit") - F.col("naive_hit"), 9))


def winners(rows: DataFrame) -> DataFrame:
    """(author, iou, naive_winner, aligned_winner, agree): by hit, then mrr, then name."""
    first = lambda hit, mrr: F.min_by("config_id", F.struct(-F.col(hit), -F.col(mrr), F.col("config_id")))
    got = rows.groupBy("author", "iou").agg(first("naive_hit", "naive_mrr").alias("naive_winner"), first("aligned_hit", "aligned_mrr").alias("aligned_winner"))
    return got.withColumn("agree", F.col("naive_winner") == F.col("aligned_winner"))


def self_preference(rows: DataFrame, own: str = "chunker") -> DataFrame:
    """(author, iou, naive_bias, aligned_bias): an author's own configuration less the mean of the others, by hit."""
    mine = F.col("author") == F.col(own)
    gap = lambda c: F.round(F.avg(F.when(mine, F.col(c))) - F.avg(F.when(~mine, F.col(c))), 9)
    return rows.groupBy("author", "iou").agg(gap("naive_hit").alias("naive_bias"), gap("aligned_hit").alias("aligned_bias"))
