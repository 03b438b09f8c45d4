"""Which stage lost the evidence: an ordered decision table over per-question records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Causes in order of priority with what fixes them; the last two need none or little.
CAUSES = (
    ("chunker_destroyed", "change chunking (size/strategy) -- embeddings cannot recover this"),
    ("chunker_degraded", "evidence survived only partially: increase chunk size before tuning retrieval"),
    ("reranker_demoted", "first stage found it, reranker pushed it out: drop or retune reranking"),
    ("retriever_missed", "evidence was indexed but unranked: try hybrid, or a reranker"),
    ("ranked_low", "found but not first: a reranker is the targeted fix"),
    ("ok", ""),
)


def causes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, c, f) for k, (c, f) in enumerate(CAUSES)], "priority long, cause string, fix string")


def cause(baseline_rank: Column, reachable: float = 0.999, whole: float = 0.999, good: int = 1) -> Column:
    """Missing fields count as unreachable, wholly achievable."""
    r, a, rank = F.coalesce("reachable", F.lit(0.0)), F.coalesce("max_achievable", F.lit(1.0)), F.col("rank")
    lost = F.when(a < whole, "chunker_degraded").when(baseline_rank.isNotNull(), "reranker_demoted").otherwise("retriever_missed")
    return F.when(r < reachable, "chunker_destroyed").when(rank.isNull(), lost).when(rank > good, "ranked_low").otherwise("ok")


def diagnose(records: DataFrame, baseline: DataFrame | None = None, by: tuple = (), **limits) -> DataFrame:
    """(by, qid, cause, detail); ``baseline`` has (by, qid, rank) of the configuration without its reranker."""
    if baseline is None:
        joined = records.withColumn("b_rank", F.lit(None).cast("long"))
    else:
        joined = records.join(baseline.select(*by, "qid", F.col("rank").alias("b_rank")), [*by, "qid"], "left")
    found = joined.withColumn("cause", cause(F.col("b_rank"), **limits))
    r, c, a = F.coalesce("reachable", F.lit(0.0)), F.coalesce("best_coverage", F.lit(0.0)), F.coalesce("max_achievable", F.lit(1.0))
    detail = (
        F.when(F.col("cause") == "chunker_destroyed", F.format_string("no chunk covers the evidence: %.2f reachable, %.2f retrieved", r, c))
        .when(F.col("cause") == "chunker_degraded", F.format_string("no chunk holds more than %.0f%% of the evidence", a * 100))
        .when(F.col("cause") == "reranker_demoted", F.format_string("at rank %d before reranking, gone after", "b_rank"))
        .when(F.col("cause") == "retriever_missed", F.format_string("within reach (%.2f) but not retrieved", r))
        .when(F.col("cause") == "ranked_low", F.format_string("found at rank %d", "rank"))
        .otherwise(F.lit("found at rank 1"))
    )
    return found.select(*by, "qid", "cause", detail.alias("detail"))


def summary(findings: DataFrame, by: tuple = ()) -> DataFrame:
    """(by, cause, n, share): all causes, also those with none."""
    spark = findings.sparkSession
    counted = findings.groupBy(*by, "cause").agg(F.count(F.lit(1)).alias("c"))
    total = findings.groupBy(*by).agg(F.count(F.lit(1)).alias("t"))
    every = total.crossJoin(F.broadcast(causes(spark).select("cause")))
    out = every.join(counted, [*by, "cause"], "left")
    return out.select(*by, "cause", F.coalesce("c", F.lit(0)).alias("n"), F.round(F.coalesce(F.try_divide(F.col("c").cast("double"), F.col("t")), F.lit(0.0)), 6).alias("share"))


def recommended(findings: DataFrame, by: tuple = ()) -> DataFrame:
    """(by, action): ``n/total questions: fix`` of the first cause in priority that occurs; empty if all is well."""
    spark = findings.sparkSession
    s = summary(findings, by).join(F.broadcast(causes(spark)), "cause")
    total = s.groupBy(*by).agg(F.sum("n").alias("t"), F.min_by(F.struct("n", "fix"), F.when((F.col("n") > 0) & (F.col("cause") != "ok"), F.col("priority"))).alias("f"))
    return total.select(*by, F.when(F.col("f").isNull(), "").otherwise(F.concat(F.col("f.n").cast("string"), F.lit("/"), F.col("t").cast("string"), F.lit(" questions: "), F.col("f.fix"))).alias("action"))
