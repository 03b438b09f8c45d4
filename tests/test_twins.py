"""Twins: pairs are dealt over tasks by their number, and the explanation makes none but the winner's."""

from pyspark.sql import functions as F

from spanforge.operators import ranking


def rows(spark, n=60):
    return spark.range(n).select(
        F.col("id").alias("config_id"), F.lit("c").alias("chunker"), (F.col("id") % 2).cast("string").alias("params"), F.lit("r").alias("retriever"), F.when(F.col("id") % 3 == 0, "rr").alias("reranker"),
        (F.col("id") / 100).alias("mrr"), (F.col("id") % 5).cast("double").alias("latency_ms"),
    )


def test_a_key_of_many_pairs_is_many_tasks(spark, monkeypatch):
    whole = sorted(map(tuple, ranking.reranker_twins(rows(spark)).collect()), key=str)
    monkeypatch.setattr(ranking, "TASK_PAIRS", 50)
    dealt = ranking.reranker_twins(rows(spark))
    assert len(whole) == 2 * 10 * 20 and sorted(map(tuple, dealt.collect()), key=str) == whole
    assert max(r.n for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()) < len(whole) // 2


def test_only_pairs_of_the_winner_are_made(spark):
    all_ = rows(spark)
    for best in (12, 13):  # with a reranker and without
        winner = all_.where(F.col("config_id") == best)
        mine = lambda pairs: sorted((tuple(r) for r in pairs.collect() if best in (r.config_id, r.twin_id)), key=str)
        made = ranking.reranker_twins(ranking.twins_of(all_, winner))
        assert mine(made) == mine(ranking.reranker_twins(all_)) and made.count() == len(mine(made)) > 0


def test_copies_follow_the_root_of_the_cells(spark, monkeypatch):
    """A key of 16 cells copies its rows four times, not one side sixteen times; a key of few pairs is not copied for it."""
    some = rows(spark, 1200).withColumn("params", F.when(F.col("config_id") % 10 < 9, "hot").otherwise("cold"))
    whole = ranking.reranker_twins(some)
    monkeypatch.setattr(ranking, "TASK_PAIRS", 360 * 720 // 16)
    dealt = ranking.reranker_twins(some)
    assert sorted(map(tuple, dealt.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
    node, sent = dealt._jdf.queryExecution().executedPlan().toString(), []
    assert "BroadcastExchange" in node
    plan = dealt._jdf.queryExecution().optimizedPlan()
    stack = [plan]
    while stack:
        at = stack.pop()
        if at.nodeName() == "RepartitionByExpression":
            sent.append(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, at).count())
        stack += [at.children().apply(i) for i in range(at.children().size())]
    assert len(sent) == 2 and sum(sent) <= 5 * 1200
