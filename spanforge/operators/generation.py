"""Scores of generated answers: token overlap, refusals, prompts, judgements, summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import text

#: Characters of an extractive answer and of a prompt's context.
ANSWER_CHARS, PROMPT_CHARS = 900, 6000
#: Fixed value: what a prompt says without context.
NO_CONTEXT = "(no context retrieved)"


def multiset_overlap(a: Column, b: Column) -> Column:
    """Sum over tokens of the smaller count, for two token arrays of one row."""
    count = lambda tokens, t: F.size(F.filter(tokens, lambda x: x == t))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, t: acc + F.least(count(a, t), count(b, t))).cast("long")


def overlap_columns(rows: DataFrame, answer: str = "answer", gold: str = "gold", evidence: str | None = None) -> DataFrame:
    """Adds token_f1, gold_recall and, given evidence, span_grounding; 0 where a side has no tokens. No exchange."""
    out = rows.withColumn("_a", text.answer_tokens(F.coalesce(answer, F.lit("")))).withColumn("_g", text.answer_tokens(F.coalesce(gold, F.lit(""))))
    out = out.withColumn("_o", multiset_overlap(F.col("_a"), F.col("_g")))
    share = lambda of: F.coalesce(F.try_divide(F.col("_o").cast("double"), F.nullif(F.size(of), F.lit(0))), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("_o"), F.nullif(F.size("_a") + F.size("_g"), F.lit(0))), F.lit(0.0))
    out = out.withColumn("token_f1", F.when((F.size("_a") == 0) | (F.size("_g") == 0), F.lit(0.0)).otherwise(f1)).withColumn("gold_recall", share("_g"))
    if evidence:
        out = out.withColumn("_e", text.answer_tokens(F.coalesce(evidence, F.lit("")))).withColumn("_o", multiset_overlap(F.col("_a"), F.col("_e")))
        out = out.withColumn("span_grounding", share("_e")).drop("_e")
    return out.drop("_a", "_g", "_o")


def extractive_answers(ranked: DataFrame, chunks: DataFrame, questions: DataFrame, most: int = ANSWER_CHARS) -> DataFrame:
    """(qid, answer) of every question: the first chunk, stripped and cut; empty, which is a refusal, where nothing was retrieved."""
    first = ranked.where("rank = 1").select("qid", "doc_id", "start", "end")
    found = first.join(chunks.select("doc_id", "start", "end", "chunk_text"), ["doc_id", "start", "end"])
    found = found.select("qid", F.substring(text.strip(F.col("chunk_text")), 1, most).alias("answer"))
    return questions.select("qid").distinct().join(found, "qid", "left").select("qid", F.coalesce("answer", F.lit("")).alias("answer"))


def prompts(questions: DataFrame, ranked: DataFrame, chunks: DataFrame, most: int = PROMPT_CHARS) -> DataFrame:
    """(qid, n_blocks, prompt): numbered blocks in rank order while their lengths fit; separators are not counted."""
    body = ranked.select("qid", "rank", "doc_id", "start", "end").join(chunks.select("doc_id", "start", "end", "chunk_text"), ["doc_id", "start", "end"])
    w = Window.partitionBy("qid").orderBy("rank")
    blocks = body.withColumn("nth", F.row_number().over(w)).withColumn("block", F.concat(F.lit("["), F.col("nth").cast("string"), F.lit("] "), text.strip(F.col("chunk_text"))))
    fit = blocks.withColumn("used", F.sum(F.length("block")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("used") <= most)
    context = fit.groupBy("qid").agg(F.count(F.lit(1)).alias("n_blocks"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "block"))), lambda x: x["block"]), "\n\n").alias("context"))
    out = questions.join(context, "qid", "left")
    return out.select("qid", F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), F.concat(F.lit("Context:\n"), F.coalesce("context", F.lit(NO_CONTEXT)), F.lit("\n\nQuestion: "), F.col("question"), F.lit("\n\nAnswer:")).alias("prompt"))


def called(rows: DataFrame, column: str, fn: Callable[[list[str]], list[str]], out: str) -> DataFrame:
    """Adds a model's replies to the texts of a column, in batches: the hook for answerers and judges."""

    @F.pandas_udf("string")
    def reply(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(fn(part.tolist()))

    return rows.withColumn(out, reply(F.col(column)))


def judge(rows: DataFrame, column: str, fn: Callable[[list[str]], list[str]], repeats: int = 1) -> DataFrame:
    """(qid, score, spread, failures): mean and population deviation of the parsed replies; null if all failed."""
    asked = rows.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("ask", F.concat(F.col(column), F.lit("\nseed: "), F.col("seed").cast("string")))
    got = called(asked, "ask", fn, "reply").withColumn("s", text.judged_score(F.col("reply")))
    return got.groupBy("qid").agg(F.avg("s").alias("score"), F.when(F.count("s") > 0, F.stddev_pop("s")).alias("spread"), F.count_if(F.col("s").isNull()).alias("failures"))


def generation_summary(scored: DataFrame, by: tuple = ("config_id",)) -> DataFrame:
    """One row a configuration. Refusals are not judged; null judgements are left out; coverage is mean times answer rate.

    Rows: (by, qid, answer, token_f1, gold_recall, span_grounding, faithfulness, relevance).
    """
    r = scored.withColumn("refused", text.is_refusal(F.coalesce("answer", F.lit(""))))
    judged = lambda c: F.when(~F.col("refused"), F.col(c))
    four = lambda c: F.round(c, 4)
    rate = 1.0 - F.avg(F.col("refused").cast("double"))
    return r.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), four(F.avg(F.col("refused").cast("double"))).alias("refusal_rate"), *[four(F.avg(four(F.col(c)))).alias(c) for c in ("token_f1", "gold_recall", "span_grounding")],
        four(F.avg(judged("faithfulness"))).alias("faithfulness"), four(F.avg(judged("relevance"))).alias("relevance"), F.count(judged("faithfulness")).alias("n_judged"),
        four(F.avg(judged("faithfulness")) * rate).alias("faithful_coverage"), four(F.avg(judged("relevance")) * rate).alias("relevant_coverage"),
    )
