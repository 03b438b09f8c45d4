"""Queries over conversations that ask a model through the client, and over what sidecars hold.

No model runs offline, so the transport is a stub that fails and answers by the digest of what it is asked: it drops connections,
gives each of the statuses worth another try, refuses, and wraps its scores in prose.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from spanforge.functions import text
from spanforge.queries.core import query, table
from spanforge.sources import chat, sidecars

#: Statuses in the order in which the stub fails; after them comes a dropped connection.
FAILING = tuple(sorted(chat.RETRIED))


def stub(request: str, attempt: int) -> chat.Answer:
    body = json.loads(request)
    prompt = body["messages"][-1]["content"] + (str(body["random_seed"]) if body["random_seed"] else "")
    a = int(hashlib.md5(prompt.encode()).hexdigest()[:4], 16)
    if a % 37 == 0:
        return chat.Answer(400, "refused")
    if attempt < a % 10:
        kind = (a + attempt) % 8
        if kind == len(FAILING):
            raise ConnectionResetError
        return chat.Answer(FAILING[kind])
    said = ('{"score": %s}' % ((a % 100) / 100), 'Sure: {"score": "%d%%"}, as asked.' % (a % 91 + 10), "no score today")[a % 3]
    return chat.Answer(200, json.dumps({"choices": [{"message": {"content": said}}], "usage": {"prompt_tokens": len(prompt), "completion_tokens": len(said)}}))


def ask(requests):
    """Without a limit and without waiting: the stub is no service. What would be waited is reported."""
    return chat.replies(requests, stub, lanes=8, per_minute=0, sleep=lambda seconds: None)


def replied(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("prompt"))
    return chat.asked(turns, chat.request("stub", F.col("prompt")), ask)


STUB = f"""t AS (SELECT conv_id, turn, coalesce(text, '') AS prompt, ('0x' || substr(md5(coalesce(text, '')), 1, 4))::INT AS a FROM conversations),
    s AS (SELECT *, a % 37 = 0 AS bad, a % 37 <> 0 AND a % 10 >= {chat.TRIES} AS down, CASE WHEN a % 37 = 0 THEN 1 ELSE least(a % 10 + 1, {chat.TRIES}) END AS tries,
        [{', '.join(map(str, FAILING))}, NULL][(a + {chat.TRIES - 1}) % 8 + 1] AS last,
        [0, 1, 3, 7, 15, 31, 61][CASE WHEN a % 37 = 0 THEN 1 ELSE least(a % 10 + 1, {chat.TRIES}) END]::DOUBLE AS waited,
        CASE WHEN a % 3 = 0 THEN (a % 100) / 100.0::DOUBLE WHEN a % 3 = 1 THEN (a % 91 + 10) / 100.0::DOUBLE END AS said FROM t),
    replied AS (SELECT *, CASE WHEN bad THEN 400 WHEN down THEN last ELSE 200 END::INTEGER AS status,
        CASE WHEN bad THEN 'HTTP 400: refused' WHEN down THEN 'no answer after {chat.TRIES} tries: ' || coalesce('HTTP ' || last, 'ConnectionResetError') END AS error,
        CASE WHEN NOT bad AND NOT down THEN said END AS score FROM s)"""


@query(f"WITH {STUB} SELECT conv_id, turn, status, tries::INTEGER AS tries, waited, error, round(score, 9) AS score FROM replied")
def model_replies(spark, sf_dir):
    """Every turn is a prompt: its tries, waits, final status, error and the score salvaged from the reply."""
    got = replied(spark, sf_dir)
    return got.select("conv_id", "turn", "status", "tries", "waited", "error", F.round(text.judged_score(F.col("json")), 9).alias("score"))


@query(f"""WITH {STUB}, one AS (SELECT DISTINCT prompt, a, tries, error FROM replied)
    SELECT count(*)::BIGINT AS calls, 0::BIGINT AS cache_hits, count(error)::BIGINT AS failures, sum(tries)::BIGINT AS tries, coalesce(sum(length(prompt)) FILTER (WHERE error IS NULL), 0)::BIGINT AS prompt_tokens,
        coalesce(sum(CASE a % 3 WHEN 0 THEN length('{{"score": ' || CASE WHEN a % 100 = 0 THEN '0.0' ELSE trim(trailing '0' FROM printf('%.2f', (a % 100) / 100.0::DOUBLE)) END || '}}') WHEN 1 THEN length('Sure: {{"score": "' || (a % 91 + 10) || '%"}}, as asked.') ELSE length('no score today') END) FILTER (WHERE error IS NULL), 0)::BIGINT AS completion_tokens FROM one""")
def model_usage(spark, sf_dir):
    """What all turns cost together; equal prompts are asked once."""
    turns = table(spark, sf_dir, "conversations").select(chat.request("stub", F.col("text")).alias("request"))
    return chat.usage(ask(turns.withColumn("key", chat.request_key(F.col("request")))))


@query("""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS prompt FROM conversations),
    seeds AS (SELECT *, ('0x' || substr(md5(prompt || CASE WHEN seed = 0 THEN '' ELSE seed::VARCHAR END), 1, 4))::INT AS a FROM t, range(0, 3) x(seed)),
    scored AS (SELECT *, CASE WHEN a % 37 = 0 OR a % 10 >= 7 THEN NULL WHEN a % 3 = 0 THEN (a % 100) / 100.0::DOUBLE WHEN a % 3 = 1 THEN (a % 91 + 10) / 100.0::DOUBLE END AS s FROM seeds)
    SELECT conv_id, turn, round(avg(s), 6) AS score, round(stddev_pop(s), 6) AS spread, count(*) FILTER (WHERE s IS NULL)::BIGINT AS failures FROM scored GROUP BY 1, 2""")
def model_judgements(spark, sf_dir):
    """Every turn judged under three seeds; what fails or has no score is counted, not scored."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"))
    got = chat.judgements(turns, ("conv_id", "turn"), "prompt", ask, "stub", 3)
    return got.select("conv_id", "turn", F.round("score", 6).alias("score"), F.round("spread", 6).alias("spread"), "failures")


@query("""WITH log AS (SELECT 'c' || conv_id % 60 AS config_id, lpad(conv_id::VARCHAR, 12, '0') || '-' || lpad(turn::VARCHAR, 6, '0') AS attempt, role AS qa_file, length(text) % 3 AS n_questions, length(text) % 4 = 0 AS failed FROM conversations),
    latest AS (SELECT config_id, failed FROM log WHERE qa_file = 'user' AND n_questions = 1 QUALIFY row_number() OVER (PARTITION BY config_id ORDER BY attempt DESC) = 1)
    SELECT config_id FROM (SELECT DISTINCT config_id FROM log) WHERE config_id NOT IN (SELECT config_id FROM latest WHERE NOT coalesce(failed, false))""")
def sidecar_left(spark, sf_dir):
    """A log with an entry a turn: the configurations that a run for 'user' with one question still has to measure."""
    attempt = F.concat(F.lpad(F.col("conv_id").cast("string"), 12, "0"), F.lit("-"), F.lpad(F.col("turn").cast("string"), 6, "0"))
    log = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), (F.col("conv_id") % 60).cast("string")).alias("config_id"), attempt.alias("attempt"), F.col("role").alias("qa_file"), (F.length("text") % 3).cast("long").alias("n_questions"),
        F.lit(1).cast("long").alias("n_rows"), F.when(F.length("text") % 4 == 0, F.lit("failed")).alias("error"), attempt.alias("ended"),
    )
    return sidecars.left(log.select("config_id").distinct(), log, "user", 1)
