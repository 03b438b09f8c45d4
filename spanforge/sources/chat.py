"""A chat model behind a transport, asked from Spark tasks: requests, pacing, tries, replies, usage.

Each distinct request is asked once. Requests are dealt to ``lanes`` tasks by the hash of their body; a lane asks one at a time and
keeps its share of the allowed rate by a token bucket, so all lanes together stay within it. A try fails by one of the statuses
of ``RETRIED`` or by a dropped connection, and is followed by a wait that doubles; any other status is final. A request that
fails costs its own row, which tells why; ``strict`` makes it fail the job. ``through_replies_in`` appends replies to a cache round
by round, so a run that is stopped pays again for one round at most.
"""

from __future__ import annotations

import http.client
import json
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import text

#: Statuses worth another try, tries, the longest wait in seconds, requests a minute, characters of a key.
RETRIED = frozenset({408, 409, 429, 500, 502, 503, 504})
TRIES, LONGEST_WAIT, PER_MINUTE, KEY_CHARS = 7, 30, 90, 32
REPLY_SCHEMA = "key string, reply string, json string, status int, tries int, waited double, error string, prompt_tokens long, completion_tokens long"
#: The header that names a model's limit.
LIMIT_HEADER = "x-ratelimit-limit-req-minute"


@dataclass(frozen=True)
class Answer:
    """What a transport gives back. A connection that drops raises OSError or HTTPException instead."""

    status: int
    body: str = ""
    headers: dict = field(default_factory=dict)


#: (request body, number of the try from 0) -> answer.
Transport = Callable[[str, int], Answer]


@dataclass(frozen=True)
class Http:
    """Posts requests to a URL. The key stands in the headers only, never in a request's body or its cache key."""

    url: str
    key: str = ""
    timeout: float = 90.0

    def __call__(self, request: str, attempt: int) -> Answer:
        headers = {"Content-Type": "application/json", "Accept": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        try:
            with urllib.request.urlopen(urllib.request.Request(self.url, request.encode(), headers, method="POST"), timeout=self.timeout) as got:
                return Answer(got.status, got.read().decode(), {k.lower(): v for k, v in got.headers.items()})
        except urllib.error.HTTPError as failed:
            return Answer(failed.code, failed.read().decode("utf-8", "replace"), {k.lower(): v for k, v in failed.headers.items()})


class Bucket:
    """A token bucket: ``rate`` tokens a second, ``burst`` at most at once."""

    def __init__(self, rate: float, burst: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.held, self.at = float(burst), clock()

    def take(self) -> None:
        if self.rate <= 0:  # no limit
            return
        now = self.clock()
        self.held, self.at = min(self.burst, self.held + (now - self.at) * self.rate), now
        if self.held < 1:
            self.sleep((1 - self.held) / self.rate)
            self.held, self.at = 1.0, self.clock()
        self.held -= 1


@dataclass
class Outcome:
    """How a request ended."""

    status: int | None = None
    tries: int = 0
    waited: float = 0.0
    body: str | None = None
    error: str | None = None


def posted(transport: Transport, request: str, bucket: Bucket, tries: int = TRIES, sleep: Callable[[float], None] = time.sleep) -> Outcome:
    """Asks until there is a final answer or no try is left; waits 1, 2, 4 ... seconds, ``LONGEST_WAIT`` at most, in between."""
    out = Outcome()
    while out.tries < tries:
        if out.tries:
            pause = float(min(2 ** (out.tries - 1), LONGEST_WAIT))
            sleep(pause)
            out.waited += pause
        bucket.take()
        try:
            answer = transport(request, out.tries)
            out.status, last = answer.status, f"HTTP {answer.status}"
        except (OSError, http.client.HTTPException) as dropped:  # URLError and TimeoutError are OSErrors
            answer, out.status, last = None, None, type(dropped).__name__
        out.tries += 1
        if answer is not None and answer.status not in RETRIED:
            if 200 <= answer.status < 300:
                out.body = answer.body
            else:
                out.error = f"HTTP {answer.status}: {answer.body[:300]}"
            return out
    out.error = f"no answer after {tries} tries: {last}" if tries else "no tries"
    return out


def salvaged(reply: str | None) -> str:
    """The reply if it is JSON, else what stands between its outer braces if that is, else an empty object."""
    reply = reply or ""
    for piece in (reply, reply[reply.find("{") : reply.rfind("}") + 1] if "{" in reply else ""):
        try:
            json.loads(piece)
            return piece
        except ValueError:
            continue
    return "{}"


def content(outcome: Outcome) -> tuple[str | None, int, int]:
    """Reply, prompt and completion tokens of a completion's payload; a payload of another form is an error."""
    if outcome.body is None:
        return None, 0, 0
    try:
        payload = json.loads(outcome.body)
        said, used = payload["choices"][0]["message"]["content"], payload.get("usage") or {}
        return said, int(used.get("prompt_tokens", 0)), int(used.get("completion_tokens", 0))
    except (ValueError, KeyError, IndexError, TypeError, AttributeError):
        outcome.error = "not a completion: " + outcome.body[:300]
        return None, 0, 0


class Usage:
    """Counts while a job runs, in accumulators: calls, tries beyond the first, tokens. A task that runs again counts again;
    ``usage`` has the exact figures."""

    def __init__(self, spark: SparkSession):
        self.calls, self.again, self.prompt_tokens, self.completion_tokens = (spark.sparkContext.accumulator(0) for _ in range(4))

    def add(self, outcome: Outcome, prompt_tokens: int, completion_tokens: int) -> None:
        self.calls.add(1)
        self.again.add(outcome.tries - 1)
        self.prompt_tokens.add(prompt_tokens)
        self.completion_tokens.add(completion_tokens)

    def as_dict(self) -> dict[str, int]:
        return {"calls": self.calls.value, "again": self.again.value, "prompt_tokens": self.prompt_tokens.value, "completion_tokens": self.completion_tokens.value}


def request(model: str, prompt: Column, system: str | None = None, temperature: float = 0.0, max_tokens: int = 512, seed: int | Column | None = 0, json_mode: bool = False) -> Column:
    """A completion's body as JSON, fields in the order of their names; a null prompt is empty."""
    said = lambda role, what: F.struct(F.lit(role).alias("role"), what.alias("content"))
    messages = [said("system", F.lit(system))] if system else []
    fields = {
        "max_tokens": F.lit(max_tokens), "messages": F.array(*messages, said("user", F.coalesce(prompt, F.lit("")))), "model": F.lit(model),
        **({} if seed is None else {"random_seed": seed if isinstance(seed, Column) else F.lit(seed)}), **({"response_format": F.struct(F.lit("json_object").alias("type"))} if json_mode else {}), "temperature": F.lit(temperature),
    }
    return F.to_json(F.struct(*(column.alias(name) for name, column in fields.items())))


def request_key(body: Column) -> Column:
    return F.substring(F.sha2(body, 256), 1, KEY_CHARS)


def replies(requests: DataFrame, transport: Transport, lanes: int = 8, per_minute: float = PER_MINUTE, tries: int = TRIES, burst: int = 1, strict: bool = False, usage: Usage | None = None, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """REPLY_SCHEMA, a row for each distinct request (key, request)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = Bucket(per_minute / 60 / lanes, burst, sleep=sleep)
        for batch in batches:
            rows = []
            for key, body in zip(batch.column("key").to_pylist(), batch.column("request").to_pylist(), strict=True):
                outcome = posted(transport, body, bucket, tries, sleep)
                reply, asked, said = content(outcome)
                if strict and outcome.error:
                    raise RuntimeError(f"request {key}: {outcome.error}")
                if usage:
                    usage.add(outcome, asked, said)
                rows.append((key, reply, salvaged(reply), outcome.status, outcome.tries, outcome.waited, outcome.error, asked, said))
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.int64(), pa.int64()]
            names = [part.split(" ")[0] for part in REPLY_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], kind) for kind in kinds], names)

    return requests.select("key", "request").dropDuplicates(["key"]).repartition(lanes, "key").mapInArrow(run, REPLY_SCHEMA)


def asked(rows: DataFrame, body: Column, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows with what ``ask`` (requests to REPLY_SCHEMA) says to the request that ``body`` makes of each."""
    keyed = rows.withColumn("request", body).withColumn("key", request_key(F.col("request")))
    return keyed.drop("request").join(ask(keyed.select("key", "request")), "key", "left").drop("key")


def _there(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def through_replies_in(requests: DataFrame, cache: str, transport: Transport, rounds: int = 1, **how) -> DataFrame:
    """REPLY_SCHEMA and ``cached`` of every distinct request: replies that the cache (a Parquet folder) has are taken from it.

    The rest is asked in ``rounds`` jobs by hash, each appended when it is done, with the number of the run. Failures are appended
    too but serve no later run, which asks again.
    """
    spark, run, schema = requests.sparkSession, uuid.uuid4().hex, REPLY_SCHEMA + ", run string"
    wanted = requests.select("key", "request").dropDuplicates(["key"])

    def held() -> DataFrame:
        return spark.read.schema(schema).parquet(cache) if _there(spark, cache) else spark.createDataFrame([], schema)

    for k in range(rounds):
        left = wanted.where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == k).join(held().where("error IS NULL").select("key"), "key", "left_anti")
        replies(left, transport, **how).withColumn("run", F.lit(run)).write.mode("append").parquet(cache)
    own = F.col("run") == run
    return held().where(F.col("error").isNull() | own).join(wanted.select("key"), "key", "left_semi").withColumn("cached", ~own).drop("run")


def usage(rows: DataFrame) -> DataFrame:
    """One row: calls, cache hits, failures, tries and tokens of replies; cached ones cost no tries and no tokens."""
    cached = F.col("cached") if "cached" in rows.columns else F.lit(False)
    paid = lambda c: F.coalesce(F.sum(F.when(~cached, F.col(c))), F.lit(0)).cast("long")
    return rows.agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(cached).alias("cache_hits"), F.count_if(F.col("error").isNotNull()).alias("failures"), paid("tries").alias("tries"), paid("prompt_tokens").alias("prompt_tokens"), paid("completion_tokens").alias("completion_tokens"),
    )


def judgements(rows: DataFrame, keys: tuple, prompt: str, ask: Callable[[DataFrame], DataFrame], model: str, repeats: int = 1, **options) -> DataFrame:
    """(keys, score, spread, failures): each prompt is judged ``repeats`` times under seeds 0, 1, ...; a reply without a score, and a
    request that failed, is a failure and no zero."""
    seeded = rows.select(*keys, prompt).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    got = asked(seeded, request(model, F.col(prompt), seed=F.col("seed"), json_mode=True, **options), ask).withColumn("s", text.judged_score(F.col("json")))
    return got.groupBy(*keys).agg(F.avg("s").alias("score"), F.when(F.count("s") > 0, F.stddev_pop("s")).alias("spread"), F.count_if(F.col("s").isNull()).alias("failures"))


def probe(spark: SparkSession, models: list[str], transport: Transport) -> DataFrame:
    """(model, usable, per_minute): which models a key may call, and their limits as far as answers tell; asked once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for model, body in zip(batch.column("model").to_pylist(), batch.column("request").to_pylist(), strict=True):
                try:
                    answer = transport(body, 0)
                    limit = answer.headers.get(LIMIT_HEADER, "")
                    limit = int(limit) if limit.isdigit() else 0
                    usable = 200 <= answer.status < 300 or limit > 0
                except (OSError, http.client.HTTPException):
                    usable, limit = False, 0
                out.append((model, usable, limit if usable else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.bool_(), pa.int64()), strict=True)], ["model", "usable", "per_minute"])

    named = spark.createDataFrame([(m,) for m in models], "model string")
    body = F.to_json(F.struct(F.lit(4).alias("max_tokens"), F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content"))).alias("messages"), F.col("model")))
    return named.select("model", body.alias("request")).mapInArrow(run, "model string, usable boolean, per_minute long")
