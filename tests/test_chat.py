"""The model client and sidecars: tries, pacing, caching, resume."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from spanforge.sources import chat, sidecars


def completion(said, asked=3, tokens=2):
    return json.dumps({"choices": [{"message": {"role": "assistant", "content": said}}], "usage": {"prompt_tokens": asked, "completion_tokens": tokens}})


class Script:
    """A transport that gives each of these answers in turn; exceptions are raised."""

    def __init__(self, *answers):
        self.answers = answers

    def __call__(self, request, attempt):
        answer = self.answers[min(attempt, len(self.answers) - 1)]
        if isinstance(answer, Exception):
            raise answer
        return answer


def tried(*answers, tries=chat.TRIES):
    slept = []
    return chat.posted(Script(*answers), "{}", chat.Bucket(0), tries, slept.append), slept


@pytest.mark.parametrize("status", sorted(chat.RETRIED))
def test_statuses_worth_another_try(status):
    out, slept = tried(chat.Answer(status), chat.Answer(200, "x"))
    assert (out.status, out.tries, out.body, out.error, out.waited) == (200, 2, "x", None, 1.0) and slept == [1.0]


def test_waits_double_up_to_a_bound_and_end():
    out, slept = tried(chat.Answer(503))
    assert slept == [1, 2, 4, 8, 16, 30] and out.waited == 61 and out.tries == 7 and out.error == "no answer after 7 tries: HTTP 503"
    out, slept = tried(ConnectionResetError("gone"), TimeoutError(), chat.Answer(429), chat.Answer(201, "y"))
    assert out.body == "y" and out.tries == 4 and slept == [1, 2, 4]
    assert tried(ConnectionResetError())[0].error == "no answer after 7 tries: ConnectionResetError"
    out, slept = tried(chat.Answer(401, "no key"), chat.Answer(200, "never"))
    assert out.error == "HTTP 401: no key" and out.tries == 1 and not slept


def test_bucket_keeps_the_rate():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    bucket = chat.Bucket(2.0, 3, lambda: now[0], sleep)
    for _ in range(3):
        bucket.take()
    assert not slept  # the burst
    for _ in range(4):
        bucket.take()
    assert slept == [0.5] * 4
    now[0] += 10  # what is saved up is bounded
    for _ in range(4):
        bucket.take()
    assert len(slept) == 5


def test_salvage():
    assert chat.salvaged('{"a": 1}') == '{"a": 1}' and chat.salvaged('Sure: {"a": {"b": 1}} done') == '{"a": {"b": 1}}' and chat.salvaged("[1]") == "[1]"
    assert [chat.salvaged(x) for x in (None, "", "no", "} {", "{a} {", '{"a": 1} {"b": 2}')] == ["{}"] * 6


def stub(request, attempt):
    """Prompts say how they go: 'fail 2' twice 503 first, 'bad' is refused, 'odd' is no completion."""
    prompt = json.loads(request)["messages"][-1]["content"]
    if prompt.startswith("fail") and attempt < int(prompt.split()[1]):
        return chat.Answer(503)
    if prompt.startswith("bad"):
        return chat.Answer(400, "refused")
    return chat.Answer(200, "{}" if prompt.startswith("odd") else completion(f"said {prompt}"))


def prompts(spark, *texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, prompt string")


FAST = {"per_minute": 0, "sleep": lambda s: None}


def test_replies_and_usage(spark):
    rows = prompts(spark, "a", "a", "fail 2", "fail 9", "bad", "odd", None, 'quote " \n é')
    counts = chat.Usage(spark)
    got = chat.asked(rows, chat.request("m", F.col("prompt")), lambda new: chat.replies(new, stub, lanes=3, usage=counts, **FAST)).orderBy("k").collect()
    assert [r.reply for r in got] == ["said a", "said a", "said fail 2", None, None, None, "said ", 'said quote " \n é']
    assert [r.tries for r in got] == [1, 1, 3, 7, 1, 1, 1, 1] and got[2].waited == 3.0
    assert [r.error for r in got[3:6]] == ["no answer after 7 tries: HTTP 503", "HTTP 400: refused", "not a completion: {}"]
    assert counts.as_dict() == {"calls": 7, "again": 8, "prompt_tokens": 12, "completion_tokens": 8}  # 'a' is asked once
    with pytest.raises(Exception, match="refused"):
        chat.replies(prompts(spark, "bad").select(F.lit("k").alias("key"), chat.request("m", F.col("prompt")).alias("request")), stub, strict=True, **FAST).collect()


def test_requests_are_json_with_sorted_fields(spark):
    row = prompts(spark, "hi").select(chat.request("m", F.col("prompt"), system="s", seed=4, json_mode=True).alias("r"), chat.request("m", F.col("prompt"), seed=None).alias("q")).first()
    body = json.loads(row.r)
    assert list(body) == sorted(body) and body == {"model": "m", "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "hi"}], "temperature": 0.0, "max_tokens": 512, "random_seed": 4, "response_format": {"type": "json_object"}}
    assert "random_seed" not in json.loads(row.q)


def test_cache_serves_and_failures_are_asked_again(spark, tmp_path):
    cache = str(tmp_path / "cache")
    ask = lambda rows, transport, **how: chat.through_replies_in(rows.select(chat.request_key(chat.request("m", F.col("prompt"))).alias("key"), chat.request("m", F.col("prompt")).alias("request")), cache, transport, **how, **FAST)
    first = ask(prompts(spark, "a", "b", "bad 1", "a"), stub, rounds=3)
    u = chat.usage(first).first()
    assert (u.calls, u.cache_hits, u.failures, u.tries, u.prompt_tokens) == (3, 0, 1, 3, 6)
    again = ask(prompts(spark, "a", "b", "bad 1", "c"), Script(chat.Answer(200, completion("new"))))
    got = {r.reply: r.cached for r in again.collect()}
    assert got == {"said a": True, "said b": True, "new": False} and again.where("reply = 'new'").count() == 2
    u = chat.usage(again).first()
    assert (u.calls, u.cache_hits, u.failures, u.tries) == (4, 2, 0, 2)


def test_a_run_that_stops_pays_for_its_round_only(spark, tmp_path):
    cache, rows = str(tmp_path / "cache"), prompts(spark, *(f"p{k}" for k in range(40)))
    requests = rows.select(chat.request_key(chat.request("m", F.col("prompt"))).alias("key"), chat.request("m", F.col("prompt")).alias("request"))

    def dies(request, attempt):
        if json.loads(request)["messages"][-1]["content"] == "p7":
            raise MemoryError  # no dropped connection: the job ends
        return stub(request, attempt)

    with pytest.raises(Exception, match="MemoryError"):
        chat.through_replies_in(requests, cache, dies, rounds=8, **FAST)
    kept = spark.read.parquet(cache).count()
    out = chat.through_replies_in(requests, cache, stub, rounds=8, **FAST)
    assert 0 < kept < 40 and out.count() == 40 and out.where("cached").count() == kept


def test_judgements_count_failures(spark):
    def judge(request, attempt):
        body = json.loads(request)
        prompt, seed = body["messages"][-1]["content"], body["random_seed"]
        return chat.Answer(200, completion({"mixed": ['{"score": 0}', 'well {"score": 1} then'][seed % 2], "none": "no idea", "flag": '{"score": true}'}[prompt])) if prompt != "down" else chat.Answer(400)

    got = {r.k: (r.score, r.spread, r.failures) for r in chat.judgements(prompts(spark, "mixed", "none", "flag", "down"), ("k",), "prompt", lambda new: chat.replies(new, judge, **FAST), "m", 2).collect()}
    assert got == {0: (0.5, 0.5, 0), 1: (None, None, 2), 2: (1.0, 0.0, 0), 3: (None, None, 2)}


def test_probe(spark):
    def transport(request, attempt):
        model = json.loads(request)["model"]
        if model == "gone":
            raise ConnectionResetError
        return {"ok": chat.Answer(200, "", {chat.LIMIT_HEADER: "188"}), "quiet": chat.Answer(200), "busy": chat.Answer(429, "", {chat.LIMIT_HEADER: "5"}), "not": chat.Answer(403, "", {chat.LIMIT_HEADER: "0"})}[model]

    got = {r.model: (r.usable, r.per_minute) for r in chat.probe(spark, ["ok", "quiet", "busy", "not", "gone"], transport).collect()}
    assert got == {"ok": (True, 188), "quiet": (True, 0), "busy": (True, 5), "not": (False, None), "gone": (False, None)}


def test_http_transport():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"])).decode()
            seen.append((body, self.headers["Authorization"]))
            code = 503 if len(seen) == 1 else 200
            data = completion("over the wire").encode()
            self.send_response(code)
            self.send_header("X-RateLimit-Limit-Req-Minute", "9")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        out = chat.posted(chat.Http(f"http://127.0.0.1:{server.server_port}/", "secret", 5), '{"a": 1}', chat.Bucket(0), sleep=lambda s: None)
        assert out.tries == 2 and chat.content(out) == ("over the wire", 3, 2) and seen == [('{"a": 1}', "Bearer secret")] * 2
        assert chat.Http(f"http://127.0.0.1:{server.server_port}/")("{}", 0).headers[chat.LIMIT_HEADER] == "9"
    finally:
        server.shutdown()


# ---------------------------------------------------------------- sidecars

class Killed(BaseException):
    """Ends a run as a signal would."""


def summary(spark, config_id):
    return spark.createDataFrame([(len(config_id), 0.5)], "n long, score double")


def sidecar(spark, tmp_path, qa_file="q.json", n=4):
    return sidecars.Sidecar(spark, str(tmp_path / "side"), qa_file, n, "n long, score double")


def test_resume_after_a_kill(spark, tmp_path):
    """Killed after two configurations, and in the middle of the third, whose data stand without an entry."""
    configs = [f"c{k}" * (k + 1) for k in range(5)]

    class Cut(sidecars.Sidecar):
        def commit(self, config_id, attempt, n_rows, error=None):
            if config_id == configs[2]:
                raise Killed
            super().commit(config_id, attempt, n_rows, error)

    with pytest.raises(Killed):
        Cut(spark, str(tmp_path / "side"), "q.json", 4, "n long, score double").run(configs, lambda c: summary(spark, c))
    side = sidecar(spark, tmp_path)
    assert side.done() == configs[:2] and len(list((tmp_path / "side" / "data").iterdir())) == 3
    assert {r.config_id for r in side.rows().collect()} == set(configs[:2])
    asked = []
    assert side.run(configs, lambda c: asked.append(c) or summary(spark, c)) == (configs[2:], [])
    assert asked == configs[2:] and sorted((r.config_id, r.n) for r in side.rows().collect()) == sorted((c, len(c)) for c in configs)
    assert side.run(configs, lambda c: asked.append(c)) == ([], []) and asked == configs[2:]


def test_another_question_file_begins_anew(spark, tmp_path):
    sidecar(spark, tmp_path).run(["a", "b"], lambda c: summary(spark, c))
    for other in (sidecar(spark, tmp_path, n=5), sidecar(spark, tmp_path, "r.json")):
        assert other.done() == [] and other.rows().count() == 0
    other = sidecar(spark, tmp_path, n=5)
    assert other.run(["a"], lambda c: summary(spark, c)) == (["a"], [])
    assert sidecar(spark, tmp_path).done() == ["a", "b"] and other.done() == ["a"] and other.rows().count() == 1


def test_failures_are_noted_and_tried_again(spark, tmp_path):
    def measure(config_id):
        if config_id == "b":
            raise ValueError("no chunks")
        return summary(spark, config_id)

    side = sidecar(spark, tmp_path)
    assert side.run("abc", measure) == (["a", "c"], ["b"])
    assert [(r.config_id, r.error) for r in side.failures().collect()] == [("b", "ValueError: no chunks")]
    assert [r.config_id for r in sidecars.left(spark.createDataFrame([(c,) for c in "abcd"], "config_id string"), side.log(), "q.json", 4).orderBy("config_id").collect()] == ["b", "d"]
    side.report(str(tmp_path / "out"), corpus="texts")
    told = json.loads("".join(p.read_text() for p in (tmp_path / "out").glob("part-*")))
    assert told["corpus"] == "texts" and told["n_questions"] == 4 and [c["config_id"] for c in told["configs"]] == ["a", "c"] and told["configs"][0]["rows"] == [{"n": 1, "score": 0.5}] and told["failed"][0]["config_id"] == "b"
    assert side.run("abc", lambda c: summary(spark, c)) == (["b"], []) and side.failures().count() == 0


def test_spread_picks(spark):
    df = spark.createDataFrame([(f"c{k}", k / 10) for k in range(9)], "config_id string, mrr double")
    assert sidecars.spread_picks(df, "mrr", 3) == ["c8", "c4", "c0"] and sidecars.spread_picks(df, "mrr", 1) == ["c8"] and len(sidecars.spread_picks(df, "mrr", 50)) == 9
    assert sidecars.spread_picks(df.limit(0), "mrr", 3) == []
