"""Batch tokens, and a lexical ranking whose tasks give k rows a question however many chunks they read."""

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from spanforge.functions import lexical, splitters
from spanforge.functions import text as T
from spanforge.operators import retrieval, verbatim

ODD = ["", "a", "-_.", "--a-b", "A.b_C- d", "é1é", "x" * 50, "Ünï 語 a1", "end.", ".start", "a", "b\x00c", None, "same same SAME"]


def plain(text):
    return [t.lower() for t in re.findall(r"[A-Za-z0-9][A-Za-z0-9_\-.]*", text or "")]


def test_tokens_of_a_batch_are_those_of_each_text():
    found = lexical.Tokens(pa.array(["skip", *ODD])[1:])
    want = [(k, t) for k, x in enumerate(ODD) for t in plain(x)]
    got = [bytes(found.raw[a:b]).decode() for a, b in zip(found.start, found.end, strict=True)]
    assert list(zip(found.row.tolist(), got, strict=True)) == want
    assert found.dl.tolist() == [len(plain(x)) for x in ODD]
    assert found.h.tolist() == lexical.hash_of([t for _, t in want]).tolist()
    toks, n = found.counted()
    assert dict(zip(toks.to_pylist(), n.tolist(), strict=True)) == Counter(t for x in ODD for t in set(plain(x)))


def test_blank_is_as_the_java_pattern_says(spark):
    texts = ["", " ", "　\x85", "\x1c", " \x1f ", "a", "​"]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", T.has_content(F.col("t")).alias("c")).collect()
    assert [splitters.has_content(r.t) for r in rows] == [r.c for r in rows]


def test_a_task_gives_k_rows_a_question(spark):
    chunks = spark.range(5000, numPartitions=2).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.lit(9).cast("long").alias("end"), F.concat(F.lit("w "), F.repeat(F.lit("x "), (F.col("id") % 7).cast("int"))).alias("chunk_text"))
    wanted = spark.createDataFrame([("q", "x", 1, 1.5), ("p", "w", 1, 0.5)], "qid string, tok string, qtf long, idf double").collect()
    found = retrieval.slim(chunks).mapInArrow(retrieval._scorer(["p", "q"], wanted, pa.string(), 4.0, 3, True, 1.5, 0.75), "qid string, doc_id long, start long, end long, score double")
    assert found.count() == 2 * 2 * 3
    first = found.where("qid = 'q'").orderBy(F.desc("score"), "doc_id").limit(3)
    assert [r.doc_id for r in first.collect()] == [6, 13, 20]


def test_what_meets_by_fingerprint_are_ids(spark):
    """A window in many documents must not heap their texts up in one task."""
    docs = spark.createDataFrame([(k, f"{k} a sentence that stands in all of the documents {k}") for k in range(40)], "doc_id long, text string")
    quotes = spark.createDataFrame([("q", "a sentence that stands in all of the documents")], "item_id string, quote string")
    keep = verbatim.Filter.of(verbatim.windows(quotes).select("fp", "width"))
    assert verbatim.found_windows(docs, keep).columns == ["doc_id", "fp"]
    assert sorted(r.doc_id for r in verbatim.holding(quotes, docs).collect()) == list(range(40))


def test_index_blocks_come_packed():
    """No posting becomes a row on its way into the written index."""
    from spanforge.operators import postings

    batch = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array(["a b a", "a", "", "b", "a", "a a"])], ["cid", "body"])
    out = pa.Table.from_batches(postings._packer(2.0, 1.5, 0.75, 4)(iter([batch]))).to_pylist()
    got = {(r["tok"], r["range"]): (r["n"], r["at"], r["tf"], r["dl"]) for r in out}
    assert got == {("a", 0): (2, [0, 1], [2, 1], [3, 1]), ("a", 1): (2, [0, 1], [1, 2], [1, 2]), ("b", 0): (2, [0, 3], [1, 1], [3, 1])}


def test_sentences_of_many_texts_are_embedded_at_once():
    from spanforge.functions import splitters

    texts = ["One here. Two there! Three. " * k + "```\nx. y\n```\nEnd" for k in range(1, 30)] + ["", "word", "a. b", " \n"]
    calls = []

    def vectors(windows):
        calls.append(len(windows))
        return splitters.bag_vectors(windows)

    for buffer in (0, 1):
        alone = [splitters.semantic_spans(t, splitters.bag_vectors, 80.0, 120, 20, buffer) for t in texts]
        calls.clear()
        assert list(splitters.semantic_many(texts, vectors, 80.0, 120, 20, buffer)) == alone and any(alone)
        assert len(calls) == 1
    assert list(splitters.semantic_many([], vectors)) == []


def test_tokens_of_many_and_of_few_questions_score_the_same(monkeypatch):
    """Whichever tokens are columns of the product, and of one tf, length and weight the plain sum of the formula."""
    from types import SimpleNamespace as Row

    from spanforge.operators import retrieval

    bodies = [" ".join(f"t{j % 7}" for j in range(i, i + i % 9)) + (" rare" if i % 5 == 0 else "") for i in range(40)]
    ask = {q: {f"t{(q + j) % 7}": 0.5 + j - (q % 2) for j in range(3)} | ({"rare": 2.0} if q % 3 == 0 else {}) for q in range(6)}
    rows = [Row(qid=q, tok=t, qtf=1, idf=w) for q, own in ask.items() for t, w in own.items()]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64())] * 3 + [pa.array(bodies)], ["doc_id", "start", "end", "body"])
    want = {}
    for q, own in ask.items():
        for i, body in enumerate(bodies):
            toks = body.split()
            want[q, i] = (sum(w * toks.count(t) * 2.5 / (toks.count(t) + 1.5 * (0.25 + 0.75 * len(toks) / 4.0)) for t, w in own.items()), any(t in own for t in toks))
    for zero_fill in (True, False):
        for many in (-1, 2, 100):
            monkeypatch.setattr(retrieval, "MANY", many)
            got = pa.Table.from_batches(retrieval._scorer(list(ask), rows, pa.int64(), 4.0, 40, zero_fill, 1.5, 0.75)(iter([batch]))).to_pylist()
            assert {(r["qid"], r["doc_id"]) for r in got} == {x for x, (_, shared) in want.items() if shared or zero_fill}
            assert all(abs(r["score"] - want[r["qid"], r["doc_id"]][0]) < 2e-9 for r in got)


def test_vectors_of_texts_do_not_leave_the_task(spark):
    from spanforge.functions import splitters
    from spanforge.operators import retrieval

    chunks = spark.createDataFrame([(k, 0, 9, None if k == 3 else f"word{k % 4} and more {k}") for k in range(20)], "doc_id long, start long, end long, chunk_text string")
    questions = spark.createDataFrame([(1, "word1 more"), (2, "word2 and 7")], "qid long, question string")
    dense = retrieval.dense(chunks, questions, 3)
    assert "ArrowEvalPython" not in dense._jdf.queryExecution().optimizedPlan().toString()
    vectors = [splitters.bag_vectors([t])[0] for t in ("word1 more", "word2 and 7")]
    texts = {r.doc_id: r.chunk_text or "" for r in chunks.collect()}
    for qid, v in enumerate(vectors, 1):
        best = sorted((-round(float(v @ splitters.bag_vectors([t])[0]), 9), k) for k, t in texts.items())[:3]
        assert [r.doc_id for r in dense.where(f"qid = {qid}").orderBy("rank").collect()] == [k for _, k in best]
