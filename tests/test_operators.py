"""DataFrame operators against hand-computed cases."""

import json
import math

import pytest
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.operators import alignment, chunking, diagnosis, generation, metrics, postings, ranking, retrieval, study, truth
from spanforge.plans.experiment import GRID, Config, Experiment
from spanforge.sources import files
from spanforge.streaming import incremental

SPAN = "qid string, span_ix long, doc_id string, start long, end long"
RANK = "qid string, rank long, doc_id string, start long, end long"


def rows(df, *by):
    return [tuple(r) for r in (df.orderBy(*by) if by else df).collect()]


def test_fixed_windows_stop_at_the_first_that_reaches_the_end(spark):
    docs = spark.createDataFrame([("a", "x" * 10), ("b", ""), ("c", "   "), ("d", "😀" * 7), ("e", "y" * 4), ("f", "z" * 5)], "doc_id string, text string")
    got = rows(chunking.fixed_chunks(docs, 4, 1).select("doc_id", "start", "end"), "doc_id", "start")
    assert got == [("a", 0, 4), ("a", 3, 7), ("a", 6, 10), ("d", 0, 4), ("d", 3, 7), ("e", 0, 4), ("f", 0, 4), ("f", 3, 5)]
    assert chunking.invariant_violations(docs, chunking.fixed_chunks(docs, 4, 1)).count() == 0
    broken = spark.createDataFrame([("a", 0, 2, "xy"), ("zz", 0, 1, "x"), ("a", 3, 2, "")], "doc_id string, start long, end long, chunk_text string")
    assert chunking.invariant_violations(docs, broken).count() == 3
    cover = dict(rows(chunking.coverage(docs, spark.createDataFrame([("a", 0, 4), ("a", 2, 6), ("a", 2, 3), ("a", 8, 9)], "doc_id string, start long, end long"))))
    assert cover["a"] == 0.7 and cover["b"] == 1.0 and cover["e"] == 0.0
    with pytest.raises(ValueError):
        chunking.fixed_chunks(docs, 4, 4)
    with pytest.raises(ValueError):
        chunking.build_chunks(docs, "nope")


def test_sentences_agree_with_the_splitter_on_fences(spark):
    body = "One. Two!\n```\nx = 1. y\n```\nThree? Four."
    docs = spark.createDataFrame([("a", body), ("b", "No fence. Here."), ("c", "")], "doc_id string, text string")
    from spanforge.functions.splitters import sentence_spans

    got = rows(chunking.sentences(docs).select("doc_id", "start", "end"), "doc_id", "start")
    assert got == [("a", *s) for s in sentence_spans(body)] + [("b", *s) for s in sentence_spans("No fence. Here.")]


def test_heading_lines_in_sql(spark):
    docs = spark.createDataFrame([("a", "# A\ntext\n### B \n```\n# no\n```\n## C\n# D")], "doc_id string, text string")
    assert [(r.level, r.title, r.path) for r in chunking.heading_lines(docs).orderBy("start").collect()] == [(1, "A", "A"), (3, "B", "A > B"), (2, "C", "A > C"), (1, "D", "D")]


def test_overlap_scores(spark):
    chunks = spark.createDataFrame([("a", 0, 1000), ("a", 0, 100), ("a", 450, 600), ("b", 0, 100)], "doc_id string, start long, end long")
    t = spark.createDataFrame([("q", 0, "a", 400, 500), ("r", 0, "a", 100, 200)], SPAN)
    got = {(r.qid, r.start, r.end): (r.overlap_chars, r.coverage, r.precision, round(r.iou, 4)) for r in alignment.pair_scores(chunks, t).collect()}
    assert got == {("q", 0, 1000): (100, 1.0, 0.1, 0.1), ("q", 450, 600): (50, 0.5, round(50 / 150, 9), 0.25), ("r", 0, 1000): (100, 1.0, 0.1, 0.1)}  # touching and other documents share nothing
    reach = dict((q, b) for q, _, b in rows(alignment.reachability(chunks.where("start = 450"), t)))
    assert reach == {"q": 0.5, "r": 0.0}
    assert rows(alignment.ceiling(alignment.reachability(chunks, t), (0.5,))) == [(0.5, 2, 1.0)] and rows(alignment.ceiling(alignment.reachability(chunks, t.limit(0)), (0.5,))) == [(0.5, 0, 0.0)]


def ranked_fixture(spark):
    ranked = [("q1", 1, "a", 0, 100), ("q1", 2, "a", 400, 500), ("q2", 1, "a", 0, 100), ("q3", 1, "a", 0, 100), ("q3", 2, "a", 0, 100), ("q4", 1, "a", 450, 600), ("q5", 1, "a", 0, 100), ("q5", 2, "a", 900, 1200)]
    truths = [("q1", 0, "a", 400, 500), ("q2", 0, "a", 400, 500), ("q3", 0, "a", 0, 100), ("q3", 1, "a", 900, 1000), ("q4", 0, "a", 400, 500), ("q5", 0, "a", 0, 100), ("q5", 1, "a", 900, 1000)]
    return spark.createDataFrame(ranked, RANK), spark.createDataFrame(truths, SPAN)


def test_reductions_of_the_alignment(spark):
    ranked, t = ranked_fixture(spark)
    aligned = alignment.align(ranked, t)
    assert dict(rows(alignment.first_hits(aligned, 10, 0.5))) == {"q1": 2, "q2": None, "q3": 1, "q4": 1, "q5": 1}
    assert dict(rows(alignment.first_hits(aligned, 1, 0.5)))["q1"] is None and dict(rows(alignment.first_hits(aligned, 0, 0.5)))["q1"] == 2
    recall = {q: (r, s) for q, r, s in rows(alignment.span_recall(aligned, 10, 0.5))}
    assert recall["q3"] == (0.5, 0.5) and recall["q5"] == (1.0, 1.0) and recall["q4"] == (1.0, 0.5)
    assert {q: r for q, r, _ in rows(alignment.span_recall(aligned, 1, 0.5))}["q5"] == 0.5
    chars = dict(rows(alignment.chars_retrieved(ranked, 1)))
    assert chars["q5"] == 100 and dict(rows(alignment.chars_retrieved(ranked, None)))["q5"] == 400
    n = dict(rows(alignment.ndcg(aligned, 10)))
    assert n["q2"] == 0 and n["q5"] == 1.0 and math.isclose(n["q1"], 1 / math.log2(3), rel_tol=1e-8)


def test_questions_without_rows_count_in_every_reduction(spark):
    truths = spark.createDataFrame([("q", 0, "a", 0, 10), ("none", 0, "a", 0, 10), ("none", 1, "b", 5, 9)], "qid string, span_ix long, doc_id string, start long, end long")
    ranked = spark.createDataFrame([("q", 1, "a", 0, 10)], RANK)
    cell = metrics.metric_cube(ranked, truths, (5,), (0.5,)).first()
    assert (cell.n_questions, cell.unanswered, cell.hit_at_k, cell.mrr, cell.recall_at_k, cell.ndcg_at_k, cell.mean_chars_retrieved) == (2, 1, 0.5, 0.5, 0.5, 0.5, 5.0)
    aligned = alignment.align(ranked, truths)
    assert rows(alignment.first_hits(aligned, 5, 0.5), "qid") == [("none", None), ("q", 1)]
    assert rows(alignment.span_recall(aligned, 5, 0.5), "qid") == [("none", 0.0, 0.0), ("q", 1.0, 1.0)]
    assert rows(alignment.ndcg(aligned, 5), "qid") == [("none", 0.0), ("q", 1.0)]
    by = alignment.align(ranked.withColumn("c", F.lit("x")), truths, by=("c",))
    assert sorted({(r.c, r.qid) for r in by.collect()}) == [("x", "none"), ("x", "q")]


def test_metric_cube_is_consistent(spark):
    cube = {(r.k, r.tau): r for r in metrics.metric_cube(*ranked_fixture(spark)).collect()}
    assert len(cube) == 16 and all(r.n_questions == 5 for r in cube.values())
    assert cube[10, 0.5].hit_at_k == 0.8 and cube[10, 0.5].unanswered == 1 and math.isclose(cube[10, 0.5].mrr, (0.5 + 0 + 1 + 1 + 1) / 5)
    for tau in metrics.TAUS:
        assert all(cube[a, tau].hit_at_k <= cube[b, tau].hit_at_k for a, b in zip(metrics.KS, metrics.KS[1:]))
    for k in metrics.KS:
        assert all(cube[k, a].recall_at_k >= cube[k, b].recall_at_k for a, b in zip(metrics.TAUS, metrics.TAUS[1:]))


def test_bootstrap(spark):
    def interval(hits, misses):
        df = spark.createDataFrame([(k, float(k < hits)) for k in range(hits + misses)], "qid long, v double")
        return tuple(metrics.bootstrap(df, "v", iterations=300).select("point", "low", "high").first())

    p, lo, hi = interval(8, 4)
    assert lo <= p <= hi and lo < hi and interval(10, 0) == (1.0, 1.0, 1.0) and interval(8, 4) == (p, lo, hi)
    wide, narrow = interval(6, 6), interval(60, 60)
    assert narrow[2] - narrow[1] < wide[2] - wide[1]
    iv = spark.createDataFrame([("x", 0.3, 0.7), ("y", 0.4, 0.8), ("z", 0.85, 0.95)], "c string, low double, high double")
    assert {(r.a, r.b): r.tied for r in metrics.indistinguishable(iv, "c").collect()} == {("x", "y"): True, ("x", "z"): False, ("y", "z"): False}


def test_correlation_guards(spark):
    df = spark.createDataFrame([("up", float(k), 2.0 * k) for k in range(5)] + [("down", float(k), -k * 1.0) for k in range(5)] + [("flat", float(k), 1.0) for k in range(5)] + [("two", 1.0, 2.0), ("two", 2.0, 3.0)], "g string, x double, y double")
    assert {r.g: r.r for r in metrics.correlation(df, "x", "y", ("g",)).collect()} == {"up": 1.0, "down": -1.0, "flat": None, "two": None}


def test_bm25_by_hand(spark):
    chunks = spark.createDataFrame([("a", 0, 9, "red fox fox"), ("b", 0, 9, "red dog"), ("c", 0, 9, "blue cat end."), ("d", 0, 9, "red")], "doc_id string, start long, end long, chunk_text string")
    questions = spark.createDataFrame([("q", "Fox red"), ("none", "zebra")], "qid string, question string")
    got = rows(retrieval.bm25(chunks, questions, 3), "qid", "rank")
    n, avg = 4, (3 + 2 + 3 + 1) / 4
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in {"red": 3, "fox": 1, "dog": 1, "blue": 1, "cat": 1, "end.": 1}.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: floor if w < 0 else w for t, w in raw.items()}
    part = lambda t, tf, dl: idf[t] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    want = {"a": part("red", 1, 3) + part("fox", 2, 3), "b": part("red", 1, 2), "d": part("red", 1, 1)}
    assert [r[2] for r in got if r[0] == "q"] == ["a", "d", "b"] and all(math.isclose(r[5], want[r[2]], rel_tol=1e-7) for r in got if r[0] == "q")
    assert [(r[2], r[5]) for r in got if r[0] == "none"] == [("a", 0.0), ("b", 0.0), ("c", 0.0)]


@pytest.mark.parametrize("zero_fill", [True, False])
def test_bm25_over_many_matrices_and_over_an_index_ranks_alike(spark, monkeypatch, tmp_path, zero_fill):
    import random

    rng = random.Random(3)
    text = lambda n: " ".join(f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(n))
    chunks = spark.createDataFrame([(k // 3, 100 * (k % 3), 100 * (k % 3) + 50, text(rng.randrange(1, 30))) for k in range(150)], "doc_id long, start long, end long, chunk_text string")
    questions = spark.createDataFrame([(k, text(6)) for k in range(12)] + [(50, "nowhere at all"), (51, "w59 nowhere")], "qid long, question string")
    matrix = rows(retrieval.bm25(chunks, questions, 7, zero_fill), "qid", "rank")
    monkeypatch.setattr(retrieval, "MATRIX_BYTES", 2000)
    sliced = rows(retrieval.bm25(chunks, questions, 7, zero_fill), "qid", "rank")
    indexed = rows(postings.search(postings.write(chunks, f"{tmp_path}/index", width=16), questions, 7, zero_fill).ranked, "qid", "rank")
    for other in (sliced, indexed):
        assert [r[:5] for r in matrix] == [r[:5] for r in other] and all(math.isclose(a[5], b[5], abs_tol=2e-9) for a, b in zip(matrix, other, strict=True))


def test_fusion_and_rerank(spark):
    d = spark.createDataFrame([("q", 1, "a", 0, 1), ("q", 2, "b", 0, 1)], RANK)
    l = spark.createDataFrame([("q", 1, "b", 0, 1), ("q", 2, "c", 0, 1)], RANK)
    fused = rows(retrieval.fuse(d, l, 3), "rank")
    assert [r[2] for r in fused] == ["b", "a", "c"] and math.isclose(fused[0][5], 1 / 62 + 1 / 61, rel_tol=1e-7)
    chunks = spark.createDataFrame([("a", 0, 1, "x"), ("b", 0, 1, "x y"), ("c", 0, 1, "x y")], "doc_id string, start long, end long, chunk_text string")
    q = spark.createDataFrame([("q", "x y")], "qid string, question string")
    base = spark.createDataFrame([("q", 1, "a", 0, 1), ("q", 2, "c", 0, 1), ("q", 3, "b", 0, 1)], RANK)
    assert [r[2] for r in rows(retrieval.rerank(base, chunks, q, 3), "rank")] == ["c", "b", "a"] and retrieval.rerank(base.limit(0), chunks, q).count() == 0
    with pytest.raises(ValueError):
        retrieval.retrieve("nope", chunks, q)


def test_nearest_breaks_ties_by_id_and_takes_empty_sets(spark):
    v = spark.createDataFrame([(k, [1.0, 0.0] if k < 5 else [0.0, 1.0]) for k in range(8)], "vec_id long, vector array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, vector array<double>")
    assert [r[2] for r in rows(retrieval.nearest(v, q, 3), "rank")] == [0, 1, 2] and [r[2] for r in rows(retrieval.nearest(v, q, 3, exclude_self=True), "rank")] == [1, 2, 3]
    assert retrieval.nearest(v, q.limit(0), 3).count() == 0 and retrieval.nearest(v, q, 20).count() == 8


def items(spark, data):
    return spark.createDataFrame([(k, i, [dict(doc=d, quote=q, occurrence=o) for d, q, o in qs]) for k, (i, qs) in enumerate(data)], "item_ix long, item_id string, quotes array<struct<doc:string,quote:string,occurrence:int>>")


def test_quotes_resolve_or_are_rejected_in_order(spark):
    docs = spark.createDataFrame([("d", "abab abab xyz"), ("e", "aaa")], "doc_id string, text string")
    data = [("ok", [("d", "xyz", 0)]), ("dup", [("d", "nope", 0)]), ("dup", [("d", "xyz", 0)]), ("unknown", [("zz", "xyz", 0)]), ("amb", [("d", "abab", 0)]), ("second", [("d", "abab", 1)]), ("range", [("d", "abab", 9)]), ("over", [("e", "aa", 1)]), ("two", [("d", "xyz", 0), ("d", "none", 0)])]
    spans, rejected = truth.judged_items(items(spark, data), docs)
    assert rows(rejected.select("item_ix", "reason"), "item_ix") == [(1, "unresolved_quote"), (2, "duplicate_id"), (3, "unknown_doc"), (4, "ambiguous_quote"), (6, "unresolved_quote"), (8, "unresolved_quote")]
    assert sorted((r.item_id, r.start, r.end) for r in spans.collect()) == [("ok", 10, 13), ("over", 1, 3), ("second", 5, 9)]
    assert [r.item_id for r in truth.short_quotes(items(spark, [("s", [("d", "  short   ", 0)]), ("l", [("d", "x" * 25, 0)]), ("none", [])])).collect()] == ["s", "none"]


def test_quotes_are_located_anywhere(spark):
    docs = spark.createDataFrame([(1, "pre one two three four five six seven post"), (2, "xone two three four five six sevenx and more"), (3, "unrelated")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "one two three four five six seven"), (2, "related"), (3, "absent words that are long enough here")], "item_id long, quote string")
    assert sorted(rows(truth.locate_quotes(q, docs))) == [(1, 1, 4, 37), (1, 2, 1, 34), (2, 3, 2, 9)]


def test_passages_and_samples(spark):
    para = "A first sentence is here. Then a second one follows it closely. "
    body = "# Title\n\n" + para * 3 + "\n\n" + "```\ncode. code. Code\n```\n\n" + "\n\n* one\n* two\n* three and some more text to be long enough\n\n\n" + para * 2
    docs = spark.createDataFrame([("a", body), ("b", para * 3)], "doc_id string, text string")
    got = truth.passages(docs, 50, 400)
    assert got.count() == 2 and all(body[r.start : r.end] == r.passage for r in got.collect() if r.doc_id == "a") and not got.where("passage LIKE '%Title%' OR passage LIKE 'code%'").count()
    used = spark.createDataFrame([("b",)], "doc_id string")
    none = spark.createDataFrame([], "quote string")
    assert [r.doc_id for r in truth.sampled_passages(got, docs, used, none, 5).collect()] == ["a"]


def record(spark, data):
    return spark.createDataFrame(data, "qid string, rank long, reachable double, max_achievable double, best_coverage double, soft double")


def test_diagnosis_table(spark):
    data = [("a", None, 0.0, None, None, None), ("b", 1, 0.0, None, None, None), ("c", None, 1.0, 1.0, 0.0, 0.0), ("d", None, 1.0, 0.6, 0.0, 0.0), ("e", 1, 1.0, 0.6, 0.0, 0.0), ("f", None, 1.0, None, None, None), ("g", None, 1.0, 1.0, 0.0, 0.0), ("h", 4, 1.0, None, None, None), ("i", 1, None, None, None, None)]
    base = spark.createDataFrame([("c", None), ("g", 2)], "qid string, rank long")
    got = {r.qid: r.cause for r in diagnosis.diagnose(record(spark, data), base).collect()}
    assert got == dict(a="chunker_destroyed", b="chunker_destroyed", c="retriever_missed", d="chunker_degraded", e="ok", f="retriever_missed", g="reranker_demoted", h="ranked_low", i="chunker_destroyed")
    some = diagnosis.diagnose(record(spark, [("a", None, 0.0, None, None, None), ("b", 3, 1.0, 1.0, 1.0, 1.0), ("c", 2, 1.0, 1.0, 1.0, 1.0)]))
    assert diagnosis.recommended(some).first().action.startswith("1/3 questions: change chunking")
    assert diagnosis.recommended(diagnosis.diagnose(record(spark, [("a", 1, 1.0, 1.0, 1.0, 1.0)]))).first().action == ""
    assert {r.cause: r.n for r in diagnosis.summary(some).collect()}["ok"] == 0


def cands(spark):
    data = [("a", "fixed800/dense", "fixed", "800", "dense", None, 10, 0.8, 0.6, 0.6, 100.0, 1.0), ("b", "fixed800/dense+r", "fixed", "800", "dense", "rr", 10, 0.9, 0.7, 0.7, 100.0, 2000.0), ("c", "fixed300/dense", "fixed", "300", "dense", None, 30, 0.5, 0.3, 0.3, 50.0, 0.001), ("d", "fixed800/bm25", "fixed", "800", "bm25", None, 10, 0.4, 0.2, 0.2, 100.0, 5.0), ("e", "twin", "fixed", "800", "hybrid", None, 10, 0.8, 0.6, 0.6, 100.0, 1.0)]
    df = spark.createDataFrame(data, "config_id string, label string, chunker string, params string, retriever string, reranker string, n_chunks long, hit double, mrr double, ndcg double, chars double, latency_ms double")
    return df.withColumn("quality", ranking.quality())


def test_frontier_against_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    for points in (rng.integers(0, 6, (400, 3)).astype(float), rng.random((1500, 3)), np.stack([np.arange(700.0), -np.arange(700.0)], 1)):
        points = np.unique(points, axis=0)
        beaten = [((points >= p).all(1) & (points > p).any(1)).any() for p in points]
        assert sorted(ranking.frontier(points).tolist()) == np.flatnonzero(~np.array(beaten)).tolist()
    data = [(int(k), float(a), float(b), float(c)) for k, (a, b, c) in enumerate(rng.integers(0, 9, (300, 3)))]
    df = spark.createDataFrame([*data, (900, None, 1.0, 1.0)], "config_id long, quality double, latency_ms double, chars double")
    want = [k for k, q, t, c in data if not any(q2 >= q and t2 <= t and c2 <= c and (q2, t2, c2) != (q, t, c) for _, q2, t2, c2 in data)]
    assert sorted(r.config_id for r in ranking.pareto(df.repartition(5)).collect()) == [*want, 900]


def test_ranking(spark):
    df = cands(spark)
    assert sorted(r.config_id for r in ranking.pareto(df).collect()) == ["a", "b", "c", "e"]  # equal rows both stay
    scored = {r.config_id: r for r in ranking.weighted(df).collect()}
    assert sorted(r.position for r in scored.values()) == [1, 2, 3, 4, 5] and scored["d"].position == 5 and scored["a"].position + 1 == scored["e"].position
    assert ranking.weighted(df.where("config_id IN ('a', 'e')")).first().score == 1.0
    best = {r.axis: (r.config_id, r.delta) for r in ranking.best_varying(df, df.where("config_id = 'a'")).collect()}
    assert best == {"chunker": ("c", 0.3), "retriever": ("e", 0.0)}
    twin = ranking.reranker_twins(df).first()
    assert (twin.config_id, twin.twin_id) == ("b", "a") and math.isclose(twin.mrr_per_s, 100 / 1999, rel_tol=1e-6)
    lines = [r.line for r in ranking.explanation(df, df.where("config_id = 'a'"), spark.createDataFrame([("a", 0.9, 0.83)], "config_id string, tau double, reachable double")).orderBy("line_no").collect()]
    assert lines[0] == "RECOMMENDED: fixed800/dense" and any("WARNING" in x and "83.0%" in x for x in lines) and any("Rejected" in x for x in lines)
    picks = [r.config_id for r in ranking.spread_sample(df, 3, F.col("mrr").desc()).orderBy(F.col("mrr").desc()).collect()]
    assert picks[0] == "b" and picks[-1] == "d" and len(picks) == 3
    sky = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 2.0), (3, 6.0, 2.0), (4, 5.5, 3.0), (5, 5.0, 1.0)], "i long, hi double, lo double")
    assert sorted(r.i for r in ranking.skyline(sky, "hi", "lo").collect()) == [1, 3, 5]


def test_runs_latest_fingerprints_and_resume(spark, tmp_path):
    runs = spark.createDataFrame([("r1", "a", "t1", "f", "c", "q"), ("r2", "a", "t2", "f", "c", "q"), ("r3", "b", "t1", "f", "c", "q")], "run_id string, config_id string, run_ts string, corpus_fingerprint string, corpus string, qa_file string")
    files.save_run(runs, str(tmp_path / "runs"))
    back = files.load_runs(spark, str(tmp_path / "runs"))
    assert sorted(r.run_id for r in ranking.latest(back).collect()) == ["r2", "r3"]
    cells = spark.createDataFrame([("r2", "a", 5, 0.5, 0.9), ("r2", "a", 10, 0.5, 1.0)], "run_id string, config_id string, k long, tau double, hit double")
    assert {r.config_id: r.hit for r in ranking.candidates(back, cells, "q", "c").collect()} == {"a": 0.9, "b": None}  # a missing cell is null
    mixed = runs.withColumn("corpus_fingerprint", F.col("run_id"))
    with pytest.raises(Exception, match="fingerprints"):
        ranking.one_fingerprint(mixed).collect()
    assert [r.config_id for r in files.pending(spark.createDataFrame([("a",), ("z",)], "config_id string"), runs).collect()] == ["z"]


def test_manifests_are_known_by_their_shape(spark, tmp_path):
    m = {"config": {"id": "c1", "chunker": "fixed"}, "corpus_fingerprint": "f", "qa_file": "q", "corpus": "c", "metrics": {"k=5,tau=0.5": {"hit_at_k": 0.5, "mrr": 0.25}}}
    (tmp_path / "1.json").write_text(json.dumps(m))
    (tmp_path / "report.json").write_text(json.dumps({"rows": []}))
    got = files.load_manifests(spark, str(tmp_path))
    cells = files.manifest_cells(got)
    assert [(r.run_id, r.config_id, r.k, r.tau, r.hit, r.ndcg) for r in cells.collect()] == [("1.json", "c1", 5, 0.5, 0.5, None)]
    assert files.metric_at(cells, "hit", 10, 0.5).first().value is None and files.metric_at(cells, "hit", 5, 0.5).first().value == 0.5


def test_study(spark):
    chunks = spark.createDataFrame([("x", "a", 0, 100), ("x", "a", 100, 200), ("y", "a", 50, 150)], "author string, doc_id string, start long, end long")
    t = spark.createDataFrame([("q", 0, "a", 60, 120)], SPAN)
    gold = study.gold_chunks(chunks, t, ("author",))
    assert {(r.author, r.start) for r in gold.collect()} == {("x", 0), ("y", 50)}
    ranked = spark.createDataFrame([("x", "q", 1, "a", 0, 100), ("y", "q", 1, "a", 50, 150)], "config_id string, qid string, rank long, doc_id string, start long, end long")
    got = {(r.author, r.config_id): (r.naive_hit, r.aligned_hit) for r in study.rotation(ranked, gold, t).collect()}
    assert got == {("x", "x"): (1.0, 1.0), ("x", "y"): (0.0, 1.0), ("y", "x"): (0.0, 1.0), ("y", "y"): (1.0, 1.0)}
    bias = study.self_preference(study.rotation(ranked, gold, t), "config_id").collect()
    assert all(b.naive_bias == 1.0 and b.aligned_bias == 0.0 for b in bias)
    assert all(w.naive_winner == w.author and not w.agree or w.aligned_winner == "x" for w in study.winners(study.rotation(ranked, gold, t)).collect())


def test_answers(spark):
    df = spark.createDataFrame([("The Cat, sat!", "the cat sat"), ("dog", "the cat"), ("", "the cat"), ("alpha", "alpha beta gamma delta"), ("a a b", "a b b")], "answer string, gold string")
    got = [(round(r.token_f1, 4), round(r.gold_recall, 4)) for r in generation.overlap_columns(df).collect()]
    assert got == [(1.0, 1.0), (0.0, 0.0), (0.0, 0.0), (0.4, 0.25), (round(2 / 3, 4), round(2 / 3, 4))]
    said = spark.createDataFrame([(x,) for x in ("I don't know.", " ", "The text is INSUFFICIENT", "This is not in the context", "A plain answer", "Use the app")], "t string")
    assert [r[0] for r in said.select(T.is_refusal(F.col("t"))).collect()] == [True, True, True, True, False, False]


def test_judged_scores(spark):
    cases = [
        ('{"score": 0.4}', 0.4), ('{"any": {"score": 0.9}}', 0.9), ('[{"score": 0.9}]', 0.9), ('{"a": {"b": {"score": 0.9}}}', 0.9), ('{"a": [[{"score": 0.3}]]}', 0.3), ('{"a": {"b": {"c": {"score": 1}}}}', 1.0),
        ('{"a": {"b": {"c": {"d": {"score": 1}}}}}', None), ('{"a": {"score": 0.1}, "score": 0.2}', 0.2), ('{"a": {"score": null}, "b": {"score": 0.7}}', 0.7), ('{"score": null, "b": {"score": 0.7}}', None),
        ('{"score": 85}', 0.85), ('{"score": " 60% "}', 0.6), ('{"score": 5}', 1.0), ('{"score": -2}', 0.0), ('{"score": true}', 1.0), ('{"score": false}', 0.0), ('{"score": "high"}', None), ('{"score": {"x": 1}}', None),
        ('{"verdict": "good"}', None), ("no json", None), ("", None), (None, None), ('Sure: {"score": 0.5}. Done', 0.5), ("} {", None),
    ]
    got = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, p string").select("k", T.judged_score(F.col("p")).alias("s")).collect()
    assert {r.k: r.s for r in got} == {k: c[1] for k, c in enumerate(cases)}


def test_prompts_and_judges(spark):
    chunks = spark.createDataFrame([("a", 0, 5, " one "), ("b", 0, 5, "x" * 50), ("c", 0, 5, "two")], "doc_id string, start long, end long, chunk_text string")
    ranked = spark.createDataFrame([("q", 1, "a", 0, 5), ("q", 2, "b", 0, 5), ("q", 3, "c", 0, 5)], RANK)
    qs = spark.createDataFrame([("q", "Why?"), ("r", "How?")], "qid string, question string")
    got = {r.qid: (r.n_blocks, r.prompt) for r in generation.prompts(qs, ranked, chunks, 30).collect()}
    assert got["q"] == (1, "Context:\n[1] one\n\nQuestion: Why?\n\nAnswer:") and "(no context retrieved)" in got["r"][1]  # stops at the first that does not fit
    assert {r.qid: r.answer for r in generation.extractive_answers(ranked, chunks, qs).collect()} == {"q": "one", "r": ""}
    judged = generation.judge(spark.createDataFrame([("q", "p"), ("bad", "p2")], "qid string, prompt string"), "prompt", lambda ps: ['{"score":0.5}' if not p.startswith("p2") else "?" for p in ps], 2)
    assert {r.qid: (r.score, r.spread, r.failures) for r in judged.collect()} == {"q": (0.5, 0.0, 0), "bad": (None, None, 2)}


def test_summary_leaves_refusals_unjudged(spark):
    df = spark.createDataFrame([("c", "1", "fine", 1.0, 1.0, 1.0, 0.8, None), ("c", "2", "I don't know", 0.0, 0.0, 0.0, 0.9, 0.9)], "config_id string, qid string, answer string, token_f1 double, gold_recall double, span_grounding double, faithfulness double, relevance double")
    r = generation.generation_summary(df).first()
    assert (r.n, r.refusal_rate, r.faithfulness, r.n_judged, r.faithful_coverage, r.relevance, r.relevant_coverage) == (2, 0.5, 0.8, 1, 0.4, None, None)


def test_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_bytes("x\r\ny😀".encode())
    (tmp_path / "sub" / "b.md").write_bytes(b"z")
    docs = files.load_documents(spark, str(tmp_path))
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == [("a.md", "x\r\ny😀"), ("sub/b.md", "z")]
    assert files.fingerprint(docs).first().fingerprint == files.fingerprint(docs.repartition(3)).first().fingerprint
    assert files.wide_fingerprint(docs).first().fingerprint != files.wide_fingerprint(docs.where("doc_id = 'a.md'")).first().fingerprint
    with pytest.raises(Exception):
        files.load_documents(spark, str(tmp_path), "*.nothing")
    with pytest.raises(KeyError):
        files.load_corpus(spark, {}, "x")
    with pytest.raises(ValueError, match="sub/b.md|a.md"):
        files.load_documents(spark, str(tmp_path), most=3)
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "bad name.md").write_bytes(b"fine \xff\xfe")
    with pytest.raises(Exception, match="no UTF-8: .*bad(%20| )name.md"):
        files.load_documents(spark, str(tmp_path / "broken")).collect()
    (tmp_path / "qa.json").write_text(json.dumps([{"id": "1", "question": "Q", "answer": "A", "quotes": [{"doc": "a.md", "quote": "y"}]}]))
    q = files.load_questions(spark, str(tmp_path / "qa.json")).first()
    assert (q.item_id, q.quotes[0].quote, q.quotes[0].occurrence, q.tags) == ("1", "y", None, [])
    assert files.default_question_file(["b.json", "a_longspan.json", "a.json"]) == "a_longspan.json" and files.default_question_file(["b.json", "a.json"]) == "a.json"


def test_cache_and_streaming(spark, tmp_path):
    compute = lambda missing: missing.select("key", F.length("text").alias("value"))
    cache = spark.createDataFrame([], "key string, value int")
    texts = spark.createDataFrame([("a",), ("bb",), ("a",), (None,)], "text string")
    served, new = files.through_cache(texts, cache, "m", compute)
    assert new.count() == 2 and files.through_cache(texts, new, "m", compute)[1].count() == 0 and served.count() == 2
    source, root = str(tmp_path / "in"), str(tmp_path / "cache")
    for _ in range(2):  # the same texts again add nothing
        texts.where("text IS NOT NULL").write.mode("append").parquet(source)
        stream = spark.readStream.schema("text string").parquet(source)
        incremental.cache_new_texts(stream, root, "m", compute, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(root).count() == 2


def test_experiment_end_to_end(spark):
    body = "The red fox runs far away. It hides below the old tree. " * 8 + "The golden key lies under the third stone of the bridge. " + "Nothing else happens here at all. " * 8
    docs = spark.createDataFrame([("a", body), ("b", "Filler text about other things. " * 30)], "doc_id string, text string")
    quote = "golden key lies under the third stone"
    at = body.index(quote)
    run = Experiment(docs, spark.createDataFrame([("q", "golden key third stone")], "qid string, question string"), spark.createDataFrame([("q", 0, "a", at, at + len(quote))], SPAN))
    configs = (Config("fixed", {"size": 120, "overlap": 30}), Config("recursive", {"size": 120, "overlap": 0}, "hybrid"), Config("fixed", {"size": 120, "overlap": 30}, "bm25", True))
    cells = run.over(configs).metrics().where("k = 5 AND tau = 0.5").collect()
    assert {c.config_id for c in cells} == {"fixed_120_30_bm25", "recursive_120_0_hybrid", "fixed_120_30_bm25_rerank"} and all(c.hit_at_k == 1.0 for c in cells)
    assert run.records(configs[0]).first().rank == 1 and run.ceilings((0.5,)).count() == 2 and len(GRID) == 30


def test_manifests_are_written_read_and_ranked(spark, tmp_path):
    docs = spark.createDataFrame([("a", "The red fox runs. " + "Some other words stand here. " * 9), ("b", "A blue cat sleeps here. " + "Nothing of that is told. " * 9)], "doc_id string, text string")
    questions = spark.createDataFrame([("q1", "red fox"), ("q2", "blue cat")], "qid string, question string")
    spans_ = spark.createDataFrame([("q1", 0, "a", 4, 11), ("q2", 0, "b", 2, 10)], "qid string, span_ix long, doc_id string, start long, end long")
    run = Experiment(docs, questions, spans_, 5).over((Config("fixed", {"size": 60, "overlap": 10}, "bm25"),))
    assert len(run.timed(run.configs[0], 2)) == 2
    rows_ = run.manifests("c", "f.json", files.fingerprint(docs), (1, 5), (0.5,))
    files.save_manifests(rows_, str(tmp_path / "runs"))
    got = files.load_manifests(spark, str(tmp_path / "runs" / "*" / "*.json"))
    one = got.first()
    assert (one.config.id, one.config.chunker_params, one.corpus, one.qa_file) == ("fixed_60_10_bm25", {"size": "60", "overlap": "10"}, "c", "f.json")
    assert one.query_ms_p90 >= 0 and one.query_ms_mean > 0 and one.build_seconds >= 0 and one.oracle_reachability and set(one.per_question) == {"q1", "q2"}
    cells = {(r.k, r.tau): r.mrr for r in files.manifest_cells(got).collect()}
    assert cells == {(1, 0.5): 1.0, (5, 0.5): 1.0}


def test_replies_are_asked_for_once(spark):
    prompts = spark.createDataFrame([(1, 'say "a"'), (2, "b"), (3, "b"), (4, None)], "id long, prompt string")
    none = spark.createDataFrame([], "key string, reply string")
    call = lambda new: new.select("key", F.upper("prompt").alias("reply"))
    got, new = files.through_replies(prompts.where("prompt IS NOT NULL"), none, "m", call, temperature=0)
    assert {r.id: r.reply for r in got.collect()} == {1: 'SAY "A"', 2: "B", 3: "B"} and new.count() == 2
    import hashlib
    import json

    body = json.dumps({"model": "m", "prompt": 'say "a"', "temperature": 0}, sort_keys=True)
    assert hashlib.sha256(body.encode()).hexdigest() in {r.key for r in new.collect()}
    assert files.through_replies(prompts, new, "m", call, temperature=0)[1].where("reply IS NOT NULL").count() == 0


def test_queries_in_parts_find_the_same(spark, monkeypatch):
    v = spark.createDataFrame([(k, [float(k % 7), float(k % 5), 1.0]) for k in range(60)], "vec_id long, vector array<double>")
    q = v.where("vec_id < 20").withColumnRenamed("vec_id", "qid")
    want = rows(retrieval.nearest(v, q, 4), "qid", "rank")
    monkeypatch.setattr(retrieval, "HELD_BYTES", 100)
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 48)
    assert rows(retrieval.nearest(v, q, 4), "qid", "rank") == want


def test_private_characters_keep_offsets(spark):
    body = "A first sentence\uf8ff is here. Then a second one follows.\n\nB\uf8ff second paragraph is here. And it goes on a bit."
    docs = spark.createDataFrame([("a", body)], "doc_id string, text string")
    got = truth.passages(docs, 10, 400).collect()
    assert got and all(body[r.start : r.end] == r.passage for r in got)
    assert [(r.start, r.end) for r in chunking.sentences(docs).orderBy("sentence_ix").collect()][-1][1] == len(body)


def test_passages_exchange_no_text(spark):
    """Passages are one map, and a sample of counted ones exchanges keys only; odd white space, gaps and fences keep their places."""
    para = "A first sentence is here. Then a second one follows it closely. "
    odd = ["", " " + para * 2 + " ", "\x1c" + para * 2, "```\n" + para, para * 2, "~~~", "# " + para, " \t" + para * 2, para + "\n\n" + para]
    texts = ["\n \t\n".join(odd), "\n\n\n\n".join(odd[::-1]), para * 2 + "\n\n" + para * 2, "", "\n\n" + para * 3 + "\n"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(9, None)], "doc_id long, text string")
    got = truth.passages(docs, 100, 420, counted=True)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan(got) for x in ("Window", "Join", "Aggregate", "Generate", "Sort"))
    found = got.collect()
    assert found and all(texts[r.doc_id][r.start : r.end] == r.passage and texts[r.doc_id].count(r.passage) == r.times for r in found)
    spans = {(r.doc_id, r.start, r.end) for r in found}
    assert {(4, 2, 2 + len(para * 3) - 1), (2, 0, len(para * 2) - 1)} <= spans and any(r.passage[0] == "A" and texts[r.doc_id][r.start - 1] == " " for r in found)
    used, none = spark.createDataFrame([(4,)], "doc_id long"), spark.createDataFrame([], "quote string")
    sample = truth.sampled_passages(got, docs, used, none, 5)
    assert plan(sample).count("LeftAnti") == 2 and "Inner" not in plan(sample)
    plain = truth.sampled_passages(truth.passages(docs, 100, 420), docs, used, none, 5)
    assert sample.collect() == plain.collect() and {r.doc_id for r in plain.collect()} <= {0, 1, 2}
