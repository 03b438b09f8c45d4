"""Positions and running bests over ranges, and what an index skips."""

import random

from pyspark.sql import functions as F

from spanforge.operators import metrics, order, postings, retrieval


def test_positions_over_ranges(spark):
    rng = random.Random(0)
    rows = [(k, rng.choice([None, rng.randrange(50)]), "x") for k in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, v int, place string").repartition(7)
    got = order.with_positions(df, F.col("v").desc_nulls_last(), "id")
    assert got.columns == ["id", "v", "place", "position"] and "Window" not in got._jdf.queryExecution().toString()
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [(r.id, r.position) for r in got.orderBy("position").collect()] == [(r[0], k + 1) for k, r in enumerate(want)]
    assert order.with_positions(df.limit(0), "id").collect() == []
    assert [r.n for r in order.with_positions(df.limit(1), "id", out="n", first=0).collect()] == [0]


def test_best_before_over_ranges(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, rng.random()])) for k in range(1000)]
    got = {r.x: r.b for r in order.best_before(spark.createDataFrame(rows, "x long, y double").repartition(5), "x", "y", "b").collect()}
    best = None
    for x, y in rows:
        assert got[x] == best
        best = y if best is None else best if y is None else max(best, y)
    assert order.best_before(spark.createDataFrame([], "x long, y double"), "x", "y", "b").collect() == []


def chunks_of(spark, n, seed=0):
    """Text of common words, with rare ones in a few neighbouring chunks."""
    rng = random.Random(seed)
    body = lambda k: " ".join([f"c{rng.randrange(20)}" for _ in range(rng.randrange(5, 20))] + ([f"rare{k // 40}"] * 3 if k % 40 < 2 else []))
    return spark.createDataFrame([(k, 0, 100, body(k)) for k in range(n)], "doc_id long, start long, end long, chunk_text string")


def test_blocks_below_the_bar_are_skipped(spark, tmp_path):
    chunks = chunks_of(spark, 2000)
    questions = spark.createDataFrame([(q, f"rare{q} rare{q} c1 c2") for q in range(10)] + [(99, "c3"), (100, "nothing known")], "qid long, question string")
    index = postings.write(chunks, f"{tmp_path}/index", width=32)
    found = postings.search(index, questions, 2, first=1)
    want = [tuple(r) for r in retrieval.bm25(chunks, questions, 2).orderBy("qid", "rank").collect()]
    assert [tuple(r) for r in found.ranked.orderBy("qid", "rank").collect()] == want
    total, skipped = found.skipped()
    assert total > 600 and skipped > 0.8 * total
    again = postings.search(postings.opened(spark, f"{tmp_path}/index"), questions, 2)
    assert [tuple(r) for r in again.ranked.orderBy("qid", "rank").collect()] == want


def test_a_common_token_is_many_keys(spark, tmp_path):
    index = postings.write(chunks_of(spark, 2000), f"{tmp_path}/index", width=32)
    per = index.blocks.groupBy("tok").agg(F.count(F.lit(1)).alias("blocks"), F.max("n").alias("most")).where("tok = 'c1'").first()
    assert per.blocks > 50 and index.blocks.agg(F.max(F.size("at"))).first()[0] <= 32
    cids = [r.cid for r in index.chunks.orderBy("doc_id", "start").collect()]
    assert cids == list(range(2000))


def test_an_empty_index_and_no_questions(spark, tmp_path):
    chunks = chunks_of(spark, 30)
    none = spark.createDataFrame([], "qid long, question string")
    some = spark.createDataFrame([(1, "c1 rare0")], "qid long, question string")
    index = postings.write(chunks, f"{tmp_path}/some", width=8)
    assert postings.search(index, none).ranked.collect() == []
    empty = postings.write(chunks.limit(0), f"{tmp_path}/none")
    assert postings.search(empty, some).ranked.collect() == []


def test_poisson_intervals_are_those_of_resampling(spark):
    """On 400 values the ends are within a hundredth of the resampled ones; few values give the point; nulls are left out."""
    rng = random.Random(5)
    rows = [("a", k, rng.random()) for k in range(400)] + [("b", k, 0.25) for k in range(50)] + [("c", 1, 2.0), ("d", 1, None), ("a", 999, None)]
    df = spark.createDataFrame(rows, "config string, qid long, v double")
    got = {r.config: r for r in metrics.poisson_bootstrap(df, "v", ("config",), 1000, least=2).collect()}
    want = {r.config: r for r in metrics.bootstrap(df.where("v IS NOT NULL"), "v", ("config",), 1000, least=2).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"].n == 400 and got["a"].point == want["a"].point
    assert abs(got["a"].low - want["a"].low) < 0.01 and abs(got["a"].high - want["a"].high) < 0.01 and got["a"].low < got["a"].point < got["a"].high
    assert (got["b"].low, got["b"].high) == (0.25, 0.25) and (got["c"].low, got["c"].point, got["c"].high) == (2.0, 2.0, 2.0)
    whole = metrics.poisson_bootstrap(df.where("config = 'b'"), "v", iterations=7).first()
    assert (whole.n, whole.low) == (50, 0.25) and metrics.poisson_bootstrap(df.limit(0), "v", ("config",)).collect() == []


def test_poisson_parts_merge(spark):
    """However rows are dealt the result is the same, and one hot configuration is not one task's rows."""
    df = spark.range(3000).select(F.lit("a").alias("config"), F.col("id").alias("qid"), (F.col("id") % 7).cast("double").alias("v"))
    results = {tuple(metrics.poisson_bootstrap(df.repartition(n), "v", ("config",), 40).first()) for n in (1, 3, 8)}
    assert len(results) == 1


def test_a_range_hands_on_k_rows_a_question(spark, tmp_path, monkeypatch):
    """No pair of a posting and a question becomes a row, texts are not exchanged, and slices of questions and tokens score the same."""
    rows = [(n % 7, n, n + 1, " ".join(f"c{j}" for j in range(12) if (n * 31 + j * 17) % (j + 2) < 2)) for n in range(300)]
    chunks = spark.createDataFrame(rows, "doc_id long, start long, end long, chunk_text string").repartition(3)
    questions = spark.createDataFrame([(q, " ".join(f"c{(q + j) % 12}" for j in range(5))) for q in range(9)], "qid long, question string")
    index = postings.write(chunks, f"{tmp_path}/index", width=32)
    assert index.held.count() >= 10 and sorted(map(tuple, index.keys.select("doc_id", "start").collect())) == sorted((r[0], r[1]) for r in rows)
    found = postings.search(index, questions, 4, first=1)
    want = [tuple(r) for r in retrieval.bm25(chunks, questions, 4).orderBy("qid", "rank").collect()]
    assert [tuple(r) for r in found.ranked.orderBy("qid", "rank").collect()] == want
    asked, avgdl = postings._asked(index, questions), spark.read.parquet(f"{index.root}/about").first().avgdl
    scored = postings._scored(index, found.bounds.select("qid", "range"), asked, avgdl, 4)
    assert 0 < scored.count() <= 4 * found.bounds.count() < index.blocks.agg(F.sum("n")).first()[0]
    one = index.held.select("range").first()[0]
    blocks = index.blocks.where(F.col("range") == one).select("tok", "at", "tf", "dl", *[F.expr(f"cast(null as array<long>) as {c}") for c in ("doc_id", "start", "end")])
    blocks = blocks.unionByName(index.held.where(F.col("range") == one).selectExpr("cast(null as string) as tok", "cast(null as array<int>) as at", "cast(null as array<int>) as tf", "dl", "doc_id", "start", "end")).toArrow()
    own = asked.withColumn("w", F.col("w") - 1.0).groupBy("qid").agg(F.collect_list(F.struct("tok", "w")).alias("t")).selectExpr("qid", "t.tok as toks", "t.w as ws", "cast(null as double) as floor").toArrow()
    whole = postings._ranker(avgdl, 1.5, 0.75, 3)(blocks, own).to_pylist()
    monkeypatch.setattr(postings, "ASKED", 2)
    monkeypatch.setattr(postings, "TOKENS", 3)
    assert postings._ranker(avgdl, 1.5, 0.75, 3)(blocks, own).to_pylist() == whole and len(whole) == 27
